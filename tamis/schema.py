"""Schemas of the tables, and checks that a table fits one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
SAMPLES = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("conversations", T.ArrayType(TURN)),
        T.StructField("prompt", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)
TOKEN_LOSSES = T.StructType([T.StructField("ckpt", T.IntegerType()), T.StructField("sample_id", T.LongType()), T.StructField("losses", T.ArrayType(T.FloatType()))])
LOSSES = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("ckpt", T.IntegerType()), T.StructField("window", T.StringType()), T.StructField("loss", T.DoubleType())])
EMBEDDINGS = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
SUBSET = T.StructType([T.StructField("sample_id", T.LongType())])
OPTION = T.StructType([T.StructField("letter", T.StringType()), T.StructField("text", T.StringType())])
EVAL_ITEMS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("options", T.ArrayType(OPTION)),
        T.StructField("answer_idx", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)
PARAMS = T.StructType([T.StructField("model", T.StringType()), T.StructField("name", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("value", T.FloatType())])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns; both domain and source are asked for where strata matter."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
