"""What the operators share: cutting lineage, size-checked broadcasts, and rules that go through a group's rows in order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side goes out as a broadcast only if its rows, counted, take at most this.
BROADCAST_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset a local session, as in tests, gets a temporary one; on a cluster executors would each write
    to a disk of their own, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tamis-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder: it is computed once, and a lost executor loses nothing of it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table, for rows of which later steps read some columns, or that go before the job ends."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows of at most row_bytes fit the limit; else as it is. df is counted, up to just past the limit."""
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def folded(rows: DataFrame, group: tuple[str, ...], schema: str, rule: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """What rule() makes of each group's rows, for rules in which a row's share depends on the ones before it.

    For a group's strata or clusters, not for samples: one task goes through them, in time that grows with their number.
    """
    if group:
        return rows.groupBy(*group).applyInPandas(rule, schema)
    return rows.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(lambda g: rule(g.drop(columns="__all")), schema)
