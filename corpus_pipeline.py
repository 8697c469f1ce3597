"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All stages but the last return the columns of documents.

Quality rules drop the documents they reject. Line dedup replaces each text by what is left of it. Of each
group of near duplicates (five-word shingles, similarity 0.8 or more) the document of the smallest id stays,
and of rows with the same id and fingerprint all. Documents with words of a benchmark window go. The last
stage encodes the texts and decodes them again.

In every stage a null text counts as empty, an empty table gives an empty one, rows that repeat or share an id are
judged row by row with their own texts, and other columns pass through whatever their names. A row with a null id is
a document: it has the smallest id for line dedup, and near-duplicate removal lets it stay and never drops others
for it. Ties go to the smallest id. Very long texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import byte_bpe, decontaminate, line_dedup, quality, simhash
from tamis.llm.runtime import remove, scratch_path, table


USED = ("doc_id", "text")


def apart(docs: DataFrame) -> DataFrame:
    """docs with the columns that operators don't use under names that none of theirs can clash with."""
    return docs.select(*(F.col(c) if c in USED else F.col(c).alias(f"__own{i}") for i, c in enumerate(docs.columns)))


def back(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from what apart() made of them."""
    return made.select(*(F.col(c) if c in USED else F.col(f"__own{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return back(quality.judge(apart(docs)).where("kept"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars follows the text."""
    deduped = back(line_dedup.line_dedup(apart(docs)).withColumn("text", F.col("kept")), docs)
    if "n_chars" in docs.columns:
        deduped = deduped.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return deduped


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return back(simhash.one_of_each(apart(docs), words=5, similarity=0.8), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any window of a benchmark item."""
    judged = decontaminate.decontaminate(apart(docs), table(spark, sf_dir, "benchmark"))
    return back(judged.where("NOT contaminated"), docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and whether they decode to it."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = byte_bpe.encode_and_decode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", token_stage),
]

#: Estimated label models, fingerprints and tokens aren't expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what is between them is written to the shared folder, until the next stage has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
