"""Line dedup with DataFrame functions only.

Lines are exploded, normalised, hashed to 128 bits and counted by distinct documents. Lines whose key is long
enough and stands in min_docs documents or more go, except in the largest document id that holds the key;
the rest are put together again by position.

The counts hold one row for each key and document at most and are combined before they are shuffled, so a
line of a third of all documents is no hot spot; where lines meet the repeated ones, common lines are dealt in
parts. Hashes and positions are written once, without the texts; what is dropped from a text is a list of
positions, joined to it in one shuffle.

Null and empty texts are one empty line. Rows with a null id are one document, smaller than all others. Rows
with the same id are one document for the counts, and each keeps its own text; if they tie for the largest id of a
line, all keep it. Very long texts take time in proportion to their lines. An empty table gives an empty result.
Other columns pass through under their names; earlier columns of the outputs' names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.runtime import ascii_lower, broadcast_if_small, join_in_parts, written

#: The characters stripped at both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
LEAST_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line stripped at both ends, with A-Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(STRIPPED)))


def key_hash(key: Column) -> Column:
    """128 bits: XXH64 under two seeds."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def _row_key(text: Column, doc_id: Column) -> list[Column]:
    """What tells rows apart: the id, and 128 bits of the text."""
    return [F.coalesce(doc_id.cast("long"), F.lit(LEAST_ID)).alias("__doc"), F.xxhash64(text).alias("__ta"), F.xxhash64(F.lit(1), text).alias("__tb")]


def hashed_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20) -> DataFrame:
    """__doc, __ta, __tb, pos, a, b: one row for each line with a key that counts."""
    keyed = df.select(*_row_key(F.col(text), F.col(doc_id)), F.split(F.col(text), "\n").alias("lines"))  # once a text, not with each of its lines
    rows = keyed.select("__doc", "__ta", "__tb", F.posexplode("lines").alias("pos", "line"))
    keys = rows.select("__doc", "__ta", "__tb", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("__doc", "__ta", "__tb", "pos", key_hash(F.col("key")).alias("h")).select("__doc", "__ta", "__tb", "pos", "h.a", "h.b")


def repeated_lines(lines: DataFrame, min_docs: int = 3) -> DataFrame:
    """a, b, n_docs, last: the hashes of the keys over the threshold, and the largest document that holds each."""
    return lines.groupBy("a", "b").agg(F.countDistinct("__doc").alias("n_docs"), F.max("__doc").alias("last")).where(F.col("n_docs") >= min_docs)


def line_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3, kept: str = "kept") -> DataFrame:
    """df with the text that is left, n_lines before and n_dropped."""
    lines = written(hashed_lines(df, text, doc_id, min_chars))
    repeated = broadcast_if_small(written(repeated_lines(lines, min_docs).select(F.col("a").alias("__a"), F.col("b").alias("__b"), "last")), 24)
    hits = join_in_parts(lines, repeated, {"a": "__a", "b": "__b"}, "inner").where(F.col("__doc") != F.col("last"))
    drops = hits.groupBy("__doc", "__ta", "__tb").agg(F.collect_set("pos").alias("__drops"))
    names = [c for c in df.columns if c not in (kept, "n_lines", "n_dropped")]
    rows = df.select(*(F.col(c) for c in names), F.coalesce(F.col(text), F.lit("")).alias("__text"), *_row_key(F.col(text), F.col(doc_id)))
    # texts too short for a key drop nothing: a key of its own for each keeps empty ones of null ids from meeting in one task
    short = F.length("__text") < min_chars
    rows = rows.withColumns({"__doc": F.when(~short, F.col("__doc")), "__ta": F.when(short, F.monotonically_increasing_id()).otherwise(F.col("__ta"))})
    joined = rows.join(drops, ["__doc", "__ta", "__tb"], "left")
    joined = joined.withColumn("__lines", F.when(F.col("__drops").isNotNull(), F.split("__text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drops")  # by a hash set, in order
    return joined.select(
        *names,
        F.when(F.col("__drops").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")).alias(kept),
        (F.length("__text") - F.length(F.replace("__text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
