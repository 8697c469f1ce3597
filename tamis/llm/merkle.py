"""A Merkle manifest of a dataset: every row a leaf, every group of rows a tree, the groups' roots a tree of their own.

A node's digest is the SHA-256, in lowercase hexadecimal, of the digests below it. Every FANOUT consecutive nodes
become one, the last run of a level with fewer, until one is left. Rows stand in their group by the order columns, then
by digest, nulls first; groups by name, a null one first.

Superblocks: a level's nodes are bucketed by their place divided by FANOUT ** LEVELS, and a task collapses that many
levels of a bucket at once, so it holds FANOUT ** LEVELS digests however large the group. The buckets' roots are reduced
the same way until each group has one. Proofs go back down: a bucket's rows meet the path of the bucket's root, and the
siblings below it are put before it. Places come from a range partitioning with counts added up over the partitions, so a
group of any size is spread over all tasks.

A null field is a `-`; an empty text isn't null. A group of one row is its own root, with no siblings. Repeated rows are leaves
of their own, side by side. Very long texts are hashed whole. An empty table has no rows, no groups and no root. Other
columns pass through whatever their names; the names of the outputs (GIVEN) are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.llm.runtime import broadcast_if_small, written
from tamis.sources.io import folder_names

FANOUT, LEVELS = 16, 3
#: The columns that a manifest adds to the rows.
GIVEN = ("subroot", "root", "left", "right")
#: What a row of places takes in a broadcast, besides the group's name.
PLACE_BYTES = 512


def field(value: Column) -> Column:
    """A value as part of a leaf: its length in bytes, a colon and the value; `-` if null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def joined(digests: list[bytes]) -> bytes:
    """The digest over some digests."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def collapsed(digests: list[bytes], levels: int, fanout: int) -> list[list[bytes]]:
    """The nodes of a bucket by level, from the given ones up."""
    found = [digests]
    for _ in range(levels):
        below = found[-1]
        found.append([joined(below[at : at + fanout]) for at in range(0, len(below), fanout)])
    return found


def levels_above(n: Column, fanout: int) -> Column:
    """How many levels it takes until one of n nodes is left."""
    powers = F.array(*(F.lit(fanout**i).cast("long") for i in range(int(np.log(2.0**62) / np.log(fanout)) + 1)))
    return F.size(F.filter(powers, lambda p: p < n))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with __place, their place in the group by some columns, and __n, the group's rows; written once."""
    part, local = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = written(spread.withColumn("__at", F.monotonically_increasing_id()))
    counts = rows.groupBy(F.col(group).alias("__g"), part.alias("__p")).agg(F.count("*").alias("__c"), F.min(local).alias("__first"))
    by = Window.partitionBy("__g")  # a row for each partition that has rows of the group
    before = F.coalesce(F.sum("__c").over(by.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__g", "__p", (before - F.col("__first")).alias("__shift"), F.sum("__c").over(by).alias("__n"))
    met = rows.join(broadcast_if_small(written(counts), PLACE_BYTES), (part == F.col("__p")) & (F.col(group) == F.col("__g")))
    return met.withColumn("__place", local + F.col("__shift")).drop("__at", "__g", "__p", "__shift")


def bucketed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes with their bucket and the levels that are collapsed there."""
    return nodes.select("*", F.expr(f"__place div {fanout**levels}").alias("__bucket"), F.least(F.lit(levels), levels_above(F.col("__n"), fanout)).alias("__steps"))


def reduced(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The buckets' roots as nodes: __group, __place, __n, __digest."""

    def collapse(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("__place")
        first = bucket.iloc[0]
        root = collapsed(bucket["__digest"].tolist(), int(first["__steps"]), fanout)[-1][0]
        return pd.DataFrame({"__group": [first["__group"]], "__place": [first["__bucket"]], "__n": [-(-int(first["__n"]) // fanout**levels)], "__digest": [root]})

    few = bucketed(nodes, fanout, levels).select("__group", "__place", "__n", "__digest", "__bucket", "__steps")
    return few.groupBy("__group", "__bucket").applyInPandas(collapse, "__group string, __place long, __n long, __digest binary")


def reduced_to_one(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The tables of nodes from the given one up to that of the groups' roots; their number grows with the logarithm of the largest group."""
    found, most = [nodes], nodes.agg(F.max("__n")).first()[0] or 1
    while most > 1:
        found.append(written(reduced(found[-1], fanout, levels)))
        most = -(-most // fanout**levels)
    return found


def siblings(digests: list[bytes], steps: int, fanout: int) -> tuple[list[list[bytes]], list[list[bytes]]]:
    """For each node of a bucket the digests left and right of it in its run, joined, level by level."""
    runs = [[b"".join(nodes[at : at + fanout]) for at in range(0, len(nodes), fanout)] for nodes in collapsed(digests, steps, fanout)[:-1]]
    width = len(digests[0])
    left, right = [], []
    for place in range(len(digests)):
        before, after = [], []
        for level in runs:
            run, at = level[place // fanout], place % fanout * width
            before.append(run[:at])
            after.append(run[at + width :])
            place //= fanout
        left.append(before)
        right.append(after)
    return left, right


def with_paths(nodes: DataFrame, above: DataFrame, passed: list[str], fanout: int, levels: int) -> DataFrame:
    """nodes with left and right, their siblings level by level: those in their bucket, then those of the bucket's root; passed columns of the root's row come along."""
    kept = [f for f in nodes.schema.fields if f.name not in GIVEN]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + "".join(f", {c} binary" for c in passed) + ", left array<binary>, right array<binary>"
    names = [*(f.name for f in kept), *passed, "left", "right"]

    def meet(rows: pa.Table, roots: pa.Table) -> pa.Table:
        rows, root = rows.sort_by("__place"), roots.to_pylist()[0]
        sides = siblings(rows["__digest"].to_pylist(), rows["__steps"][0].as_py(), fanout)
        paths = [pa.array([x + root[side] for x in own], pa.list_(pa.binary())) for own, side in zip(sides, ("left", "right"), strict=True)]
        return pa.Table.from_arrays([*(rows[f.name] for f in kept), *(pa.repeat(pa.scalar(root[c], pa.binary()), len(rows)) for c in passed), *paths], names)

    own = bucketed(nodes, fanout, levels).groupBy("__group", "__bucket")
    return own.cogroup(above.select("__group", "__place", "left", "right", *passed).groupBy("__group", "__place")).applyInArrow(meet, schema)


@dataclass
class Manifest:
    """The levels of the groups' trees (rows first, subroots last) and of the tree above them (subroots first, root last)."""

    levels: list[DataFrame]
    forest: list[DataFrame]
    digest: str
    fanout: int
    per_task: int

    @property
    def root(self) -> str | None:
        """The dataset's digest; None if it has no rows."""
        row = self.forest[-1].first()
        return row["__digest"].hex() if row else None

    def subroots(self) -> DataFrame:
        """group_name (null for the null group), subroot, rows."""
        sizes = self.levels[0].groupBy("__group").agg(F.count("*").alias("rows"))
        return self.levels[-1].join(sizes, "__group").select(_name("__group").alias("group_name"), F.lower(F.hex("__digest")).alias("subroot"), "rows")

    def proofs(self) -> DataFrame:
        """The rows with subroot, root, and left and right: the digests before and after the row's node in its run, level by level up to the root."""
        down = partial(with_paths, fanout=self.fanout, levels=self.per_task)
        empty = F.array().cast("array<binary>")
        above = self.forest[-1].select("*", F.col("__digest").alias("root"), empty.alias("left"), empty.alias("right"))
        for nodes in reversed(self.forest[:-1]):
            above = down(nodes, above, ["root"])
        subroots = above.select(F.col("__name").alias("__group"), F.col("__digest").alias("subroot"), "root", "left", "right")
        if len(self.levels) == 1:  # every group has one row
            above = self.levels[0].join(subroots, "__group")
        else:
            above = subroots.withColumn("__place", F.lit(0).cast("long"))
        for nodes in reversed(self.levels[:-1]):
            above = down(nodes, above, ["subroot", "root"])
        hexed = [F.lower(F.hex(c)).alias(c) for c in ("subroot", "root")]
        own = [c for c in self.levels[0].columns if not c.startswith("__") and c not in GIVEN and c != self.digest]
        return above.select(*own, F.lower(F.hex("__digest")).alias(self.digest), *hexed, "left", "right")


def _key(group: Column) -> Column:
    """A group's name that isn't null and keeps the order, null first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def _name(key: str) -> Column:
    return F.when(F.col(key) != "", F.substring(F.col(key), F.lit(2), F.length(key)))


def build(rows: DataFrame, group: str, order: list[str], digest: str = "leaf", fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The manifest of rows with their leaf digests: by group, in the order of some columns, then of digests."""
    nodes = rows.withColumn("__group", _key(F.col(group))).withColumn("__digest", F.unhex(digest)).drop(digest)
    tables = reduced_to_one(placed(nodes, "__group", [*order, "__digest"]).drop(*GIVEN), fanout, levels)
    tops = tables[-1].select(F.lit("").alias("__group"), F.col("__group").alias("__name"), "__digest")
    return Manifest(tables, reduced_to_one(placed(tops, "__group", ["__name"]), fanout, levels), digest, fanout, levels)


def folded(digest: Column, left: Column, right: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    level = lambda at, x: F.sha2(F.concat(F.lower(F.hex(x["left"])), at, F.lower(F.hex(x["right"]))), 256)
    return F.aggregate(F.arrays_zip(left.alias("left"), right.alias("right")), digest, level)


def proof_digest(left: Column, right: Column) -> Column:
    """The digest over all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.lower(F.hex(F.concat(a, b)))), ""), 256)


def write(manifest: Manifest, folder: str) -> None:
    """The manifest's digests as tables below a folder that must not exist yet: rows, the levels of nodes, and the upper tree."""
    for name, tables in (("level", manifest.levels), ("forest", manifest.forest)):
        for n, nodes in enumerate(tables):
            own = ["__name"] if "__name" in nodes.columns else []
            nodes.select("__group", "__place", "__n", "__digest", *own).write.mode("errorifexists").parquet(f"{folder}/{name}{n}")


def changed(spark: SparkSession, before: str, after: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """group_name, place: the leaves in which two written manifests differ, on either side.

    Only buckets whose roots differ are looked into: from the subroots down, level by level.
    """
    count = _levels_in(spark, before), _levels_in(spark, after)
    wanted = None
    for n in reversed(range(max(count))):
        sides = [spark.read.parquet(f"{folder}/level{min(n, c - 1)}").select("__group", "__place", "__digest", "__n") for folder, c in zip((before, after), count, strict=True)]
        if n >= min(count):  # one side has fewer levels here, so all of it is looked into further down
            continue
        if wanted is not None:
            sides = [s.join(wanted, (s["__group"] == wanted["__g"]) & (F.expr(f"__place div {fanout**levels}") == wanted["__b"]), "left_semi") for s in sides]
        a, b = (s.select("__group", "__place", F.col("__digest").alias(x)) for s, x in zip(sides, ("__x", "__y"), strict=True))
        differ = a.join(b, ["__group", "__place"], "full").where(~F.col("__x").eqNullSafe(F.col("__y")))
        wanted = written(differ.select(F.col("__group").alias("__g"), F.col("__place").alias("__b")))
    return wanted.select(_name("__g").alias("group_name"), F.col("__b").alias("place"))


def _levels_in(spark: SparkSession, folder: str) -> int:
    return sum(name.startswith("level") for name in folder_names(spark, folder))

