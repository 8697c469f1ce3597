"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised to a few bits each, in the order of their values; rows are ordered by the
index of their cell on the Hilbert curve and cut into runs of equal row counts, so that a file's range of every
dimension is narrow and readers can skip files.

Ranks are exact without a global sort in one task: rows are counted by cell (their number is bounded by the
bits, not by the data), cells of many rows are split by a hash into parts of a few thousandths of all rows at
most, parts are ordered by cell and hash, and rows get their numbers within their part. A cell of a third of
all rows becomes many parts, and the number of parts is bounded.

Rows of a group (equal texts, say) take the dimensions of the group's first row and follow each other without a gap,
so a group is in one shard unless a cut falls into it or it is larger than a shard. A group of more rows than a part
is split by a hash of its rows, its parts standing side by side.

Dimensions that are null fall into cell 0 of their dimension, and so do empty texts; very long ones count by their
size alone. Rows that agree in all tie columns are interchangeable. An empty table gives an empty result. Other
columns pass through whatever their names; earlier columns of the outputs' names are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.runtime import broadcast_if_small, join_in_parts, written

LEAST_PART_ROWS, MOST_SPLITS = 1_000, 4_096
#: Up to so many different values are ranked exactly; of more, cells are cut between values by rows, near enough.
MOST_VALUES = 4_096


def category(column: Column, bits: int) -> Column:
    """A cell number for a value without order."""
    return F.coalesce(F.pmod(F.xxhash64(column), F.lit(1 << bits)).cast("int"), F.lit(0))


def cuts(df: DataFrame, column: str, bits: int) -> list[str]:
    """The largest value of every cell but the last, for cells of about as many rows, or of one value each if these are few.

    The values and their rows are counted in Spark; beyond MOST_VALUES those of the first bytes, as a number, are cut
    at its approximate quantiles.
    """
    cells = 1 << bits
    counts = written(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")))
    if counts.limit(MOST_VALUES + 1).count() <= MOST_VALUES:
        held = sorted(((r["v"].encode(), r["n"]) for r in counts.collect()), key=lambda x: x[0])
        if len(held) <= cells:
            return [v.decode() for v, _ in held[:-1]]
        total, before, found = sum(n for _, n in held), 0, []
        for value, n in held[:-1]:
            before += n
            if before * cells >= total * (len(found) + 1):
                found.append(value.decode())
        return found[: cells - 1]
    number = F.conv(F.hex(F.rpad(F.substring(F.col("v").cast("binary"), 1, 7), 7, F.unhex(F.lit("00")))), 16, 10).cast("long")
    marks = counts.select(number.alias("x"), "v", "n").agg(F.percentile_approx("x", [i / cells for i in range(1, cells)], F.lit(10_000)).alias("q")).first()["q"]
    least = counts.select(number.alias("x"), "v").groupBy("x").agg(F.max("v").alias("v")).where(F.col("x").isin(sorted(set(marks))))
    return sorted((r["v"] for r in least.collect()), key=str.encode)


def ordered(column: str, limits: list[str]) -> Column:
    """A cell number that grows with the value: how many of the cuts are below it."""
    if not limits:
        return F.lit(0)
    below = (F.when(F.col(column) > F.lit(limit), 1).otherwise(0) for limit in limits)
    return F.coalesce(reduce(lambda a, b: a + b, below), F.lit(0))


def with_group_rows(df: DataFrame, group: str, columns: list[str], tie: list[str]) -> DataFrame:
    """df with the columns of each group's first row by tie; the groups of several rows are few, and are met in parts."""
    first = F.min_by(F.struct(*columns), F.struct(*tie))
    groups = written(df.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("n"), first.alias("__first")).where("n > 1").drop("n"))
    met = join_in_parts(df, broadcast_if_small(groups, 256), {group: "__group"})
    own = {c: F.when(F.col("__first").isNull(), F.col(c)).otherwise(F.col("__first")[c]).alias(c) for c in columns}
    return met.select(*(own.get(c, F.col(c)) for c in df.columns))


def logarithmic(column: Column, bits: int, largest: float) -> Column:
    """A cell number for a size: equal ratios in equal cells, up to the largest size told apart."""
    top = (1 << bits) - 1
    cell = F.floor(F.log(F.greatest(F.coalesce(column, F.lit(1)), F.lit(1)).cast("double")) * (top / math.log(largest)))
    return F.least(F.greatest(cell, F.lit(0)), F.lit(top)).cast("int")


def with_curve(df: DataFrame, dims: list[Column], bits: int, name: str = "curve") -> DataFrame:
    """df with the place of each row's cell on the Hilbert curve, by transposed Gray codes (Skilling 2004).

    The steps are columns of their own, each used several times, so that none is evaluated twice.
    """
    n = len(dims)
    steps = F.array(*(F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))

    def undo(x: Column, step: Column) -> Column:
        """One excess turn taken back: invert axis 0, or swap low bits of axes 0 and i."""
        q, own, zero = step["q"], F.get(x, step["i"]), F.get(x, F.lit(0))
        low = q - 1
        swap = own.bitwiseXOR(zero).bitwiseAND(low)
        turned = lambda v, j: F.when(own.bitwiseAND(q) != 0, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).when((j == 0) | (j == step["i"]), v.bitwiseXOR(swap)).otherwise(v)
        return F.when((own.bitwiseAND(q) == 0) & (step["i"] == 0), x).otherwise(F.transform(x, turned))

    long_zero = F.lit(0).cast("long")
    points = F.array(*(d.cast("long") for d in dims))
    rows = df.select("*", (F.aggregate(steps, points, undo) if bits > 1 else points).alias("__turned"))
    axes = [F.get("__turned", F.lit(i)) for i in range(n)]
    rows = rows.select("*", *(reduce(lambda a, b: a.bitwiseXOR(b), axes[: i + 1]).alias(f"__x{i}") for i in range(n)))
    last = F.col(f"__x{n - 1}")
    flips = (F.when(last.bitwiseAND(F.lit(1 << b).cast("long")) != 0, F.lit((1 << b) - 1).cast("long")).otherwise(long_zero) for b in range(1, bits))
    rows = rows.select("*", reduce(lambda a, b: a.bitwiseXOR(b), flips, long_zero).alias("__parity"))
    places = [(i, b) for b in range(bits - 1, -1, -1) for i in range(n)]
    bit = lambda i, b: F.shiftright(F.col(f"__x{i}").bitwiseXOR(F.col("__parity")), b).bitwiseAND(F.lit(1).cast("long"))
    index = reduce(lambda a, b: a + b, (F.shiftleft(bit(i, b), len(places) - 1 - k) for k, (i, b) in enumerate(places)), long_zero)
    return rows.select("*", index.alias(name)).drop("__turned", "__parity", *(f"__x{i}" for i in range(n)))


def assign(df: DataFrame, dims: list[Column], shards: int, bits: int, tie: list[Column], group: Column | None = None) -> DataFrame:
    """df with curve, shard and slot: counts differ by one at most, slots are gapless from 0 along the curve.

    group: a 64-bit number; rows that share it should share their dims, and stand together. Else tie orders the rows of a cell.
    """
    names = [c for c in df.columns if c not in ("curve", "shard", "slot")]
    own = F.xxhash64(*tie)
    placed = df.select(*names, (own if group is None else group).cast("long").alias("__hash"), own.alias("__single"), F.struct(*tie).alias("__tie"))
    placed = written(with_curve(placed, dims, bits))  # the curve is computed once; in the plans below its expressions would be repeated
    cells = written(placed.groupBy(F.col("curve").alias("__cell")).agg(F.count("*").alias("__rows")))  # 2 ** (bits * dims) rows at most
    total = cells.agg(F.sum("__rows")).first()[0] or 1
    rows_per_part = max(LEAST_PART_ROWS, math.ceil(total / MOST_SPLITS))
    large = placed.groupBy(F.col("__hash").alias("__of")).agg(F.count("*").alias("__n")).where(F.col("__n") > rows_per_part)  # MOST_SPLITS rows at most
    large = F.broadcast(written(large.select("__of", F.ceil(F.col("__n") / rows_per_part).alias("__pieces"))))
    parted = placed.join(broadcast_if_small(cells, 24), F.col("curve") == F.col("__cell")).join(large, F.col("__hash") == F.col("__of"), "left")
    part = F.pmod(F.col("__hash"), F.ceil(F.col("__rows") / rows_per_part))
    piece = F.when(F.col("__of").isNotNull(), F.struct(F.col("__of").alias("of"), F.pmod(F.col("__single"), F.col("__pieces")).alias("no")))
    parted = parted.withColumn("__part", F.struct(part.alias("no"), piece.alias("piece"))).drop("__cell", "__rows", "__single", "__of", "__pieces")
    counts = parted.groupBy("curve", "__part").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("curve", "__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("curve", "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    offsets = written(offsets.select(F.col("curve").alias("__curve"), F.xxhash64("__part").alias("__p"), "__offset"))
    number = F.row_number().over(Window.partitionBy("curve", "__part").orderBy("__hash", "__tie"))
    ranked = parted.withColumn("__own", number).withColumn("__p1", F.xxhash64("__part")).join(broadcast_if_small(offsets, 32), (F.col("curve") == F.col("__curve")) & (F.col("__p1") == F.col("__p")))
    ranked = ranked.withColumn("__rank", F.col("__offset") + F.col("__own") - 1)
    shard = F.expr(f"cast(__rank * {shards} div {total} AS int)")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("__rank") - first).select(*names, "curve", "shard", "slot")


def write_shards(df: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Parquet files by shard, each sorted by slot. df has shard and slot."""
    dealt = df.repartition("shard") if files_per_shard == 1 else df.repartition("shard", F.floor(F.col("slot") / F.lit(1 << 20)) % files_per_shard)
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
