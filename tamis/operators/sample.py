"""Sampling within clusters, and the baselines that rank the whole pool."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.allocate import ROW_BYTES, carried_quotas, cluster_quotas, ordered_quotas
from tamis.operators.cluster import hash_order
from tamis.operators.common import broadcast_if_small, written

#: A slice of an order is taken from ranges of about so many rows.
RANGE_ROWS, MOST_RANGES = 200_000, 10_000


def top_by_quota(ranked: DataFrame, quotas: DataFrame, keys: tuple[str, ...], rank: str = "rank", quota: str = "quota") -> DataFrame:
    """The rows of rank up to their group's quota.

    The largest quota, a single number, is filtered for first: a constant bound lets Spark stop ranking a
    group early, which a column does not.
    """
    quotas = written(quotas)
    largest = quotas.agg(F.max(quota)).first()[0] or 0
    return ranked.where(F.col(rank) <= largest).join(broadcast_if_small(quotas, ROW_BYTES), list(keys)).where(F.col(rank) <= F.col(quota))


def learnability_sample(clustered: DataFrame, strata: tuple[str, ...], budget: str = "n_samples", ident: str = "sample_id", seed: int = 42) -> DataFrame:
    """strata, ident: of each cluster its quota of rows with the strongest trend; what is left goes to singletons.

    A row's score is last - first where the cluster's mean first loss is below its mean last loss, else first
    - last. Clusters of one row share what remains by hash order.
    """
    keys = (*strata, "cluster_id")
    sums = written(clustered.groupBy(*keys).agg(F.count("*").alias("size"), F.sum(F.element_at("traj", 1)).alias("__f"), F.sum(F.element_at("traj", -1)).alias("__l"), F.first(budget).alias(budget)))
    quotas = cluster_quotas(sums, strata, budget=budget)
    gap = F.element_at("traj", -1) - F.element_at("traj", 1)
    scored = clustered.join(broadcast_if_small(sums.select(*keys, "size", (F.col("__f") < F.col("__l")).alias("__up")), ROW_BYTES), list(keys))
    scored = scored.withColumn("__score", F.when(F.col("__up"), gap).otherwise(-gap))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__score"), ident))
    picked = top_by_quota(scored.where("size >= 2").withColumn("rank", rank), quotas, keys).select(*strata, ident)

    taken = quotas.groupBy(*strata).agg(F.sum("quota").alias("__taken"))
    left = sums.select(*strata, F.col(budget).alias("__b")).distinct().join(taken, list(strata), "left").select(*strata, (F.col("__b") - F.coalesce("__taken", F.lit(0))).alias("__left"))
    order = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_order(seed, ident), ident))
    singles = scored.where("size = 1").withColumn("rank", order)
    rest = top_by_quota(singles, left.withColumnRenamed("__left", "quota"), strata).select(*strata, ident)
    return picked.unionByName(rest)


def ranked_by_loss(clustered: DataFrame, strata: tuple[str, ...], share: float = 0.5) -> DataFrame:
    """strata, cluster_id, rank, size: each stratum's clusters of highest mean loss, highest first: at least one, at most the share of its clusters."""
    keys = (*strata, "cluster_id")
    sums = clustered.groupBy(*keys).agg(F.sum(F.aggregate("traj", F.lit(0).cast("long"), lambda a, x: a + x)).alias("__s"), F.sum(F.size("traj")).alias("__n"), F.count("*").alias("size"))
    by = Window.partitionBy(*strata)  # a row for each cluster
    rank = F.row_number().over(by.orderBy(F.desc(F.col("__s") / F.col("__n")), "cluster_id"))
    ranked = sums.select(*keys, rank.alias("rank"), "size", F.count("*").over(by).alias("__c"))
    return ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("__c") * share))).drop("__c")


def high_loss_clusters(clustered: DataFrame, strata: tuple[str, ...], share: float = 0.5) -> DataFrame:
    """The rows of each stratum's clusters of highest mean loss."""
    keys = (*strata, "cluster_id")
    return clustered.join(broadcast_if_small(written(ranked_by_loss(clustered, strata, share).select(*keys)), ROW_BYTES), list(keys))


def high_loss_sample(clustered: DataFrame, strata: tuple[str, ...], budget: str = "n_samples", ident: str = "sample_id", seed: int = 42, share: float = 0.5, total: int | None = None) -> DataFrame:
    """As high_loss_clusters, but a budget's worth: quotas over the kept clusters in the order of loss, by hash order within them.

    The budget is the stratum's (a column); or a total over all strata, of which a stratum's unused share goes to later, larger ones.
    """
    keys = (*strata, "cluster_id")
    sizes = clustered.groupBy(*strata).agg(F.count("*").alias("n_rows"), F.first(budget).alias(budget))
    kept = written(ranked_by_loss(clustered, strata, share).join(broadcast_if_small(written(sizes), ROW_BYTES), list(strata)))
    quotas = ordered_quotas(kept, strata, "rank", budget) if total is None else carried_quotas(kept, strata, total, "rank")
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(seed, ident), ident))
    rows = clustered.join(broadcast_if_small(kept.select(*keys), ROW_BYTES), list(keys))
    return top_by_quota(rows.withColumn("rank", order), quotas, keys).select(*strata, ident)


def middle_slice(df: DataFrame, n: int, by: str = "loss", ident: str = "sample_id") -> DataFrame:
    """The n rows in the middle of the order by loss (perplexity grows with it), then id."""
    df = written(df)
    total = df.count()
    n = min(n, total)
    return order_slice(df, [by, ident], (total - n) // 2, n, total)


def order_slice(df: DataFrame, order: list[str], first: int, n: int, total: int) -> DataFrame:
    """The rows of ranks first to first + n - 1 in the order of some numeric columns; df (total rows) is written.

    Rows are counted by ranges between approximate quantiles of the first column, and those outside of the ranges that
    hold the slice are left out by their count, so no task sorts more than these. Where one value makes a range too
    large, its rows are cut by the next column.
    """
    while total > 2 * RANGE_ROWS + n and order:
        ranges = min(MOST_RANGES, math.ceil(total / RANGE_ROWS))
        marks = df.agg(F.percentile_approx(order[0], [i / ranges for i in range(1, ranges)], F.lit(10 * ranges)).alias("q")).first()["q"]
        marks = sorted({m for m in marks if m is not None})
        table = F.array(*(F.lit(m) for m in marks))
        # 2 i for values between the marks i - 1 and i, 2 i + 1 for the mark itself; nulls come first
        below = F.size(F.filter(table, lambda m: m < F.col(order[0])))
        place = F.coalesce(2 * below + F.array_contains(table, F.col(order[0])).cast("int"), F.lit(-1))
        counts = sorted((r["p"], r["count"]) for r in df.groupBy(place.alias("p")).count().collect())  # two rows a range
        before, keep = 0, []
        for p, count in counts:
            if before < first + n and before + count > first:
                keep.append((p, before, count))
            before += count
        low, high = keep[0][0], keep[-1][0]
        held = sum(c for _, _, c in keep)
        df = df.where((place >= low) & (place <= high))
        first, single = first - keep[0][1], len(keep) == 1 and keep[0][0] % 2 == 1
        if single:
            order = order[1:]  # all rows have the same value
        elif held == total:
            break
        total = held
    return df.orderBy(*order).offset(first).limit(n) if order else df.offset(first).limit(n)


def learnability_baseline(df: DataFrame, n: int, order: str = "as_written", ident: str = "sample_id") -> DataFrame:
    """The first n by last - first loss, of two checkpoints, in a series whose losses fall on the whole.

    as_written takes the largest difference first, that is the rows that improve least; order="improvement"
    takes those that improve most.
    """
    width = df.select(F.min(F.size("traj")), F.max(F.size("traj")), F.sum(F.element_at("traj", 1)), F.sum(F.element_at("traj", -1))).first()
    if width[0] is not None and (width[0], width[1]) != (2, 2):
        raise ValueError("exactly two checkpoints are needed")
    if width[2] is not None and not width[2] > width[3]:
        raise ValueError("the mean first loss is not above the mean last loss")
    gap = F.element_at("traj", -1) - F.element_at("traj", 1)
    return df.withColumn("gap", gap).orderBy(F.desc("gap") if order == "as_written" else F.asc("gap"), ident).limit(n)


def longest(df: DataFrame, n: int, length: str = "reasoning_length", ident: str = "sample_id") -> DataFrame:
    return df.orderBy(F.desc(length), ident).limit(n)


def random_subset(df: DataFrame, n: int, seed: int = 42, ident: str = "sample_id") -> DataFrame:
    """Exactly n rows, by hash order."""
    return df.orderBy(hash_order(seed, ident), ident).limit(n)


def apply_subset(samples: DataFrame, subset: DataFrame, ident: str = "sample_id") -> DataFrame:
    return samples.join(subset.select(ident), ident, "left_semi")


def complement(samples: DataFrame, subset: DataFrame, ident: str = "sample_id") -> DataFrame:
    return samples.join(subset.select(ident), ident, "left_anti")


def capped(df: DataFrame, n: int, source: str = "source", ident: str = "sample_id", sizes: DataFrame | None = None) -> DataFrame:
    """The first n rows, sources by size (of sizes: source and size, or as they stand), then name, rows by id; over all sources in one order."""
    if sizes is None:
        sizes = df.groupBy(source).agg(F.count("*").alias("size"))
    sizes = written(sizes.select(F.col(source).alias("__source"), F.col("size").alias("__size")))
    return df.join(broadcast_if_small(sizes, ROW_BYTES), F.col(source) == F.col("__source")).orderBy("__size", source, ident).limit(n).drop("__size", "__source")
