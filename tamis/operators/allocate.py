"""Budgets over strata.

The rules are sequential by nature: each stratum's share depends on what the ones before it left. Strata are
few, so a group's strata are gone through in one task, in time that grows with their number.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.common import broadcast_if_small, folded

#: What a row of budgets takes in a broadcast.
ROW_BYTES = 256


def _kinds(df: DataFrame, columns: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _rule_fit(visit, group: tuple[str, ...], name: str, out: str):
    """A rule that gives the strata, ordered by size and name, to visit(sizes, rows) for what each takes."""

    def rule(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__size", "__name"], kind="stable")
        made = rows[[*group]].copy()
        made[name], made[out] = rows["__name"], visit(rows["__size"].tolist(), rows)
        return made

    return rule


def softmax_takes(sizes: list[int], difficulty: list[float], budget: int) -> list[int]:
    """What strata, sorted by size, take of a budget by softmax of difficulty; the softmax is shifted by the largest."""
    if any(math.isnan(d) for d in difficulty):
        raise ValueError("a stratum's last loss is below its first")
    top = max(difficulty)
    e = [math.exp(d - top) for d in difficulty]
    z = 0.0
    for x in e:
        z += x
    share = [x / z for x in e]
    rest, ahead = [0.0] * len(share), 0.0  # added from the end, so that the last one's share of the rest is exactly 1
    for i in reversed(range(len(share))):
        rest[i] = ahead = ahead + share[i]
    takes, left = [], budget
    for size, p, r in zip(sizes, share, rest, strict=True):
        take = size if size < math.floor(p * budget) else max(min(math.floor(p / r * left) if r > 0 else 0, size), 0)
        takes.append(take)
        left -= take
    return takes


def softmax_allocation(strata: DataFrame, budget: str | int, group: tuple[str, ...] = (), name: str = "name", size: str = "size", difficulty: str = "difficulty") -> DataFrame:
    """group, name, take: the budget shared by softmax of difficulty under capacity limits.

    Strata are visited by size, then name. One smaller than its first request is taken whole; else it gets its
    share of what is left among those left, at most its size. What remains goes to the largest first. The
    softmax is shifted by the largest difficulty; a difficulty that is NaN is an error.
    """

    def visit(sizes: list[int], rows: pd.DataFrame) -> list[int]:
        budget = int(rows["__budget"].iloc[0])
        takes = softmax_takes(sizes, rows["__difficulty"].tolist(), budget)
        left = budget - sum(takes)
        names = rows["__name"].tolist()
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], names[i])):
            more = min(left, sizes[i] - takes[i])
            takes[i] += more
            left -= more
        return takes

    total = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    rows = strata.select(*group, F.col(size).cast("long").alias("__size"), F.col(name).alias("__name"), F.coalesce(F.col(difficulty).cast("double"), F.lit(float("nan"))).alias("__difficulty"), total.cast("long").alias("__budget"))
    return folded(rows, group, f"{_kinds(strata, (*group, name))}, take long", _rule_fit(visit, group, name, "take"))


def hierarchical_allocation(strata: DataFrame, budget: int, per_cluster: int = 4) -> DataFrame:
    """domain, source, n_clusters, n_samples: the budget over domains, then each domain's over its sources.

    strata: domain, source, size, first_sum, last_sum (sums of first and last losses in millionths).
    """
    domains = strata.groupBy("domain").agg(F.sum("size").alias("size"), F.sum("first_sum").alias("first_sum"), F.sum("last_sum").alias("last_sum"))
    by_domain = softmax_allocation(domains.withColumn("difficulty", geometric_difficulty()), budget, name="domain").withColumnRenamed("take", "budget")
    sources = strata.withColumn("difficulty", geometric_difficulty()).join(broadcast_if_small(by_domain, ROW_BYTES), "domain")
    taken = softmax_allocation(sources, "budget", ("domain",), name="source")
    return taken.select("domain", "source", F.greatest(F.lit(1).cast("long"), F.expr(f"take div {per_cluster}")).alias("n_clusters"), F.col("take").alias("n_samples"))


def geometric_difficulty() -> Column:
    """sqrt((last - first) * last) of a stratum's mean losses, from whole sums in millionths."""
    mean = lambda c: F.col(c) / F.col("size") / F.lit(1e6)
    return F.sqrt((mean("last_sum") - mean("first_sum")) * mean("last_sum"))


def stratum_sums(trajs: DataFrame, *keys: str) -> DataFrame:
    """keys, size, first_sum, last_sum."""
    return trajs.groupBy(*keys).agg(F.count("*").alias("size"), F.sum(F.element_at("traj", 1)).alias("first_sum"), F.sum(F.element_at("traj", -1)).alias("last_sum"))


def equal_takes(sizes: list[int], budget: int) -> list[int]:
    """What strata, sorted by size, take in equal shares of what is left: small ones go whole, the rest share."""
    takes, left = [], budget
    for i, size in enumerate(sizes):
        takes.append(min(left // (len(sizes) - i), size))
        left -= takes[-1]
    return takes


def waterfill(strata: DataFrame, budget: int, name: str = "source", size: str = "size", group: tuple[str, ...] = ()) -> DataFrame:
    """group, name, take: equal shares; small strata are taken whole, the rest share what is left."""
    rows = strata.select(*group, F.col(size).cast("long").alias("__size"), F.col(name).alias("__name"))
    return folded(rows, group, f"{_kinds(strata, (*group, name))}, take long", _rule_fit(lambda sizes, _: equal_takes(sizes, budget), group, name, "take"))


def cluster_quotas(clusters: DataFrame, group: tuple[str, ...], cluster: str = "cluster_id", size: str = "size", budget: str = "n_samples", least: int = 2) -> DataFrame:
    """group, cluster, quota: a group's budget over its clusters of two rows or more, smallest first."""
    rows = clusters.where(F.col(size) >= least).select(*group, F.col(size).cast("long").alias("__size"), F.col(cluster).cast("int").alias("__name"), F.col(budget).cast("long").alias("__budget"))
    return folded(rows, group, f"{_kinds(clusters, group)}, `{cluster}` int, quota long", _rule_fit(lambda sizes, rows: equal_takes(sizes, int(rows["__budget"].iloc[0])), group, cluster, "quota"))


def ordered_quotas(clusters: DataFrame, group: tuple[str, ...], order: str, budget: str = "n_samples", cluster: str = "cluster_id", size: str = "size") -> DataFrame:
    """group, cluster, quota: a group's budget over its clusters in a given order, equal shares of what is left; what the last can't use is dropped."""
    rows = clusters.select(*group, F.col(size).cast("long").alias("__size"), F.col(cluster).cast("int").alias("__name"), F.col(order).alias("__order"), F.col(budget).cast("long").alias("__budget"))

    def rule(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__order", kind="stable")
        made = rows[[*group]].copy()
        made[cluster], made["quota"] = rows["__name"], equal_takes(rows["__size"].tolist(), int(rows["__budget"].iloc[0]))
        return made

    return folded(rows, group, f"{_kinds(clusters, group)}, `{cluster}` int, quota long", rule)


def carried_quotas(clusters: DataFrame, strata: tuple[str, ...], total: int, order: str, rows_of: str = "n_rows", cluster: str = "cluster_id", size: str = "size") -> DataFrame:
    """strata, cluster, quota: a total over strata, smallest first, and over each one's clusters in a given order.

    A stratum's share is an equal part of what is left, at most its rows (rows_of); what its clusters can't use of it stays in the total, so
    that later strata get more. One task goes through all clusters.
    """
    rows = clusters.select(*strata, F.col(size).cast("long").alias("__size"), F.col(cluster).cast("int").alias("__name"), F.col(order).alias("__order"), F.col(rows_of).cast("long").alias("__rows"))

    def rule(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__rows", *strata, "__order"], kind="stable").reset_index(drop=True)
        left, takes = total, []
        starts = [i for i in range(len(rows)) if i == 0 or any(rows[s][i] != rows[s][i - 1] for s in strata)]
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(rows)], strict=True)):
            share = min(left // (len(starts) - n), int(rows["__rows"][a]))
            takes += equal_takes(rows["__size"][a:b].tolist(), share)
            left -= sum(takes[a:b])
        made = rows[[*strata]].copy()
        made[cluster], made["quota"] = rows["__name"], takes
        return made

    return folded(rows, (), f"{_kinds(clusters, strata)}, `{cluster}` int, quota long", rule)


def custom_budget(sums: DataFrame, given: dict[str, tuple[int, int]]) -> DataFrame:
    """sums (domain, source, size, ...) with n_clusters and n_samples by source; `other` holds for sources that aren't named.

    Without `other` they get (1, 0): none of their rows. It is an error if a source is really called other, or if a
    named one isn't there. More samples than a source has are all of them.
    """
    sources = {r["source"] for r in sums.select("source").distinct().collect()}  # strata, which are few
    if "other" in sources:
        raise ValueError("a source is called other, which stands for the sources that aren't named")
    if missing := sorted(set(given) - sources - {"other"}):
        raise ValueError(f"no such source: {', '.join(missing)}")
    rest = given.get("other", (1, 0))
    rows = [(name, int(k), int(n)) for name, (k, n) in given.items() if name != "other"]
    named = sums.sparkSession.createDataFrame(rows, "__source string, __k long, __n long")
    joined = sums.join(broadcast_if_small(named, ROW_BYTES), F.col("source") == F.col("__source"), "left")
    return joined.withColumn("n_clusters", F.coalesce("__k", F.lit(rest[0]))).withColumn("n_samples", F.least(F.coalesce("__n", F.lit(rest[1])), F.col("size"))).drop("__source", "__k", "__n")


def sources_of_domains(samples: DataFrame) -> DataFrame:
    """domain, sources: the different sources of each domain, sorted."""
    return samples.groupBy("domain").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def contiguous_split(rows: int, workers: int) -> list[tuple[int, int]]:
    """(first, end) for each worker: runs that differ by one row at most, the longer ones first."""
    if workers < 1:
        raise ValueError("at least one worker is needed")
    size, more = divmod(rows, workers)
    starts = [w * size + min(w, more) for w in range(workers + 1)]
    return list(zip(starts, starts[1:], strict=False))
