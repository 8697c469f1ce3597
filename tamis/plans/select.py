"""A whole selection: budgets, clusters, and the chosen rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators import allocate, cluster, sample
from tamis.operators.common import broadcast_if_small, written
from tamis.operators.losses import require_rise
from tamis.plans.config import SelectionConfig
from tamis.schema import require

STRATA = ("domain", "source")


@dataclass
class SelectionResult:
    """selected: sample_id (and its stratum); clusters and budget where the method has them."""

    selected: DataFrame
    clusters: DataFrame | None = None
    budget: DataFrame | None = None


def softmax_budget(trajs: DataFrame, size: int, per_cluster: int = 4) -> DataFrame:
    """domain, source, n_clusters, n_samples: hierarchical budgets by difficulty."""
    return allocate.hierarchical_allocation(allocate.stratum_sums(trajs, *STRATA), size, per_cluster)


def waterfill_budget(trajs: DataFrame, size: int | None, n_clusters: int) -> DataFrame:
    """The same columns: equal shares of sources, small ones whole. Without a size no source has a bound, and none counts as small."""
    sums = trajs.groupBy(*STRATA).agg(F.count("*").alias("size")).withColumn("key", F.to_json(F.struct(*STRATA)))
    clusters = F.lit(n_clusters).cast("long").alias("n_clusters")
    if size is None:
        return sums.select(*STRATA, clusters, F.col("size").alias("n_samples"))
    shares = allocate.waterfill(sums, size, name="key")
    return sums.join(shares, "key").select(*STRATA, clusters, F.col("take").alias("n_samples"))


def with_rows(budget: DataFrame, trajs: DataFrame) -> DataFrame:
    """budget with n_rows, the rows of each stratum that can be chosen; written, as strata are few."""
    sizes = trajs.groupBy(*STRATA).agg(F.count("*").alias("n_rows"))
    return written(budget.join(sizes, list(STRATA)))


def clustered(trajs: DataFrame, budget: DataFrame, config: SelectionConfig) -> DataFrame:
    """trajs of the strata with a budget, with k, n_samples and cluster_id; strata taken whole are one cluster."""
    bounded = config.size is not None or not config.all_samples
    k = F.when(F.col("n_samples") >= F.col("n_rows"), F.lit(1)).otherwise(F.least("n_clusters", "n_rows")) if bounded else F.least("n_clusters", "n_rows")
    chosen = budget.where("n_samples > 0").withColumn("k", F.greatest(k, F.lit(1)))
    rows = trajs.join(broadcast_if_small(chosen, allocate.ROW_BYTES), list(STRATA))
    features = "traj"
    if config.cluster_features == "standardized":
        rows, features = cluster.standardized(rows, STRATA), "features"
    # read once an iteration, so the budgets and the join are not to be computed again
    return cluster.lloyd(written(rows), STRATA, "k", features, niter=config.niter or 20, seed=_seed(config)).drop("features")


def _seed(config: SelectionConfig) -> int:
    return config.seed if config.seed is not None else 42


def mean_loss() -> Column:
    """The mean of a sample's losses over its checkpoints; perplexity grows with it."""
    return F.aggregate("traj", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("traj")


def embedded(pool: DataFrame, config: SelectionConfig) -> SelectionResult:
    """The rows nearest to the centroids of `size` clusters of embeddings; pool has embedding, or features in whole numbers as traj."""
    if "embedding" in pool.columns:
        pool = pool.withColumn("traj", cluster.quantize(F.col("embedding"))).drop("embedding")
    rows = written(require(pool, "traj").withColumn("__all", F.lit(0)))
    rows = rows.withColumn("k", F.lit(min(config.size, rows.count())))
    groups = cluster.lloyd(rows, ("__all",), "k", niter=config.niter or 20, seed=_seed(config))
    return SelectionResult(cluster.medoids(groups, ("__all",)).select("sample_id"), groups.drop("__all", "k"))


def select(trajs: DataFrame, config: SelectionConfig, difficulty: DataFrame | None = None) -> SelectionResult:
    """trajs: sample_id, domain, source, traj (whole numbers, by checkpoint); more columns where a method needs them.

    difficulty: the same with the losses that budgets by softmax are taken from, where these aren't those to cluster by.
    For the method embedding the pool has a column embedding instead of traj.
    """
    require(trajs, "sample_id", *STRATA)
    size, seed = config.size, _seed(config)
    if config.method == "random":
        return SelectionResult(sample.random_subset(trajs, size, seed))
    if config.method == "longest_reasoning":
        return SelectionResult(sample.longest(require(trajs, "reasoning_length"), size))
    if config.method == "embedding":
        return embedded(trajs, config)
    require(trajs, "traj")
    if config.method == "middle_perplexity":
        return SelectionResult(sample.middle_slice(trajs.withColumn("loss", mean_loss()), size))
    if config.method == "learnability_baseline":
        return SelectionResult(sample.learnability_baseline(trajs, size, config.order or "as_written"))
    if config.sources:
        sums = trajs.groupBy(*STRATA).agg(F.count("*").alias("size"))
        budget = allocate.custom_budget(sums, config.sources).select(*STRATA, "n_clusters", "n_samples")
    elif config.softmax:
        judged = trajs if difficulty is None else written(sample.apply_subset(difficulty, trajs))
        require_rise(judged)
        budget = softmax_budget(judged, size, config.n_sample_per_cluster or 4)
    else:
        budget = waterfill_budget(trajs, size, config.n_clusters or (2 if config.all_samples else 100))
    budget = with_rows(budget, trajs)
    groups = written(clustered(trajs, budget, config))
    if config.all_samples and size is None:
        chosen = sample.high_loss_clusters(groups, STRATA)
    else:
        # small sources are taken whole, whatever the method
        whole, rest = groups.where("n_samples >= n_rows").select(*STRATA, "sample_id"), groups.where("n_samples < n_rows")
        if config.method != "high_loss_clusters":
            chosen = sample.learnability_sample(rest, STRATA, seed=seed)
        elif config.all_samples:
            chosen = sample.high_loss_clusters(rest, STRATA)
        elif config.softmax or config.sources:
            chosen = sample.high_loss_sample(rest, STRATA, seed=seed)
        else:
            chosen = sample.high_loss_sample(rest, STRATA, seed=seed, total=size - whole.count())
        chosen = chosen.select(*STRATA, "sample_id").unionByName(whole)
    chosen = chosen.select(*STRATA, "sample_id")
    if config.compat and not config.softmax:
        # with compat, the middle rows by perplexity come on top of what the clusters give
        middle = sample.middle_slice(trajs.withColumn("loss", mean_loss()), size or 1000).select(*STRATA, "sample_id")
        chosen = chosen.unionByName(middle).distinct()
    elif size is not None and not config.all_samples and not config.sources:
        chosen = sample.capped(chosen, size, sizes=budget.groupBy("source").agg(F.sum("n_rows").alias("size")))
    return SelectionResult(chosen, groups.select(*STRATA, "sample_id", "cluster_id"), budget)
