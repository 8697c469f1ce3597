"""Losses, budgets, clusters, samplers, converters, scoring and tensors: golden values, guards and properties."""

import contextlib
import hashlib
import math
import os
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions import answers
from tamis.operators import allocate, cluster, convert, losses, sample, score, tensors
from tamis.plans.config import SelectionConfig
from tamis.plans.select import select
from tamis.schema import require
from tamis.sources import io


def one(df):
    return df.collect()[0]


# -- losses ------------------------------------------------------------------------------------------------


def test_checkpoint_specs():
    assert losses.parse_checkpoints("1-3,8") == {1, 2, 3, 8} and losses.parse_checkpoints("None") == set()
    for bad in ("3-1", "x", "1-"):
        with pytest.raises(ValueError):
            losses.parse_checkpoints(bad)


def test_missing_checkpoints_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.7)], "sample_id long, ckpt int, loss double")
    assert losses.require_checkpoints(df, "1-2").count() == 2
    with pytest.raises(ValueError, match="3"):
        losses.require_checkpoints(df, "1-3")
    with pytest.raises(ValueError):
        losses.prune_checkpoints(df, "None")


def test_prefix_means(spark):
    df = spark.createDataFrame([([1.0, 2.0, 9.0],), ([],), (None,)], "losses array<float>")
    rows = losses.prefix_means(df, [2, 100, -1]).collect()
    assert [rows[0][c] for c in ("mean_2", "mean_100", "mean_full")] == [1.5, 4.0, 4.0]
    assert all(r.mean_2 == r.mean_full == 0.0 for r in rows[1:])


def test_trajectories_and_nan(spark):
    df = spark.createDataFrame([(1, 2, 3.0), (1, 1, float("nan")), (2, 1, 5.0), (2, 2, 6.0)], "sample_id long, ckpt int, loss double")
    assert {r.sample_id: r.traj for r in losses.trajectories(df).collect()} == {1: [0.0, 3.0], 2: [5.0, 6.0]}
    assert {r.sample_id: (r.ckpt_1, r.ckpt_2) for r in losses.loss_matrix(df, [1, 2]).collect()} == {1: (0.0, 3.0), 2: (5.0, 6.0)}


def test_windows_and_valid_tokens(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [0.1, 0.2, 0.3], [-100, 7, -100])], "t array<int>, l array<double>, y array<int>")
    row = one(df.select(losses.response_window(F.col("t"), F.lit(2), 2).alias("r"), losses.response_window(F.col("t"), F.lit(2), -1).alias("a"), losses.response_window(F.col("t"), F.lit(3), 2, True).alias("p"), losses.valid_losses(F.col("l"), F.col("y")).alias("v")))
    assert (row.r, row.a, row.p, row.v) == ([3, 4], [3, 4, 5], [1, 2], [0.2])


def test_guards_on_checkpoint_means(spark):
    rising = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "sample_id long, ckpt int, loss double")
    losses.require_last_is_highest(rising)
    with pytest.raises(ValueError):
        losses.require_last_is_highest(rising.withColumn("loss", -F.col("loss")))
    with pytest.raises(ValueError):
        losses.require_last_is_highest(rising.where("ckpt = 1"))
    summary = one(losses.loss_summary(spark.createDataFrame([(float(i),) for i in (4, 1, 3, 2)], "loss double")))
    assert summary.median_loss == 2.0


def test_length_faults(spark):
    df = spark.createDataFrame([([1.0], 1), ([1.0], 2), (None, 0)], "losses array<double>, expected int")
    assert losses.length_faults(df, "expected").count() == 1


# -- budgets -----------------------------------------------------------------------------------------------


def taken(df, name="name"):
    return {r[name]: r["take"] for r in df.collect()}


def test_softmax_golden(spark):
    strata = spark.createDataFrame([("A", 5, 0.5), ("B", 100, 1.0), ("C", 30, 2.0)], "name string, size long, difficulty double")
    assert taken(allocate.softmax_allocation(strata, 60)) == {"A": 5, "B": 25, "C": 30}


def test_waterfill_and_quota_golden(spark):
    sizes = spark.createDataFrame([("a", 3), ("b", 10), ("c", 50)], "source string, size long")
    assert taken(allocate.waterfill(sizes, 20), "source") == {"a": 3, "b": 8, "c": 9}
    clusters = spark.createDataFrame([("s", i, n, 20) for i, n in enumerate((2, 3, 9, 40, 1))], "source string, cluster_id int, size long, n_samples long")
    assert {r.cluster_id: r.quota for r in allocate.cluster_quotas(clusters, ("source",)).collect()} == {0: 2, 1: 3, 2: 7, 3: 8}


def test_difficulty_golden(spark):
    df = spark.createDataFrame([(2, 2_000_000, 4_000_000)], "size long, first_sum long, last_sum long")
    assert round(one(df.select(allocate.geometric_difficulty().alias("d"))).d, 6) == 1.414214
    falling = spark.createDataFrame([("x", 2, 4_000_000, 2_000_000)], "name string, size long, first_sum long, last_sum long").withColumn("difficulty", allocate.geometric_difficulty())
    with pytest.raises(Exception, match="below its first"):
        allocate.softmax_allocation(falling, 1).collect()


def test_allocation_properties(spark):
    rng = random.Random(4)
    rows, budgets = [], {}
    for g in range(30):
        budgets[g] = rng.randint(0, 200)
        rows += [(g, f"n{i}", rng.randint(1, 60), rng.random() * 3, budgets[g]) for i in range(rng.randint(1, 9))]
    strata = spark.createDataFrame(rows, "g int, name string, size long, difficulty double, b long")
    got = allocate.softmax_allocation(strata, "b", ("g",)).collect()
    sizes = {(r[0], r[1]): r[2] for r in rows}
    assert len(got) == len(rows) and all(0 <= r["take"] <= sizes[r.g, r["name"]] for r in got)
    for g, b in budgets.items():
        assert sum(r["take"] for r in got if r.g == g) == min(b, sum(n for (h, _), n in sizes.items() if h == g))


def test_hierarchical_keeps_domains_apart(spark):
    rows = [("x", "s", 10, 10_000_000, 30_000_000), ("y", "s", 40, 40_000_000, 90_000_000), ("y", "t", 40, 40_000_000, 120_000_000)]
    strata = spark.createDataFrame(rows, "domain string, source string, size long, first_sum long, last_sum long")
    got = {(r.domain, r.source): (r.n_clusters, r.n_samples) for r in allocate.hierarchical_allocation(strata, 50).collect()}
    assert set(got) == {("x", "s"), ("y", "s"), ("y", "t")} and sum(n for _, n in got.values()) == 50
    assert all(k == max(1, n // 4) for k, n in got.values())


# -- clusters and samplers ---------------------------------------------------------------------------------


def test_lloyd_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(i, "ab"[i % 2], [rng.randint(-1000, 1000) for _ in range(3)], 4) for i in range(200)]
    df = spark.createDataFrame(rows, "sample_id long, source string, traj array<bigint>, k int")
    runs = [sorted((r.sample_id, r.cluster_id, r.dist) for r in cluster.lloyd(df.repartition(n), ("source",), "k", niter=5).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 200 and {c for _, c, _ in runs[0]} == {0, 1, 2, 3}
    groups = cluster.lloyd(df, ("source",), "k", niter=2)
    medoids = cluster.medoids(groups, ("source",)).collect()
    assert len(medoids) == 8 and len({m.sample_id for m in medoids}) == 8


def test_standardized_ends(spark):
    df = spark.createDataFrame([(1, "a", [1, 5]), (2, "a", [3, 5]), (3, "b", [7, 7])], "sample_id long, source string, traj array<bigint>")
    got = {r.sample_id: (r.first_z, r.last_z) for r in cluster.standardize_ends(df, ("source",)).collect()}
    assert got[1][0] == pytest.approx(-math.sqrt(0.5)) and got[1][1] == 5 and got[3] == (7.0, 7.0)


def test_masked_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1, 1]), ([[1.0, 2.0]], [0])], "v array<array<float>>, m array<int>")
    assert [r.p for r in df.select(cluster.masked_mean(F.col("v"), F.col("m"), 2).alias("p")).collect()] == [[2.0, 3.0], [0.0, 0.0]]


def test_high_loss_keeps_upper_half(spark):
    rows = [(c * 10 + i, "d", "s", c, [c, c]) for c in range(5) for i in range(2)] + [(100, "d", "t", 0, [1, 1])]
    df = spark.createDataFrame(rows, "sample_id long, domain string, source string, cluster_id int, traj array<bigint>")
    kept = {(r.source, r.cluster_id) for r in sample.high_loss_clusters(df, ("domain", "source")).collect()}
    assert kept == {("s", 4), ("s", 3), ("t", 0)}
    plan = cluster.standardize_ends(df, ("domain", "source"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    some = sample.high_loss_sample(df.withColumn("n_samples", F.lit(3)), ("domain", "source")).collect()
    assert len([r for r in some if r.source == "s"]) == 3


def test_learnability_sample_uses_singletons_last(spark):
    rows = [(1, 0, [1, 9]), (2, 0, [1, 5]), (3, 1, [4, 4]), (4, 2, [2, 2])]
    df = spark.createDataFrame([(i, "d", "s", c, t, 3) for i, c, t in rows], "sample_id long, domain string, source string, cluster_id int, traj array<bigint>, n_samples long")
    got = {r.sample_id for r in sample.learnability_sample(df, ("domain", "source")).collect()}
    assert {1, 2} < got and len(got) == 3
    assert {r.sample_id for r in sample.learnability_sample(df.withColumn("n_samples", F.lit(1)), ("domain", "source")).collect()} == {1}


def test_rankings(spark):
    df = spark.createDataFrame([(i, i * 10, i % 3) for i in range(10)], "sample_id long, loss long, reasoning_length int")
    assert [r.sample_id for r in sample.middle_slice(df, 4).collect()] == [3, 4, 5, 6]
    assert [r.sample_id for r in sample.middle_slice(df.limit(5), 2).orderBy("sample_id").collect()] == [1, 2]
    assert sample.middle_slice(df, 99).count() == 10
    assert [r.sample_id for r in sample.longest(df, 3).collect()] == [2, 5, 8]
    first = {r.sample_id for r in sample.random_subset(df, 4).collect()}
    assert first == {r.sample_id for r in sample.random_subset(df.repartition(5), 4).collect()} and len(first) == 4
    assert sample.apply_subset(df, df.limit(3)).count() + sample.complement(df, df.limit(3)).count() == 10


def test_learnability_baseline_guards(spark):
    falling = spark.createDataFrame([(1, [9, 1]), (2, [9, 8])], "sample_id long, traj array<bigint>")
    assert [r.sample_id for r in sample.learnability_baseline(falling, 1).collect()] == [2]
    assert [r.sample_id for r in sample.learnability_baseline(falling, 1, "improvement").collect()] == [1]
    for bad in ([(1, [1, 9])], [(1, [9, 5, 1])]):
        with pytest.raises(ValueError):
            sample.learnability_baseline(spark.createDataFrame(bad, "sample_id long, traj array<bigint>"), 1)


def test_quota_ranking_stops_early(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "sample_id long, g int")
    from pyspark.sql import Window

    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("sample_id")))
    quotas = spark.createDataFrame([(0, 2), (1, 0), (2, 5)], "g int, quota long")
    plan = sample.top_by_quota(ranked, quotas, ("g",))
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 7


# -- selection ---------------------------------------------------------------------------------------------


def pool(spark, n=120):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        base = rng.randint(1_000_000, 3_000_000)
        rows.append((i, "d" + str(i % 2), f"s{i % 4}", [base, base + rng.randint(1, 900_000), base + 1_000_000 + rng.randint(0, 900_000)], rng.randint(1, 99)))
    return spark.createDataFrame(rows, "sample_id long, domain string, source string, traj array<bigint>, reasoning_length int")


@pytest.mark.parametrize("config", [{"method": "learnability", "softmax": True}, {"method": "learnability", "n_clusters": 5}, {"method": "high_loss_clusters", "n_clusters": 4}, {"method": "random"}, {"method": "longest_reasoning"}, {"method": "middle_perplexity"}, {"method": "embedding"}])
def test_selections_have_the_size_asked_for(spark, config):
    df = pool(spark)
    runs = [{r.sample_id for r in select(rows, SelectionConfig(size=30, niter=3, **config).merged({})).selected.collect()} for rows in (df, df.repartition(6))]
    assert runs[0] == runs[1] and len(runs[0]) <= 30 and (len(runs[0]) == 30 or config["method"] in ("embedding", "high_loss_clusters"))


def test_many_strata_and_clusters_take_seconds(spark):
    began = time.perf_counter()
    rows = [(f"d{i % 20}", f"s{i}", i % 97 + 1, (i % 97 + 1) * 1_000_000, (i % 97 + 1) * (1_500_000 + i % 1000)) for i in range(10_000)]
    strata = spark.createDataFrame(rows, "domain string, source string, size long, first_sum long, last_sum long")
    got = allocate.hierarchical_allocation(strata, 50_000).collect()
    assert len(got) == 10_000 and sum(r.n_samples for r in got) == 50_000
    one_group = allocate.softmax_allocation(strata.withColumn("difficulty", allocate.geometric_difficulty()), 9_999, name="source")
    assert one_group.agg({"take": "sum"}).first()[0] == 9_999
    assert allocate.waterfill(strata.selectExpr("source", "size"), 1234).agg({"take": "sum"}).first()[0] == 1234
    assert time.perf_counter() - began < 40


def brute_clusters(rows, k, niter, seed=42):
    """ids, features of one stratum, to the cluster of each id."""
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0]))
    centers = [list(x) for _, x in order[:k]]
    near = lambda x: min(range(len(centers)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(x, centers[c], strict=True)), c))
    for _ in range(niter):
        groups = {}
        for _, x in rows:
            groups.setdefault(near(x), []).append(x)
        for c, members in groups.items():
            centers[c] = [cluster.truncated(sum(col), len(members)) for col in zip(*members, strict=True)]
    return {i: near(x) for i, x in rows}


@pytest.mark.parametrize("width", [1, 3, 80])
def test_lloyd_is_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK_DISTANCES", 64)
    rng = random.Random(width)
    rows = [(i, "ab"[i % 2], [rng.randint(-50, 50) for _ in range(width)]) for i in range(120)]
    df = spark.createDataFrame(rows, "sample_id long, source string, traj array<bigint>").withColumn("k", F.when(F.col("source") == "a", 7).otherwise(1))
    got = {r.sample_id: r.cluster_id for r in cluster.lloyd(df, ("source",), "k", niter=4).collect()}
    want = {}
    for s, k in (("a", 7), ("b", 1)):
        want |= brute_clusters([(i, x) for i, t, x in rows if t == s], k, 4)
    assert got == want


@pytest.mark.parametrize("block_values", [1 << 24, 90])
@pytest.mark.parametrize("width", [1, 3, 70])
def test_bounds_and_blocks_give_the_same_clusters(spark, width, block_values, monkeypatch):
    rng = random.Random(width)
    rows = [(i, [None, "a", 'b"'][i % 3], [rng.randint(-5, 5) if i % 2 else rng.choice([-50, 50]) for _ in range(width)]) for i in range(150)]
    df = spark.createDataFrame(rows, "sample_id long, source string, traj array<bigint>").withColumn("k", F.when(F.col("source") == "a", 9).when(F.col("source").isNull(), 1).otherwise(4))
    df = df.unionByName(df.where("source = 'a'").withColumns({"source": F.lit("none"), "k": F.lit(0), "sample_id": F.col("sample_id") + 1000}))
    plain = {r.sample_id: (r.source, r.cluster_id, r.dist) for r in cluster.lloyd(df, ("source",), "k", niter=6).collect()}
    monkeypatch.setattr(cluster, "BOUNDS_FROM", 2)
    monkeypatch.setattr(cluster, "BLOCK_VALUES", block_values)
    kept = cluster.lloyd(df, ("source",), "k", niter=6)
    assert kept.columns == [*df.columns, "cluster_id", "dist"]
    assert {r.sample_id: (r.source, r.cluster_id, r.dist) for r in kept.collect()} == plain and len(plain) == 150
    want = {}
    for s, k in ((None, 1), ("a", 9), ('b"', 4)):
        want |= brute_clusters([(i, x) for i, t, x in rows if t == s], k, 6)
    assert {i: c for i, (_, c, _) in plain.items()} == want
    assert cluster.lloyd(df.where("false"), ("source",), "k").count() == 0


def test_bounds_spare_distances(spark):
    """10,000 rows and 200 clusters: settled rows don't meet all centroids again."""
    rng = np.random.default_rng(4)
    points = rng.integers(0, 1_000_000, (200, 4))[rng.integers(0, 200, 10_000)] + rng.integers(-5_000, 5_000, (10_000, 4))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(points.tolist())], "sample_id long, traj array<bigint>").withColumns({"source": F.lit("s"), "k": F.lit(200)})
    met = []
    got = {r.sample_id: (r.cluster_id, r.dist) for r in cluster.lloyd(df, ("source",), "k", niter=10, met=met).collect()}
    order = sorted(range(len(points)), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    centers = points[order[:200]]
    for _ in range(10):
        at, _ = cluster.nearest_rows(points, centers)
        sums, n = np.zeros_like(centers), np.bincount(at, minlength=200)
        np.add.at(sums, at, points)
        centers = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centers)
    at, dist = cluster.nearest_rows(points, centers)
    assert got == {i: (int(a), int(d)) for i, (a, d) in enumerate(zip(at, dist, strict=True))}
    assert met[0] == 10_000 and met[-1] < 5_000 and sum(met) < 0.7 * 10_000 * len(met)


def test_close_distances_are_decided_exactly():
    big = 2_000_000_000
    centers = np.array([[big, 0], [0, big], [1, big - 1], [big, 1]], np.int64)
    rows = np.array([[big // 2, big // 2], [big // 2 + 1, big // 2], [0, big], [1, big], [big, 1]], np.int64)
    at, dist = cluster.nearest_rows(rows, centers)
    for r, a, d in zip(rows.tolist(), at.tolist(), dist.tolist(), strict=True):
        exact = [sum((x - y) ** 2 for x, y in zip(r, c, strict=True)) for c in centers.tolist()]
        assert d == min(exact) and a == exact.index(d)
    with pytest.raises(ValueError, match="64 bits"):
        cluster.nearest_rows(rows * 4, centers)


def test_many_wide_centroids_can_be_clustered(spark):
    df = spark.range(1200).select(F.col("id").alias("sample_id"), F.lit("x").alias("source"), F.transform(F.sequence(F.lit(0), F.lit(1099)), lambda i: (F.xxhash64("id", i) % 1000).cast("long")).alias("traj"), F.lit(1000).alias("k"))
    groups = cluster.lloyd(df, ("source",), "k", niter=1)  # 1.1 million values of centroids
    assert groups.select("cluster_id").distinct().count() == 1000


def test_seeding_stops_a_stratum_early(spark):
    df = spark.range(500).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("string").alias("source"), F.array(F.col("id")).alias("traj"), F.lit(3).alias("k"))
    plans, real = [], cluster.written
    try:
        cluster.written = lambda d: (plans.append(d._jdf.queryExecution().executedPlan().toString()), real(d))[1]
        cluster.lloyd(df, ("source",), "k", niter=1).count()
    finally:
        cluster.written = real
    assert "WindowGroupLimit" in plans[0]


def test_slices_are_taken_from_few_ranges(spark, monkeypatch):
    monkeypatch.setattr(sample, "RANGE_ROWS", 50)
    rng = random.Random(8)
    for values in ([rng.random() for _ in range(2000)], [float(rng.randint(0, 2)) for _ in range(2000)], [1.0] * 2000, [None if i % 3 else float(i) for i in range(2000)]):
        df = spark.createDataFrame([(i * 7 % 2000, v) for i, v in enumerate(values)], "sample_id long, loss double")
        want = [i for _, i in sorted((((v is not None, v or 0.0), i * 7 % 2000) for i, v in enumerate(values)))]
        for n in (4, 301, 1999, 5000):
            n_kept = min(n, 2000)
            first = (2000 - n_kept) // 2
            assert [r.sample_id for r in sample.middle_slice(df, n).collect()] == want[first : first + n_kept]


def test_middle_perplexity_is_of_the_mean(spark):
    rows = [(i, "d", "s", [10 * i, 1000 - 30 * i]) for i in range(9)]  # the means fall as the first losses rise
    df = spark.createDataFrame(rows + [(9, "d", "s", [85, 500])], "sample_id long, domain string, source string, traj array<bigint>")
    got = [r.sample_id for r in select(df, SelectionConfig(method="middle_perplexity", size=2).merged({})).selected.collect()]
    means = sorted((sum(t) / 2, i) for i, _, _, t in [*rows, (9, "d", "s", [85, 500])])
    assert got == [i for _, i in means[4:6]]


def test_standardized_features_change_the_clusters(spark):
    df = pool(spark)
    one_way, other = ({r.sample_id: r.cluster_id for r in select(df, SelectionConfig(method="high_loss_clusters", all_samples=True, n_clusters=3, cluster_features=f).merged({})).clusters.collect()} for f in ("raw", "standardized"))
    assert one_way != other and set(one_way) == set(other)
    rows = {}
    for r in df.collect():
        rows.setdefault(r.source, []).append(r)
    for members in rows.values():
        ends = []
        for e in (0, -1):
            xs = [r.traj[e] / 1e6 for r in members]
            m = sum(xs) / len(xs)
            d = math.sqrt(sum((x - m) ** 2 for x in xs) / (len(xs) - 1))
            ends.append([round((x - m) / d * 1e6) for x in xs])
        features = [(r.sample_id, [a, *r.traj[1:-1], b]) for r, a, b in zip(members, *ends, strict=True)]
        want = brute_clusters(features, 3, 20)
        assert sum(other[i] == c for i, c in want.items()) >= 0.9 * len(want)  # rounding may move a row on a border


def test_embeddings_are_selected_without_losses(spark):
    rng = random.Random(3)
    rows = [(i, "d", "s", [float(i % 4), rng.random() / 100]) for i in range(80)]
    df = spark.createDataFrame(rows, "sample_id long, domain string, source string, embedding array<float>")
    got = sorted(r.sample_id for r in select(df, SelectionConfig(method="embedding", size=4).merged({})).selected.collect())
    assert 1 <= len(got) <= 4
    exact = [(i, [round(float(np.float32(x)) * 1e6) for x in e]) for i, _, _, e in rows]
    want = brute_clusters(exact, 4, 20)
    assert {want[i] for i in got} == set(want.values())


def test_custom_sources(spark):
    df = pool(spark)
    config = SelectionConfig(method="learnability", sources={"s0": (3, 7), "s1": (2, 10_000), "other": (1, 2)}).merged({})
    made = select(df, config)
    got = {}
    for r in made.selected.collect():
        got[r.source] = got.get(r.source, 0) + 1
    assert got == {"s0": 7, "s1": 30, "s2": 2, "s3": 2}
    assert {r.cluster_id for r in made.clusters.where("source = 's1'").collect()} == {0}
    none = select(df, SelectionConfig(method="learnability", sources={"s0": (3, 7)}).merged({})).selected
    assert {r.source for r in none.collect()} == {"s0"}
    for bad in ({"nowhere": (1, 1)},):
        with pytest.raises(ValueError, match="nowhere"):
            select(df, SelectionConfig(method="learnability", sources=bad).merged({}))
    with pytest.raises(ValueError, match="called other"):
        select(df.withColumn("source", F.when(F.col("source") == "s1", "other").otherwise(F.col("source"))), config)
    with pytest.raises(ValueError):
        SelectionConfig(method="learnability", softmax=True, size=3, sources={"s0": (1, 1)}).merged({})


def test_difficulty_losses_give_the_budget(spark):
    df = pool(spark)
    hard = df.withColumn("traj", F.when(F.col("domain") == "d0", F.array(F.lit(1_000_000).cast("long"), F.lit(9_000_000).cast("long"))).otherwise(F.array(F.lit(1_000_000).cast("long"), F.lit(1_100_000).cast("long"))))
    config = SelectionConfig(method="learnability", softmax=True, size=40, niter=2).merged({})
    share = lambda made: made.selected.where("domain = 'd0'").count()
    assert share(select(df, config, hard)) >= 39 and share(select(df, config)) < 30


def test_lines_of_several_files_are_numbered_in_their_order(spark, tmp_path):
    sizes = {"a": 2, "b": 50, "c": 0, "d": 400, "e": 7}
    want = []
    for name, n in sizes.items():
        lines = [f'{{"v": "{name}{i}"}}' for i in range(n)]
        want += [f"{name}{i}" for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # files in several blocks, dealt by size
    try:
        schema = T.StructType([T.StructField("v", T.StringType())])
        got = sorted((r.sample_id, r.v) for r in io.read_numbered(spark, str(tmp_path), schema).collect())
        assert got == list(enumerate(want))
        places = spark.createDataFrame([(0,), (2,), (51,), (52,), (458,)], "sample_id long")
        io.write_raw_subset(spark, str(tmp_path), places, str(tmp_path / "out"))
        assert sorted(r.v for r in spark.read.schema("v string").json(str(tmp_path / "out")).collect()) == sorted(["a0", "b0", "b49", "d0", "e6"])
        spark.createDataFrame([(x,) for x in want], "v string").repartition(3).write.parquet(str(tmp_path / "p"))
        rows = io.with_line_ids(spark.read.parquet(str(tmp_path / "p"))).collect()
        assert sorted(r.sample_id for r in rows) == list(range(len(want))) and sorted(r.v for r in rows) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_incomplete_trajectories_are_errors(spark):
    full = [(i, c, float(10 * i + c)) for i in (1, 2) for c in (1, 4, 8)]
    df = spark.createDataFrame(full, "sample_id long, ckpt int, loss double")
    assert {r.sample_id: r.traj for r in losses.trajectories(df, checkpoints=[8, 4, 1]).collect()} == {1: [11.0, 14.0, 18.0], 2: [21.0, 24.0, 28.0]}
    assert losses.incomplete(df, [1, 4, 8]).count() == 0
    lacking = df.where("NOT (sample_id = 2 AND ckpt = 4)").unionByName(df.where("sample_id = 1 AND ckpt = 8"))
    for broken in (lacking, lacking.where("sample_id = 1")):
        with pytest.raises(Exception, match="sample_id"):
            losses.trajectories(broken, checkpoints=[1, 4, 8]).collect()
    assert sorted((r.sample_id, r.missing, r.repeated) for r in losses.incomplete(lacking, [1, 4, 8]).collect()) == [(1, [], [8]), (2, [4], [])]
    ragged = spark.createDataFrame([(1, [1, 2], 1), (2, [1, 2, 3, 4], 1)], "sample_id long, traj array<bigint>, k int").withColumn("s", F.lit(0))
    with pytest.raises(ValueError, match="from 2 to 4 features"):
        cluster.lloyd(ragged, ("s",), "k")


def test_high_loss_quotas_go_by_loss_and_carry_over(spark):
    kept = spark.createDataFrame([("d", "s", 0, 9, 1, 10), ("d", "s", 1, 2, 2, 10)], "domain string, source string, cluster_id int, size long, rank int, n_samples long")
    got = {r.cluster_id: r.quota for r in allocate.ordered_quotas(kept, ("domain", "source"), "rank").collect()}
    assert got == {0: 5, 1: 2}  # 7 of 10: what the last cluster can't use is dropped
    rows = [("d", "a", 0, 3, 1, 20), ("d", "b", 0, 9, 1, 30), ("d", "b", 1, 40, 2, 30), ("e", "c", 0, 50, 1, 60)]
    df = spark.createDataFrame(rows, "domain string, source string, cluster_id int, size long, rank int, n_rows long")
    got = {(r.source, r.cluster_id): r.quota for r in allocate.carried_quotas(df, ("domain", "source"), 60, "rank").collect()}
    assert got == {("a", 0): 3, ("b", 0): 9, ("b", 1): 19, ("c", 0): 29}  # a leaves 17 of its 20 to b and c


def test_the_guard_on_means_is_part_of_a_selection_by_softmax(spark):
    df = pool(spark)
    falling = df.withColumn("traj", F.reverse("traj"))
    config = SelectionConfig(method="learnability", softmax=True, size=20, niter=2).merged({})
    with pytest.raises(ValueError, match="highest mean loss"):
        select(falling, config)
    assert select(falling, config, df).selected.count() == 20  # it is about the losses that budgets come from


def test_ids_of_lines_have_no_gaps(spark):
    df = spark.range(1000).withColumn("x", F.xxhash64("id")).repartition(7, "x")
    got = sorted((r.n, r.x) for r in io.with_line_ids(df.where("id % 3 > 0"), order="x", name="n").collect())
    assert [n for n, _ in got] == list(range(666)) and [x for _, x in got] == sorted(x for _, x in got)


def test_names():
    assert io.name_of_subset("/a/run-1/data/labeled_idx.npy") == "run-1" and io.name_of_subset("/a/run-1/rows.npy") == "run-1-rows"
    assert io.free_name("a", ["b"]) == "a" and io.free_name("a", ["a", "a-2"]) == "a-3"
    assert io.matching_checkpoints(["checkpoint-10", "checkpoint-9", "x"], "checkpoint-*") == ["checkpoint-9", "checkpoint-10"] and io.matching_checkpoints(["x"], "") == ["."]
    assert io.loss_file_name("/data/Math-pool", 100, 56_370, prefixes={"math": "m"}) == "m-tokenwise-100token-56k" and io.loss_file_name("/x", -1, 7, True) == "tokenwise-prompt-full-7"


def test_tensor_seeds(spark):
    df = spark.createDataFrame([("layer.0", 0, 1.0), ("layer.0", 1, 1.0), ("b", 0, 2.0)], "name string, idx long, value double")
    for r in tensors.with_tensor_seeds(df, 42, 3).collect():
        assert r.tensor_seed == int.from_bytes(hashlib.blake2b(f"42:3:{r.name}".encode(), digest_size=8).digest(), "little") % (1 << 63)


def test_compat_adds_the_middle(spark):
    df = pool(spark)
    plain = select(df, SelectionConfig(method="high_loss_clusters", all_samples=True, niter=2).merged({})).selected.count()
    both = select(df, SelectionConfig(method="high_loss_clusters", all_samples=True, niter=2, size=50, compat=True).merged({})).selected.count()
    assert both > plain


def test_config_precedence_and_conflicts():
    assert SelectionConfig(size=5).merged({"seed": 7, "size": 9}) == SelectionConfig(size=5, seed=7).merged({})
    for bad in ({"method": "x"}, {"softmax": True, "n_clusters": 3}, {"n_sample_per_cluster": 4}, {"all_samples": True}, {"method": "learnability_baseline", "checkpoints": "1-3"}, {"method": "longest_reasoning", "checkpoints": "1"}, {"cluster_features": "z"}):
        with pytest.raises(ValueError):
            SelectionConfig(size=5, **bad).merged({})
    with pytest.raises(ValueError):
        SelectionConfig().merged({})
    with pytest.raises(ValueError):
        SelectionConfig(size=1).merged({"unknown": 1})


def test_columns_are_required(spark):
    with pytest.raises(ValueError, match="domain"):
        require(spark.range(1), "domain", "source")


# -- conversations -----------------------------------------------------------------------------------------


def test_reasoning_samples(spark):
    df = spark.createDataFrame([("p", " abc\n", "\tde ")], "prompt string, reasoning string, answer string")
    content = one(convert.reasoning_sample(df, "medical")).conversations[1].content
    assert content == "<|im_start|>think\nabc\n<|im_start|>answer\nde\n<|im_end|>\n"
    with pytest.raises(Exception, match="no answer"):
        convert.reasoning_sample(df.withColumn("answer", F.lit("")), "medical").collect()


def test_math_samples(spark):
    turns = [Row(role=None, content=None, **{"from": "human", "value": "q"}), None, Row(role="system", content="c", **{"from": None, "value": None}), Row(role=None, content=None, **{"from": "tool", "value": "t"})]
    df = spark.createDataFrame([("pr", None, turns, True), ("pr", None, turns, None), ("pr", "x", turns, False)], "problem string, prompt string, conversations array<struct<role:string,content:string,`from`:string,value:string>>, correct boolean")
    row = one(convert.math_sample(df))
    assert row.prompt == "pr" and row.domain == "math" and [tuple(t) for t in row.conversations] == [("user", "q"), ("system", "c"), ("tool", "t")]


def test_reasoning_lengths(spark):
    def length(text):
        return one(spark.createDataFrame([(text, 7)], "t string, i long").select(convert.reasoning_length(F.col("t"), F.col("i")).alias("n"))).n

    assert length("<|im_start|>think\nabc\n<|im_start|>answer\nde\n<|im_end|>") == 9
    assert length("<|im_start|>think\nabc\n<|im_start|>answer\nde") == 8
    assert length("<|begin_of_thought|>hello<|end_of_thought|>") == 5
    for bad in ("plain", "<|im_start|>think only", "<|begin_of_thought|>open"):
        with pytest.raises(Exception, match="sample 7"):
            length(bad)


def test_prompt_parts(spark):
    df = spark.createDataFrame([([("A", "x"), ("B", "y. z")], "q", "hello ", "stop")], "o array<struct<letter:string,text:string>>, q string, t string, r string")
    row = one(df.select(convert.option_string(F.col("o")).alias("s"), convert.question_prompt(F.col("q"), F.col("o"), "pre", "post").alias("p"), convert.continuation(F.col("t")).alias("c"), convert.end_prefix(F.col("r"), "too long", "answer:\n").alias("e")))
    assert (row.s, row.p, row.c, row.e) == ("A. x\nB. y. z", "pre\nq\nA. x\nB. y. z\npost", "hello  Wait", "answer:\n")
    assert one(df.select(convert.parse_options(F.lit("A. x\nnothing\n B. y. z ")).alias("o"))).o == [Row(letter="A", text="x"), Row(letter="B", text="y. z")]
    with pytest.raises(Exception, match="unknown finish reason"):
        df.select(convert.end_prefix(F.lit("odd"), "a", "b")).collect()


# -- answers -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "want"), [("so \\boxed{B}", "B"), ("\\boxed{\\text{B. Foo}}", "B. Foo"), ("\\boxed{x = 3}", "3"), ("\\boxed{A} then \\boxed{C", "\\boxed{A} then \\boxed{C"), ("\\fbox{D}", "\\fbox{D}"), ("\\boxed{\\frac{1}{2}}", "\\frac{1}{2}"), ("none", "none"), (None, None), ("", "")])
def test_boxed(text, want):
    assert answers.boxed_answer(text) == want


OPTIONS = "A. aspirin\nB. ibuprofen\nC. codeine"


@pytest.mark.parametrize(("text", "want"), [("The answer is B", "B"), ("I think (C).", "C"), ("A patient took B.", "B"), ("aspirin or ibuprofen", "B"), ("ibuprofin", "B"), ("## Final Response\n\nanswer is A", "A"), ("answer is A, no, answer is C", "C"), ("选B吧", "B")])
def test_choices(text, want):
    assert answers.chosen_letter(text, OPTIONS) == want


def random_texts(alphabet, n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_boxes_as_expressions(spark):
    texts = [None, "", "\\boxed{a = {b = c}}", "{}}\\boxed{é{}}", "\\fbox{\\text{x}}", "\\boxed", "\\boxed{}", "\\text{ a=  b}", "🤦\\boxed{🤦} }"] + random_texts(["\\boxed", "\\fbox", "\\text", "{", "}", "{", "}", "=", " ", "x", "é"], 3000, 14, 1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", answers.boxed(F.col("t")).alias("b"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.i: r.b for r in df.collect()} == {i: answers.boxed_answer(t) for i, t in enumerate(texts)}


def test_choices_as_expressions(spark):
    parts = ["answer is", "is ", "A", "B", "C", "D", "A ", "a ", " ", "\n", "中", "是", "项", "é", "_", "1", "½", "\u0301", "*", "(", ")", "'", '"', "#", ".", "\x1c", "## Final Response\n\n", "aspirin", "IBUPROFEN", "code", "x"]
    lines = ["A. aspirin\nB. ibuprofen\nC. codeine", "A. x\nB. aspirin\n  A. y. z \nnothing", "", "no options", "A. \nB. b", None, "D. code\nB. Code"]
    rows = [(i, t, lines[i % len(lines)]) for i, t in enumerate([None, *random_texts(parts, 4000, 9, 2)])]
    df = spark.createDataFrame(rows, "i int, t string, o string")
    strict = df.select(answers.strict_choice(F.col("t"), F.col("o")).alias("c"))
    assert "Python" not in strict._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.c for r in answers.with_choice(df, F.col("t"), F.col("o"), "c").collect()}
    assert {i: c for i, c in got.items() if c != answers.chosen_letter(*rows[i][1:])} == {}


def test_closest_is_the_full_comparison(spark):
    import difflib

    rng = random.Random(3)
    for _ in range(400):
        options = random_texts("abcd ", rng.randint(1, 6), 12, rng.random())
        target = rng.choice([*options, "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 40)))])
        ratios = [difflib.SequenceMatcher(None, o, target).ratio() for o in options]
        assert answers.closest(options, target) == max(range(len(options)), key=lambda i: (ratios[i], i))
    began = time.perf_counter()
    long = " ".join(random_texts("abcdefghijklmnopqrstuvwxyz", 15_000, 12, 4))[:100_000]
    assert answers.closest([long[:200], "zz" * 50, "quite another", long[500:600]], long) in range(4) and time.perf_counter() - began < 10


def test_scoring(spark):
    rows = [("Aspirin", "A", "aspirin", "s"), ("a. aspirin", "A", "aspirin", "s"), ("a", "A", "aspirin", "s"), ("The answer is A", "A", "aspirin", "t"), ("codeine", "A", "aspirin", "t"), (None, "A", "aspirin", "t")]
    df = spark.createDataFrame([(*r, OPTIONS, "q") for r in rows], "extracted_answer string, answer_idx string, answer string, source string, option_str string, question string")
    scored = score.scored(df)
    assert [r.correct for r in scored.collect()] == [True, True, True, True, False, False]
    assert {r.source: (r.correct_count, r.total_count) for r in score.accuracy(scored).collect()} == {"s": (3, 3), "t": (1, 3)}
    metrics = spark.createDataFrame([("r", "NEJM", 0.5), ("r", "zz", 0.1), ("r", "Lancet", 0.2), ("q", "NEJM", 0.9)], "run string, source string, accuracy double")
    assert score.pivoted(metrics).columns == ["run", "Lancet", "NEJM", "zz"]
    answers.register(spark)
    assert one(spark.sql("SELECT extract_answer('\\\\boxed{7}') AS a")).a == "7"


def test_metrics_documents(spark):
    texts = ['{"A": {"accuracy": 0.5}, "B": 0.25}', '{"results": {"C": {"accuracy_avg": 1.0}}}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.m for r in df.select(score.accuracy_of_json(F.col("t")).alias("m")).collect()] == [{"A": 0.5, "B": 0.25}, {"C": 1.0}]


# -- tensors -----------------------------------------------------------------------------------------------


def test_schedules():
    assert [round(x, 6) for _, _, x in tensors.lambda_schedule(4, 10)] == [1.767767, 2.303004, 2.410713, 2.449373]
    assert [round(x, 6) for _, _, x in tensors.lambda_schedule(8, 10, 1)][:2] == [0.707107, 1.142189]
    assert [round(x, 8) for _, x in tensors.gaussian_schedule(8, 2e-3, 8e-3)][:3] == [0.002, 0.00354562, 0.00459814]
    assert tensors.lambda_schedule(1, 10, 1)[0][1] == 10
    for bad in ((4, 0.0), (4, 1.0, -1.0), (4, 1.0, 2.0)):
        with pytest.raises(ValueError):
            tensors.lambda_schedule(*bad)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.floats(0.1, 50))
def test_steps_reach_their_radii(n, radius):
    total, squares = 0.0, 0.0
    for _, r, step in tensors.lambda_schedule(n, radius):
        total, squares = total + step, squares + step**2
        assert math.sqrt((total**2 + squares) / 1) >= r * 0.7


def test_distances_and_directions(spark):
    rows = [("a", "w", 0, 0.0), ("a", "w", 1, 0.0), ("b", "w", 0, 3.0), ("b", "w", 1, 4.0), ("a", "Embed", 0, 0.0), ("b", "Embed", 0, 9.0)]
    params = spark.createDataFrame(rows, "model string, name string, idx long, value double")
    row = one(tensors.distance(params, "a", "b", 10.0))
    assert (row.actual_distance, row.num_params, round(row.l2_per_sqrt_d, 6), row.actual_over_target) == (5.0, 2, 3.535534, 0.5)
    unit = tensors.direction(params, "a", "b")
    assert {r.idx: r.value for r in unit.collect()} == {0: 0.6, 1: 0.8}
    moved = tensors.directional_step(params.where("model = 'a'"), unit, 2.0, 1).collect()
    assert {r.name for r in moved} == {"w", "Embed"} and next(r for r in moved if r.name == "Embed").value == 0.0
    with pytest.raises(Exception, match="zero"):
        tensors.direction(params, "a", "a").collect()


def test_noise_is_normal_and_repeatable(spark):
    params = spark.range(20_000).select(F.lit("m").alias("model"), F.lit("w").alias("name"), F.col("id").alias("idx"), F.lit(0.0).alias("value"))
    made = tensors.gaussian_perturb(params, 2.0, 42)
    row = one(made.agg(F.avg("value").alias("m"), F.stddev("value").alias("s")))
    assert abs(row.m) < 0.06 and abs(row.s - 2) < 0.06
    again = tensors.gaussian_perturb(params.repartition(3), 2.0, 42)
    assert made.exceptAll(again).count() == 0


def test_the_least_step_counts_as_moved(spark, tmp_path):
    """Element 25,015,677 of layer1 gets noise so near -1 that its step is below 1e-9; DuckDB says how many move."""
    import duckdb

    from tamis.plans import catalog

    spark.range(390_600, 391_000).selectExpr("id AS vec_id", "array_repeat(0.5F, 64) AS embedding", "1 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = one(catalog.queries()["directional_steps"](spark, str(tmp_path)))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        assert tuple(got) == db.execute(catalog.oracle_sql()["directional_steps"]).fetchone()


def test_weighted_losses(spark):
    df = spark.createDataFrame([(1, [1.0, float("inf"), None]), (1, [3.0]), (2, []), (3, [8.0])], "ckpt int, losses array<double>")
    rows = {r.ckpt: r for r in tensors.against_base(tensors.weighted_loss(df), 1).collect()}
    assert (rows[1].loss, rows[1].tokens, rows[3].ratio, rows[2].loss) == (2.0, 2, 4.0, 0.0)
    flat = spark.createDataFrame([(1, 1 << 60), (1, 1), (2, None)], "ckpt int, loss long")
    assert {tuple(r) for r in tensors.weighted_loss(flat).collect()} == {(1, float((1 << 60) + 1) / 2, 2), (2, 0.0, 0)}


@pytest.mark.parametrize("series", ["perturbation", "training"])
def test_losses_of_all_tokens(spark, monkeypatch, series):
    """The same losses as sample by sample, of frequent and rare words, negative ids, a text of many words and texts without any."""
    monkeypatch.setattr(losses, "FREQUENT", 10)
    rows = [(-5, "a b\ta\u00c4 b"), (1, None), (2, " \n "), (3, "a " * 30_000 + "end"), (4, " ".join(f"w{i % 700}" for i in range(5_000)))]
    df = spark.createDataFrame(rows, "sample_id long, text string")
    made = losses.surrogate_losses(df, [1, 8], series)
    flat = [losses.surrogate_token_losses(df, j, series).select(F.lit(j).alias("ckpt"), F.explode("losses").alias("loss")) for j in (1, 8)]
    counted = lambda x: {(r.ckpt, r.loss): r["count"] for r in x.groupBy("ckpt", "loss").count().collect()}
    assert counted(made) == counted(flat[0].unionByName(flat[1])) and made.count() == 2 * 35_005
    assert losses.surrogate_losses(df.where("sample_id IN (1, 2)"), [1, 8], series).count() == 0


def test_losses_of_all_tokens_take_less_disk_than_texts(spark, tmp_path):
    """Shuffled tokens of each checkpoint, put together by sample, took several times the texts."""
    from tamis.operators.common import shared_folder
    from tamis.plans import catalog

    drawn = random.Random(1)
    texts = [(i, " ".join(f"word{int(drawn.paretovariate(0.4)) % 200_000}" for _ in range(1_000)), "en", "web") for i in range(1_000)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    folders = [shared_folder(spark).removeprefix("file:"), *local]

    def used():
        sizes = {}
        for path in (os.path.join(at, f) for folder in folders for at, _, files in os.walk(folder) for f in files):
            with contextlib.suppress(FileNotFoundError):  # Spark cleans up meanwhile
                sizes[path] = os.path.getsize(path)
        return sizes

    before = used()
    catalog.queries()["token_weighted_loss"](spark, str(tmp_path)).collect()
    assert 0 < sum(n for f, n in used().items() if f not in before) < sum(len(t[1]) for t in texts)


# -- files -------------------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt":"x"}\n{"prompt":"y"}\n')
    (tmp_path / "a.json").write_text('[{"prompt":"x"},\n{"prompt":"y"}]')
    (tmp_path / "b.jsonl").write_text('{"prompt":"x"}\n\n{"prompt":"y"}\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("prompt", T.StringType())])
    for name in ("a.jsonl", "a.json"):
        assert [r.prompt for r in io.read_samples(spark, str(tmp_path / name), schema).collect()] == ["x", "y"]
    assert io.read_json_lines(spark, str(tmp_path / "b.jsonl"), schema).count() == 2
    ids = io.with_line_ids(spark.range(50).repartition(4).withColumnRenamed("id", "v"), order="v").orderBy("sample_id").collect()
    assert [r.sample_id for r in ids] == list(range(50)) == [r.v for r in ids]
    samples = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "sample_id long, prompt string")
    io.write_selected(samples, samples.limit(2), str(tmp_path / "sel"))
    assert spark.read.json(str(tmp_path / "sel")).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_selected(samples, samples.limit(2), str(tmp_path / "sel"))
    io.write_losses(spark.createDataFrame([(1, 1, "full", 0.5), (1, 2, "full", 0.7)], "sample_id long, ckpt int, window string, loss double"), str(tmp_path / "loss"))
    pruned = losses.prune_checkpoints(io.read_losses(spark, str(tmp_path / "loss"), "full"), "2")
    assert pruned.count() == 1 and "PartitionFilters: [isnotnull" in pruned._jdf.queryExecution().executedPlan().toString()
    suite = '{"S": [{"question": "q", "options": {"B": "y", "A": "x"}, "answer_idx": "A", "answer": "x"}], "HumanityLastExam": [{"question": "h"}]}'
    (tmp_path / "suite.json").write_text(suite)
    row = one(io.read_eval_suite(spark, str(tmp_path / "suite.json")))
    assert row.source == "S" and [o.letter for o in row.options] == ["A", "B"]
    import hashlib

    good = hashlib.md5(suite.encode()).hexdigest()
    assert io.md5_faults(spark, str(tmp_path / "suite.json"), good).count() == 0 and io.md5_faults(spark, str(tmp_path / "suite.json"), "0").count() == 1
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "metrics.json").write_text("{}")
    assert one(io.find_metrics(spark, str(tmp_path / "runs"))).run == "r1"


def test_versions_suffixes_and_runs():
    assert io.next_version(["version_2", "x", "version_10"]) == "version_11" and io.next_version([]) == "version_0"
    assert [io.token_suffix(n) for n in (100, 1000, -1)] == ["100", "1k", "full"]
    assert io.run_name("learnability", 1000, 42, "1-8", "my-hard_set", True) == "learnability-ckpt1-8-sub-mhs-softmax-n1000-seed42"
    assert '"formatting": "sharegpt"' in io.dataset_info("d", "train.jsonl")


def test_row_wise_operators_run_on_streams(spark, tmp_path):
    spark.createDataFrame([([1.0, 3.0],), ([],)], "losses array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("losses array<double>").parquet(str(tmp_path / "in"))
    query = losses.prefix_means(stream, [1, -1]).writeStream.format("memory").queryName("prefix_means_stream").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.mean_full for r in spark.table("prefix_means_stream").collect()) == [0.0, 2.0]


def brute_lloyd(points, k, rounds):
    """ident -> (cluster, dist) by whole-number k-means from the first k by md5."""
    order = sorted(points, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    centers = [points[i] for i in order[:k]]
    toward = lambda n, d: abs(n) // d * (1 if n >= 0 else -1)
    for done in range(rounds + 1):
        near = {i: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), n) for n, c in enumerate(centers)) for i, p in points.items()}
        if done < rounds:
            own = [[points[i] for i, (_, m) in near.items() if m == n] for n in range(k)]
            centers = [[toward(sum(x), len(o)) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, centers, strict=True)]
    return {i: (n, d) for i, (d, n) in near.items()}


def test_full_queries_run_twenty_rounds_over_the_main_window(spark):
    from tamis.plans import catalog

    sf = "/root/testdata/sf0.001"
    got = {r.sample_id: (r.cluster_id, r.dist) for r in catalog.queries()["kmeans_lloyd_losses"](spark, sf).collect()}
    points = {}
    for r in losses.surrogate_trajectories(catalog.samples(spark, sf), catalog.CKPTS, 1000).collect():
        points.setdefault(r.domain, {})[r.sample_id] = list(r.traj)
    runs = {rounds: {i: x for of in points.values() for i, x in brute_lloyd(of, 5, rounds).items()} for rounds in (3, 20)}
    assert got == runs[20] != runs[3]
    vectors = {r.vec_id: list(r.traj) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", cluster.quantize(F.col("embedding")).alias("traj")).collect()}
    best = {}
    for i, (n, d) in brute_lloyd(vectors, 10, 20).items():
        best[n] = min(best.get(n, (d, i)), (d, i))
    assert {r.cluster_id: r.sample_id for r in catalog.queries()["embedding_medoids"](spark, sf).collect()} == {n: i for n, (_, i) in best.items()}


def test_blocks_give_what_elements_give(spark):
    rows = [(m, n, i, (i % 5) * 0.5 + k * (i % 3)) for k, m in enumerate(("a", "b", "c")) for n, size in (("layer.0", 11), ("embed", 4), ("w", 3)) for i in range(size)]
    params = spark.createDataFrame(rows, "model string, name string, idx long, value double")
    blocks = tensors.blocked(params, 4)
    assert sorted(map(tuple, tensors.unblocked(blocks, 4).collect())) == sorted(rows)
    made = {r.model: r for r in tensors.distances(blocks, "a", {"b": 2.0, "c": 0.0}).collect()}
    for m in ("b", "c"):
        want = one(tensors.distance(params, "a", m))
        assert made[m].actual_distance == pytest.approx(want.actual_distance) and made[m].num_params == want.num_params == 14
    assert made["b"].actual_over_target == pytest.approx(made["b"].actual_distance / 2) and made["c"].actual_over_target == float("inf")
    unit = tensors.direction_blocks(blocks, "a", "b")
    per_element = {(r["name"], r.idx): r.value for r in tensors.direction(params, "a", "b").collect()}
    flat = {(r["name"], r.idx): r.value for r in tensors.unblocked(unit.withColumn("model", F.lit("u")), 4).collect()}
    assert flat == pytest.approx(per_element)
    with pytest.raises(ValueError, match="zero"):
        tensors.direction_blocks(blocks, "a", "a")
    base = params.where("model = 'a'")
    noisy = {(r["name"], r.idx): r.value for r in tensors.gaussian_perturb(base, 0.5, 7).collect()}
    assert {(r["name"], r.idx): r.value for r in tensors.unblocked(tensors.gaussian_blocks(blocks.where("model = 'a'"), 0.5, 7, size=4), 4).collect()} == pytest.approx(noisy)
    # two steps by element are the second checkpoint
    schedule = tensors.lambda_schedule(2, 3.0)
    steps = base
    for j, _, lam in schedule:
        steps = tensors.directional_step(steps, tensors.direction(params, "a", "b"), lam, 7, j)
    want = {(r["name"], r.idx): r.value for r in steps.collect()}
    got = tensors.unblocked(tensors.directional_checkpoints(blocks.where("model = 'a'"), unit, schedule, 7, 4), 4).where("model = 'checkpoint-2'").collect()
    assert {(r["name"], r.idx): r.value for r in got} == pytest.approx(want)
    with pytest.raises(Exception, match="gaps"):
        tensors.blocked(params.where("idx <> 1"), 4).collect()
    plan = tensors.distances(blocks, "a")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # whatever the number of models


def test_scoring_goes_on_where_it_stopped(spark, tmp_path):
    import os

    from tamis.operators import providers

    class Scorer:
        """Losses are the words' lengths; what it was made for and given is written down."""

        def __init__(self, checkpoint, folder):
            self.checkpoint, self.folder = checkpoint, folder

        def losses(self, prompts, responses, most):
            import uuid

            with open(f"{self.folder}/{self.checkpoint}-{uuid.uuid4().hex}", "w") as file:
                file.write(str(len(responses)))
            if "break" in prompts:
                raise RuntimeError("broken off")
            return [[float(len(w)) for w in r.split()] for r in responses]

    seen = tmp_path / "seen"
    seen.mkdir()
    folder, path = str(seen), str(tmp_path / "losses")
    make = lambda c: Scorer(c, folder)
    df = spark.createDataFrame([(i, "p", "w " * i) for i in range(10)], "sample_id long, prompt string, response string")
    assert providers.store_token_losses(df, make, [1, 2], path) == {1: 10, 2: 10}
    for name in os.listdir(folder):
        os.remove(f"{folder}/{name}")
    assert providers.store_token_losses(df, make, [1, 2], path) == {} and not os.listdir(folder)  # no model is made
    more = df.unionByName(spark.createDataFrame([(50, "p", None)], df.schema))
    assert providers.store_token_losses(more, make, [1, 2, 4], path) == {1: 1, 2: 1, 4: 11}
    with pytest.raises(Exception, match="broken off"):
        providers.store_token_losses(df.withColumn("prompt", F.when(F.col("sample_id") == 3, "break").otherwise(F.col("prompt"))), make, [8], path)
    assert providers.store_token_losses(df, make, [8], path) == {8: 10}  # nothing of the broken run counts
    spark.read.parquet(f"{path}/ckpt=4").write.mode("append").parquet(f"{path}/ckpt=4")
    rows = providers.stored_losses(spark, path).collect()
    assert len(rows) == 11 + 11 + 11 + 10 and all(len(r.losses) == (r.sample_id if r.sample_id < 50 else 0) for r in rows)
    assert providers.by_length([5, 1, 9, 1, 100], 12) == [[1, 3], [0], [2], [4]] and providers.by_length([]) == []


def test_outputs_appear_together_or_not_at_all(spark, tmp_path):
    import json
    import os
    from concurrent.futures import ThreadPoolExecutor

    target = str(tmp_path / "runs" / "x")
    with pytest.raises(RuntimeError, match="killed"), io.staged(spark, target) as folder:
        io.write_subset(spark.range(3).withColumnRenamed("id", "sample_id"), f"{folder}/ids")
        raise RuntimeError("killed")
    assert os.listdir(tmp_path / "runs") == []  # a retry isn't blocked
    with io.staged(spark, target) as folder:
        io.write_subset(spark.range(3).withColumnRenamed("id", "sample_id"), f"{folder}/ids")
        assert not os.path.exists(target)
        io.write_sidecar(spark.range(1), f"{folder}/side")
    with open(f"{target}/{io.MANIFEST}") as file:
        assert set(json.load(file)["outputs"]) == {"ids", "side"}
    assert spark.read.parquet(f"{target}/ids").count() == 3
    with pytest.raises(FileExistsError), io.staged(spark, target):
        pass
    with pytest.raises(FileExistsError), io.staged(spark, str(tmp_path / "late")) as folder:
        os.mkdir(tmp_path / "late")
    with ThreadPoolExecutor(8) as pool_:
        made = list(pool_.map(lambda _: io.claim_version(spark, str(tmp_path / "versions")), range(8)))
    assert sorted(made) == sorted(f"{tmp_path}/versions/version_{n}" for n in range(8))
    assert io.claim_version(spark, f"file://{tmp_path}/versions").endswith("version_8")
