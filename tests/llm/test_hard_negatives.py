"""Hard negatives against all inner products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import hard_negatives
from tamis.llm.runtime import stored

SCHEMA = "vec_id long, embedding array<double>, label int, id string, key int"


def expected(rows, scale=256.0):
    """(anchor, positive, rank, negative, positive score, negative score) of (id, vector, label), ids divisible by 10 being anchors."""
    fit = [(i, tuple(int(np.floor(scale * x)) for x in v), label) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    fit = sorted(set(fit))
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, v, label in fit:
        if i % 10:
            continue
        others = [(-product(v, w), j, m) for j, w, m in fit if j != i]
        for s, j, _ in sorted(x for x in others if x[2] == label)[:5]:
            hard = sorted(x for x in others if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, scale=256.0, parts=4):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, hard_negatives.mine(hard_negatives.taking_part(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 10 == 0, scale)).collect()))


def clustered(n, width, seed):
    """Vectors around a few centers, so that most keys are beyond the bound."""
    random_ = np.random.default_rng(seed)
    centers = random_.normal(size=(12, width)) * 3
    return [(int(i), (centers[i % 12] + random_.normal(size=width) * 0.2).tolist(), int(random_.integers(3))) for i in range(n)]


def noise(n, width, seed):
    random_ = np.random.default_rng(seed)
    return [(int(i), random_.normal(size=width).tolist(), int(random_.integers(4))) for i in range(n)]


AWKWARD = [
    (0, [1.0, 2.0], 1),
    (0, [1.0, 2.0], 1),  # a repeat
    (0, [0.5, 2.0], 2),  # another row of the same id
    (10, [0.0, 0.0], 1),
    (20, [-1.0, -1.0], 1),
    (30, [1.0], 2),  # narrower
    (40, [], 1),
    (50, [float("nan"), 1.0], 1),
    (60, [1.0, None], 1),
    (70, None, 1),
    (80, [1.0, 1.0], None),
    (None, [9.0, 9.0], 2),
    (90, [float("inf"), 0.0], 2),
    *[(100 + i, [1.0, 1.5], i % 3) for i in range(60)],  # ties
    (-10, [2.0, 2.0], 0),
]


@pytest.mark.parametrize("rows", [clustered(400, 8, 1), noise(300, 16, 2), AWKWARD, [(i, [1.0, 0.0], i % 2) for i in range(500)], noise(4, 3, 3), [(10, [1.0], 1)]], ids=["clusters", "noise", "awkward", "all alike", "few", "one"])
def test_like_all_inner_products(spark, monkeypatch, rows):
    monkeypatch.setattr(hard_negatives, "RUN_ROWS", 37)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 5)
    assert mined(spark, rows) == expected(rows)


def test_large_and_whole_numbers(spark):
    rows = [(i, [float(random.Random(i).randrange(-(1 << 26), 1 << 26)) for _ in range(4)], i % 2) for i in range(80)]
    assert mined(spark, rows, 1.0) == expected(rows, 1.0)
    with pytest.raises(ValueError, match="56 bits"):
        mined(spark, [(0, [1e12], 1), (1, [1e12], 2)])


def test_keys_prune_what_is_far(spark):
    """Of clustered rows most runs are never looked into, and searches end at a radius."""
    rows = spark.createDataFrame([(i, v, m, "x", 1) for i, v, m in clustered(1200, 8, 4)], SCHEMA)
    rows = hard_negatives.taking_part(rows, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 100 == 0, 256.0)
    space = hard_negatives.space_of(rows)
    index = hard_negatives.keyed(rows, space)
    runs = stored(hard_negatives.packed(index, space, 25, queries=False), "runs")
    blocks = hard_negatives.started(hard_negatives.packed(index.where("asks"), space, 4, queries=True), 1, 5)
    done = hard_negatives.searched(blocks, runs, space, True, 1, 5).collect()
    assert done and max(r.done for r in done) < space.reach
    looked = [max(0, run.low - r.high[run.pivot], r.low[run.pivot] - run.high) <= r.done for r in done for run in runs.collect()]
    assert sum(looked) < len(looked) / 2


def test_names_clash_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(hard_negatives.taking_part(empty, "vec_id", "embedding", F.col("label"), F.lit(True), 256.0)).count() == 0
    some = spark.createDataFrame([(1, [1.0], 1, "x", 1)], SCHEMA)
    assert hard_negatives.mine(hard_negatives.taking_part(some, "vec_id", "embedding", F.col("label"), F.lit(False), 256.0)).count() == 0


def test_query_at_the_smallest_size(spark, sf):
    from tamis.llm.queries import QUERIES

    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = [x for x in expected(rows) if x[0] % 100 == 0]
    assert sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, sf).collect())) == want
