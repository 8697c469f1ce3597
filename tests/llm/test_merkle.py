"""Merkle manifests against a plain recursive version."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tamis.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fanout):
    """The root, and for each leaf the (left, right) siblings by level."""
    paths, places, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for path, place in zip(paths, places, strict=True):
            run, at = runs[place // fanout], place % fanout
            path.append(("".join(run[:at]), "".join(run[at + 1 :])))
        places = [p // fanout for p in places]
        nodes = [digest("".join(r)) for r in runs]
    return nodes[0], paths


def expected(rows, fanout):
    """(group, leaf, subroot, root, siblings) of rows of (id, group, text)."""
    groups = {}
    for ident, group, text in rows:
        groups.setdefault(group, []).append(((ident is not None, ident or 0), leaf_of(ident, group, text)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[1] for x in sorted(groups[g])], fanout) for g in names}
    root, above = tree([trees[g][0] for g in names], fanout)
    return sorted((str(g), x[1], trees[g][0], root, "".join(a + b for a, b in path + above[n])) for n, g in enumerate(names) for x, path in zip(sorted(groups[g]), trees[g][1], strict=True))


def found(manifest):
    hexed = lambda a, b: F.lower(F.hex(F.concat(a, b)))
    rows = manifest.proofs().select("g", "leaf", "subroot", "root", F.array_join(F.zip_with("left", "right", hexed), "").alias("s"), merkle.folded(F.col("leaf"), F.col("left"), F.col("right")).alias("again")).collect()
    assert all(r.again == r.root for r in rows)
    return sorted((str(r.g), r.leaf, r.subroot, r.root, r.s) for r in rows)


def manifest_of(spark, rows, fanout, levels, parts=3):
    df = spark.createDataFrame(rows, "id long, g string, t string").repartition(parts)
    return merkle.build(df.withColumn("leaf", merkle.leaf(F.col("id"), F.col("g"), F.col("t"))), "g", ["id"], fanout=fanout, levels=levels)


CASES = {
    "many": [(i, random.Random(i).choice(["hot", "hot", "b", "é", None]), f"text {i}") for i in range(150)],
    "singles": [(1, "a", "x"), (2, "b", ""), (3, None, None), (None, "", "y")],
    "one": [(7, "only", "x")],
    "repeats and nulls": [(1, "a", None), (1, "a", None), (1, "a", "z"), (None, "a", "q"), (None, None, "q" * 5000), (2, "=", "x")] * 3,
    "sixteen to seventeen": [(i, "a" if i < 16 else "b", "x") for i in range(33)],
}


@pytest.mark.parametrize(("name", "fanout", "levels"), [("many", 2, 2), ("many", 16, 3), ("singles", 16, 3), ("one", 16, 3), ("repeats and nulls", 3, 1), ("sixteen to seventeen", 16, 1)])
def test_like_a_recursive_tree(spark, name, fanout, levels):
    assert found(manifest_of(spark, CASES[name], fanout, levels)) == expected(CASES[name], fanout)


def test_the_root_does_not_depend_on_partitions_or_superblocks(spark):
    roots = {manifest_of(spark, CASES["many"], 2, levels, parts).root for levels, parts in ((1, 1), (3, 7))}
    assert roots == {expected(CASES["many"], 2)[0][3]}


def test_changed_leaves_are_found_from_the_roots_down(spark, tmp_path):
    rows = [(i, "a" if i < 60 else "b", f"t{i}") for i in range(80)]
    other = [(i, g, t.upper() if i in (17, 70) else t) for i, g, t in rows] + [(1000, "b", "new"), (5, "c", "x")]
    for name, table in (("x", rows), ("y", other)):
        merkle.write(manifest_of(spark, table, 2, 2), str(tmp_path / name))
    got = {(r.group_name, r.place) for r in merkle.changed(spark, str(tmp_path / "x"), str(tmp_path / "y"), 2, 2).collect()}
    assert got == {("a", 17), ("b", 10), ("b", 20), ("c", 0)}
    assert merkle.changed(spark, str(tmp_path / "x"), str(tmp_path / "x"), 2, 2).count() == 0


def test_names_clash_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "x", 5, 6, 7)], "id long, g string, leaf string, root int, left int, n int")
    made = merkle.build(df.withColumn("leaf", merkle.leaf(F.col("id"))), "g", ["id"]).proofs()
    assert set(made.columns) == {"id", "g", "n", "leaf", "subroot", "root", "left", "right"} and made.first().root == made.first().leaf == leaf_of(1)
    empty = merkle.build(df.limit(0).withColumn("leaf", F.lit("")), "g", ["id"])
    assert empty.root is None and empty.proofs().count() == 0 and empty.subroots().count() == 0


def test_subroots_have_their_rows(spark):
    rows = {(r.group_name, r.rows) for r in manifest_of(spark, CASES["singles"], 16, 3).subroots().collect()}
    assert rows == {("a", 1), ("b", 1), (None, 1), ("", 1)}
