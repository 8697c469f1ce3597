"""SimHash near-dedup with vantage-point trees.

A fingerprint has a bit for each of 64 (or more) hash bits: 1 if more than half of the text's shingles have it
set. Fingerprints link at few differing bits; groups are the components of that relation.

Links are found exactly. Different fingerprints are dealt to shards by a vantage-point tree over Hamming
distance, fitted on a bounded sample: at a node with vantage point v and limit m, those within m + radius go
inside and those beyond m go outside, so that any linked pair meets in at least one shard, and pairs on
different sides are met by the copies that cross the boundary. A shard is one task's work, which goes on with
a tree of its own down to leaves that are compared in full; it returns a spanning forest of its links, never
all pairs. Components come from alternating large and small stars over those edges.

A shard holds about LEAF_ROWS fingerprints times the copies across boundaries; equal fingerprints are one. The
first tree's size is bounded by its sample, so for very many fingerprints its shards are too large: those of more than
SHARD_ROWS are dealt again by trees of their own, each fitted on a sample of its shard, until all are small or none
can be told apart any further (more than SHARD_ROWS different fingerprints of which most are within a few
bits of each other; such a shard is one task, in memory in proportion to it). A task handles a shard or two.

Null texts and texts without words have fingerprint zero, which links like any other; very long texts are hashed whole,
in time and memory in proportion to them. Repeated rows have equal
fingerprints and so share a component. Rows with a null id get the component of their fingerprint but never
name one, unless all of its ids are null. An empty table gives an empty result. Other columns pass through;
earlier columns of the outputs' names are replaced.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Callable
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.runtime import broadcast_if_small, join_in_parts, map_rows, release, small_batches, written

SEED = 42
#: The tree is fitted on so many fingerprints at most, drawn by hash; a shard aims at leaf_rows of them.
SAMPLE_ROWS, LEAF_ROWS, SAMPLE_PER_LEAF = 32_768, 4_096, 32
MAX_LEAVES = SAMPLE_ROWS // SAMPLE_PER_LEAF
#: Larger shards are dealt again, by trees fitted on so many of their rows, at most so often and while all trees fit so many bytes.
SHARD_ROWS, SHARD_SAMPLE, LEVELS, TREE_BYTES = 32_768, 4_096, 4, 64 << 20
#: Leaves up to this size are compared in full.
FULL_ROWS = 512
#: So many edges are contracted by one task at a time.
RUN_EDGES = 200_000


# -- fingerprints -----------------------------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of so many words, A-Z in lower case; of the whole sequence if it is shorter."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [joined[a:b] for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def with_fingerprints(df: DataFrame, text: str = "text", words: int = 3, name: str = "fp", drop_text: bool = False) -> DataFrame:
    """df with the 64-bit fingerprint as a signed integer."""

    def start():
        return lambda texts: [np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)]

    return map_rows(df, [text], [T.StructField(name, T.LongType())], start, [text] if drop_text else None)


# -- links ------------------------------------------------------------------------------------------------


def distances(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Differing bits of each row of points (n, words) from one (words)."""
    return np.bitwise_count(points ^ one).sum(axis=1, dtype=np.int64)


def forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links within the radius connect. points: (n, words) unsigned, all different."""
    parent = list(range(len(points)))
    edges: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((i, j))

    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        own = points[rows]
        if len(rows) <= FULL_ROWS:
            near = np.bitwise_count(own[:, None, :] ^ own[None, :, :]).sum(axis=2, dtype=np.int16) <= radius
            for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
                join(int(rows[i]), int(rows[j]))
            continue
        sides = split(own, radius)
        if sides is None:
            spread(rows, points, radius, join)
        else:
            todo += [rows[sides[0]], rows[sides[1]]]
    return edges


def split(own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray] | None:
    """What goes inside and outside a vantage point's sphere, or None if no sphere tells much apart."""
    best = None
    for at in (0, len(own) // 2, len(own) - 1):
        d = distances(own, own[at])
        limit = int(np.median(d))
        for m in (limit, limit - 1, limit - radius):
            inside, outside = d <= m + radius, d > m
            most = max(inside.sum(), outside.sum())
            if best is None or most < best[0]:
                best = most, inside, outside
    return None if best[0] > 0.85 * len(own) else best[1:]


def spread(rows: np.ndarray, points: np.ndarray, radius: int, join) -> None:
    """Components by growing them a row at a time against the rows not reached yet; memory in proportion to the rows."""
    left = rows
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            near = distances(points[left], points[i]) <= radius
            if near.any():
                for j in left[near].tolist():
                    join(i, j)
                    front.append(j)
                left = left[~near]


class Tree:
    """A vantage-point tree over a sample; leaves are shards."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int):
        self.radius, self.leaves = radius, 0
        self.root = self._grow(sample, max(1, leaves))

    def _grow(self, sample: np.ndarray, leaves: int):
        if leaves > 1 and len(sample) >= 2 * SAMPLE_PER_LEAF:
            # of a few vantage points the one with the fewest boundary crossings
            best = None
            for at in range(0, len(sample), max(1, len(sample) // 8)):
                d = distances(sample, sample[at])
                for m in range(int(np.quantile(d, 0.3)), int(np.quantile(d, 0.7)) + 1):
                    inside, outside = (d <= m + self.radius).sum(), (d > m).sum()
                    cost = int(inside) ** 2 + int(outside) ** 2
                    if best is None or cost < best[0]:
                        best = cost, at, m, d
            _, at, m, d = best
            inside, outside = d <= m + self.radius, d > m
            if max(inside.sum(), outside.sum()) <= 0.85 * len(sample):
                return sample[at], m, self._grow(sample[inside], leaves // 2), self._grow(sample[outside], leaves - leaves // 2)
        self.leaves += 1
        return self.leaves - 1

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and their shards; a row is in each shard where it may meet a link."""
        rows, shards = [], []
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                rows.append(at)
                shards.append(np.full(len(at), node, np.int64))
                continue
            point, limit, inner, outer = node
            d = distances(points[at], point)
            todo += [(inner, at[d <= limit + self.radius]), (outer, at[d > limit])]
        return (np.concatenate(rows), np.concatenate(shards)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def fit_tree(points: DataFrame, rows: int, radius: int, fp: str = "fp") -> Tree:
    """A tree for so many different fingerprints, fitted on SAMPLE_ROWS of them at most, the first by hash."""
    sample = points.orderBy(F.xxhash64(fp), fp).limit(SAMPLE_ROWS).select(fp).collect()
    array = np.array([r[0] for r in sample], np.int64).view(np.uint64).reshape(-1, 1)
    return Tree(array, math.ceil(rows / LEAF_ROWS), radius)


def shard_edges(sharded: DataFrame, shard: str, radius: int, names: list[str], ident: str) -> DataFrame:
    """u, v: a spanning forest of the links within each shard. names: the 64-bit words of a fingerprint."""

    def link(group: pd.DataFrame) -> pd.DataFrame:
        release()
        group = group.drop_duplicates(ident)
        points = np.ascontiguousarray(group[names].to_numpy(np.int64)).view(np.uint64)
        ids = group[ident].to_numpy(np.int64)
        edges = forest(points, radius)
        return pd.DataFrame({"u": ids[[a for a, _ in edges]], "v": ids[[b for _, b in edges]]}, dtype=np.int64)

    return sharded.groupBy(shard).applyInPandas(link, "u long, v long").where("u <> v")


def dealt_by(rows: DataFrame, trees: Callable[[], dict[int, Tree]], fp: str) -> DataFrame:
    """shard, fp: the rows (shard, fp) by the trees of their shards; new shards are numbered by a hash of the old one and the leaf."""

    def deal(batches):
        release()
        for batch in batches:
            shards, points = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
            at, to = [], []
            for shard in np.unique(shards).tolist():
                own = np.flatnonzero(shards == shard)
                found, leaf = trees()[shard].route(points[own])
                at.append(own[found])
                to.append(mixed(leaf.astype(np.uint64) + np.uint64(xxhash.xxh64_intdigest(str(shard))), 0).view(np.int64))
            at, to = (np.concatenate([np.empty(0, np.int64), *x]) for x in (at, to))
            yield pa.RecordBatch.from_arrays([pa.array(to), batch.column(1).take(pa.array(at))], ["shard", fp])

    return rows.select("shard", fp).mapInArrow(deal, f"shard long, {fp} long")


def fit_shards(rows: DataFrame, sizes: dict[int, int], radius: int, fp: str, level: int) -> dict[int, Tree]:
    """A tree for each of the shards, by its size, fitted on a sample of it."""
    spark, scale = rows.sparkSession, 1 << 30
    rates = spark.createDataFrame([(k, math.ceil(min(1.0, SHARD_SAMPLE / n) * scale), n) for k, n in sizes.items()], "of long, rate long, size long")
    chosen = rows.join(F.broadcast(rates), F.col("shard") == F.col("of")).where(F.pmod(F.xxhash64(F.lit(level), fp), F.lit(scale)) < F.col("rate"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        points = group[fp].to_numpy(np.int64).view(np.uint64).reshape(-1, 1)
        tree = Tree(points, min(MAX_LEAVES, math.ceil(group["size"].iloc[0] / LEAF_ROWS)), radius)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})

    made = written(chosen.select("shard", fp, "size").groupBy("shard").applyInPandas(fit, "shard long, tree binary"))
    if (made.agg(F.sum(F.octet_length("tree"))).first()[0] or 0) > TREE_BYTES:
        return {}
    trees = {r["shard"]: pickle.loads(r["tree"]) for r in made.collect()}
    return {k: t for k, t in trees.items() if t.leaves > 1}


def link_fingerprints(points: DataFrame, radius: int, fp: str = "fp") -> DataFrame:
    """u, v: edges whose components are those of all links. points: different fingerprints, a checkpoint."""
    context = points.sparkSession.sparkContext
    tree = context.broadcast(fit_tree(points, points.count(), radius, fp))
    ready, dealt = [], dealt_by(points.select(F.lit(0).cast("long").alias("shard"), fp), lambda: {0: tree.value}, fp)
    shards = tree.value.leaves
    for level in range(LEVELS):
        dealt = written(dealt)
        counts = {r["shard"]: r["count"] for r in dealt.groupBy("shard").count().where(F.col("count") > SHARD_ROWS).collect()}  # few: rows over SHARD_ROWS
        trees = fit_shards(dealt, counts, radius, fp, level) if counts else {}
        if not trees:
            break
        large = points.sparkSession.createDataFrame([(k,) for k in trees], "of long")
        ready.append(dealt.join(F.broadcast(large), F.col("shard") == F.col("of"), "left_anti"))
        held = context.broadcast(trees)
        dealt = dealt_by(dealt.join(F.broadcast(large), F.col("shard") == F.col("of"), "left_semi"), lambda held=held: held.value, fp)
        shards += sum(t.leaves for t in trees.values())
    dealt = reduce(DataFrame.unionByName, [*ready, dealt])
    return shard_edges(dealt.repartition(max(shards, 1), "shard"), "shard", radius, [fp], fp)


# -- components -------------------------------------------------------------------------------------------


def contracted(pairs: DataFrame, n: int) -> DataFrame:
    """u, v: the edges (n of them) as stars: in runs of RUN_EDGES, every node with the smallest one that the run connects it with.

    A run is one task's work and bounded, so many edges only come nearer to their components, few are there at once.
    """

    def stars(edges: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        least: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := least.get(x, x)) != x:
                least[x] = x = least.get(y, y)
            return x

        for us, vs in edges:
            for u, v in zip(us.tolist(), vs.tolist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    least[max(a, b)] = min(a, b)
        nodes = list(least)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])

    def work(batches):
        release()
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, RUN_EDGES):
                part = batch.slice(at, RUN_EDGES)
                if rows + part.num_rows > RUN_EDGES and held:
                    yield stars(held)
                    held, rows = [], 0
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
                rows += part.num_rows
        yield stars(held)

    return pairs.coalesce(max(1, math.ceil(n / RUN_EDGES))).select("u", "v").mapInArrow(work, "u long, v long").where("u <> v")


def star_state(pairs: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether they are stars around smallest nodes: every node has one edge to its root, and roots have none."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    nodes = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    found = nodes.agg(F.sum("low").alias("n"), F.max(F.when(F.col("high") == 1, F.col("low") + 1).otherwise(F.col("low"))).alias("most")).first()
    return found["n"] or 0, (found["most"] or 0) <= 1


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: for every node of the edges (u, v) but the roots, the smallest node it is connected with.

    Edges are contracted in runs, then large stars join each node's larger neighbours to its smallest one, small stars its
    smaller ones (Kiveris and others, 2014); all keep the components, and the rounds end when every component is a star.
    """
    pairs = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    n, done = star_state(pairs)
    for step in range(2 * most_rounds):
        if done:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if step % 2 == 0:
            pairs = written(contracted(pairs, n))
        else:
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u")
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            pairs = written(small)
        n, done = star_state(pairs)
    raise RuntimeError("the components did not settle")


def groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = 3, name: str = "component_id") -> DataFrame:
    """df without its text, with fp and the smallest id of each row's component."""
    names = [c for c in df.columns if c not in ("fp", name)]
    marked = written(with_fingerprints(df.select(*names), text, words, "fp", drop_text=True))
    points = written(marked.groupBy("fp").agg(F.min(doc_id).alias("least")))
    stars = components(link_fingerprints(points, radius))
    placed = points.join(stars, points["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias(name))
    labels = placed.join(named, "root").select(F.col("fp").alias("__fp"), name)
    return join_in_parts(marked, labels, {"fp": "__fp"}, "inner").select(*(c for c in names if c != text), "fp", name)


# -- near duplicates by similarity ------------------------------------------------------------------------

#: Bits of a wide fingerprint, and the min-hash bands by which wide fingerprints are dealt to shards.
WIDE_WORDS, BANDS, BAND_ROWS = 8, 10, 2
#: A band key of more rows isn't compared as a whole; proposed components are confirmed in blocks of so many rows
#: or bytes of hashes, which meet by so many representatives first. So few sets are compared without fingerprints.
HOT_ROWS, BLOCK_ROWS, BLOCK_BYTES, REPRESENTATIVES, FEW_ROWS = 4_096, 1_024, 16 << 20, 8, 8
#: Odd multipliers of a 64-bit mix, from the golden ratio and from SplitMix64.
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """The n-th independent hash made from 64-bit hashes (SplitMix64)."""
    z = hashes + np.uint64((n + 1) * GOLDEN & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(MIX_A)
    z = (z ^ z >> np.uint64(27)) * np.uint64(MIX_B)
    return z ^ z >> np.uint64(31)


@functools.cache
def differing_share(similarity: Fraction, most: int = 64) -> float:
    """The largest chance that a bit differs between two sets of at least this Jaccard similarity.

    For sets up to `most` hashes it is counted out, as ties and few hashes make short texts differ more often than
    the angle says; for larger ones it is the angle's share of a half turn, at equal sizes, where it is largest.
    """
    worst = math.acos(float(2 * similarity / (1 + similarity))) / math.pi
    chance = lambda n: np.array([math.comb(n, k) for k in range(n + 1)], float) / 2.0**n
    for union in range(1, most + 1):
        apart = union - math.ceil(similarity * union)
        for left in range(apart // 2 + 1):
            right, both = apart - left, union - apart
            p, ones = chance(both)[:, None, None] * chance(left)[None, :, None] * chance(right)[None, None, :], np.arange(both + 1)[:, None]
            a = 2 * (ones + np.arange(left + 1)) > both + left
            b = 2 * (ones + np.arange(right + 1)) > both + right
            worst = max(worst, float(p[a[:, :, None] != b[:, None, :]].sum()))
    return worst


def radius_for(similarity: float, bits: int = 64 * WIDE_WORDS, margin: float = 4.5) -> int:
    """The distance that sets of at least this Jaccard similarity keep to, up to `margin` standard deviations."""
    share = differing_share(exact(similarity))
    return int(bits * share + margin * math.sqrt(bits * share * (1 - share)))


def exact(similarity: float) -> Fraction:
    """The decimal fraction that a limit is written as, so that 4 of 5 is 0.8."""
    return Fraction(str(similarity))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """The words of a hash set's wide fingerprint."""
    return [majority(mixed(hashes, n)) for n in range(WIDE_WORDS)]


def signature(text: str | None, words: int) -> tuple[list[int], list[int], int]:
    """The words of the wide fingerprint, a key for each band, and a digest; of the set of the text's shingles."""
    hashes = np.unique(shingle_hashes(text, words))
    if not len(hashes):
        return [0] * WIDE_WORDS, [0] * BANDS, 0
    wide = wide_fingerprint(hashes)
    least = [int(mixed(hashes, WIDE_WORDS + n).min()) for n in range(BANDS * BAND_ROWS)]
    keys = [xxhash.xxh64_intdigest(np.array(least[n * BAND_ROWS : (n + 1) * BAND_ROWS], "<u8").tobytes(), n) for n in range(BANDS)]
    return wide, keys, xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def with_signatures(df: DataFrame, text: str, words: int) -> DataFrame:
    """df without its text, with f0, f1, ..., keys, and digest, which tells different sets of shingles apart."""
    names = [f"f{n}" for n in range(WIDE_WORDS)]

    def start():
        def work(texts):
            made = [signature(t, words) for t in texts]
            wide = np.array([w for w, _, _ in made], np.uint64).reshape(-1, WIDE_WORDS).view(np.int64)
            keys = np.array([k for _, k, _ in made], np.uint64).reshape(-1, BANDS).view(np.int64)
            offsets = np.arange(0, (len(made) + 1) * BANDS, BANDS, dtype=np.int32)
            return [*(wide[:, n].copy() for n in range(WIDE_WORDS)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))), np.array([d for _, _, d in made], np.uint64).view(np.int64)]

        return work

    fields = [*(T.StructField(n, T.LongType()) for n in names), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("digest", T.LongType())]
    return map_rows(df, [text], fields, start, [text])


def runs_edges(rows: DataFrame, keys: list[str], link: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """u, v: the edges that link() finds among rows of the same keys (long); rows are dealt and sorted by them, runs of one cost nothing."""

    def walk(batches):
        release()
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(k).to_numpy() for k in keys])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            edges: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                mark = tuple(marks[:, a].tolist())
                if mark != last:
                    edges += ended(held)
                    held, last = [], mark
                held.append(batch.slice(a, b - a))
            yield made(edges)
        yield made(ended(held))

    def ended(held):
        return link(pa.Table.from_batches(held)) if sum(h.num_rows for h in held) > 1 else []

    def made(edges):
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["u", "v"])

    small_batches(rows.sparkSession)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(walk, "u long, v long").where("u <> v")


def proposals(dealt: DataFrame, names: list[str], radius: int) -> DataFrame:
    """u, v: edges whose components hold all pairs (id, key, names) that share a key and are within the radius.

    A key of more than HOT_ROWS rows isn't compared here: all its rows are proposed as one, by a count that is
    combined before the shuffle, and told apart in blocks when proposals are confirmed. So no task holds more.
    """

    def link(run: pa.Table) -> list[tuple[int, int]]:
        points = np.stack([run.column(n).to_numpy() for n in names], axis=1).view(np.uint64)
        ids = run.column("id").to_numpy().tolist()
        return [(ids[i], ids[j]) for i, j in forest(points, radius)]

    heads = written(dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("head")).where(F.col("n") > HOT_ROWS).select("key", "head"))
    hot = broadcast_if_small(heads, 16)
    cold = dealt.join(hot, "key", "left_anti")
    one = dealt.select("id", "key").join(hot, "key").select(F.col("id").alias("u"), F.col("head").alias("v")).where("u <> v")
    return runs_edges(cold, ["key"], link).unionByName(one)


def alike(a: np.ndarray, b: np.ndarray, similarity: Fraction) -> bool:
    """Whether two sorted hash sets have at least this Jaccard similarity; empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * similarity.denominator >= similarity.numerator * (len(a) + len(b) - both)


def confirmed_edges(ids: list[int], sets: list[np.ndarray], similarity: Fraction, radius: int, labels: list[int] | None = None, blocks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that are alike; with labels those of a label are joined already, with blocks only pairs of different ones count."""
    names = ids if labels is None else labels
    places = {x: i for i, x in reversed(list(enumerate(names)))}
    parent = [places[x] for x in names]
    edges = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(places) < 2:
        return edges
    sizes = np.array([len(s) for s in sets])
    least = np.array([math.ceil(similarity * n) for n in sizes.tolist()])
    points = np.array([wide_fingerprint(s) for s in sets], np.uint64) if len(ids) > FEW_ROWS else None
    left = len({root(i) for i in range(len(ids))})
    for i in range(len(ids) - 1):
        near = (sizes[i + 1 :] >= least[i]) & (least[i + 1 :] <= sizes[i])
        if blocks is not None:
            near &= blocks[i + 1 :] != blocks[i]
        if points is not None:
            near &= distances(points[i + 1 :], points[i]) <= radius
        for j in (np.flatnonzero(near) + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b and alike(sets[i], sets[j], similarity):
                parent[max(a, b)] = min(a, b)
                edges.append((ids[i], ids[j]))
                left -= 1
        if left == 1:
            break
    return edges


def confirmed(texts: DataFrame, stars: DataFrame, words: int, similarity: Fraction, radius: int) -> DataFrame:
    """u, v: edges whose components are those of the pairs (id, text) that are alike within a proposed component (node, root).

    Components are cut into blocks of BLOCK_ROWS rows or BLOCK_BYTES of hashes. Blocks are linked in themselves,
    then by some representatives of what each found, and only where a component is still in parts is every
    block compared with every other. Every pair in different parts is decided by its whole sets.
    """

    def start():
        return lambda values: [[np.unique(shingle_hashes(t, words)).tobytes() for t in values]]

    def link(run: pa.Table) -> list[tuple[int, int]]:
        sets = [np.frombuffer(h, np.uint64) for h in run.column("hashes").to_pylist()]
        other = {}
        if "label" in run.column_names:
            other = {"labels": run.column("label").to_pylist(), "blocks": run.column("block").to_numpy()}
        return confirmed_edges(run.column("id").to_pylist(), sets, similarity, radius, **other)

    placed = written(stars.select(F.col("node").alias("id"), "root").unionByName(stars.select(F.col("root").alias("id"), "root").distinct()))
    members = texts.join(broadcast_if_small(placed, 16), "id").dropDuplicates(["id", "text"])
    rows = written(map_rows(members, ["text"], [T.StructField("hashes", T.BinaryType())], start, ["text"]))
    block = lambda n: F.pmod(F.xxhash64("id"), n)
    number = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.octet_length("hashes")) / BLOCK_BYTES)).cast("long")
    large = written(rows.groupBy("root").agg(number.alias("blocks")).where("blocks > 1"))
    some = broadcast_if_small(large, 16)
    first = rows.join(some, "root", "left").withColumn("block", block(F.coalesce("blocks", F.lit(1).cast("long"))))
    edges = written(runs_edges(first.select("root", "block", "id", "hashes"), ["root", "block"], link))
    if not large.limit(1).count():
        return edges

    def labelled(edges: DataFrame) -> DataFrame:
        found = components(edges).select(F.col("node").alias("id"), F.col("root").alias("label"))
        return written(placed.join(some, "root").join(found, "id", "left").select("id", "root", "blocks", F.coalesce("label", "id").alias("label")))

    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(n)).alias("at"), "id"))["id"].alias(f"r{n}") for n in range(REPRESENTATIVES)]
    chosen = labelled(edges).groupBy("root", "label").agg(*drawn)
    chosen = written(chosen.select("root", F.explode(F.array_distinct(F.array(*(f"r{n}" for n in range(REPRESENTATIVES))))).alias("id")))
    sizes = chosen.groupBy("root").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("blocks"))
    second = rows.join(chosen.select("id"), "id").join(sizes, "root").withColumn("block", block(F.col("blocks")))
    edges = written(edges.unionByName(runs_edges(second.select("root", "block", "id", "hashes"), ["root", "block"], link)))

    labels = labelled(edges)
    parted = labels.groupBy("root").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("root")
    rest = rows.join(labels.join(parted, "root").select("id", "blocks", "label"), "id").withColumn("block", block(F.col("blocks")))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> block")
    cells = rest.select("root", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "label", "hashes")
    return edges.unionByName(runs_edges(cells, ["root", "one", "two"], link))


def similar_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(classes, stars): the smallest id of each different set of shingles, and node, root for those that join a smaller one.

    At this similarity shingle fingerprints differ in so many bits that no vantage point of all documents tells
    anything apart: a tree would send every document everywhere. So shards come from min-hash bands, in which
    documents of the similarity meet but for a chance of (1 - s ** BAND_ROWS) ** BANDS (4 in 100,000 at 0.8);
    within a shard pairs are proposed by the trees as above, on fingerprints of 64 * WIDE_WORDS bits and with a
    radius that leaves out next to none. What links is decided by the exact similarity of the sets of hashes.
    """
    names = [f"f{n}" for n in range(WIDE_WORDS)]
    texts = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    classes = written(with_signatures(texts, "text", words).groupBy(*names, "keys", "digest").agg(F.min("id").alias("id")))
    dealt = classes.select("id", *names, F.explode("keys").alias("key"))
    radius = radius_for(similarity)
    proposed = components(proposals(dealt, names, radius))
    return classes, components(confirmed(texts, proposed, words, exact(similarity), radius))


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df but those whose near-duplicate group has a smaller id. Rows with a null id stay."""
    classes, stars = similar_groups(df, text, doc_id, words, similarity)
    stay = classes.select(F.col("id").alias("__id")).join(stars.select(F.col("node").alias("__id")), "__id", "left_anti").distinct()
    named = df.where(F.col(doc_id).isNotNull()).join(stay, F.col(doc_id).cast("long") == F.col("__id"), "left_semi")
    return named.unionByName(df.where(F.col(doc_id).isNull()))
