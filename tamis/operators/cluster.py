"""K-means by stratum and medoids, in whole numbers.

Features and centroids are whole numbers and centroids are truncated means, so assignments don't depend on
partitions or on the order of summation. Initial centroids are the first rows by md5 of seed and id. All strata
are clustered at once: rows stay dealt as they are, an iteration is one broadcast of the centroids and one pass in
Arrow batches with partial sums, and a stratum of any size is spread over all tasks. The driver holds the
centroids only, whose number the budget bounds.

Where a stratum has many clusters, rows keep their cluster and a lower bound of the distance to all others; by the
triangle inequality a row whose own centroid is nearer than that bound, less what the others have moved, needs no
other distance. Centroids too many for one broadcast go out block by block, and each row keeps the nearest so far.
Both give the clusters of the plain rounds, exactly.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.common import broadcast_if_small, remove, scratch_path, stored, written

#: Centroids go out in blocks of about so many values (128 MB), ten clusterings of 800 centroids of 2,048 values each, say.
BLOCK_VALUES = 1 << 24
#: From so many clusters in a stratum on, rows keep bounds from round to round; below, distances cost less than keeping them.
BOUNDS_FROM = 64
#: Partitions of fewer values are put together, up to the number of cores.
PART_VALUES = 1 << 20
#: What floating-point bounds are loosened by, as a share and as a length.
SLACK, LEAST_SLACK = 1e-12, 1e-9
#: Rows are compared with the centroids in blocks of so many distances.
BLOCK_DISTANCES = 1 << 21
#: Up to so many values a row, the batches' sums are added up by built-in sums; wider ones in groups of partial sums.
FEW_VALUES = 64


def hash_order(seed: int | str, ident: str) -> Column:
    """A random order that depends on seed and id only."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))


def require_fit(rows: np.ndarray, centers: np.ndarray) -> None:
    """An error if a squared distance might not fit 64 bits."""
    reach = int(max(rows.max(initial=0), centers.max(initial=0))) - int(min(rows.min(initial=0), centers.min(initial=0)))
    if reach * reach * max(rows.shape[1], 1) >= 1 << 63:
        raise ValueError("squared distances don't fit 64 bits; scale the features down")


def nearest_rows(rows: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row (n, w) the nearest center (k, w), of equal ones the first, and the squared distance; all exact whole numbers."""
    return nearest_two(rows, centers)[:2]


def nearest_two(rows: np.ndarray, centers: np.ndarray, bounds: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest_rows() and, with bounds, a lower bound of each row's distance to all other centers.

    Distances are first taken as floating-point products; where several centers come within their error, exactly.
    """
    n, k = len(rows), len(centers)
    require_fit(rows, centers)
    found, beyond = np.empty(n, np.int64), np.full(n, np.inf)
    middle = centers.mean(axis=0)
    own, others = rows - middle, centers - middle
    lengths = (others * others).sum(axis=1)
    for at in range(0, n, max(1, BLOCK_DISTANCES // k)):
        block = own[at : at + max(1, BLOCK_DISTANCES // k)]
        square = (block * block).sum(axis=1)
        about = square[:, None] - 2 * block @ others.T + lengths
        error = 1e-12 * rows.shape[1] * (square + lengths.max()) + 1e-6
        best = about.argmin(axis=1)
        close = about <= (about[np.arange(len(block)), best] + 2 * error)[:, None]
        for i in np.flatnonzero(close.sum(axis=1) > 1):
            among = np.flatnonzero(close[i])
            best[i] = among[((centers[among] - rows[at + i]) ** 2).sum(axis=1).argmin()]
        found[at : at + len(block)] = best
        if bounds and k > 1:
            about[np.arange(len(block)), best] = np.inf
            beyond[at : at + len(block)] = np.sqrt(np.maximum(about.min(axis=1) - 2 * error, 0))
    return found, ((rows - centers[found]) ** 2).sum(axis=1), beyond


class Centers:
    """The centroids of all strata, and the batches' rows by stratum."""

    def __init__(self, held: dict[tuple, np.ndarray]):
        self.held = held

    def near(self, strata: list[list], features: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple], np.ndarray, np.ndarray]:
        """For a batch: each row's stratum as a place in a list, that list, the nearest center and distance, and the features."""
        names: dict[tuple, int] = {}
        place = np.fromiter((names.setdefault(x, len(names)) for x in zip(*strata, strict=True)), np.int64, len(features))
        width = len(features.values) // max(len(features), 1)
        values = features.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(features), width)
        cluster, dist = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(len(names) + 1))
        for name, a, b in zip(names, cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            cluster[at], dist[at] = nearest_rows(values[at], self.held[name])
        return place, values, list(names), cluster, dist


def truncated(total: int, n: int) -> int:
    """total / n without its fraction, towards zero."""
    return total // n if total >= 0 else -(-total // n)


class Block:
    """Some centroids of each stratum: their places in it, their values, and how far they have just moved."""

    def __init__(self, rows):
        held: dict[str, list] = {}
        for r in rows:
            center = np.array(r["center"], np.int64)
            held.setdefault(r["__g"], []).append((r["__n"], center, float(((center - np.array(r["was"], np.int64)) ** 2).sum()) ** 0.5))
        self.held = {g: tuple(np.array(x) for x in zip(*sorted(of, key=lambda x: x[0]), strict=True)) for g, of in held.items()}

    def others_moved(self, g: str, own: np.ndarray) -> np.ndarray:
        """The longest way that a centroid other than a row's own has moved."""
        moves = self.held[g][2]
        far = int(moves.argmax())
        next_far = np.delete(moves, far).max(initial=0.0)
        return np.where(own == far, next_far, moves[far])

    def bounded(self, g: str, rows: np.ndarray, own: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cluster, squared distance, bound and whether a row had to meet all centroids, if the block holds all of them."""
        _, centers, _ = self.held[g]
        require_fit(rows, centers)
        known = own >= 0
        dist = ((rows - centers[own]) ** 2).sum(axis=1)
        bound = bound * (1 - SLACK) - self.others_moved(g, own) * (1 + SLACK) - LEAST_SLACK
        stale = ~(known & (np.sqrt(dist) * (1 + SLACK) < bound))
        own = own.copy()
        if stale.any():
            own[stale], dist[stale], bound[stale] = nearest_two(rows[stale], centers, True)
        return own, dist, bound, stale

    def nearer(self, g: str, rows: np.ndarray, own: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of the nearest centroid of this block and the ones before."""
        places, centers, _ = self.held[g]
        at, here = nearest_rows(rows, centers)
        better = (own < 0) | (here < dist) | ((here == dist) & (places[at] < own))
        return np.where(better, places[at], own), np.where(better, here, dist)


def of_strata(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
    """The names of a batch's strata and each row's place among them."""
    named = batch.column("__g").dictionary_encode()
    return named.dictionary.to_pylist(), named.indices.to_numpy(zero_copy_only=False)


def matrix(features: pa.Array) -> np.ndarray:
    """Features of one length as a table of whole numbers."""
    width = len(features.values) // max(len(features), 1)
    return features.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(features), width)


#: What a row keeps from round to round: cluster, squared distance, bound, the cluster before, and if it met all centroids.
KEPT = ("__c", "__d", "__l", "__was", "__met")


def scan(shared, names: list[str], features: str, whole: bool, begins: bool):
    """A pass over the rows with one block of centroids: the only one (whole), or the first or a later one of several."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, place = of_strata(batch)
            rows = matrix(batch.column(features))
            own, dist, bound, was, met = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in KEPT)
            if begins:
                was, met = own.copy(), np.zeros(len(own), bool)
                own = own if whole else np.full_like(own, -1)
            for i, g in enumerate(groups):
                at = np.flatnonzero(place == i)
                if g not in shared.value.held:
                    continue
                if whole:
                    own[at], dist[at], bound[at], met[at] = shared.value.bounded(g, rows[at], own[at], bound[at])
                else:
                    own[at], dist[at] = shared.value.nearer(g, rows[at], own[at], dist[at])
                    met[at] = True
            made = dict(zip(KEPT, (own, dist, bound, was, met), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(made[n]) if n in made else batch.column(n) for n in names], names)

    return work


def shifts(features: str):
    """What a batch's rows that have changed their cluster add to the sums of the new one and take from the old one's."""

    def work(batches):
        for batch in batches:
            own, was = batch.column("__c").to_numpy(), batch.column("__was").to_numpy()
            came, left = np.flatnonzero(own != was), np.flatnonzero((own != was) & (was >= 0))
            if not len(came):
                continue
            groups, place = of_strata(batch)
            rows = matrix(batch.column(features))
            at = np.concatenate([came, left])
            pairs = np.stack([place[at], np.concatenate([own[came], was[left]])], axis=1)
            keys, to = np.unique(pairs, axis=0, return_inverse=True)
            to, sign = to.reshape(-1), np.repeat([1, -1], [len(came), len(left)])
            total, n = np.zeros((len(keys), rows.shape[1]), np.int64), np.zeros(len(keys), np.int64)
            np.add.at(total, to, rows[at] * sign[:, None])
            np.add.at(n, to, sign)
            offsets = pa.array((np.arange(len(keys) + 1) * rows.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([groups[i] for i in keys[:, 0]]), pa.array(keys[:, 1].astype(np.int64)), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(total.reshape(-1)))], ["__g", "__n", "n", "sums"])

    return work


def added(parts: DataFrame, keys: tuple[str, ...], width: int) -> DataFrame:
    """n and sums added up by keys."""
    if width <= FEW_VALUES:
        total = F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width)))
        return parts.groupBy(*keys).agg(F.sum("n").alias("n"), total.alias("sums"))

    def add(group):
        one = group.iloc[:1].copy()
        one["n"], one["sums"] = group["n"].sum(), [np.sum(np.stack(group["sums"].to_list()), axis=0)]
        return one

    return parts.groupBy(*keys).applyInPandas(add, parts.schema)


def lloyd_with_bounds(df: DataFrame, chosen: DataFrame, strata: tuple[str, ...], features: str, width: int, n_blocks: int, niter: int, met: list[int] | None) -> DataFrame:
    """The rounds of lloyd() over rows that keep their cluster and bound, with the centroids as a table in n_blocks blocks.

    A table of the rows is written for each block and round, in the shared folder, and goes when the next one is there.
    """
    spark = df.sparkSession
    group = F.to_json(F.struct(*(F.col(s) for s in strata)), {"ignoreNullFields": "false"})
    start = zip(KEPT, (F.lit(-1).cast("long"), F.lit((1 << 63) - 1), F.lit(0.0), F.lit(-1).cast("long"), F.lit(True)), strict=True)
    state = df.withColumn("__g", group).withColumns(dict(start))
    names, schema, path = state.columns, state.schema, None
    block = F.pmod(F.xxhash64("__g", "__n"), F.lit(n_blocks)).alias("block")
    centers = written(chosen.select(group.alias("__g"), (F.col("__n") - 1).cast("long").alias("__n"), "center").select("*", F.col("center").alias("was"), block))
    totals = spark.createDataFrame([], "__g string, __n long, n long, sums array<bigint>")
    for step in range(niter + 1):
        for b in range(n_blocks):
            shared = spark.sparkContext.broadcast(Block(centers.where(F.col("block") == b).toLocalIterator()))
            before, path = path, scratch_path(spark, "clusters")
            state = stored(state.mapInArrow(scan(shared, names, features, n_blocks == 1, b == 0), schema), path)
            shared.destroy()
            if before:
                remove(spark, before)
        if met is not None:
            met.append(state.where("__met").count())
        if step == niter:
            break
        parts = state.select("__g", "__c", "__was", features).mapInArrow(shifts(features), totals.schema)
        totals = written(added(parts.unionByName(totals), ("__g", "__n"), width))
        mean = F.when(F.col("n") > 0, F.expr("transform(sums, x -> x div n)")).otherwise(F.col("center"))
        centers = written(centers.join(totals, ["__g", "__n"], "left").select("__g", "__n", mean.alias("center"), F.col("center").alias("was"), "block"))
        if centers.where("center <> was").isEmpty():
            break
    return state.select(*df.columns, F.col("__c").cast("int").alias("cluster_id"), F.col("__d").alias("dist"))


def lloyd(df: DataFrame, strata: tuple[str, ...], k: str, features: str = "traj", ident: str = "sample_id", niter: int = 20, seed: int = 42, met: list[int] | None = None) -> DataFrame:
    """df with cluster_id and dist: k-means within each stratum; k is a column and at most the stratum's rows.

    df should be cheap to read again (written); it is read once an iteration, or once if rows keep bounds. Strata without a
    centroid (k of 0 or null) go. Where bounds are kept, met gets each round's number of rows that met all their centroids.
    """
    spark = df.sparkSession
    df = df.where(F.col(k) >= 1)
    largest, least_width, most_width, short, n_rows = df.agg(F.max(k), F.min(F.size(features)), F.max(F.size(features)), F.min_by(ident, F.size(features)), F.count("*")).first()
    if least_width != most_width:
        raise ValueError(f"rows have from {least_width} to {most_width} features, such as {ident} {short}")
    largest = largest or 0
    # every round starts a Python task for each partition: no more of them than cores, but for parts of PART_VALUES
    df = df.coalesce(max(spark.sparkContext.defaultParallelism, n_rows * (most_width or 0) // PART_VALUES))
    # a constant bound stops the ranking of a stratum early, on ids alone; the features of the chosen rows come after
    order = F.row_number().over(Window.partitionBy(*strata).orderBy("__h", ident))
    ranked = df.select(*strata, ident, F.col(k).cast("long").alias("__k"), hash_order(seed, ident).alias("__h")).withColumn("__n", order)
    first = ranked.where(F.col("__n") <= F.lit(int(largest))).where(F.col("__n") <= F.col("__k")).select(*(F.col(s).alias(f"__s{i}") for i, s in enumerate(strata)), F.col(ident).alias("__i"), "__n")
    first = written(first)
    same_row = F.col(ident) == F.col("__i")
    for i, s in enumerate(strata):
        same_row &= F.col(s).eqNullSafe(F.col(f"__s{i}"))
    chosen = df.join(broadcast_if_small(first, 256), same_row).select(*strata, "__n", F.col(features).alias("center"))
    n_blocks = -(-first.count() * (most_width or 0) // BLOCK_VALUES)
    if largest >= BOUNDS_FROM or n_blocks > 1:
        return lloyd_with_bounds(df, chosen, strata, features, most_width, max(n_blocks, 1), niter, met)
    held: dict[tuple, list] = {}
    for r in chosen.toLocalIterator():
        held.setdefault(tuple(r[s] for s in strata), []).append((r["__n"], r["center"]))
    centers = {s: np.array([c for _, c in sorted(rows, key=lambda x: x[0])], np.int64) for s, rows in held.items()}
    width = max((c.shape[1] for c in centers.values()), default=0)
    source = df if centers else df.limit(0)
    names = [*strata, features]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in strata)

    def sums(held):
        def work(batches):
            for batch in batches:
                if batch.num_rows:
                    place, rows, found, cluster, _ = held.value.near([batch.column(i).to_pylist() for i in range(len(strata))], batch.column(len(strata)))
                    most = int(cluster.max()) + 1
                    keys, at = np.unique(place * most + cluster, return_inverse=True)
                    total = np.zeros((len(keys), rows.shape[1]), np.int64)
                    np.add.at(total, at, rows)
                    offsets = pa.array(np.arange(0, total.size + 1, max(width, 1)).astype(np.int32))
                    columns = [pa.array([found[x // most][i] for x in keys], batch.schema.field(i).type) for i in range(len(strata))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(keys % most), pa.array(np.bincount(at)), pa.ListArray.from_arrays(offsets, pa.array(total.reshape(-1)))], [*strata, "cluster", "n", "sums"])

        return work

    for _ in range(niter if centers else 0):
        shared = spark.sparkContext.broadcast(Centers(centers))
        parts = source.select(names).mapInArrow(sums(shared), f"{kinds}, cluster long, n long, sums array<bigint>")
        moved = {s: c.copy() for s, c in centers.items()}
        for r in added(parts, (*strata, "cluster"), width).toLocalIterator():
            moved[tuple(r[s] for s in strata)][r["cluster"]] = [truncated(x, r["n"]) for x in r["sums"]]
        shared.unpersist()
        same = all((moved[s] == c).all() for s, c in centers.items())
        centers = moved
        if same:
            break

    last = spark.sparkContext.broadcast(Centers(centers))
    kept = df.schema.fields

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                _, _, _, cluster, dist = last.value.near([batch.column(s).to_pylist() for s in strata], batch.column(features))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(cluster.astype(np.int32)), pa.array(dist)], [*(f.name for f in kept), "cluster_id", "dist"])

    everywhere = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return source.mapInArrow(assign, f"{everywhere}, cluster_id int, dist long")


def medoids(clustered: DataFrame, strata: tuple[str, ...], ident: str = "sample_id") -> DataFrame:
    """strata, cluster_id, ident: the row nearest to each centroid, of equal ones the lowest id; empty clusters have none."""
    return clustered.groupBy(*strata, "cluster_id").agg(F.min(F.struct("dist", ident)).alias("m")).select(*strata, "cluster_id", F.col(f"m.{ident}").alias(ident))


def standardize_ends(df: DataFrame, strata: tuple[str, ...], features: str = "traj") -> DataFrame:
    """df with first_z and last_z: z-scores of the first and last feature within the stratum (sample deviation); unchanged where it is 0 or undefined.

    The moments are added up where the rows are and meet them as a row for each stratum, so a stratum of any size is spread over all tasks.
    """
    ends = {"first": F.element_at(features, 1).cast("double"), "last": F.element_at(features, -1).cast("double")}
    moments = df.groupBy(*(F.col(s).alias(f"__s{i}") for i, s in enumerate(strata))).agg(*(f(v).alias(f"__{n}_{w}") for n, v in ends.items() for f, w in ((F.avg, "m"), (F.stddev_samp, "d"))))
    met = reduce(and_, (F.col(s).eqNullSafe(F.col(f"__s{i}")) for i, s in enumerate(strata)))
    rows = df.join(broadcast_if_small(written(moments), 256), met)
    z = {n: F.when(F.col(f"__{n}_d") > 0, (v - F.col(f"__{n}_m")) / F.col(f"__{n}_d")).otherwise(v) for n, v in ends.items()}
    return rows.select(*df.columns, z["first"].alias("first_z"), z["last"].alias("last_z"))


def standardized(df: DataFrame, strata: tuple[str, ...], features: str = "traj", name: str = "features", scale: int = 1_000_000) -> DataFrame:
    """df with features to cluster by: the first and last value as z-scores, those between as they are, in whole numbers.

    The values are in units of 1 / scale; of a single value only its last z-score is taken.
    """
    whole = lambda z: F.round(F.col(z) * scale).cast("long")
    scaled = df.withColumn("__own", F.col(features)).withColumn(features, F.transform(features, lambda x: x.cast("double") / scale))
    ends = standardize_ends(scaled, strata, features).withColumn(features, F.col("__own"))
    size = F.size(features)
    made = F.when(size > 1, F.concat(F.array(whole("first_z")), F.slice(features, F.lit(2), size - 2), F.array(whole("last_z")))).otherwise(F.transform(features, lambda _: whole("last_z")))
    return ends.withColumn(name, made).drop("__own", "first_z", "last_z")


def quantize(embedding: Column, scale: int = 1_000_000) -> Column:
    """A float vector in whole numbers."""
    return F.transform(embedding, lambda x: F.round(x.cast("double") * scale).cast("long"))


def masked_mean(vectors: Column, mask: Column, width: int) -> Column:
    """The mean of the token vectors whose mask is 1; zeros if there are none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    zeros = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(kept, zeros, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept))).otherwise(zeros)
