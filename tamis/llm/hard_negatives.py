"""Hard negatives by exact search of the largest inner products over one-dimensional distance keys.

Vectors of whole numbers get one more component, sqrt(N - |x|^2) with N the largest square length, and queries a zero there. Then the
squared distance of a query q and a row is N + |q|^2 - 2 score, so higher scores are smaller distances. Every row belongs to the nearest
of a few pivots, and the rows are stored sorted by (pivot, distance to it), cut into runs. A row whose key lies more than r from a
query's own distance to that pivot is itself more than r away. So a search looks into the runs whose keys come within a radius,
on both sides of the query's key at every pivot, and widens it: to the distance that its k-th find certifies, or twice as far while it has found
too few. Each run is looked into once, and a search ends when all keys left are beyond what could still change its result.

Queries go in blocks that stand together in the same order, a block with a run at a time: a product of matrices, of which only each
query's best finds are kept. Neither all queries nor all rows are ever in one place; the driver holds the pivots, fitted to a sample of
SAMPLE_ROWS rows (they decide how much is pruned, not what is found).

Only rows with an id, a label and a vector without null or non-finite components take part. Vectors of other widths count as padded with zeros. Scores
have to fit 56 bits, else it is an error. Higher scores come first, ties by smaller id. Rows that repeat in id, label and vector count once;
different rows of one id are rows of their own, but never another row to a query of that id. An empty table, or none that asks, gives an empty
result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.runtime import broadcast_if_small, give_back, small_batches, stored, written

PIVOTS, SAMPLE_ROWS, PIVOT_ROUNDS = 32, 4_096, 4
#: Rows of a run and queries of a block at most.
RUN_ROWS, BLOCK_ROWS = 4_096, 256
#: Blocks whose finds a task holds before it passes them on.
HELD_BLOCKS = 64
NONE = np.iinfo(np.int64).min
#: Added to every bound, in parts of the vectors' length, for what floating point loses.
SLACK = 1e-6
ROWS = "id long, label long, vector array<bigint>, asks boolean"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column, shorter ones padded with zeros."""
    offsets = column.offsets.to_numpy()
    values, lengths = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


@dataclass
class Space:
    """What all vectors have in common: width, largest square length, the packed components' type, and the pivots with their last components."""

    width: int
    norm: int
    dtype: str
    exact: bool
    pivots: np.ndarray

    def to_pivots(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """Distances of vectors to all pivots, in the space with one more component."""
        x = vectors.astype(np.float64)
        square = (x * x).sum(axis=1)
        last = np.zeros(len(x)) if queries else np.sqrt(np.maximum(self.norm - square, 0))
        square = square + last * last
        products = x @ self.pivots[:, :-1].T + last[:, None] * self.pivots[:, -1]
        return np.sqrt(np.maximum(square[:, None] + (self.pivots**2).sum(axis=1) - 2 * products, 0))

    def distance(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a query of some square length has a score."""
        return np.sqrt(np.maximum(self.norm + square - 2.0 * score, 0))

    @property
    def slack(self) -> float:
        return SLACK * (self.norm**0.5 + 1)

    @property
    def reach(self) -> float:
        """A radius that leaves out nothing."""
        return 4 * self.norm**0.5 + 1

    def scores(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """All inner products, exactly: in floating point where they fit."""
        if self.exact:
            return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
        return queries.astype(np.int64) @ rows.astype(np.int64).T

    def unpacked(self, vectors: bytes) -> np.ndarray:
        return np.frombuffer(vectors, self.dtype).reshape(-1, self.width)


def taking_part(df: DataFrame, ident: str, vector: str, label: Column, asks: Column, scale: float | None = None) -> DataFrame:
    """The rows that take part, as ROWS; components of floating point become floor(scale * x)."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")) if scale else x.cast("long"))
    rows = df.where(F.col(ident).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & finite)
    return rows.select(F.col(ident).cast("long").alias("id"), label.cast("long").alias("label"), whole.cast("array<bigint>").alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))


def space_of(rows: DataFrame, pivots: int = PIVOTS) -> Space:
    """Measures all rows, and fits pivots to a sample: the rows of smallest hash, then a few rounds of means."""
    long = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    width, norm, largest = rows.agg(F.max(F.size("vector")), F.max(long), F.max(most)).first()
    width, norm, largest = max(int(width or 0), 1), float(norm or 0), float(largest or 0)
    if largest**2 * width >= 2.0**56:
        raise ValueError("scores don't fit 56 bits; scale the vectors down")
    dtype = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
    space = Space(width, int(norm) + 1, dtype, largest**2 * width < 2.0**53, np.zeros((1, width + 1)))
    sample = rows.orderBy(F.xxhash64("id"), "id", "label").select("vector").limit(SAMPLE_ROWS).toArrow()
    if sample.num_rows:
        x = matrix(sample.column("vector").combine_chunks(), width).astype(np.float64)
        x = np.column_stack([x, np.sqrt(np.maximum(space.norm - (x * x).sum(axis=1), 0))])
        space.pivots = x[:pivots].copy()
        for _ in range(PIVOT_ROUNDS):
            near = ((x * x).sum(axis=1)[:, None] + (space.pivots**2).sum(axis=1) - 2 * x @ space.pivots.T).argmin(axis=1)
            for p in np.unique(near):
                space.pivots[p] = x[near == p].mean(axis=0)
    return space


def keyed(rows: DataFrame, space: Space) -> DataFrame:
    """rows with pivot and key, the distance to it; stored."""
    shared = rows.sparkSession.sparkContext.broadcast(space)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                distances = shared.value.to_pivots(matrix(batch.column(2), shared.value.width), queries=False)
                pivot = distances.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32()), pa.array(distances[np.arange(len(pivot)), pivot])], [*batch.schema.names, "pivot", "key"])

    return stored(rows.mapInArrow(work, f"{ROWS}, pivot int, key double"), "keyed")


def packed(rows: DataFrame, space: Space, most: int, queries: bool) -> DataFrame:
    """Keyed rows in the order of their keys, `most` to a row: no, pivot, low, high (of their keys; of queries their distances to every pivot), ids, labels, vectors."""
    shared = rows.sparkSession.sparkContext.broadcast(space)
    kinds = "no long, low array<double>, high array<double>" if queries else "no long, pivot int, low double, high double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, no, left = shared.value, TaskContext.get().partitionId() << 33, []

        def pack(ids, labels, vectors, pivot, keys):
            nonlocal no
            order = np.argsort(ids, kind="stable")
            if queries:
                near = space.to_pivots(vectors, queries=True)
                span = {"low": pa.array([near.min(axis=0).tolist()]), "high": pa.array([near.max(axis=0).tolist()])}
            else:
                span = {"pivot": pa.array([int(pivot)], pa.int32()), "low": [float(keys.min())], "high": [float(keys.max())]}
            contents = {"ids": ids[order].astype("<i8"), "labels": labels[order].astype("<i8"), "vectors": vectors[order].astype(space.dtype)}
            no += 1
            return pa.RecordBatch.from_pydict({"no": [no - 1], **span, **{c: pa.array([v.tobytes()], pa.binary()) for c, v in contents.items()}})

        for batch in batches:
            if not batch.num_rows:
                continue
            left.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), space.width), batch.column(4).to_numpy(), batch.column(5).to_numpy()))
            yield from cut(left, most, pack, False)
        if left:
            yield from cut(left, most, pack, True)
        give_back()

    small_batches(rows.sparkSession)
    spread = rows.repartitionByRange("pivot", "key", "id").sortWithinPartitions("pivot", "key", "id", "label", "vector")
    return spread.mapInArrow(work, f"{kinds}, ids binary, labels binary, vectors binary")


def cut(left: list, most: int, pack, end: bool) -> Iterator[pa.RecordBatch]:
    """Packs what is held into runs of one pivot and at most `most` rows, without repeats; an unfinished one stays in left unless it is the end."""
    ids, labels, vectors, pivots, keys = (np.concatenate(x) for x in zip(*left, strict=True))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1) | (pivots[1:] != pivots[:-1])
    ids, labels, vectors, pivots, keys = (x[new] for x in (ids, labels, vectors, pivots, keys))
    left.clear()
    at = 0
    while at < len(ids):
        stop = min(at + most, int(np.searchsorted(pivots, pivots[at], "right")))
        if stop == len(ids) and not end and stop - at < most:
            break
        if stop == len(ids) and not end:
            stop -= 1  # what comes next may repeat the last row
        if stop == at:
            break
        yield pack(ids[at:stop], labels[at:stop], vectors[at:stop], pivots[at], keys[at:stop])
        at = stop
    if at < len(ids):
        left.append((ids[at:], labels[at:], vectors[at:], pivots[at:], keys[at:]))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each line and their ids, ties by smaller id; NONE stands for no score. ids ascend."""
    n = scores.shape[-1]
    if n <= k:
        return scores, np.broadcast_to(ids, scores.shape)
    if int(np.abs(np.where(scores == NONE, 0, scores)).max()) < 2**62 // n:  # score and place in one number
        order = np.where(scores == NONE, NONE, scores * n + np.arange(n - 1, -1, -1))
        at = np.argpartition(order, n - k, axis=-1)[..., n - k :]
    else:
        at = np.lexsort((np.broadcast_to(ids, scores.shape), ~scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, at, -1), ids[at]


def merged(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line, in order."""
    order = np.lexsort((ids, ~scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


@dataclass
class Finds:
    """The best finds of a block's queries: for each query and window (low to high scores) k scores and ids, in order."""

    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls, queries: int, windows: int, k: int) -> Finds:
        return cls(np.full((queries, windows, k), NONE), np.full((queries, windows, k), np.iinfo(np.int64).max))

    @classmethod
    def read(cls, content: bytes, windows: int, k: int) -> Finds:
        both = np.frombuffer(content, "<i8").reshape(2, -1, windows, k)
        return cls(both[0], both[1])

    def packed(self) -> bytes:
        return np.stack([self.scores, self.ids]).astype("<i8").tobytes()

    def with_more(self, other: Finds) -> Finds:
        return Finds(*merged(np.concatenate([self.scores, other.scores], -1), np.concatenate([self.ids, other.ids], -1), self.scores.shape[-1]))


def found_in(space: Space, block: dict, run: dict, same: bool, windows: int, k: int) -> Finds:
    """What a run adds to a block."""
    queries, rows = space.unpacked(block["vectors"]), space.unpacked(run["vectors"])
    asks, ids = np.frombuffer(block["ids"], "<i8"), np.frombuffer(run["ids"], "<i8")
    alike = np.frombuffer(block["labels"], "<i8")[:, None] == np.frombuffer(run["labels"], "<i8")
    scores = np.where((alike == same) & (asks[:, None] != ids), space.scores(queries, rows), NONE)
    spans = np.frombuffer(block["windows"], "<i8").reshape(2, -1, windows)
    finds = Finds.none(len(asks), windows, k)
    for w in range(windows):
        low, high = spans[0, :, w, None], spans[1, :, w, None]
        inside = np.where((scores >= low) & (scores <= high), scores, NONE)
        lines = np.flatnonzero((inside != NONE).any(axis=1))
        if len(lines):
            made, names = best(inside[lines], ids, k)
            made, names = merged(made, np.where(made == NONE, np.iinfo(np.int64).max, names), k)
            finds.scores[lines, w, : made.shape[1]], finds.ids[lines, w, : made.shape[1]] = made, names
    return finds


def certain_at(space: Space, block: dict, finds: Finds) -> float:
    """The radius beyond which nothing can change a block's finds; infinite while a window without a lower end has too few."""
    windows = finds.scores.shape[1]
    low, high = np.frombuffer(block["windows"], "<i8").reshape(2, -1, windows)
    queries = space.unpacked(block["vectors"]).astype(np.float64)
    square = (queries * queries).sum(axis=1)[:, None]
    last = finds.scores[..., -1]
    least = np.maximum(np.where(last == NONE, low, last), low)
    radius = np.where(low > high, 0.0, np.where(least <= NONE + 1, np.inf, space.distance(square, least.astype(np.float64))))
    return float(radius.max(initial=0.0))


STATE = "no long, low array<double>, high array<double>, ids binary, labels binary, vectors binary, windows binary, finds binary, done double, next double"


def searched(blocks: DataFrame, runs: DataFrame, space: Space, same: bool, windows: int, k: int) -> DataFrame:
    """Blocks (STATE) with their finds complete: the k best of the same label, or of others, in each window."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(space)
    keys = runs.select(F.col("no").alias("run"), "pivot", F.col("low").alias("from"), F.col("high").alias("to"))
    contents = runs.select(F.col("no").alias("__run"), F.col("ids").alias("run_ids"), F.col("labels").alias("run_labels"), F.col("vectors").alias("run_vectors"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Finds] = {}

        def passed():
            rows = {"no": pa.array(list(held), pa.int64()), "finds": pa.array([f.packed() for f in held.values()], pa.binary())}
            held.clear()
            return pa.RecordBatch.from_pydict(rows)

        for batch in batches:
            for row in batch.to_pylist():
                run = {c: row[f"run_{c}"] for c in ("ids", "labels", "vectors")}
                more = found_in(shared.value, row, run, same, windows, k)
                held[row["no"]] = held[row["no"]].with_more(more) if row["no"] in held else more
                if len(held) >= HELD_BLOCKS:
                    yield passed()
        if held:
            yield passed()
        give_back()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block, its state first and then what was found: the state after."""
        space, state, finds = shared.value, None, None

        def closed():
            radius = certain_at(space, state, finds)
            beyond = min(radius + space.slack, space.reach) if np.isfinite(radius) else min(max(2 * state["next"], space.norm**0.5 / 4), space.reach)
            row = {**state, "finds": finds.packed(), "done": state["next"], "next": max(beyond, state["next"])}
            return pa.RecordBatch.from_pylist([row], pa.schema([pa.field(f.name, f.type) for f in batch.schema if f.name in row]))

        for batch in batches:
            for row in batch.to_pylist():
                own = row.pop("own")
                if own:
                    if state is not None:
                        yield closed()
                    state, finds = row, Finds.read(row["finds"], windows, k)
                else:
                    finds = finds.with_more(Finds.read(row["finds"], windows, k))
        if state is not None:
            yield closed()
        give_back()

    names = [x.split()[0] for x in STATE.split(", ")]
    done: list[DataFrame] = []
    state = written(blocks.select(names))
    small_batches(spark)
    while state.limit(1).count():
        reach = state.select("no", "done", "next", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x")).select("no", "done", "next", F.col("at").alias("pivot"), F.col("x.low").alias("low"), F.col("x.high").alias("high"))
        apart = F.greatest(F.lit(0.0), F.col("from") - F.col("high"), F.col("low") - F.col("to"))
        near = (apart > F.col("done")) & (apart <= F.col("next"))
        pairs = keys.join(broadcast_if_small(reach, 64), "pivot").where(near).select("run", F.col("no").alias("__no"))
        wide = BLOCK_ROWS * (space.width * np.dtype(space.dtype).itemsize + 16 + 16 * windows * (k + 1)) + 16 * len(space.pivots)
        asked = pairs.join(broadcast_if_small(state.select("no", "ids", "labels", "vectors", "windows"), wide), F.col("__no") == F.col("no"))
        found = asked.join(contents, F.col("run") == F.col("__run")).drop("run", "__run", "__no").mapInArrow(scan, "no long, finds binary")
        both = state.withColumn("own", F.lit(True)).unionByName(found.withColumn("own", F.lit(False)), allowMissingColumns=True)
        state = written(both.repartition("no").sortWithinPartitions("no", F.desc("own")).select(*names, "own").mapInArrow(settle, STATE))
        whole = (F.col("next") <= F.col("done")) | (F.col("done") >= space.reach)
        done.append(state.where(whole))
        state = state.where(~whole)
    out = done[0] if done else blocks.limit(0).select(names)
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def started(blocks: DataFrame, windows: int, k: int, spans=None) -> DataFrame:
    """Blocks as STATE with nothing found; spans gives each block's windows from its row, else one window takes every score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"]) // 8
                row["windows"] = spans(row, n) if spans else np.stack([np.full((n, 1), NONE + 1), np.full((n, 1), np.iinfo(np.int64).max)]).astype("<i8").tobytes()
                row |= {"finds": Finds.none(n, windows, k).packed(), "done": -1.0, "next": 0.0}
                types = {"no": pa.int64(), "low": pa.list_(pa.float64()), "high": pa.list_(pa.float64()), "done": pa.float64(), "next": pa.float64()}
                fields = [x.split()[0] for x in (STATE + ", positives binary" if spans else STATE).split(", ")]
                yield pa.RecordBatch.from_pylist([{c: row[c] for c in fields}], pa.schema([(c, types.get(c, pa.binary())) for c in fields]))

    return blocks.mapInArrow(work, STATE + ", positives binary" if spans else STATE)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (ROWS, see taking_part()).

    An anchor is a row that asks; its positives are the best other rows of its label. For each of them the negatives are the best rows of
    other labels whose scores are from `least` to `most` hundredths of the positive's.
    """
    rows = rows.select("id", "label", "vector", "asks")
    space = space_of(rows)
    index = keyed(rows, space)
    runs = stored(packed(index, space, RUN_ROWS, queries=False), "runs")
    blocks = packed(index.where("asks"), space, BLOCK_ROWS, queries=True)
    first = written(searched(started(blocks, 1, positives), runs, space, True, 1, positives))

    def spans(row: dict, n: int) -> bytes:
        scores = Finds.read(row["positives"], 1, positives).scores[:, 0, :]
        real = scores != NONE
        scores = np.where(real, scores, 0)
        low, high = -((-least * scores) // 100), (most * scores) // 100
        return np.stack([np.where(real, low, 1), np.where(real, high, 0)]).astype("<i8").tobytes()

    second = started(first.withColumn("positives", F.col("finds")), positives, negatives, spans)
    second = written(second)
    complete = searched(second, runs, space, False, positives, negatives)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchors, own, other = np.frombuffer(row["ids"], "<i8"), Finds.read(row["positives"], 1, positives), Finds.read(row["finds"], positives, negatives)
                a, p, r = np.nonzero(other.scores != NONE)
                columns = [anchors[a], own.ids[a, 0, p], r + 1, other.ids[a, p, r], own.scores[a, 0, p], other.scores[a, p, r]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(columns)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    both = complete.select("no", "ids", "finds").join(second.select("no", "positives"), "no").drop("no")
    return both.mapInArrow(listed, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
