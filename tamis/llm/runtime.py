"""What the operators share: cutting lineage, size-checked broadcasts and row-wise Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.operators.common import BROADCAST_BYTES, broadcast_if_small, scratch_path, shared_folder, written

__all__ = ["BROADCAST_BYTES", "broadcast_if_small", "scratch_path", "shared_folder", "written"]

#: Rows are handled in slices of about this size in Python, which bounds a worker's memory.
SLICE_BYTES = 2 << 20
#: Arrow batches to and from Python take about so many bytes, unless the session sets it: each is held on both sides.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for wide rows of which later steps read some columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Keys of so large a share of all rows are dealt in parts by join_in_parts().
HOT_SHARE = 0.001


def is_broadcast(df: DataFrame) -> bool:
    return df._jdf.queryExecution().analyzed().nodeName() == "ResolvedHint"


def join_in_parts(rows: DataFrame, side: DataFrame, keys: dict[str, str], how: str = "left") -> DataFrame:
    """rows joined with side where rows.key = side.other for each of keys; side has each key once, its key columns go.

    If side is too large to go out to all tasks, keys of at least twice a HOT_SHARE of all rows (at most 1 / HOT_SHARE
    of them) are dealt in parts: their rows by a hash of the other columns, side's row to each part. Null keys meet
    nothing and, in a left join, stay where they are.
    """
    met = reduce(and_, (F.col(k) == F.col(o) for k, o in keys.items()))
    if is_broadcast(side):
        return rows.join(side, met, how).drop(*keys.values())
    names = [f"__hot{n}" for n in range(len(keys))]
    counts = written(rows.where(F.col(next(iter(keys))).isNotNull()).groupBy(*(F.col(k).alias(h) for k, h in zip(keys, names, strict=True))).agg(F.count("*").alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    share = F.col("__n") / F.lit(max(1.0, total * HOT_SHARE))
    hot = F.broadcast(written(counts.where(share >= 2).select(*names, F.ceil(share).cast("int").alias("__parts"))))
    parts = F.coalesce("__parts", F.lit(1))
    of = lambda columns: reduce(and_, (F.col(c) == F.col(h) for c, h in zip(columns, names, strict=True)))
    side = side.join(hot, of(keys.values()), "left").withColumn("__no", F.explode(F.sequence(F.lit(0), parts - 1))).drop(*names, "__parts")
    others = [f.name for f in rows.schema.fields if f.name not in keys and isinstance(f.dataType, T.AtomicType)]
    chance = F.xxhash64(*others) if others else F.monotonically_increasing_id()
    rows = rows.join(hot, of(keys), "left").withColumn("__part", F.pmod(chance, parts).cast("int")).drop(*names, "__parts")
    return rows.join(side, met & (F.col("__part") == F.col("__no")), how).drop(*keys.values(), "__no", "__part")


#: Tables that a Python worker keeps from task to task, of one operator at a time.
_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]):
    """What make() gives, kept by a Python worker for later tasks of the same operator."""
    if key not in _resident:
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Gives a Python worker's kept tables and free memory back to the system."""
    if _resident:
        _resident.clear()
        gc.collect()
    give_back()


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by BATCH_BYTES where the session leaves them at Spark's 64 MB."""
    if spark.conf.get(BATCH_SETTING, "67108864b") == "67108864b":
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Gives a Python worker's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, inputs: list[str], fields: list[T.StructField], start: Callable[[], Callable[..., list]], drop: list[str] | None = None, holds: bool = False) -> DataFrame:
    """df with new columns computed from the columns named in inputs, in Arrow batches.

    start() runs once a task and returns a function from the values of each input to one list or Arrow array
    for each new field; batches are cut to about SLICE_BYTES first. Columns in drop aren't returned. A new field replaces a column of its name.
    Unless the operator holds tables from task to task, those that a worker has left of another one go first.
    """
    new = [f.name for f in fields]
    keep = [f for f in df.schema.fields if f.name not in {*new, *(drop or [])}]
    schema = T.StructType([*keep, *fields])
    arrow = [to_arrow(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            release()
        work = start()
        for whole in batches:
            rows = max(1, whole.num_rows * SLICE_BYTES // max(whole.nbytes, 1))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = work(*(column_rows(batch.column(c)) for c in inputs))
                made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, kind) for x, kind in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *made], names)
        give_back()

    small_batches(df.sparkSession)
    return df.select(*dict.fromkeys([*(f.name for f in keep), *inputs])).mapInArrow(run, schema)


def column_rows(column: pa.Array) -> Iterable:
    """The values of a column; those of an array column as numpy arrays made one at a time."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    offsets, values, valid = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False), column.is_valid().to_pylist()
    return (values[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True))


def to_arrow(kind: T.DataType) -> pa.DataType:
    """The Arrow type of the few Spark types that the operators return."""
    simple = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, to_arrow(f.dataType)) for f in kind.fields])
    return simple[kind.simpleString()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """A-Z in lower case, all else as it is; lower() where the text is ASCII, which is much faster than translate()."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
