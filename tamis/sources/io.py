"""Readers and writers of samples, losses, subsets, results and reports."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.operators.common import broadcast_if_small, written
from tamis.operators.losses import parse_checkpoints

#: The list of what a folder of several outputs holds, and the mark of a version that someone took.
MANIFEST, CLAIM = "manifest.json", "claimed"


def read_samples(spark: SparkSession, path: str, schema: T.StructType | None = None, split: str | None = None) -> DataFrame:
    """Samples from JSON lines (.jsonl), a JSON array (.json) or a folder of Parquet (else), of a split those files whose names begin with it."""
    if path.endswith((".jsonl", ".json")):
        reader = spark.read.option("multiLine", str(path.endswith(".json")).lower())
        return (reader.schema(schema) if schema else reader).json(path)
    reader = spark.read if split is None else spark.read.option("pathGlobFilter", f"{split}*.parquet").option("recursiveFileLookup", "true")
    return reader.parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, blank ones left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def with_line_ids(df: DataFrame, order: str | None = None, name: str = "sample_id") -> DataFrame:
    """df with ids from 0 without gaps: by a column's order, or of rows read from files by file, then place in it.

    Files come in the order of their paths, however Spark deals and packs them: a row's id is its place in the block
    it was read with, after the rows of all blocks before, which are counted first (a row a block). So nothing is sorted in
    one task, and rows are written once, so that what is counted and what is numbered are the same. Filters may stand
    between the files and this, projections may not. Rows that come from no file are numbered in the order of their partitions.
    """
    place, part = F.monotonically_increasing_id().alias("__at"), F.shiftright("__at", 33)
    if order is not None:
        marked, block = df.orderBy(order).select("*", place), [part.alias("__b0")]
    else:
        try:
            marked = df.select("*", F.col("_metadata.file_path").alias("__b0"), F.col("_metadata.file_block_start").alias("__b1"), place)
            block = ["__b0", "__b1"]
        except AnalysisException as error:
            if not (error.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                raise
            marked, block = df.select("*", place), [part.alias("__b0")]
    marked = written(marked)
    counts = marked.groupBy(*block).agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    names = [c for c in ("__b0", "__b1") if c in counts.columns]
    before = F.coalesce(F.sum("n").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = written(counts.select(*(F.col(c).alias(f"{c}_") for c in names), (before - F.col("first")).alias("__shift")))
    keys = {c: (part if c == "__b0" and len(names) == 1 else F.col(c)) for c in names}
    met = reduce(and_, (keys[c] == F.col(f"{c}_") for c in names))
    return marked.join(broadcast_if_small(shifts, 512), met).select((F.col("__at") + F.col("__shift")).alias(name), *(c for c in df.columns if c != name))


def read_numbered(spark: SparkSession, path: str, schema: T.StructType, name: str = "sample_id") -> DataFrame:
    """Samples of JSON lines with their line's place as id: over all files of a folder, blank lines left out."""
    lines = with_line_ids(spark.read.text(path).where(F.trim("value") != ""), name="__id")
    rows = lines.select("__id", F.from_json("value", schema).alias("r"))
    return rows.select(F.col("__id").alias(name), *(F.col("r")[f.name].alias(f.name) for f in schema.fields if f.name != name))


def checkpoint_number(path: Column) -> Column:
    """The number in checkpoint-N of a path, 0 without one."""
    number = F.regexp_extract(path, r"checkpoint-(\d+)", 1)
    return F.when(number == "", F.lit(0)).otherwise(number.cast("int"))


def matching_checkpoints(names: list[str], pattern: str) -> list[str]:
    """The folders that a pattern names, by number and then name; an empty pattern stands for the folder itself."""
    if not pattern:
        return ["."]
    number = lambda n: int(m[1]) if (m := re.search(r"checkpoint-(\d+)", n)) else 0
    return sorted(fnmatch.filter(names, pattern), key=lambda n: (number(n), n))


def read_checkpoints(spark: SparkSession, root: str, pattern: str = "checkpoint-*") -> DataFrame:
    """The Parquet tables in the folders of checkpoints below root, with ckpt from their names; an empty pattern reads root itself."""
    df = spark.read.parquet(f"{root}/{pattern}" if pattern else root)
    return df.withColumn("ckpt", checkpoint_number(F.col("_metadata.file_path")))


def read_embeddings(spark: SparkSession, path: str, checkpoints: str | None = None) -> DataFrame:
    """sample_id, embedding (floats): of a folder, or of the one checkpoint named in a folder of checkpoint-N folders."""
    if checkpoints is not None:
        named = sorted(parse_checkpoints(checkpoints))
        if len(named) != 1:
            raise ValueError("embeddings are of exactly one checkpoint")
        path = f"{path}/checkpoint-{named[0]}"
    return spark.read.parquet(path).select("sample_id", F.col("embedding").cast("array<float>").alias("embedding"))


def read_losses(spark: SparkSession, path: str, window: str | None = None) -> DataFrame:
    """The loss table, partitioned by window and checkpoint, so that filters on them choose files."""
    df = spark.read.parquet(path)
    return df if window is None else df.where(F.col("window") == window)


def write_losses(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("window", "ckpt").parquet(path)


def write_loss_matrix(df: DataFrame, path: str) -> None:
    """The loss matrix that a selection was made from (sample_id and its checkpoints' columns, or traj)."""
    df.write.mode("errorifexists").parquet(path)


def write_subset(df: DataFrame, path: str, ident: str = "sample_id") -> None:
    """The ids of a subset, ascending."""
    df.select(ident).orderBy(ident).write.mode("errorifexists").parquet(path)


def write_clusters(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("source").parquet(path)


def write_selected(samples: DataFrame, subset: DataFrame, path: str, ident: str = "sample_id") -> None:
    """The selected samples as JSON lines, counted again once written."""
    rows = samples.join(subset.select(ident), ident, "left_semi")
    rows.write.mode("errorifexists").json(path)
    there, wanted = samples.sparkSession.read.text(path).count(), rows.count()
    if there != wanted:
        raise ValueError(f"{path} has {there} rows instead of {wanted}")


def write_raw_subset(spark: SparkSession, lines: str, subset: DataFrame, path: str, ident: str = "sample_id") -> None:
    """The lines of a JSON lines file, or a folder of them, whose places (from 0, blank lines left out) are in a subset, as they are and in their order."""
    numbered = with_line_ids(spark.read.text(lines).where(F.trim("value") != ""), name=ident)
    kept = numbered.join(subset.select(ident), ident, "left_semi").orderBy(ident)
    kept.select("value").write.mode("errorifexists").text(path)


def write_file(spark: SparkSession, path: str, content: str) -> None:
    """A small text file of a given name, on any file system that Spark writes; it must not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()


def write_sidecar(df: DataFrame, path: str) -> None:
    """A small table beside other output (settings, worker metrics, losses, distances) as one file of JSON lines."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A tab-separated report with a header, in one file."""
    df.coalesce(1).write.mode("errorifexists").option("sep", "\t").option("header", "true").csv(path)


def _system(spark: SparkSession, path: str):
    """A path of Hadoop's and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def staged(spark: SparkSession, folder: str) -> Iterator[str]:
    """A folder to write several outputs to, which become `folder` together, or not at all.

    They are written beside it; at the end a manifest of their names and files is added, and one rename makes them visible. After an
    error nothing is left, so that a retry isn't in its own way. A folder that is there already is an error, before and after.
    """
    place, system = _system(spark, folder)
    if system.exists(place):
        raise FileExistsError(f"{folder} exists already")
    beside = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex}"
    made, _ = _system(spark, beside)
    system.mkdirs(made)
    try:
        yield beside
        outputs = {name: sum(1 for file in folder_names(spark, f"{beside}/{name}") if not file.startswith(("_", "."))) for name in folder_names(spark, beside)}
        write_file(spark, f"{beside}/{MANIFEST}", json.dumps({"outputs": outputs}, indent=2))
        if system.exists(place) or not system.rename(made, place):
            raise FileExistsError(f"{folder} exists already")
    finally:
        system.delete(made, True)


def claim_version(spark: SparkSession, root: str) -> str:
    """The next version_N below root, made and taken: no one else gets it, even at the same time."""
    place, system = _system(spark, root)
    system.mkdirs(place)
    n = int(next_version(folder_names(spark, root)).removeprefix("version_"))
    while True:
        path = f"{root}/version_{n}"
        try:
            if system.getUri().getScheme() == "file":  # its create() looks first and then writes; making a folder is one step
                os.mkdir(path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:"))
            else:
                system.create(_system(spark, f"{path}/{CLAIM}")[0], False).close()
            return path
        except FileExistsError:
            n += 1
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            n += 1


def read_eval_suite(spark: SparkSession, path: str, skipped: tuple[str, ...] = ("HumanityLastExam",)) -> DataFrame:
    """source, question, options, answer_idx, answer from {source: [items]}, or from a list as source normal; skipped sources go."""
    item = "array<struct<question:string,options:map<string,string>,answer_idx:string,answer:string>>"
    text = spark.read.text(path, wholetext=True)
    single = F.ltrim("value").startswith("[")
    suites = F.when(single, F.map_from_arrays(F.array(F.lit("normal")), F.array(F.from_json("value", item)))).otherwise(F.from_json("value", f"map<string,{item}>"))
    rows = text.select(F.explode(suites).alias("source", "items")).where(~F.col("source").isin(*skipped)).select("source", F.explode("items").alias("i"))
    options = F.transform(F.array_sort(F.map_entries("i.options")), lambda e: F.struct(e["key"].alias("letter"), e["value"].alias("text")))
    return rows.select("source", "i.question", options.alias("options"), "i.answer_idx", "i.answer")


def md5_faults(spark: SparkSession, path: str, expected: str) -> DataFrame:
    """The files of a path whose MD5 isn't the expected one."""
    return spark.read.format("binaryFile").load(path).where(F.md5("content") != expected).select("path")


def find_metrics(spark: SparkSession, root: str, name: str = "metrics.json", finished: str | None = None) -> DataFrame:
    """run (the file's folder) and content of every file of a name (or pattern) below root.

    finished: a suffix; files beside which there is one of the same stem with it have been dealt with and are left out.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    found = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    if finished is not None:
        stem = lambda path: F.regexp_replace(path, r"^file:/+|\.[^./]*$", "")
        done = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{finished}").load(root).select(stem(F.col("path")).alias("stem"))
        found = found.withColumn("stem", stem(F.col("path"))).join(done, "stem", "left_anti")
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run"), "content")


def first_rows(df: DataFrame, n: int, ident: str = "sample_id") -> DataFrame:
    """The first n samples, for debugging."""
    return df.orderBy(ident).limit(n)


def run_name(method: str, size: int | str, seed: int, checkpoints: str = "", subset: str = "", softmax: bool = False) -> str:
    """A folder name that tells a selection's settings."""
    initials = "".join(word[0] for word in re.split(r"[-_]", subset) if word)
    parts = [method, f"ckpt{checkpoints}" if checkpoints else "", f"sub-{initials}" if initials else "", "softmax" if softmax else "", f"n{size}", f"seed{seed}"]
    return "-".join(p for p in parts if p)


def free_name(name: str, there: list[str]) -> str:
    """The name, or with the first of -2, -3, ... that isn't there yet."""
    taken, n = set(there), 2
    if name not in taken:
        return name
    while f"{name}-{n}" in taken:
        n += 1
    return f"{name}-{n}"


def name_of_subset(path: str) -> str:
    """The run that a subset's path belongs to: above data/labeled_idx the folder of the run, else its folder and its own name."""
    place = PurePosixPath(path)
    return place.parent.parent.name if place.stem == "labeled_idx" else f"{place.parent.name}-{place.stem}"


def folder_names(spark: SparkSession, root: str) -> list[str]:
    """The names in a folder, none if it isn't there, on any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def version_folder(spark: SparkSession, root: str) -> str:
    """The next version_N below root."""
    return f"{root}/{next_version(folder_names(spark, root))}"


def next_version(names: list[str]) -> str:
    """version_N after the highest there is."""
    return f"version_{max((int(m[1]) for n in names if (m := re.fullmatch(r'version_(\d+)', n))), default=-1) + 1}"


def token_suffix(n: int) -> str:
    """1000 as 1k, 100 as it is, -1 as full."""
    return "full" if n < 0 else f"{n // 1000}k" if n >= 1000 else str(n)


def loss_file_name(path: str, tokens: int, rows: int, prompt_only: bool = False, prefixes: dict[str, str] | None = None) -> str:
    """A name that tells a loss table's data set (by a part of its path), window and size."""
    prefix = next((p for part, p in (prefixes or {}).items() if part.lower() in path.lower()), "")
    window = "full" if tokens == -1 else f"{tokens}token"
    parts = [prefix, "tokenwise", "prompt" if prompt_only else "", window, f"{rows // 1000}k" if rows >= 1000 else str(rows)]
    return "-".join(filter(None, parts))


def dataset_info(name: str, file_name: str) -> str:
    """The metadata beside a training file."""
    return json.dumps({name: {"file_name": file_name, "formatting": "sharegpt", "columns": {"messages": "conversations"}, "tags": {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant"}}}, ensure_ascii=False, indent=2)
