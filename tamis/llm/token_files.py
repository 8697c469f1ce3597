"""Token ids as flat binary files with 64-bit document offsets, made to be memory-mapped.

A folder of parts, each three files of little-endian integers without headers:
  part-N-*.bin   the ids of the part's documents one after the other, each with the end id: unsigned, 16 bits if the vocabulary fits, else 32
  part-N-*.idx   64-bit offsets into it: where each document begins, and the end
  part-N-*.doc   the documents' ids, 64 bits
and a Parquet table `manifest` with a row a part: its files, counts, and bases. A part's bases, the documents and ids in
all parts before it, are prefix sums over that table, so documents have places in one long sequence though every part is
written by itself. Documents stand in ascending order of their ids, nulls first, then of their texts' hashes.

Texts are encoded by the tokenizers library, each distinct piece once: a byte-level vocabulary cuts a text by a fixed
pattern and no piece looks beyond itself, so pieces met before come from a table bounded by bytes. Vocabularies of any other kind
are applied text by text. Strings of special tokens inside texts are these tokens, which is the library's default.

A task writes under a name of its own; only the rows that Spark accepts get into the manifest, so files of lost or
repeated attempts are never read (remove_strays() deletes them). Null and empty texts have the end id only. Very long texts are encoded whole;
files are written and read in slices. Repeated rows are documents of their own. An empty table has an empty manifest.
Other columns aren't part of the files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamis.llm.bpe import Memo
from tamis.llm.classes import Pieces
from tamis.llm.runtime import give_back, resident, small_batches, written
from tamis.llm.token_counts import byte_symbols

#: Fixed value: the pattern built into the library's byte-level splitter.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_BYTES, PIECE_BYTES = 128 << 20, 180
#: Bytes of ids that are read at once.
READ_BYTES = 1 << 20
PARTS = "part int, name string, dtype string, n_docs long, n_null long, n_ids long"


class LibraryEncoder:
    """Ids of texts as the tokenizers library gives them for a vocabulary file, without added special tokens."""

    def __init__(self, content: str, memo_bytes: int = MEMO_BYTES):
        spec = json.loads(content)
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2" if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) < 1 << 16 else "<u4")
        cut, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not spec["normalizer"]
        plain = plain and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        self.pieces = Pieces(BYTE_LEVEL) if plain else None
        self.specials = tuple(t["content"] for t in added)
        self.model, self.stand_ins = self.library.model, {byte: char for char, byte in byte_symbols().items()}
        self.memo = Memo(self.piece, memo_bytes, lambda piece, made: PIECE_BYTES + 2 * len(piece) + len(made))

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids of a piece by the library's model, which takes printable stand-ins for bytes."""
        symbols = piece.encode().decode("latin-1").translate(self.stand_ins)
        return np.array([token.id for token in self.model.tokenize(symbols)], self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, packed."""
        if not text:
            return b""
        if self.pieces is None or any(s in text for s in self.specials):
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the path in it."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _write_part(folder: str, vocabulary, end: bytes):
    """Encodes and writes a task's documents as one part, and returns its row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = resident(("LibraryEncoder", hash(vocabulary.value)), lambda: LibraryEncoder(vocabulary.value))
        files, store, path, name, width = None, None, None, None, encoder.dtype.itemsize
        part, docs, nulls, ids = TaskContext.get().partitionId(), 0, 0, 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if files is None:
                    store, path = _store(folder)
                    name = f"part-{part:05d}-{uuid.uuid4().hex}"
                    files = [store.open_output_stream(f"{path}/{name}.{kind}") for kind in ("bin", "idx", "doc")]
                    files[1].write(np.array([0], "<i8").tobytes())
                ends = []
                for text in batch.column(1):
                    content = encoder.encode(text.as_py())
                    files[0].write(content)
                    files[0].write(end)
                    ids += len(content) // width + 1
                    ends.append(ids)
                files[1].write(np.array(ends, "<i8").tobytes())
                files[2].write(batch.column(0).fill_null(0).to_numpy().astype("<i8").tobytes())
                docs, nulls = docs + batch.num_rows, nulls + batch.column(0).null_count
        finally:
            for file in files or []:
                file.close()
        if docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "dtype": [encoder.dtype.str], "n_docs": [docs], "n_null": [nulls], "n_ids": [ids]})
        give_back()

    return work


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files of all documents to a new folder that driver and executors share; the manifest."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    dtype = LibraryEncoder(content).dtype
    if not 0 <= end_id < 1 << 8 * dtype.itemsize:
        raise ValueError(f"the end id {end_id} doesn't fit {dtype}")
    store, path = _store(folder)
    if store.get_file_info(path).type != pafs.FileType.NotFound:
        raise FileExistsError(folder)
    store.create_dir(path, recursive=True)
    small_batches(spark)
    rows = docs.select(F.col(ident).cast("long").alias("__id"), F.col(text).alias("__text"), F.xxhash64(text).alias("__tie"))
    spread = rows.repartitionByRange("__id", "__tie").sortWithinPartitions("__id", "__tie", "__text").select("__id", "__text")
    work = _write_part(folder, spark.sparkContext.broadcast(content), np.array([end_id], dtype).tobytes())
    parts = written(spread.mapInArrow(work, PARTS))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c.removeprefix('n_')[:-1]}_base") for c in ("n_docs", "n_ids")]
    parts.select("*", *sums).coalesce(1).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """part, name, dtype, n_docs, n_null, n_ids, doc_base, id_base of every part."""
    return spark.read.parquet(f"{folder}/manifest")


def remove_strays(spark: SparkSession, folder: str) -> int:
    """Deletes the files that the manifest doesn't name; how many there were."""
    store, path = _store(folder)
    named = {r["name"] for r in manifest(spark, folder).select("name").toLocalIterator()}  # a row for each part
    strays = [f.path for f in store.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and f.base_name.startswith("part-") and f.base_name.rpartition(".")[0] not in named]
    for stray in strays:
        store.delete_file(stray)
    return len(strays)


class Part:
    """A part's files: memory-mapped on a disk, else read by ranges."""

    def __init__(self, folder: str, name: str, dtype: str):
        self.store, path = _store(folder)
        self.local, self.dtype = isinstance(self.store, pafs.LocalFileSystem), np.dtype(dtype)
        self.paths = {kind: f"{path}/{name}.{kind}" for kind in ("bin", "idx", "doc")}
        self.maps: dict[str, np.ndarray] = {}

    def read(self, kind: str, first: int, end: int) -> np.ndarray:
        dtype = self.dtype if kind == "bin" else np.dtype("<i8")
        if self.local:
            if kind not in self.maps:
                self.maps[kind] = np.memmap(self.paths[kind], dtype, "r")
            return self.maps[kind][first:end]
        with self.store.open_input_file(self.paths[kind]) as file:
            return np.frombuffer(file.read_at((end - first) * dtype.itemsize, first * dtype.itemsize), dtype)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, place (of the document), start (the ids of all documents before it), and ids, as little-endian unsigned 32-bit integers: from the files."""
    rows = manifest(spark, folder)
    spread = rows.repartition(max(1, rows.count()), "part").select("name", "dtype", "n_docs", "n_null", "doc_base", "id_base")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part, done = Part(folder, row["name"], row["dtype"]), 0
                while done < row["n_docs"]:
                    edges = part.read("idx", done, min(done + 65_536, row["n_docs"]) + 1)
                    most = max(1, int(np.searchsorted(edges, edges[0] + READ_BYTES, "right")) - 1)  # one document at least
                    edges = np.asarray(edges[: most + 1])
                    docs = np.array(part.read("doc", done, done + most))
                    ids = part.read("bin", int(edges[0]), int(edges[-1])).astype("<u4")
                    places = np.arange(done, done + most)
                    offsets = pa.py_buffer(((edges - edges[0]) * 4).astype("<i4").tobytes())
                    packed = pa.Array.from_buffers(pa.binary(), most, [None, offsets, pa.py_buffer(ids.tobytes())])
                    columns = [pa.array(docs, pa.int64(), mask=places < row["n_null"]), pa.array(places + row["doc_base"]), pa.array(edges[:-1] + row["id_base"]), packed]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "start", "ids"])
                    done += most
        give_back()

    return spread.mapInArrow(work, "doc_id long, place long, start long, ids binary")


class TokenFiles:
    """Random access for a training loop: documents by place, and any run of ids across documents and parts."""

    def __init__(self, folder: str):
        store, path = _store(folder)
        rows = sorted(pq.read_table(f"{path}/manifest", filesystem=store).to_pylist(), key=lambda r: r["part"])
        self.parts = [Part(folder, r["name"], r["dtype"]) for r in rows]
        self.doc_bases, self.id_bases = (np.array([*(r[f"{c}_base"] for r in rows), sum(r[f"n_{c}s"] for r in rows)], np.int64) for c in ("doc", "id"))

    def __len__(self) -> int:
        return int(self.doc_bases[-1])

    def __getitem__(self, place: int) -> np.ndarray:
        """The ids of the document at a place."""
        if not 0 <= place < len(self):
            raise IndexError(place)
        at = int(np.searchsorted(self.doc_bases, place, "right")) - 1
        first, end = self.parts[at].read("idx", place - int(self.doc_bases[at]), place - int(self.doc_bases[at]) + 2)
        return self.parts[at].read("bin", int(first), int(end))

    def ids(self, start: int, count: int) -> np.ndarray:
        """count ids from a place in the whole sequence on, fewer at its end."""
        found, end = [], min(start + count, int(self.id_bases[-1]))
        while start < end:
            at = int(np.searchsorted(self.id_bases, start, "right")) - 1
            stop = min(end, int(self.id_bases[at + 1]))
            found.append(self.parts[at].read("bin", start - int(self.id_bases[at]), stop - int(self.id_bases[at])))
            start = stop
        return np.concatenate(found) if found else np.empty(0, "<u4")
