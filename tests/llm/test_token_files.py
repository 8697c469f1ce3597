"""Token files against the library, and what stands in them."""

import glob
import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tamis.llm import token_files

VOCABULARY, OTHER = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
LIBRARY, OTHER_LIBRARY = Tokenizer.from_file(VOCABULARY), Tokenizer.from_file(OTHER)
with open(VOCABULARY) as _file:
    ENCODER = token_files.LibraryEncoder(_file.read())
PIECES = st.lists(st.sampled_from(["a", "th", "ing", " ", "  ", "\n", "'re", "'", "ll", "!", "é", "漢", "0", "\x85", "<|endoftext|>", "<|", "🤦", "\U00018d80"]) | st.characters(exclude_categories=["Cs"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_pieces_give_the_librarys_ids(text):
    assert np.frombuffer(ENCODER.encode(text), "<u2").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_class_of_characters():
    texts = [f"{chr(c)}'re a{chr(c)}b 1{chr(c)} {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0)]
    want = LIBRARY.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, want, strict=True) if np.frombuffer(ENCODER.encode(t), "<u2").tolist() != w.ids] == []


def expected(rows, library, end, dtype):
    """(doc_id, ids) in the files' order."""
    made = [(i, [*library.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows]
    return sorted(made, key=lambda x: (x[0] is not None, x[0] or 0))


@pytest.mark.parametrize(("path", "library"), [(VOCABULARY, LIBRARY), (OTHER, OTHER_LIBRARY)])
def test_files_hold_all_documents_in_order(request, spark, tmp_path, awkward, path, library):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    folder = str(tmp_path / "t")
    rows = [(r.doc_id, r.text) for r in awkward.collect()] + [(i, f"document {i} <|endoftext|>" * (i % 7)) for i in range(500, 900)]
    docs = spark.createDataFrame([(t, "x", i, "y") for i, t in rows], "text string, ids string, doc_id long, start string").repartition(5)
    parts = token_files.write(docs, folder, path, 2).orderBy("part").collect()
    want = expected(rows, library, 2, "<u2")
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(len(want)))
    starts = np.cumsum([0, *(len(r.ids) // 4 for r in got)])
    assert [r.start for r in got] == starts[:-1].tolist()
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(i), x) for i, x in want)
    assert len(parts) > 1 and sum(p.n_ids for p in parts) == starts[-1] and parts[0].id_base == 0
    flat = np.concatenate([np.fromfile(f"{folder}/{p.name}.bin", p.dtype) for p in parts])
    again = token_files.TokenFiles(folder)
    assert len(again) == len(want) and again.ids(0, 1 << 40).tolist() == flat.tolist() and again.ids(3, 700).tolist() == flat[3:703].tolist()
    assert all(again[r.place].tolist() == np.frombuffer(r.ids, "<u4").tolist() for r in got)
    with pytest.raises(IndexError):
        again[len(want)]
    with pytest.raises(FileExistsError):
        token_files.write(docs, folder, path, 2)


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "t")
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    token_files.write(docs, folder, VOCABULARY, 2)
    for kind in ("bin", "idx", "doc"):
        with open(f"{folder}/part-00000-lost.{kind}", "wb") as file:
            file.write(b"12345678")
    before = token_files.read(spark, folder).count()
    assert before == 2 and token_files.remove_strays(spark, folder) == 3 and not glob.glob(f"{folder}/*lost*")
    assert token_files.read(spark, folder).count() == 2 and os.path.exists(f"{folder}/manifest")


def test_empty_tables_and_ends_that_do_not_fit(spark, empty, tmp_path):
    token_files.write(empty, str(tmp_path / "e"), VOCABULARY, 2)
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0 and len(token_files.TokenFiles(str(tmp_path / "e"))) == 0
    with pytest.raises(ValueError, match="end id"):
        token_files.write(empty, str(tmp_path / "f"), VOCABULARY, 1 << 16)


def test_query(spark, sf):
    from tamis.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at, want = 0, []
    for ident in sorted(texts):
        ids = [*LIBRARY.encode(texts[ident], add_special_tokens=False).ids, 2]
        want.append((ident, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    rows = QUERIES["op12_token_files"](spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want
