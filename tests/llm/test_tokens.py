"""Transducer, decoder and prefix counts against the libraries."""

import itertools
import unicodedata

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tamis.llm import byte_bpe, classes, token_counts

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
with open(RANKS, "rb") as _file:
    TABLE = byte_bpe.read_ranks(_file.read())
ENCODER, DECODER = byte_bpe.Encoder(TABLE, P.PATTERN), byte_bpe.Decoder(TABLE)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=TABLE, special_tokens={})
with open(WORDS, "rb") as _file:
    COUNTER = token_counts.Counter(_file.read())
WORD_LIBRARY = Tokenizer.from_file(WORDS)
PIECES = st.lists(st.sampled_from(["a", "th", "ing", " ", "  ", "\n", "'re", "'", "ll", "!", "é", "Σ", "漢", "0", "\x85", "<|endoftext|>", "<|", "|>", "İ", "🤦"]) | st.characters(exclude_categories=["Cs"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_encoding_is_the_librarys_and_round_trips(text):
    ids = ENCODER.encode(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert DECODER.decode(ids) == text


EVERY = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


#: Of runs of over 3,000 code points of a category, as of unassigned and private ones, the first and last 1,000.
GROUPS = ["".join(g) for _, g in itertools.groupby(EVERY, unicodedata.category)]
SHOWN = [c for g in GROUPS for c in (g if len(g) <= 3000 else g[:1000] + g[-1000:])]


@pytest.mark.parametrize("name", [r"\p{L}", r"\p{N}", r"\s"])
def test_classes_are_those_of_both_libraries(name):
    found = pre_tokenizers.Split(Regex(name + "+"), "removed", invert=True).pre_tokenize_str("".join(EVERY))
    assert {ord(c) for part, _ in found for c in part} == {c for a, b in classes.members(name) for c in range(a, b + 1)}


def test_every_code_point_is_encoded_as_by_the_library():
    texts = [f"{c}'re a{c}b 1{c}" for c in SHOWN]
    wrong = [t for t, ids in zip(texts, LIBRARY.encode_ordinary_batch(texts), strict=True) if ENCODER.encode(t).tolist() != ids]
    assert wrong == []


def test_every_code_point_is_counted_as_by_the_library():
    texts = [f"a{c}b" for c in SHOWN]
    want = [len(e.ids) for at in range(0, len(texts), 50_000) for e in WORD_LIBRARY.encode_batch_fast(texts[at : at + 50_000], add_special_tokens=False)]
    assert [t for t, n in zip(texts, want, strict=True) if COUNTER.count(t) != n] == []


def test_every_code_point_is_normalised_as_by_the_library():
    for around in ("a{}\u0301", "q\u0301{}", "a{}\u0334\u0316", "A\u0316{}\u1161"):
        texts = [around.replace("{}", c) for c in EVERY if c != "\n"]
        want = COUNTER.library.normalize_str("\n".join(texts)).split("\n")
        assert [t for t, w in zip(texts, want, strict=True) if COUNTER.normal(t) != w] == []


def test_other_patterns_are_spelled_out_too():
    pattern = r"[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s"
    for text in ("Hello  wörld 12345!!\n\n x", "漢字 𝔘𝔫 ١٢٣ \x85 a\u0301", "plain ascii  text\r\n "):
        assert classes.Pieces(pattern)(text) == regex.findall(pattern, text)
    assert classes.spelled_out(r"\bword\w+", classes.LAST) is None and classes.Pieces(r"\w+")("wörd x") == ["wörd", "x"]
    assert classes.spelled_out(r"[^\S\n]+\P{L}", classes.LAST).findall("x\t \n 1") == ["\t \n", " 1"]


def test_long_pieces_are_emitted_on_the_way():
    for text in ("a" * 5000, "-=" * 3000, " " * 4000 + "x", "ab" * 20 + "é" * 2000):
        assert ENCODER.encode(text).tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=24), st.integers(0, 24))
def test_utf8_machine_decodes_as_the_standard_says(data, cut):
    stream = byte_bpe.Utf8Stream()
    assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.finish() == data.decode("utf-8", "replace")


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_counts_are_the_librarys(text):
    assert COUNTER.count(text) == len(WORD_LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "th", "ing", " ", "'re", "'", "l", "!", "é", "0", "<|endoftext|>"]), max_size=10).map("".join))
def test_every_prefix_has_its_count(text):
    want = [len(WORD_LIBRARY.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert COUNTER.prefixes(text) == want
    assert read_table(*COUNTER.tables(text)) == want[1:]


def read_table(starts, before, inner):
    """The counts at every code point, as the table says."""
    lengths = np.diff([*starts.tolist(), len(inner) // 2])
    assert (np.diff(before) >= 0).all()
    return (np.repeat(before, lengths) + np.frombuffer(inner, ">u2").astype(int)).tolist()


def test_long_runs_are_cut():
    for text in ("a" * 30_000, "ab é" * 20 + "漢" * 20_000, "!" * 9000 + "<|endoftext|>" + " x" * 10):
        got = read_table(*COUNTER.tables(text))
        at = [1, 100, 8191, 8192, 8193, len(got)]
        clean = text.lower()
        assert [got[i - 1] for i in at if i <= len(got)] == [len(WORD_LIBRARY.encode(clean[:i], add_special_tokens=False).ids) for i in at if i <= len(got)]


def test_truncation_and_budgets_are_look_ups_in_the_stored_table(spark, tmp_path):
    texts = ["one two three", "", None, "unbelievable's thing!!  <|endoftext|> a'll be", "  x\n\ny ", "ab" * 40 + " antidisestablishmentarianism", "é漢字 漢 𝔘 naïve"]
    counted = token_counts.prefix_tables(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), WORDS)
    counted.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))  # nothing but the table is read from here on
    table = F.col("prefix_tokens")
    spots = stored.select("i", "prefix_tokens", F.explode(F.sequence(F.lit(0), F.lit(120))).alias("n"))
    rows = spots.select("i", "n", token_counts.tokens_up_to(table, F.col("n")).alias("up_to"), token_counts.longest_within(table, F.col("n") - 1).alias("within"), token_counts.tokens_in(table).alias("whole")).collect()
    want = {i: [len(WORD_LIBRARY.encode((t or "")[:n], add_special_tokens=False).ids) for n in range(len(t or "") + 1)] for i, t in enumerate(texts)}
    for r in rows:
        assert r.up_to == want[r.i][min(r.n, len(want[r.i]) - 1)] and r.whole == want[r.i][-1], r
        assert r.within == max((n for n, c in enumerate(want[r.i]) if c <= r.n - 1), default=0), r


def test_awkward_rows(awkward, empty):
    made = byte_bpe.encode(awkward, RANKS, P.PATTERN)
    rows = byte_bpe.decode(made, RANKS).collect()
    assert len(rows) == 10 and all(r.decoded == (r.text or "") and r.kept == "x" for r in rows)
    assert all(r.ids == LIBRARY.encode_ordinary(r.text or "") for r in rows)
    fused = byte_bpe.encode_and_decode(awkward, RANKS, P.PATTERN).collect()
    assert sorted(map(str, fused)) == sorted(map(str, rows))
    assert byte_bpe.encode_and_decode(empty, RANKS, P.PATTERN).count() == 0
    counted = token_counts.count_tokens(awkward, WORDS).collect()
    assert all(r.n_tokens == len(WORD_LIBRARY.encode(r.text or "", add_special_tokens=False).ids) for r in counted)
    assert token_counts.count_tokens(empty, WORDS).count() == 0


def test_prefixes_and_budgets_in_frames(spark):
    df = spark.createDataFrame([("one two three",), (None,)], "text string")
    rows = token_counts.prefix_counts(token_counts.fit_budget(df, WORDS, 2), WORDS).collect()
    assert rows[0].prefix_tokens == COUNTER.prefixes("one two three") and rows[0].fits == 8 and rows[1].fits == 0


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([([],), (None,)], "ids array<int>")
    assert [r.decoded for r in byte_bpe.decode(df, RANKS).collect()] == ["", ""]


@pytest.mark.parametrize("name", ["op3_byte_bpe", "op7_token_counts"])
def test_queries(spark, sf, name):
    import hashlib

    from tamis.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        if name == "op3_byte_bpe":
            ids = LIBRARY.encode_ordinary(text)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        else:
            n = len(WORD_LIBRARY.encode(text, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
            clean = COUNTER.normal(text)  # the texts over the limit have no special strings
            kept = r.n_chars_within_limit
            assert kept == len(clean) if n <= 2048 else len(WORD_LIBRARY.encode(clean[:kept], add_special_tokens=False).ids) <= 2048 < len(WORD_LIBRARY.encode(clean[: kept + 1], add_special_tokens=False).ids)
