"""Token counts by prefix dynamic programming, for a BPE vocabulary with word ends.

For every prefix of a text the exact number of tokens is stored in a prefix table, so that totals, truncation
and budget questions are look-ups in built-in functions; nothing is encoded again. Texts are normalised as the
vocabulary's file says: composed (NFC), lower case, white space dropped; strings of special tokens inside a text
count as one token, which is the library's default. Positions are code points of the normalised text.

A prefix table cuts the text into runs, a word and the white space behind it each:
  starts  where each run begins
  before  the tokens of the text before it, or of the shortest way on from there; never falls
  inner   for every code point two bytes, high byte first: the tokens up to and with it, less the run's before

Null and empty texts have no tokens and an empty table. Very long texts take time and space in proportion, as
runs of more than RUN code points are cut. An empty table of texts gives an empty one. Repeated rows count alike;
other columns pass through, and an earlier column of the output's name is replaced.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import normalizers

from tamis.llm.bpe import END, Memo, Merges, PrefixCounts
from tamis.llm.classes import BEYOND, LAST, PLANE, Pieces, runs, spelled
from tamis.llm.runtime import map_rows, resident

#: What a worker remembers: bytes of runs, and states of the transducer.
MEMO_BYTES, STATES = 160 << 20, 200_000
#: What a remembered run takes besides its characters and counts.
RUN_BYTES = 180
#: The longest run in code points; their counts differ by less than 2 ** 16.
RUN = 8_192
TABLE = T.StructType([T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("before", T.ArrayType(T.IntegerType())), T.StructField("inner", T.BinaryType())])

def byte_symbols() -> dict[str, int]:
    """The printable stand-ins for bytes of byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def unlike(normalize) -> list[int]:
    """The code points on which Python's tables and the library's may not agree: unassigned in Python's, or composed or ordered otherwise."""
    known = [chr(c) for c in range(LAST + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    marks = [c for c in known if unicodedata.combining(c)]
    probes = {c: [f"{c}"] for c in known if unicodedata.decomposition(c)} | {c: [f"q{c}\u0334", f"q\u0301{c}"] for c in marks}
    pairs = [(c, p) for c, texts in probes.items() for p in texts]
    made = normalize("\n".join(p for _, p in pairs)).split("\n")
    other = {ord(c) for (c, p), m in zip(pairs, made, strict=True) if unicodedata.normalize("NFC", p).lower() != m}
    return sorted(other | {c for c in range(LAST + 1) if unicodedata.category(chr(c)) == "Cn"})


class Counter:
    """Counts tokens as the library does for a vocabulary file of the kind described above."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, self.specials = spec["model"], [t["content"] for t in spec["added_tokens"]]
        suffix, symbols = model["end_of_word_suffix"], byte_symbols()

        def plain(token: str) -> str:
            ended = token.endswith(suffix)
            values = [symbols[c] for c in (token[: -len(suffix)] if ended else token)]
            if ended:
                values[-1] += END
            return "".join(map(chr, values))

        ids = {plain(t): i for t, i in model["vocab"].items() if t not in self.specials}
        pairs = {tuple(map(plain, m)): rank for rank, m in enumerate(model["merges"])}
        ranks: dict[str, int] = {}
        for (a, b), rank in pairs.items():
            ranks[a + b] = min(rank, ranks.get(a + b, rank))
        self.table = PrefixCounts(Merges(ids, lambda a, b, get=pairs.get: get((a, b)), ranks), word_ends=True, max_states=STATES)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = Pieces(pattern)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))).split if self.specials else lambda text: [text]
        self.runs = Pieces(rf"(?:{pattern})\s*|\s+")
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.unlike = re.compile(f"[{spelled(runs(unlike(self.library.normalize_str)), PLANE)}]")
        self.memo = Memo(self.run_counts, MEMO_BYTES, lambda run, made: RUN_BYTES + 2 * len(run) + len(made))

    def normal(self, text: str) -> str:
        """Composed and in lower case, character by character (a final sigma is no exception).

        Texts with characters that Python's Unicode tables and the library's don't share, or beyond the first plane, are left to the library's normaliser.
        """
        if text.isascii():
            return text.lower()
        if BEYOND.search(text) or self.unlike.search(text):
            return self.library.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def word_prefixes(self, word: str) -> list[int]:
        """The count at every character of a word."""
        if word[0] == "'" and len(word) == 3 and word[1].isalpha():  # a contraction begun is a quote and a letter
            parts = [self.word_prefixes(c)[-1] for c in word[:2]]
            whole = self.table.counts(word)
            return [parts[0], sum(parts), whole[-1]]
        if word.isascii():
            return self.table.counts(word)
        counts = self.table.counts(word.encode().decode("latin-1"))
        out, at = [], -1
        for char in word:
            at += len(char.encode())
            out.append(counts[at])
        return out

    def run_counts(self, run: str) -> bytes:
        """The count at every character of a run, as 16-bit integers; empty if the run is too long for that."""
        if len(run) > RUN:
            return b""
        match = self.words.form(run).match(run)
        counts = self.word_prefixes(match.group()) if match else [0]
        if len(counts) < len(run):
            counts += [counts[-1]] * (len(run) - len(counts))
        packed = array("H", counts)
        if sys.byteorder == "little":
            packed.byteswap()
        return packed.tobytes()

    def tables(self, text: str | None) -> tuple[np.ndarray, np.ndarray, bytes]:
        """The prefix table of a text: starts, before, inner."""
        if not text:
            return _NONE, _NONE, b""
        if len(self.split(text)) == 1:
            clean = self.normal(text)
            parts = list(map(self.memo.__getitem__, self.runs(clean)))
            lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
            if len(clean) == lengths.sum():  # else the pattern leaves out more than white space, or a run is too long
                inner = b"".join(parts)
                ends = np.cumsum(lengths)
                own = np.frombuffer(inner, ">u2")[ends - 1].astype(np.int64)
                return (ends - lengths).astype(np.int32), (np.cumsum(own) - own).astype(np.int32), inner
        return packed(np.array(self.prefixes(text)[1:], np.int64))

    def count(self, text: str | None) -> int:
        """The number of tokens of text: the last entry of its table."""
        _, before, inner = self.tables(text)
        return int(before[-1]) + int.from_bytes(inner[-2:], "big") if len(before) else 0

    def prefixes(self, text: str | None) -> list[int]:
        """Entry i: the number of tokens of the first i code points of the normalised text, entry 0 being 0."""
        out, base = [0], 0
        parts = self.split(text or "")
        rest = text or ""
        for n, part in enumerate(parts):
            rest = rest[len(part) :]
            special = "" if n == len(parts) - 1 else next(s for s in sorted(self.specials, key=len, reverse=True) if rest.startswith(s))
            rest = rest[len(special) :]
            clean = self.normal(part)
            inside = self._ordinary(clean + special)
            out += [base + c for c in inside[1:]]
            base += self._ordinary(clean)[-1] if special else inside[-1]
            if special:
                base += 1
                out[-1] = base
        return out

    def _ordinary(self, text: str) -> list[int]:
        out, base = [0], 0
        for match in self.words.form(text).finditer(text):
            out += [base] * (match.start() + 1 - len(out))
            counts = self.word_prefixes(match.group())
            out += [base + c for c in counts]
            base += counts[-1]
        return out + [base] * (len(text) + 1 - len(out))


_NONE = np.empty(0, np.int32)


def packed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """A prefix table from the counts at every code point, in runs of RUN."""
    if not len(counts):
        return _NONE, _NONE, b""
    starts = np.arange(0, len(counts), RUN)
    least = np.minimum.accumulate(np.minimum.reduceat(counts, starts)[::-1])[::-1]
    return starts.astype(np.int32), least.astype(np.int32), (counts - np.repeat(least, np.diff([*starts, len(counts)]))).astype(">u2").tobytes()


def prefix_tables(df: DataFrame, vocabulary_path: str, text: str = "text", name: str = "prefix_tokens", drop_text: bool = False) -> DataFrame:
    """df with the prefix table of each text."""
    with open(vocabulary_path, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())

    def start():
        counter = resident(("Counter", hash(content.value)), lambda: Counter(content.value))

        def work(texts):
            rows = [counter.tables(t) for t in texts]
            offsets = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]).astype(np.int32))
            flat = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([_NONE, *(r[i] for r in rows)]))) for i in (0, 1)]
            return [pa.StructArray.from_arrays([*flat, pa.array([r[2] for r in rows], pa.binary())], ["starts", "before", "inner"])]

        return work

    return map_rows(df, [text], [T.StructField(name, TABLE)], start, [text] if drop_text else None, holds=True)


def _entry(table: Column, place: Column) -> Column:
    """The inner count at a code point, from 1."""
    return F.conv(F.hex(F.substring(table["inner"], place * 2 - 1, F.lit(2))), 16, 10).cast("long")


def chars_in(table: Column) -> Column:
    """The code points of the normalised text."""
    return F.octet_length(table["inner"]).cast("long") / 2


def tokens_in(table: Column) -> Column:
    """The number of tokens of the whole text."""
    chars = chars_in(table).cast("int")
    return F.when(chars > 0, F.element_at(table["before"], -1) + _entry(table, chars)).otherwise(F.lit(0)).cast("long")


def tokens_up_to(table: Column, place: Column) -> Column:
    """The number of tokens of the first `place` code points, as a text of their own; of all if there are fewer."""
    place = F.least(place, chars_in(table).cast("int")).cast("int")
    run = F.size(F.filter(table["starts"], lambda x: x < place))
    return F.when(place > 0, F.get(table["before"], run - 1) + _entry(table, place)).otherwise(F.lit(0)).cast("long")


def longest_within(table: Column, budget: Column) -> Column:
    """The most code points of the normalised text whose tokens fit the budget.

    Counts dip inside words, so the last run that can fit is found by before, and the last code point in it by inner.
    """
    run = F.size(F.filter(table["before"], lambda x: x <= budget))
    start = F.get(table["starts"], run - 1)
    width = F.coalesce(F.get(table["starts"], run), chars_in(table).cast("int")) - start
    left = budget - F.get(table["before"], run - 1)
    fits = F.transform(F.sequence(F.lit(1), width), lambda i: F.when(_entry(table, start + i) <= left, i).otherwise(0))
    return F.when((run > 0) & (budget >= 0), start + F.array_max(fits)).otherwise(F.lit(0)).cast("long")


def count_tokens(df: DataFrame, vocabulary_path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """df with the exact token count of each text."""
    names = [c for c in df.columns if c != name]
    return prefix_tables(df.select(names), vocabulary_path, text, "__table").select(*names, tokens_in(F.col("__table")).alias(name))


def prefix_counts(df: DataFrame, vocabulary_path: str, text: str = "text", name: str = "prefix_tokens") -> DataFrame:
    """df with an array of the token counts of all prefixes of each text, entry 0 being 0."""
    names = [c for c in df.columns if c != name]
    table = F.col("__table")
    runs = F.transform(table["starts"], lambda s, i: F.transform(F.sequence(s + 1, F.coalesce(F.get(table["starts"], i + 1), chars_in(table).cast("int"))), lambda place: (F.get(table["before"], i) + _entry(table, place)).cast("int")))
    return prefix_tables(df.select(names), vocabulary_path, text, "__table").select(*names, F.concat(F.array(F.lit(0)), F.flatten(runs)).alias(name))


def fit_budget(df: DataFrame, vocabulary_path: str, budget: int, text: str = "text", name: str = "fits") -> DataFrame:
    """df with the length of the longest prefix of each text that has at most budget tokens."""
    names = [c for c in df.columns if c != name]
    return prefix_tables(df.select(names), vocabulary_path, text, "__table").select(*names, longest_within(F.col("__table"), F.lit(budget)).alias(name))
