"""Byte-level BPE encoding and decoding.

encode() splits each text by a pattern, whose classes are those of the library's Unicode version, and sends every piece through a lazily determinised transducer
(bpe.Transducer); pieces met before come from a bounded table. decode() turns ids back into text through an
incremental UTF-8 state machine that works across token boundaries.

Null and empty texts give an empty array of ids; null arrays of ids give an empty text. Ids outside the
vocabulary raise an error. Very long texts are encoded whole, in memory in proportion to the longest of them; an empty
table gives an empty result. Repeated rows are encoded alike; columns other than the named ones pass through,
and an earlier column of the output's name is replaced.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tamis.llm.bpe import Memo, Merges, Transducer
from tamis.llm.classes import Pieces
from tamis.llm.runtime import map_rows, resident

#: The bytes of the pieces that a worker remembers.
MEMO_BYTES = 32 << 20
#: The transducer's table holds so many states.
STATES = 60_000
#: What a remembered piece takes besides its characters and ids.
PIECE_BYTES = 180


def read_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Encoder:
    """Encodes texts by ranks; every match of pattern is a piece of its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_bytes: int = MEMO_BYTES, states: int = STATES):
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.pieces = Pieces(pattern)
        self.transducer = Transducer(Merges(self.ids, lambda a, b, get=self.ids.get: get(a + b)), states)
        self.memo = Memo(self.piece, memo_bytes, lambda piece, made: PIECE_BYTES + 2 * len(piece) + len(made))

    def piece(self, piece: str) -> bytes:
        """The ids of one piece, as 32-bit integers."""
        text = piece if piece.isascii() else piece.encode().decode("latin-1")
        whole = self.ids.get(text)
        return array("i", self.transducer.run(text) if whole is None else (whole,)).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        if not text:
            return np.empty(0, np.int32)
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.pieces(text))), np.int32)


class Utf8Stream:
    """An incremental UTF-8 decoder: a state machine whose state is the bytes of a character begun.

    feed() returns the characters that are complete; ill-formed bytes become U+FFFD, one for each maximal
    part of a character, as the Unicode standard recommends.
    """

    def __init__(self) -> None:
        self.code, self.missing, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, chunk: bytes) -> str:
        out: list[str] = []
        for byte in chunk:
            if self.missing:
                if self.low <= byte <= self.high:
                    self.code, self.missing, self.low, self.high = self.code << 6 | byte & 0x3F, self.missing - 1, 0x80, 0xBF
                    if not self.missing:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.missing, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.code, self.missing = byte & 0x1F, 1
            elif 0xE0 <= byte <= 0xEF:
                self.code, self.missing = byte & 0x0F, 2
                self.low, self.high = (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
            elif 0xF0 <= byte <= 0xF4:
                self.code, self.missing = byte & 0x07, 3
                self.low, self.high = (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        """What is left at the end of the stream."""
        left = "�" if self.missing else ""
        self.missing, self.low, self.high = 0, 0x80, 0xBF
        return left


class Decoder:
    """Decodes ids token by token; tokens of whole characters skip the byte steps while no character is open."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes: dict[int, bytes] = {}  # of tokens that aren't whole characters
        self.whole: dict[int, str | None] = {}
        for token, rank in ranks.items():
            try:
                self.whole[rank] = token.decode()
            except UnicodeDecodeError:
                self.whole[rank], self.bytes[rank] = None, token

    def decode(self, ids: np.ndarray | None) -> str:
        if ids is None or not len(ids):
            return ""
        ids = ids.tolist()
        parts = list(map(self.whole.__getitem__, ids))
        if None not in parts:
            return "".join(parts)
        stream = Utf8Stream()
        for i, part in enumerate(parts):
            if part is None or stream.missing:
                parts[i] = stream.feed(self.bytes[ids[i]] if part is None else part.encode())
        return "".join(parts) + stream.finish()


def _kept(kind: type, content: bytes, *more):
    """One encoder or decoder a vocabulary for the tasks of this operator in a Python worker."""
    return resident((kind.__name__, hash(content), *more), lambda: kind(read_ranks(content), *more))


def id_array(rows: list[np.ndarray]) -> pa.ListArray:
    """The ids of several texts as one Arrow array."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", drop_text: bool = False) -> DataFrame:
    """df with the ids of column text. The rank file is read on the driver and sent to the executors."""
    with open(ranks_path, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())

    def start():
        encoder = _kept(Encoder, content.value, pattern)

        return lambda texts: [id_array([encoder.encode(t) for t in texts])]

    return map_rows(df, [text], [T.StructField(ids, T.ArrayType(T.IntegerType()))], start, [text] if drop_text else None, holds=True)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", text: str = "decoded", drop_ids: bool = False) -> DataFrame:
    """df with the text of the ids in column ids."""
    with open(ranks_path, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())

    def start():
        decoder = _kept(Decoder, content.value)
        return lambda rows: [[decoder.decode(x) for x in rows]]

    return map_rows(df, [ids], [T.StructField(text, T.StringType())], start, [ids] if drop_ids else None, holds=True)


def encode_and_decode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", drop_text: bool = False, memo_bytes: int = MEMO_BYTES, states: int = STATES) -> DataFrame:
    """encode() and decode() of its ids in one pass, which spares the ids a way to the JVM and back and a second Python worker.

    A worker remembers pieces of memo_bytes and so many states, of some 400 bytes each.
    """
    with open(ranks_path, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())

    def start():
        encoder, decoder = _kept(Encoder, content.value, pattern, memo_bytes, states), _kept(Decoder, content.value)

        def work(texts):
            rows = [encoder.encode(t) for t in texts]
            return [id_array(rows), [decoder.decode(r) for r in rows]]

        return work

    return map_rows(df, [text], [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())], start, [text] if drop_text else None, holds=True)
