"""Byte-level BPE through a sentencepiece model that is serialised here from a rank file.

Each token's bytes become one printable character per byte; a piece's score is its negative rank, so the merge that
sentencepiece takes first is the one with the lowest rank. Normalisation is the identity. The unknown piece comes last,
hence piece ids equal ranks. Text is cut into pre-tokens by the tokenizer's pattern and every pre-token is encoded
separately; decoding maps each id back to its bytes.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, open_fs

CACHE_UNITS = 200_000

_cached: dict[tuple[str, str], "ByteBpe"] = {}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protocol-buffer field: integers as varints, floats as fixed 32 bits, the rest by length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is one, else one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    fs, inner = open_fs(path)
    with fs.open_input_file(inner) as f:
        pairs = [line.split() for line in f.read().splitlines() if line]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must be consecutive from 0")
    return [tokens[r] for r in range(len(tokens))]


def serialize_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto (BPE, identity normalisation) whose piece ids are the ranks."""
    alphabet = byte_alphabet()
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(map(alphabet.__getitem__, token))
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, normal))
    out += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown))
    n = len(tokens)
    absent = (1 << 64) - 1  # -1: no such control piece
    out += _field(2, _field(3, bpe) + _field(4, n + 1) + _field(40, n) + b"".join(_field(k, absent) for k in (41, 42, 43)))
    out += _field(3, _field(1, "identity") + b"".join(_field(k, 0) for k in (3, 4, 5)))
    return bytes(out)


class ByteBpe:
    """Encoder and decoder of one rank file. Encodings of space-delimited units are kept in a bounded memo."""

    def __init__(self, path: str, pattern: str):
        import re

        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(self.tokens))
        # White space as Unicode's White_Space property has it: U+001C to U+001F are none.
        self.pretokens = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.mapped = dict(enumerate(byte_alphabet()))
        self.loose = re.compile(r" \s|\s |^\s|\s$").search
        self.memo: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        ids: list[int] = []
        for piece in self.pretokens(unit):
            raw = piece.encode("utf-8", "replace")
            if (known := self.whole.get(raw)) is not None:
                ids.append(known)
            else:
                ids += self.model.encode(raw.decode("latin-1").translate(self.mapped))
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers.

        A single space between two other characters always begins a pre-token, so a text is cut there and the ids of
        each unit are looked up; a text with other runs of white space around a space is encoded in one piece.
        """
        if not text:
            return b""
        if self.loose(text):
            return self._unit(text)
        first, *rest = text.split(" ")
        memo, out = self.memo, [self._unit(first)]
        if len(memo) > CACHE_UNITS:
            memo.clear()
        for unit in rest:
            ids = memo.get(unit)
            if ids is None:
                ids = self._unit(" " + unit)
                if len(unit) <= 64:
                    memo[unit] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def load(path: str, pattern: str) -> ByteBpe:
    """The codec of a file, loaded once in a Python worker."""
    if (path, pattern) not in _cached:
        _cached[path, pattern] = ByteBpe(path, pattern)
    return _cached[path, pattern]


def _ids(made: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0] + [len(x) // 4 for x in made]).astype("i4")
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(made))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _bytes(codec: ByteBpe, ids: pa.Array) -> pa.Array:
    ids = ids.fill_null([]) if ids.null_count else ids
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False).tolist(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
    return pa.array([codec.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


_IDS = T.ArrayType(T.IntegerType(), False)


def encode_documents(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Append ``out_col`` (array of int), the token ids of each whole text.

    Null and empty texts give an empty array. Rows are mapped one by one, so ties and repeated rows change nothing, an
    empty table gives an empty one, and a column already named ``out_col`` is replaced. Memory: a batch and the memo.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        codec = load(path, pattern)
        return [_ids([codec.encode(t.as_py() or "") for t in texts])]

    return append_columns(df, [T.StructField(out_col, _IDS)], compute, [text_col])


def decode_documents(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Append ``out_col`` (binary), the bytes that the ids stand for. Null ids give no bytes; an unknown id is an error."""
    return append_columns(df, [T.StructField(out_col, T.BinaryType())], lambda ids: [_bytes(load(path, pattern), ids)], [ids_col])


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Append both, the ids of each text and the bytes decoded from these ids, in one pass through a Python worker."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        codec = load(path, pattern)
        ids = _ids([codec.encode(t.as_py() or "") for t in texts])
        return [ids, _bytes(codec, ids)]

    return append_columns(df, [T.StructField(ids_col, _IDS), T.StructField(out_col, T.BinaryType())], compute, [text_col], rows=256)
