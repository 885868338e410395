"""Encoding of whole texts with a public byte-level BPE vocabulary.

The vocabulary's ranks are serialised as a sentencepiece BPE model: every byte
string becomes a piece of printable stand-ins for its bytes, scored by its
negative rank, under identity normalisation, so that the piece number is the
token id.  A text is cut into pre-tokens by the vocabulary's pattern, each
distinct pre-token of a batch is encoded once, and decoding maps pieces back to
bytes.

Defined results: null and empty texts have no ids (an empty list); special
tokens are ordinary text; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; a parameter of the session or the environment.
DEFAULT_FOLDER = "/opt/tokenizers"
#: Pre-tokens a worker remembers; it forgets all of them when full.
MEMORY = 200_000


def byte_letters() -> list[str]:
    """A printable stand-in for each byte: itself if printable in Latin-1, else a letter from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(0x100 + n))
        n += b not in plain
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model (protobuf) whose piece numbers are the ranks; the unknown piece comes last."""
    letters = byte_letters()
    order = sorted(ranks, key=ranks.get)
    if [ranks[k] for k in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(1, _field(1, "".join(letters[b] for b in k).encode()) + _field(2, -float(i))) for i, k in enumerate(order)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, -1e9) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(order))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder over a serialised model and a pre-token pattern."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern)
        letters = byte_letters()
        self.table = {b: letters[b] for b in range(256)}
        self.back = {c: b for b, c in enumerate(letters)}
        self.seen: dict[str, list[int]] = {}

    def _learn(self, new: list[str]) -> None:
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for p in new]
        for p, ids in zip(new, self.sp.encode(mapped, out_type=int, num_threads=1), strict=True):
            self.seen[p] = ids

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        if len(self.seen) > MEMORY:
            self.seen.clear()
        parts = [self.split.findall(t) if t else [] for t in texts]
        seen = self.seen
        new = {p for own in parts for p in own if p not in seen}
        if new:
            self._learn(list(new))
        return [[i for p in own for i in seen[p]] for own in parts]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, by the inverse mapping of pieces to bytes."""
        return bytes(self.back[c] for i in ids for c in self.sp.id_to_piece(int(i))).decode("utf-8", "replace")


_CODEC: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec per worker and model."""
    key = id(shared.value[0])
    if key not in _CODEC:
        _CODEC[key] = Codec(*shared.value)
    return _CODEC[key]


def tokenizer_folder(spark: SparkSession) -> str:
    return spark.conf.get("spark.skosloom.tokenizers", None) or os.environ.get("SKOSLOOM_TOKENIZERS", DEFAULT_FOLDER)


def shared_model(spark: SparkSession, name: str = "byte_bpe_50k", folder: str | None = None, pattern: str | None = None):
    """Broadcast of the serialised model (fixed size, about a megabyte) and its pre-token pattern."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = f"{folder or tokenizer_folder(spark)}/{name}.tiktoken"
    return spark.sparkContext.broadcast((serialise(read_ranks(path)), pattern))


def encoded(text: Column, shared) -> Column:
    """Ids of ``text`` (array of int); null and empty texts give an empty array."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared)
        for s in batches:
            yield pd.Series(codec.encode_batch(s.tolist()), index=s.index, dtype=object)

    return ids(text)


def decoded(ids: Column, shared) -> Column:
    """Text of an array of ids; null gives null, an empty array the empty text."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared)
        for s in batches:
            yield s.map(lambda x: None if x is None else codec.decode(x))

    return text(ids)


def token_count(text: Column, shared) -> Column:
    """Number of ids of ``text``; only the numbers leave the worker."""

    @F.pandas_udf("bigint")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared)
        for s in batches:
            yield pd.Series([len(x) for x in codec.encode_batch(s.tolist())], index=s.index, dtype="int64")

    return size(text)
