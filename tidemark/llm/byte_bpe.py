"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import batched, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Encoded pre-tokens that a worker keeps; beyond that it starts anew. Results don't depend on it.
KEPT = 400_000


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it has one, else the next of those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    more = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(more)) for b in range(256)]


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(vocabulary: dict[bytes, int]) -> bytes:
    """A serialised model: piece i is the token of rank i in byte characters with the score -i, and one unknown piece ends it.

    Ranks must be 0, 1, 2, ... without a gap, as piece numbers are token ids.
    """
    chars = byte_chars()
    by_rank = sorted(vocabulary, key=vocabulary.__getitem__)
    if [vocabulary[x] for x in by_rank] != [*range(len(by_rank))]:
        raise ValueError("ranks must be 0, 1, 2, ... without a gap")
    score = lambda x: _varint(2 << 3 | 5) + struct.pack("<f", x)
    pieces = [_field(1, _field(1, "".join(chars[b] for b in x).encode()) + score(-float(i))) for i, x in enumerate(by_rank)]
    pieces.append(_field(1, _field(1, b"<unk>") + score(0.0) + _field(3, 2)))  # type 2: unknown
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank))  # model type BPE, size, unknown's id
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, no white space removed or escaped
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


def _members(pattern: str) -> set[str]:
    """The characters that ``pattern`` matches in the Unicode tables of tiktoken's pattern matcher."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return {*bytes(probe.encode_ordinary(_EVERY)).decode()}  # what isn't matched gets no ids


_EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
#: The classes that the pattern tells apart, and for each a character of it that no alternative names; all others: "!".
_CLASSES = {r"\p{L}": "a", r"\p{N}": "1", r"\s": "\u2003"}


@lru_cache(1)
def _differing() -> dict[int, str]:
    """Code points that regex and tiktoken put into different classes, as their Unicode versions differ, with a stand-in of
    tiktoken's class."""
    import regex

    theirs = {c: _members(c) for c in _CLASSES}
    changed = {x for c in _CLASSES for x in theirs[c] ^ {*regex.findall(c, _EVERY)}}
    return {ord(x): next((sample for c, sample in _CLASSES.items() if x in theirs[c]), "!") for x in changed}


def _any_of(points: Iterable[int]) -> str:
    """A pattern for one character of ``points``, as ranges."""
    points = sorted(points)
    first = [x for x, before in zip(points, [-2, *points]) if x != before + 1]
    last = [x for x, after in zip(points, [*points[1:], -2]) if after != x + 1]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last)) + "]" if points else r"(?!)"


class Codec(dict):
    """Pre-tokens to their ids as bytes; what isn't kept is encoded by the model."""

    def __init__(self, path: str = VOCABULARY):
        import regex
        import sentencepiece

        vocabulary = ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(vocabulary))
        pattern, self.stand_in = regex.compile(public_tokenizers.PATTERN), _differing()
        self.findall, self.finditer = pattern.findall, pattern.finditer
        self.changed = re.compile(_any_of(self.stand_in)).search
        self.chars = dict(enumerate(byte_chars()))
        self.tokens = sorted(vocabulary, key=vocabulary.__getitem__)
        self.whole = {x: struct.pack("<I", i) for x, i in vocabulary.items()}

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        found = self.whole.get(raw)  # a pre-token that is a token is one, whatever merges would make of it
        if found is None:
            found = np.asarray(self.model.encode(raw.decode("latin-1").translate(self.chars)), "<u4").tobytes()
        if len(self) >= KEPT:
            self.clear()
        self[word] = found
        return found

    def split(self, text: str) -> list[str]:
        """Pre-tokens as tiktoken finds them: characters of a class that differs there are read as their stand-ins."""
        if not self.changed(text):
            return self.findall(text)
        return [text[slice(*m.span())] for m in self.finditer(text.translate(self.stand_in))]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str = VOCABULARY, ids: bool = True) -> DataFrame:
    """doc_id, ids (null unless asked for), n_tokens, ids_sha256, decoded_sha256 for each row of ``docs``.

    Null and empty texts have no ids. Repeated rows are encoded each; an empty table gives no rows; other columns are
    ignored. Nothing is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                done = [own.encode(x.as_py() or "") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(done if ids else [None] * len(done), pa.binary()), pa.array([len(x) // 4 for x in done], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in done]), pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in done])], schema=schema)

    return batched(docs).selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no ids, and the digests of nothing. A null doc_id stays null; repeated rows are encoded each;
    texts of any length are whole; an empty table gives no rows; other columns are ignored."""
    return encoded(table(spark, sf_dir, "documents"), ids=False).drop("ids")
