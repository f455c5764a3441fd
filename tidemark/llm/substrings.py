"""Exact repeats of word passages: fixed-block anchors, probed by every rolling window, and the repeats they are part of."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import cached_property, lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import ascending, batched, scratch, shuffle_partitions, table, text_bytes, written

WINDOW = 50
#: Bytes of text that a group of documents holds about, hashes that a home looks after about, bytes of a word about, and
#: hashes that a sender has for each home at least, on average.
GROUP_BYTES, HOME_HASHES, WORD_BYTES, SENT = 4 << 20, 1 << 20, 6, 1 << 10

_U = np.uint64


@lru_cache(8)
def _all_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[:1] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def _odd_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    up, down = _all_powers(base, max(1 << 20, 1 << (n - 1).bit_length()))
    return up[:n], down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(32)) * _U(0xD6E8FEB86659FD93)
    x = (x ^ x >> _U(32)) * _U(0xD6E8FEB86659FD93)
    return x ^ x >> _U(32)


#: Odd bases of the polynomial hashes of words and of windows, and the bytes' values.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTES = np.random.default_rng(101).integers(1, 2**63, 256, dtype=np.uint64)


def routes(size: int) -> tuple[int, int]:
    """Bytes of text of a sender, and homes, for ``size`` bytes of text.

    Each sender has something for each home, so that what is sent is a row for every two of them. With few hashes in a row
    rows would be as many as hashes, and grow with the square of the data. Therefore senders and homes both grow with the
    root of the data where HOME_HASHES would leave a sender less than SENT hashes for a home: the rows stay under one for
    SENT hashes. At 10 TB a sender has 250 MB of text.
    """
    hashes = max(1, size // WORD_BYTES)
    most = max(HOME_HASHES, math.isqrt(SENT * hashes))
    homes = max(1, -(-hashes // most))
    return GROUP_BYTES if homes * SENT * WORD_BYTES <= GROUP_BYTES else max(GROUP_BYTES, most * WORD_BYTES), homes


class Words:
    """The words of some documents: where each starts and ends in the joined bytes, its document, and a hash of it."""

    def __init__(self, texts: list[bytes]):
        self.bytes = b" ".join(texts) + b" "
        raw = np.frombuffer(self.bytes, np.uint8)
        space = (raw == 32) | (raw >= 9) & (raw <= 13)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])  # of each document, its first word
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    @cached_property
    def hash(self) -> np.ndarray:
        """A hash of each word: by pieces, as there is a power for each byte; a word longer than a piece has a piece of its own."""
        raw, base, values = np.frombuffer(self.bytes, np.uint8), _BASES[0], _BYTES
        out, n, at = np.zeros(len(self.start), np.uint64), len(self.start), 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + (1 << 19), side="right")))
            a, b = int(self.start[at]), int(self.end[to - 1])
            up, down = _odd_powers(base, b - a + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw[a:b]] * down[:-1], dtype=np.uint64)])
            s, e = self.start[at:to] - a, self.end[at:to] - a
            out[at:to] = _mix((sums[e] - sums[s]) * up[s] + (e - s).astype(np.uint64) * _U(0x2545F4914F6CDD1D))
            at = to
        return out

    def windows(self, width: int) -> np.ndarray:
        """A hash of the ``width`` words from each word on, whatever document they are in."""
        h = self.hash
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        up, down = _odd_powers(_BASES[1], len(h))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down, dtype=np.uint64)])
        return _mix((sums[width:] - sums[:n]) * up[:n])

    def whole(self, width: int) -> np.ndarray:
        """Where the ``width`` words from a word on are in one document."""
        n = max(0, len(self.doc) - width + 1)
        return self.doc[:n] == self.doc[width - 1 : width - 1 + n] if n else np.zeros(0, bool)


def _pack(hashes: np.ndarray, *others: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte by byte of the same weight, and what goes with them, compressed."""
    gaps = np.diff(hashes, prepend=_U(0))
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in (gaps, *others)]
    return zstandard.ZstdCompressor(level=1).compress(len(hashes).to_bytes(8, "little") + b"".join(planes))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in ("<u8", *kinds):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _by_home(hashes: np.ndarray, homes: int) -> np.ndarray:
    """Edges of the homes' ranges among ascending 64-bit hashes."""
    return np.searchsorted(hashes, np.array([(k << 64) // homes for k in range(1, homes)], np.uint64)).tolist()


def _ranges(hashes: np.ndarray, homes: int) -> Iterator[tuple[int, slice]]:
    edges = [0, *_by_home(hashes, homes), len(hashes)]
    for home, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        if lo < hi:
            yield home, slice(lo, hi)


def _least(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys and the least value of each."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return keys[first], values[first]


def _groups(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, Words]]:
    """The keys and words of each group of a sender, one at a time."""
    for keys, lengths, packed in zip(rows["keys"], rows["lengths"], rows["texts"]):
        raw, ends = zstandard.ZstdDecompressor().decompress(packed), np.cumsum(np.frombuffer(lengths, "<i8")).tolist()
        yield np.frombuffer(keys, "<i8"), Words([raw[a:b] for a, b in zip([0, *ends], ends)])


def _rest(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("key", "text")]


def _table_bytes(batches: list[pa.RecordBatch]) -> bytes | None:
    """Columns that aren't looked at, as they travel with a group."""
    if not batches or not batches[0].num_columns:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for x in batches:
            out.write_batch(x)
    return sink.getvalue().to_pybytes()


def grouped(docs: DataFrame, buckets: int, sender_bytes: int = GROUP_BYTES) -> DataFrame:
    """g, keys, lengths, texts and rest: a row for about GROUP_BYTES of ``docs`` (key, text as bytes, others), packed, in
    buckets by g, the sender: groups that follow one another, of about ``sender_bytes``.

    Groups are cut from the tasks that read ``docs``, so no text is shuffled, and bucketed, so that no later step shuffles
    them either. The catalog forgets the table as soon as its plan is known; its files are in the shared folder.
    """
    spark = docs.sparkSession
    schema = pa.schema([("g", pa.int64()), ("keys", pa.binary()), ("lengths", pa.binary()), ("texts", pa.binary()), ("rest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, keys, texts, rest, size, sent = TaskContext.get().partitionId() << 24, [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_pylist([{"g": g, "keys": np.array(keys, "<i8").tobytes(), "lengths": np.array([*map(len, texts)], "<i8").tobytes(), "texts": packed, "rest": _table_bytes(rest)}], schema=schema)

        for batch in batches:
            others, first = batch.select(batch.schema.names[2:]), 0
            for i, (key, text) in enumerate(zip(batch.column(0), batch.column(1))):
                keys.append(key.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= GROUP_BYTES:
                    rest.append(others.slice(first, i + 1 - first))
                    yield row()
                    sent += size
                    if sent >= sender_bytes:
                        g, sent = g + 1, 0
                    keys, texts, rest, size, first = [], [], [], 0, i + 1
            rest.append(others.slice(first))
        if keys:
            yield row()

    name, path = f"groups_{uuid.uuid4().hex}", scratch(spark, "groups")
    batched(docs).select("key", "text", *_rest(docs)).mapInArrow(run, "g long, keys binary, lengths binary, texts binary, rest binary").write.bucketBy(buckets, "g").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


class _Probes:
    """What both passes over a group need: its rolling block windows, and its own anchor blocks."""

    def __init__(self, words: Words, block: int, bits: int):
        self.hash = words.windows(block) >> _U(64 - bits) << _U(64 - bits)
        self.whole = words.whole(block)
        place = np.arange(len(self.hash)) - words.first[words.doc[: len(self.hash)]]
        self.anchor = self.whole & (place % block == 0)


def _lookup(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, where) of each wanted key."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), int)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return sorted_keys[at] == wanted, at


NONE = np.int64(2**63 - 1)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, kept (what earlier documents leave of it), n_words, n_removed and all other columns for each row of ``docs``
    (key, text as bytes, others).

    Documents are cut into senders, and the hashes' range into homes, as routes() says; a task holds one of either, and of a
    sender the words of one group of about GROUP_BYTES. An anchor block has half a window's words: any window holds a whole
    block of those that start at multiples of that.

    1. Each sender sends each home one packed set of the hashes of its rolling windows of a block's words (the probes) and
       one of its anchor blocks with their least documents. Where a home finds another sender's anchor for a probe, it answers
       with the least document of that; and it tells an anchor's sender if another one's probe hit it. Hits within a sender
       stay there. Of common passages there is one entry for each sender, however many documents have them.
    2. Hits are extended: all windows around a hit, and around an anchor that was hit, go to their homes as 128 bits of
       BLAKE2b over their words with their least document, and those that another sender has with a smaller document come
       back. Truncated hashes in step 1 can only add windows to step 2, whose digests decide: windows of one digest have the
       same words, as nobody can make or meet two texts of one such digest.
    3. The removed words of a document are those of its windows that an earlier document has: where windows overlap, the
       whole maximal repeat.

    The texts are written once, in buckets by group, and never shuffled.
    """
    block = (window + 1) // 2
    size = text_bytes(docs)
    sender_bytes, homes = routes(size)
    bits = min(64, max(1, size // (WORD_BYTES * block)).bit_length() + 12)
    groups = grouped(docs, max(shuffle_partitions(docs.sparkSession), min(20_000, -(-size // (4 * sender_bytes)))), sender_bytes)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        g, rows, found, anchors = int(pdf["g"].iloc[0]), [], [], []
        for keys, words in _groups(pdf):
            probes = _Probes(words, block, bits)
            found.append(ascending(probes.hash[probes.whole]))
            at = np.flatnonzero(probes.anchor)
            anchors.append(_least(probes.hash[at], keys[words.doc[at]]))
        found = ascending(np.concatenate(found)) if len(found) > 1 else found[0]
        rows += [(home, g, 1, _pack(found[s])) for home, s in _ranges(found, homes)]
        found, least = _least(*(np.concatenate(x) for x in zip(*anchors)))
        rows += [(home, g, 0, _pack(found[s], least[s])) for home, s in _ranges(found, homes)]
        return pd.DataFrame(rows, columns=["home", "g", "kind", "blob"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """kind 0: own anchors that others hit; kind 1: probes that hit others' anchors, with their least document."""
        blocks = [(g, *_unpack(b, "<i8")) for g, k, b in zip(pdf["g"], pdf["kind"], pdf["blob"]) if k == 0]
        if not blocks:
            return pd.DataFrame([], columns=["g", "kind", "blob"])
        h = np.concatenate([x for _, x, _ in blocks])
        d = np.concatenate([x for _, _, x in blocks])
        own = np.repeat([g for g, _, _ in blocks], [len(x) for _, x, _ in blocks])
        order = np.lexsort((d, h))
        h, d, own = h[order], d[order], own[order]
        head = np.concatenate([[True], h[1:] != h[:-1]])
        keys, slot = h[head], np.cumsum(head) - 1
        d1, g1 = d[head], own[head]
        other = np.flatnonzero(own != g1[slot])  # the least entry of another group than the first's
        d2 = np.full(len(keys), NONE)
        first = np.unique(slot[other], return_index=True)
        d2[first[0]] = d[other[first[1]]]
        hits, one, rows = np.zeros(len(keys), np.int32), np.full(len(keys), -1), []
        for g, k, b in zip(pdf["g"], pdf["kind"], pdf["blob"]):
            if k == 1:
                (probe,) = _unpack(b)
                there, at = _lookup(keys, probe)
                at = at[there]
                hits[at] += 1
                one[at] = g
                least = np.where(g1[at] != g, d1[at], d2[at])
                known = least != NONE
                if known.any():
                    rows.append((g, 1, _pack(keys[at][known], least[known])))
        for g in dict.fromkeys(x[0] for x in blocks):
            at = ascending(slot[own == g])
            at = at[(hits[at] > 1) | (hits[at] == 1) & (one[at] != g)]
            if len(at):
                rows.append((g, 0, _pack(keys[at])))
        return pd.DataFrame(rows, columns=["g", "kind", "blob"])

    def candidates(left: pd.DataFrame, told: pd.DataFrame) -> Iterator[tuple[np.ndarray, Words, np.ndarray]]:
        """Keys and words of each group of a sender, and where windows start that may repeat, or be repeated."""
        outer = [_unpack(b, "<i8") for k, b in zip(told["kind"], told["blob"]) if k == 1]
        shared = [_unpack(b)[0] for k, b in zip(told["kind"], told["blob"]) if k == 0]
        groups, alone = [], len(left) == 1  # of more groups only the hashes are held, ten bytes a word, and their texts read again
        for keys, words in _groups(left):
            probes = _Probes(words, block, bits)
            at = np.flatnonzero(probes.anchor)
            outer.append(_least(probes.hash[at], keys[words.doc[at]]))
            groups.append((keys, np.diff(words.first), probes, words if alone else None))
        known, hits = _least(*(np.concatenate(x) for x in zip(*outer))), []
        for keys, sizes, probes, _ in groups:
            there, where = _lookup(known[0], probes.hash)
            hit = np.zeros(len(probes.hash), bool)
            hit[there] = known[1][where[there]] < np.repeat(keys, sizes)[: len(there)][there]
            hits.append(hit & probes.whole)
            shared.append(probes.hash[hits[-1]])
        shared = ascending(np.concatenate(shared))
        for (keys, _, probes, words), hit, again in zip(groups, hits, [(None, None)] if alone else _groups(left)):
            words = words or again[1]
            mark = hit | probes.anchor & _lookup(shared, probes.hash)[0]
            whole = words.whole(window)
            n = len(whole)
            sums = np.concatenate([[0], np.cumsum(mark)])
            yield keys, words, np.flatnonzero(whole & (sums[np.arange(n) + window - block + 1] > sums[:n])) if n else np.zeros(0, int)

    def extend(left: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame([], columns=["home", "g", "blob"])
        parts = [_distinct(*_digests(words, window, at), keys[words.doc[at]]) for keys, words, at in candidates(left, told)]
        h, more, least = _distinct(*(np.concatenate(x) for x in zip(*parts))) if len(parts) > 1 else parts[0]
        return pd.DataFrame([(home, int(left["g"].iloc[0]), _pack(h[s], more[s], least[s])) for home, s in _ranges(h, homes)], columns=["home", "g", "blob"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each group, the windows that another group has with a smaller document than it has itself."""
        parts = [_unpack(b, "<u8", "<i8") for b in pdf["blob"]]
        h, more, least = _distinct(*(np.concatenate(x) for x in zip(*parts)))
        rows = []
        for g, (a, b, d) in zip(pdf["g"], parts):
            best = least[_place(h, more, a, b)]
            if (smaller := best < d).any():
                rows.append((g, _pack(a[smaller], b[smaller], best[smaller])))
        return pd.DataFrame(rows, columns=["g", "blob"])

    def keep(left: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["key", "kept", "n_words", "n_removed"]
        if left.empty:
            return pd.DataFrame([], columns=[*columns, *rest])
        found, own = [], None
        for keys, own, at in candidates(left, told[told["kind"] < 2]):
            found.append((keys, at, *_digests(own, window, at), keys[own.doc[at]]))
        parts = [(a, b, owner) for *_, a, b, owner in found] + [_unpack(x, "<u8", "<i8") for x in told.loc[told["kind"] == 2, "blob"]]
        h, more, least = _distinct(*(np.concatenate(x) for x in zip(*parts)))
        rows = []
        for (keys, at, a, b, owner), words in zip(found, [own] if len(left) == 1 else (x for _, x in _groups(left))):
            removed = np.zeros(len(words.start) + 1, np.int64)
            again = at[least[_place(h, more, a, b)] < owner]
            np.add.at(removed, again, 1)
            np.add.at(removed, again + window, -1)
            gone, raw = np.cumsum(removed)[:-1] > 0, words.bytes
            for i, key in enumerate(keys):
                lo, hi = words.first[i], words.first[i + 1]
                stay = np.flatnonzero(~gone[lo:hi]) + lo
                text = b" ".join([raw[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist())])
                rows.append((key, text, hi - lo, hi - lo - len(stay)))
        out = pd.DataFrame(rows, columns=columns)
        if rest:
            others = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in left["rest"]]).to_pandas(types_mapper=pd.ArrowDtype)
            out[rest] = others[rest]
        return out

    rest = _rest(docs)
    schema = T.StructType([*T._parse_datatype_string("key long, kept binary, n_words long, n_removed long"), *docs.select(*rest).schema])
    sent = groups.groupBy("g").applyInPandas(send, "home int, g long, kind int, blob binary")
    told = written(sent.groupBy("home").applyInPandas(answer, "g long, kind int, blob binary"), "answers")
    around = groups.groupBy("g").cogroup(told.groupBy("g")).applyInPandas(extend, "home int, g long, blob binary")
    settled = written(around.groupBy("home").applyInPandas(settle, "g long, blob binary"), "settled")
    told = told.unionByName(settled.withColumn("kind", F.lit(2)))
    return groups.groupBy("g").cogroup(told.groupBy("g")).applyInPandas(keep, schema)


def _digests(words: Words, window: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the words, parted by one space, of each window that starts at one of ``at``, as two halves."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    used = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(used, at, 1)
    np.add.at(used, at + window, -1)
    used = np.flatnonzero(np.cumsum(used)[:-1] > 0)
    sizes = words.end[used] - words.start[used] + 1
    edge = np.concatenate([[0], np.cumsum(sizes)])
    plain = b" ".join([words.bytes[s:e] for s, e in zip(words.start[used].tolist(), words.end[used].tolist())])
    first = np.searchsorted(used, at)
    made = b"".join([blake2b(plain[s:e], digest_size=16).digest() for s, e in zip(edge[first].tolist(), (edge[first + window] - 1).tolist())])
    halves = np.frombuffer(made, "<u8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def _distinct(h: np.ndarray, more: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (h, more), ascending, with the least document of each."""
    order = np.lexsort((least, more, h))
    h, more, least = h[order], more[order], least[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])]) if len(h) else np.zeros(0, bool)
    return h[first], more[first], least[first]


def _place(h: np.ndarray, more: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where each pair (a, b) is among the ascending distinct pairs (h, more), which hold all of them."""
    at = np.searchsorted(h, a)
    while len(wrong := np.flatnonzero(more[at] != b)):
        at[wrong] += 1  # different windows of one first hash, next to each other
    return at


#: The key of rows without an id: they come before all others.
NO_ID = -(2**63)


def deduplicated(docs: DataFrame, window: int = WINDOW, carry: str | None = None) -> DataFrame:
    """doc_id, kept (text), n_words, n_removed and the column ``carry`` for each row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. Null texts have no words. Rows of one doc_id don't count as earlier than each other, and a null id
    is smaller than any. An empty table gives no rows. Other columns are ignored.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *([carry] if carry else []))
    return repeats(keyed, window).select(F.nullif("key", F.lit(NO_ID)).alias("doc_id"), F.col("kept").cast("string").alias("kept"), "n_words", "n_removed", *([carry] if carry else []))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words. Rows of one doc_id remove nothing from each other, a null id is smaller than any, and
    ties don't arise: repeated rows stay with all their words. Texts of any length are whole; an empty table gives no rows;
    other columns are ignored."""
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
