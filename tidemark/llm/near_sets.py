"""The exact check of near-duplicates: a lossless set-similarity join of word shingles within given blocks, and components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ascending, batched, joined, shuffle_partitions, written
from .components import connected_components
from .simhash import centres

#: Words of a shingle; texts of no more words are one shingle.
SHINGLE, SEED = 5, 42
#: Sets are linked from a similarity of 4/5 on: 9 times what they share is at least 4 times the sum of their sizes.
#: They differ, then, in a ninth of that sum at most, and the smaller has 4/5 of the larger's size at least.
SHARED, SIZES = 9, 4
#: Classes of sizes up to this many shingles are keyed by single shingles instead of parts.
SMALL = 64
#: Blocks of so few nodes are compared whole, without keys; and the hashes of a part of what is compared.
FEW, PART = 8, 1 << 17


def shingles(text: bytes) -> np.ndarray:
    """The different shingles of a text in UTF-8, as sorted hashes: A-Z lowered, words split at ASCII white space."""
    from xxhash import xxh64_intdigest

    words, join = text.lower().split(), b" ".join
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(join(words), SEED)] if words else [], np.uint64)
    return ascending(np.fromiter((xxh64_intdigest(join(x), SEED) for x in zip(*(words[k:] for k in range(SHINGLE)))), np.uint64, len(words) - SHINGLE + 1))


def _bounds(most: int = 1 << 32) -> np.ndarray:
    """The largest size of each class. Sets of similar sizes, 4 : 5 at least, are in one class or in neighbouring ones."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 2)
    return np.array(out)


_BOUNDS = _bounds()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def keys(found: np.ndarray) -> np.ndarray:
    """Keys of a set, one of which any set of a similarity of 4/5 or more has, too.

    Two sets meet in the class of the larger, so each has keys for its own class and, if the larger can be there, the next. In small classes the keys are
    the least hashes: as four fifths are shared, one of the first fifth and one more is. In larger ones hashes are dealt to
    parts, and what a part holds is a key. A set of n has no more than n / 4 differences from one that is similar, and more
    parts than that hold something, so one of them is untouched.
    """
    n = len(found)
    if not n:
        return found
    own, out = int(np.searchsorted(_BOUNDS, n)), []
    for c in (own, own + 1) if 5 * n > 4 * int(_BOUNDS[own]) else (own,):
        most, salt = int(_BOUNDS[c]), np.uint64(c) << np.uint64(40)
        if most <= SMALL:
            out.append(_mixed(found[: n - -(-4 * n // 5) + 1] ^ salt))
            continue
        part = (_mixed(found) % np.uint64(most * 5 // 16 + 16)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.diff(part[order], prepend=-1))
        if len(starts) <= n // 4:
            raise ValueError("too few parts hold a shingle")  # seven standard deviations off or more, whatever n is
        sums = np.add.reduceat(_mixed(found[order] + np.uint64(1)), starts)
        out.append(_mixed(sums ^ _mixed(salt + part[order][starts].astype(np.uint64) + np.uint64(1))))
    return np.concatenate(out)


def _digest(found: np.ndarray) -> bytes:
    """128 bits, so that different sets among any number of texts aren't taken for one."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _rows(docs: DataFrame, whole: bool) -> DataFrame:
    """doc_id, block, node (a digest of the set of shingles), n (its size) and, of ``whole`` sets, items for each row of ``docs``
    (doc_id, block, text)."""
    kind = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text.as_py()) for text in batch.column(2)]
            out = [*batch.columns[:2], pa.array([*map(_digest, found)], pa.binary()), pa.array([*map(len, found)], pa.int64())]
            if whole:
                out.append(pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "block", "node", "n", "items"][: len(out)])

    texts = docs.select("doc_id", "block", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return batched(texts).mapInArrow(run, f"{kind}, node binary, n long" + ", items array<long>" * whole)


def _keyed(sets: DataFrame) -> DataFrame:
    """node and its keys for each row of ``sets`` (node, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [keys(x.values.to_numpy().view(np.uint64)).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "keys"])

    return batched(sets.select("node", "items")).mapInArrow(run, "node binary, keys array<long>").select("node", F.explode("keys").alias("key"))


def linked(items: list[np.ndarray], sides: np.ndarray | None = None) -> np.ndarray:
    """For each set of sorted hashes the least place of the sets that similarities of 4/5 or more connect it with.

    ``sides``: only sets of different sides are compared. Hashes are put in order of how many sets have them, rare ones first; sets of a
    similarity of 4/5 share one of the first fifth and one more, so only what these have in common is looked at, among sets of a fitting size that
    aren't connected yet. What two sets share is then counted on all their hashes.
    """
    n, label = np.array([len(x) for x in items]), np.arange(len(items))
    flat = np.concatenate(items) if len(items) else np.zeros(0, np.uint64)
    if not len(flat):
        return label
    _, back, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    at = np.repeat(np.arange(len(items)), n)
    ids = rank[back]
    by_set = np.lexsort((ids, at))
    ids, start = ids[by_set], np.cumsum(n) - n
    mine = [ids[a : a + k] for a, k in zip(start, n)]
    head = [x[: len(x) - -(-4 * len(x) // 5) + 1] for x in mine]

    order = np.argsort(n, kind="stable")  # sets by size; from here on a set's number is its place there
    size, label_of = n[order], np.arange(len(items))
    last = np.searchsorted(size, size * 5 // 4, side="right")
    side = None if sides is None else np.asarray(sides)[order]
    lists = [head[i] for i in order]
    listed = np.concatenate(lists)
    owner = np.repeat(np.arange(len(items)), [len(x) for x in lists])
    sorted_ = np.lexsort((owner, listed))
    listed, owner = listed[sorted_], owner[sorted_]
    ends = np.flatnonzero(np.append(listed[1:] != listed[:-1], True)) + 1
    begin = dict(zip(listed[ends - 1].tolist(), zip(np.append(0, ends[:-1]).tolist(), ends.tolist())))
    mark = np.zeros(len(often), bool)
    done: set[int] = set()  # hashes whose sets are all connected
    for i in range(len(items)):
        others = []
        for h in lists[i].tolist():
            lo, hi = begin[h]
            if hi - lo < 2 or h in done:
                continue
            own = owner[lo:hi]
            if (label_of[own] == label_of[i]).all():
                done.add(h)
                continue
            others.append(own[np.searchsorted(own, i, side="right") : np.searchsorted(own, last[i])])
        if not others:
            continue
        found = np.unique(np.concatenate(others))
        found = found[label_of[found] != label_of[i]]
        if side is not None:
            found = found[side[found] != side[i]]
        mark[mine[order[i]]] = True
        for a in range(0, len(found), 256):
            some = found[a : a + 256]
            some = some[label_of[some] != label_of[i]]
            if len(some):
                both = np.add.reduceat(mark[np.concatenate([mine[order[k]] for k in some])], np.cumsum(size[some]) - size[some], dtype=np.int64)
                near = some[SHARED * both >= SIZES * (size[i] + size[some])]
                if len(near):
                    groups = np.unique(np.append(label_of[near], label_of[i]))
                    label_of[np.isin(label_of, groups)] = groups[0]
        mark[mine[order[i]]] = False
    least = np.full(len(items), len(items))
    np.minimum.at(least, label_of, order)
    label[order] = least[label_of]
    return label


def _compared(cells: DataFrame, tasks: int) -> DataFrame:
    """u and v, nodes that connect what similar sets of one cell (block, lo, hi) do; of a cell of two parts, sets of different ones."""
    key = ["block", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*key, "own", "node")]
            for i, (*now, own, node) in enumerate(zip(*columns)):
                if now != cell:
                    yield from links(cell, held)
                    cell, held = now, []
                held.append((own, node, batch.column(5)[i].values.to_numpy().view(np.uint64)))
        yield from links(cell, held)

    def links(cell: list | None, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        own, nodes, items = (list(x) for x in zip(*held))
        high, low = np.frombuffer(b"".join(nodes), ">u8").reshape(-1, 2).T
        centre = centres(linked(items, None if cell[1] == cell[2] else np.array(own)), low, high)
        at = np.flatnonzero(centre != np.arange(len(nodes)))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in x], pa.binary()) for x in (at, centre[at])], names=["u", "v"])

    return batched(cells).repartition(tasks, *key).sortWithinPartitions(*key).mapInArrow(run, "u binary, v binary")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id and component_id for each row of ``docs`` (doc_id, text, block) that has a doc_id.

    Texts of one block are linked if their different shingles have a Jaccard similarity of 4/5 or more; component_id is the
    least doc_id that links reach. Texts without words, null ones too, are alike, and equal sets are, whatever their blocks.
    Repeated rows stay; an empty table gives no rows.

    Equal sets are one node. A block is first cut into what shares keys, as sets without a common key can't be linked, and
    what is left together is compared: in one task if it is small, else cut into parts of a bounded number of hashes, each
    two parts in one task. Rows are nodes and stars of links, never pairs of a group, and no link is left out.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select("doc_id", "text", "block")
    rows = written(_rows(docs, False), "sets")
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("block").alias("block"), F.count("*").alias("rows")), "nodes")
    blocks = written(nodes.groupBy("block").agg(F.count("*").alias("members")).where("members > 1"), "blocks")
    some = written(joined(nodes.select("node", "doc_id", "n", "block"), blocks.withColumn("rows", F.col("members")), "block", "rows"), "some")
    ids = some.select("doc_id").distinct()
    sets = _rows(docs.join(ids.hint("merge"), "doc_id", "left_semi"), True).select("node", "items").dropDuplicates(["node"])
    sets = written(sets.join(some.select("node", "n", "members", F.col("block").alias("own")), "node"), "items")

    small = F.col("members") <= FEW
    keyed = _keyed(sets.where(~small)).join(sets.where(~small).select("node", "own"), "node").select(F.xxhash64("key", "own").alias("key"), "node")
    keyed = written(keyed.union(sets.where(small).select(F.xxhash64("own").alias("key"), "node")), "keys")
    first = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("v")).where("n > 1")
    near = connected_components(joined(keyed, written(first, "first"), "key").select(F.col("node").alias("u"), "v"))
    named = written(sets.join(near.select(F.col("u").alias("node"), F.col("v").alias("block")), "node", "left").select("node", "n", F.coalesce("block", "node").alias("block")), "blocks")
    sized = named.groupBy("block").agg(F.count("*").alias("members"), F.ceil(F.sum("n") / PART).alias("parts")).where("members > 1")
    parted = written(joined(named, sized, "block", "members"), "parts")
    cells = sets.select("node", "items").join(parted, "node").select("node", "items", "block", F.pmod(F.xxhash64("node", F.lit(11)), "parts").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    cells = cells.select("block", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "items")
    cells = cells.where("lo = hi or own = lo or own = hi")
    volume = parted.agg(F.coalesce(F.sum(F.col("n") * F.col("parts")), F.lit(0)).alias("n")).first()["n"]
    links = _compared(cells, max(shuffle_partitions(spark), -(-volume // (4 * PART))))
    component = connected_components(links).select(F.col("u").alias("node"), F.col("v").alias("least"))
    named = written(nodes.join(component, "node", "left").select("node", "doc_id", "rows", F.coalesce("least", "node").alias("component")), "named")
    least = written(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "least")
    named = written(joined(named.select("node", "rows", "component"), least, "component").select("node", "rows", "component_id"), "components")
    return joined(rows.select("doc_id", "node"), named, "node", "rows").select("doc_id", "component_id")
