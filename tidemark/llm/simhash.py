"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming budget by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import batched, joined, shuffle_partitions, table, written
from .components import connected_components

SHINGLE, SEED, BUDGET = 3, 42, 2
#: Members of a node pair that one task joins in memory; larger pairs are split into pairs of their children first.
PAIR_ROWS = 16_384
#: Trie levels that such a split goes down, at most.
LEVELS = 6
#: Members of node pairs that a task of the join has about.
TASK_ROWS = 100_000
_ONE = np.uint64(1)
#: The bits of each byte value, least first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = 256 * np.arange(8)


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a text in UTF-8, repeats included: A-Z lowered, words split at ASCII white space."""
    from xxhash import xxh64_intdigest

    words, join = text.lower().split(), b" ".join
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(join(words), seed)] if words else [], np.uint64)
    return np.fromiter((xxh64_intdigest(join(x), seed) for x in zip(*(words[k:] for k in range(shingle)))), "<u8", len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    if not len(hashes):
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits(2 * (counts @ _BITS).ravel() > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text: each shingle counts as often as it occurs; zero for a text without words."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(text: bytes, shingle: int, several: int) -> list[int]:
    """``several`` SimHash values of one text: the first is fingerprint(), others come of the same hashes, each mixed anew."""
    first, out = shingle_hashes(text, shingle), []
    for k in range(several):
        x = first
        if k:
            x = x ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        out.append(majority(x))
    return out


def fingerprinted(docs: DataFrame, *keep: str, shingle: int = SHINGLE, several: int = 1) -> DataFrame:
    """``keep`` columns and fps, an array of ``several`` fingerprints as signed longs. Null texts count as empty. Nothing is
    shuffled."""
    docs = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    schema = docs.drop("_text").withColumn("fps", F.array(F.lit(0).cast("long"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprints(x.as_py(), shingle, several) for x in batch.column(len(keep))], np.uint64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * several, pa.int32()), pa.array(fps.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*keep, "fps"])

    return batched(docs).mapInArrow(run, schema)


def trie_pairs(values: np.ndarray, nodes: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in ``values`` of all pairs at most ``budget`` bits apart, one of either side of a pair of ``nodes``.

    ``nodes``: rows (from, to, from, to, used, bit). A side is a range of ``values`` (uint64) that is sorted, holds different
    values and agrees above ``bit``, that is, a node of a binary trie; the sides differ in ``used`` bits above. A node paired
    with itself gives each pair once.

    Pairs of nodes go down level by level together, those of all parts at once: both split at a bit, children on the same
    side keep the bits that differ so far, children on opposite sides have one more, and pairs beyond the budget or with an
    empty side go. Where either node holds few values what is left is compared. Work is a stack of parts of bounded size.
    """
    stack = [np.asarray(nodes, np.int64).reshape(-1, 6)]
    while stack:
        p = stack.pop()
        if len(p) > 32768:
            stack += np.array_split(p, 2)
            continue
        same = (p[:, 0] == p[:, 2]) & (p[:, 1] == p[:, 3])
        p = p[(p[:, 1] > p[:, 0]) & (p[:, 3] > p[:, 2]) & (p[:, 4] <= budget) & ~(same & (p[:, 1] - p[:, 0] < 2))]
        size = (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2])
        leaf = (size <= 32) | (p[:, 5] < 0)
        if leaf.any():
            q, n = p[leaf], size[leaf]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(q[:, 3] - q[:, 2], n)
            i, j = np.repeat(q[:, 0], n) + k // wide, np.repeat(q[:, 2], n) + k % wide
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            near &= (i < j) | np.repeat(q[:, 0] != q[:, 2], n)
            yield i[near], j[near]
        p = p[~leaf]
        if len(p):
            ca, cb = _cut(values, p[:, 0], p[:, 1], p[:, 5]), _cut(values, p[:, 2], p[:, 3], p[:, 5])
            same = (p[:, 0] == p[:, 2]) & (p[:, 1] == p[:, 3])
            parts = []
            for lo_a, hi_a, lo_b, hi_b, more in ((p[:, 0], ca, p[:, 2], cb, 0), (ca, p[:, 1], cb, p[:, 3], 0), (p[:, 0], ca, cb, p[:, 3], 1), (ca, p[:, 1], p[:, 2], cb, 1)):
                parts.append(np.column_stack([lo_a, hi_a, lo_b, hi_b, p[:, 4] + more, p[:, 5] - 1]))
            parts[3] = parts[3][~same]  # of a node with itself both crossings are one
            stack.append(np.concatenate(parts))


def _cut(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """For each node, a sorted range that agrees above ``bit``: where its values with that bit begin. All are bisected at once."""
    lo, hi, bit = lo.copy(), hi.copy(), bit.astype(np.uint64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        middle = (lo[open_] + hi[open_]) // 2
        one = (values[middle] >> bit[open_] & _ONE).astype(bool)
        hi[open_[one]] = middle[one]
        lo[open_[~one]] = middle[~one] + 1
    return lo


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (of each place the least place of its set) after the sets of each i and j are made one."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def centres(label: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """For each place the one of its set that comes first in ``order`` (the last key first): the same node in every task that
    finds the same set, so that their stars are equal rows."""
    first = np.lexsort((*order, label))
    sets, start, back = np.unique(label[first], return_index=True, return_inverse=True)
    out = np.empty(len(label), np.int64)
    out[first] = first[start][back]
    return out


def _rotate(c: Column, by: int) -> Column:
    return F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, 64 - by)) if by else c


def near_links(values: DataFrame, budget: int = BUDGET) -> DataFrame:
    """u and v, nodes that connect just what pairs of ``values`` (kind, fp, node) of one kind, at most ``budget`` bits apart, do.

    Values of a kind are different from each other, and ``node`` is a struct of two longs. Not every such pair is a row: what a
    task links is put out as a star around the least node of each set that it finds connected, so a group of n values that
    are all alike makes n - 1 rows for each trie, not n squared.

    Two such values agree in one of budget + 1 bands of bits. For each band there is a trie with that band on top, whose
    self-join starts from the node pairs that haven't used up anything there: each node of the band's depth with itself. A
    pair's members meet in one task. Pairs of too many members are split down the trie, some bits at a time, each member
    going to the pairs of children within the budget, until all are small enough; at full depth a node is one value. What
    crosses the network is budget + 1 rows for each value, and more only for pairs that are split.
    """
    spark, width = values.sparkSession, 64 // (budget + 1)
    turned = F.explode(F.array(*(F.struct(F.lit(k * width).alias("turn"), _rotate(F.col("fp"), k * width).alias("x")) for k in range(budget + 1))))
    top = lambda c, n: F.expr(f"shiftrightunsigned({c}, 64 - ({n}))")
    open_ = values.select("kind", turned.alias("t"), "node").select("kind", "t.turn", F.lit(width).alias("depth"), top("t.x", width).alias("pa"), top("t.x", width).alias("pb"), F.lit(0).alias("diff"), F.lit(0).alias("side"), "t.x", "node")
    key, links = ["kind", "turn", "depth", "pa", "pb", "diff"], []
    while True:
        sizes = open_.groupBy(*key).agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"))
        sizes = sizes.where("(pa = pb and n > 1) or lo < hi")  # else nothing to pair
        rows = written(open_.join(sizes.select(*key, "n"), key), "pairs")
        count = rows.agg(F.count("*").alias("n"), F.max("n").alias("most")).first()
        tasks = max(shuffle_partitions(spark), -(-count["n"] // TASK_ROWS))
        links.append(_joined(rows.where(F.col("n") <= PAIR_ROWS).drop("n"), key, budget, tasks))
        if (count["most"] or 0) <= PAIR_ROWS:
            break
        heavy = rows.where(F.col("n") > PAIR_ROWS).withColumn("step", F.least(F.lit(LEVELS), 64 - F.col("depth"), F.ceil(F.log2(F.col("n") / PAIR_ROWS)) + 1).cast("int"))
        flips = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, step) - 1")))
        heavy = heavy.select(*key, "side", "x", "node", "step", top("x", "depth + step").alias("own"), flips.alias("flip"))
        heavy = heavy.withColumn("now", F.col("diff") + F.bit_count("flip")).where(F.col("now") <= budget)
        partner = F.expr("shiftleft(if(side = 0, pb, pa), step) | ((own & (shiftleft(1L, step) - 1)) ^ flip)")
        heavy = heavy.withColumn("a", F.when(F.col("side") == 0, F.col("own")).otherwise(partner)).withColumn("b", F.when(F.col("side") == 0, partner).otherwise(F.col("own")))
        over = F.expr("pa = pb and a > b")  # of a node with itself, children x < y make one pair, whose sides are told by the child
        heavy = heavy.select("kind", "turn", F.expr("depth + step").alias("depth"), F.when(over, F.col("b")).otherwise(F.col("a")).alias("pa"), F.when(over, F.col("a")).otherwise(F.col("b")).alias("pb"), F.col("now").alias("diff"), F.when(over, 1 - F.col("side")).otherwise(F.col("side")).alias("side"), "x", "node")
        open_ = written(heavy, "split")
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    return found.distinct()


def _joined(rows: DataFrame, key: list[str], budget: int, tasks: int) -> DataFrame:
    """Links within node pairs whose members fit into memory: some thousand members at once, as the sorted rows of a task come."""
    wide = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in (*key, "side", "x", "id", "tie")]))
            if sum(map(len, held)) < 20_000:
                continue
            now = np.concatenate(held)
            change = np.flatnonzero((now[1:, :wide] != now[:-1, :wide]).any(axis=1))
            cut = change[-1] + 1 if len(change) else 0
            yield from links(now[:cut])
            held = [now[cut:]]
        if held:
            yield from links(np.concatenate(held))

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows are in the order of key, side and x read as unsigned."""
        if not len(rows):
            return
        new = (rows[1:, : wide + 1] != rows[:-1, : wide + 1]).any(axis=1)
        start = np.concatenate([[0], np.flatnonzero(new) + 1])
        end = np.append(start[1:], len(rows))
        one = rows[start]
        lone = one[:, key.index("pa")] == one[:, key.index("pb")]
        pairs = [np.column_stack([start, end, start, end, one[:, key.index("diff")], 63 - one[:, key.index("depth")]])[lone]]
        two = np.flatnonzero(~lone & (one[:, wide] == 0))
        two = two[two + 1 < len(one)]
        two = two[(one[two, :wide] == one[two + 1, :wide]).all(axis=1)]
        pairs.append(np.column_stack([start[two], end[two], start[two + 1], end[two + 1], one[two, key.index("diff")], 63 - one[two, key.index("depth")]]))
        label = np.arange(len(rows))
        for i, j in trie_pairs(np.ascontiguousarray(rows[:, wide + 1]).view(np.uint64), np.concatenate(pairs), budget):
            label = _united(label, i, j)
        centre = centres(label, rows[:, -1], rows[:, -2])
        at = np.flatnonzero(centre != np.arange(len(rows)))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(rows[x, c]) for x in (at, centre[at]) for c in (-2, -1)], names=["u_id", "u_tie", "v_id", "v_tie"])

    flat = rows.select(*key, "side", "x", F.col("node.id").alias("id"), F.col("node.tie").alias("tie"))
    order = [*key, "side", F.col("x").bitwiseXOR(F.lit(-(2**63)))]
    done = flat.repartition(tasks, *key).sortWithinPartitions(*order).mapInArrow(run, "u_id long, u_tie long, v_id long, v_tie long")
    return done.select(node("u_id", "u_tie").alias("u"), node("v_id", "v_tie").alias("v"))


def node(ident: Column | str, tie: Column | str) -> Column:
    return F.struct(F.col(ident).alias("id") if isinstance(ident, str) else ident.alias("id"), F.col(tie).alias("tie") if isinstance(tie, str) else tie.alias("tie"))


#: The id of nodes none of whose rows has a doc_id: it comes after all others.
NO_ID = 2**63 - 1


def near_components(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, several: int = 1) -> DataFrame:
    """doc_id, fps and component_id for each row of ``docs`` (doc_id, text).

    Each text has ``several`` fingerprints, an array of signed longs; texts are linked if any of them is at most ``budget``
    bits from the other text's. component_id is the smallest doc_id that links reach. Texts without words, null ones too,
    have the fingerprint zero and are linked by it. Rows without a doc_id link like others; a component without any doc_id
    has null. Repeated rows stay; an empty table gives no rows. Other columns are ignored.

    Texts of the same fingerprints are one node from the start, so copies cost one row each, and texts that share a
    fingerprint are linked to the least of them.
    """
    rows = written(fingerprinted(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", shingle=shingle, several=several), "fingerprints")
    nodes = rows.groupBy("fps").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id"), F.count("*").alias("n"))
    nodes = written(nodes.select("fps", "n", node(F.col("id"), F.xxhash64("fps") if several > 1 else F.col("fps")[0]).alias("node")), "nodes")
    shown = nodes.select(F.posexplode("fps").alias("kind", "fp"), "node")
    if several > 1:
        least = written(shown.groupBy("kind", "fp").agg(F.min("node").alias("node")), "values")
        shared = shown.join(least.withColumnRenamed("node", "v"), ["kind", "fp"]).where("node <> v").select(F.col("node").alias("u"), "v")
        links = near_links(least, budget).union(shared)
    else:
        links = near_links(shown, budget)
    found = connected_components(links).select(F.col("u").alias("node"), F.col("v").alias("least"))
    named = nodes.join(found, "node", "left").select("fps", "n", F.nullif(F.coalesce("least", "node")["id"], F.lit(NO_ID)).alias("component_id"))
    return joined(rows, written(named, "named"), "fps").select("doc_id", "fps", "component_id")


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have the fingerprint zero. Rows without an id link like others and are never a component's name;
    repeated rows stay, and share a component; an empty table gives no rows; other columns are ignored."""
    return near_components(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex(F.col("fps")[0])), 16, "0").alias("fingerprint"), "component_id")
