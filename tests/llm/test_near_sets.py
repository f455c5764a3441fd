"""The pipeline's near-duplicates against brute force over pairs of five-word shingle sets."""

import collections
import itertools
import time
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near_sets
from tidemark.llm.common import table
from tests.llm.test_operators import WORDS, none, odd  # noqa: F401


def sets_brute(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_brute(docs):
    sets, up, of = {i: sets_brute(t) for i, t in docs}, {i: i for i, _ in docs}, collections.defaultdict(list)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for x in s or {None}:
            of[x].append(i)
    shared = collections.Counter(p for ids in of.values() for p in itertools.combinations(ids, 2))
    for (i, j), n in shared.items():
        a, b = len(sets[i]), len(sets[j])
        if not a or 5 * n >= 4 * (a + b - n):
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_stage_against_all_pairs(spark):
    """The stage takes no document that all pairs wouldn't, and at least nine in ten of those that they would."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = components_brute([(r.doc_id, r.text) for r in docs.collect()])
    gone = {i for i, c in want.items() if c < i}
    assert len(gone) > 20
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert len(gone - kept) >= 0.9 * len(gone) and not want.keys() - gone - kept


def test_stage_finds_edited_copies(spark):
    """300 texts of a word list with its own frequencies, and of each a copy with so many words changed that four fifths are shared."""
    r = np.random.default_rng(11)
    docs = []
    for k in range(300):
        words = [f"w{x}" for x in r.zipf(1.3, 300) % 5000]
        copy = list(words)
        for at in r.choice(60, 6, replace=False) * 5:
            copy[at] = f"new{at}"
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    want = components_brute(docs)
    gone = {i for i, c in want.items() if c < i}
    assert len(gone) == 300
    kept = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()}
    assert len(gone - kept) >= 270 and not want.keys() - gone - kept


@pytest.mark.parametrize("few, part", [(8, 1 << 19), (0, 1500), (1000, 400)])
def test_groups_of_copies(spark, monkeypatch, few, part):
    """Many copies of one text, some of them similar through others only, and texts that share a passage and no more."""
    monkeypatch.setattr(near_sets, "FEW", few)
    monkeypatch.setattr(near_sets, "PART", part)
    r = np.random.default_rng(5)
    base, docs = [f"w{k}" for k in range(120)], []
    for k in range(60):
        words = list(base)
        for at in r.integers(0, 120, r.integers(0, 6)):
            words[at] = f"x{k}y{at}"
        docs.append((k, " ".join(words)))
    docs += [(100 + k, " ".join(base[:60] + [f"z{k}w{j}" for j in range(20 + k)])) for k in range(30)]
    docs += [(200 + k, " ".join(f"chain{j}" for j in range(3 * k, 3 * k + 60))) for k in range(12)]
    want = components_brute(docs)
    assert len(set(want.values())) > 10
    got = near_sets.near_components(spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit(7)))
    assert {x.doc_id: x.component_id for x in got.collect()} == want
    apart = near_sets.near_components(spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.col("doc_id")))
    assert all(x.component_id == min(i for i, t in docs if sets_brute(t) == sets_brute(docs_of[x.doc_id])) for docs_of in [dict(docs)] for x in apart.collect())


def test_odd_rows(spark, odd, none):  # noqa: F811
    odd, none = (x.withColumn("block", F.lit(1)) for x in (odd, none))  # noqa: F811
    rows = [(x.doc_id, x.component_id) for x in near_sets.near_components(odd).collect()]
    assert len(rows) == 14 and {c for i, c in rows if i in (2, 3, 4)} == {2} and {c for i, c in rows if i in (1, 8, 13)} == {1}
    assert near_sets.near_components(none).count() == 0


def test_similar_sets_share_a_key():
    r = np.random.default_rng(1)
    for _ in range(3000):
        n = int(np.exp(r.uniform(0, 7.5)))
        a = r.integers(0, 2**64, n, dtype=np.uint64)
        gone = int(r.integers(0, n // 5 + 1))
        new = max(0, (5 * (n - gone) - 4 * n) // 4)  # as many as leave four fifths
        b = np.concatenate([a[gone:], r.integers(0, 2**64, new, dtype=np.uint64)])
        assert 5 * (n - gone) >= 4 * (n + new)
        assert set(near_sets.keys(np.sort(a)).tolist()) & set(near_sets.keys(np.sort(b)).tolist())
    assert near_sets.shingles(b"A b\tc") == [xxhash.xxh64_intdigest(b"a b c", 42)]


def linked_plain(items, sides=None):
    sets, label = [set(x.tolist()) for x in items], list(range(len(items)))
    for i, j in itertools.combinations(range(len(items)), 2):
        if (sides is None or sides[i] != sides[j]) and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("seed", range(8))
def test_linked_against_all_pairs(seed):
    r = np.random.default_rng(seed)
    base = [np.unique(r.integers(0, 400, r.integers(1, 60)).astype(np.uint64)) for _ in range(30)]
    items = [*base, np.zeros(0, np.uint64), np.array([7], np.uint64)]
    for x in base:
        for _ in range(r.integers(0, 4)):  # near the limit, on both sides of it
            y = np.concatenate([r.permutation(x)[r.integers(0, max(1, len(x) // 8 + 2)) :], r.integers(0, 400, r.integers(0, len(x) // 8 + 2)).astype(np.uint64)])
            items.append(np.unique(y))
    order = r.permutation(len(items))
    items = [items[k] for k in order]
    assert near_sets.linked(items).tolist() == linked_plain(items)
    sides = r.integers(0, 2, len(items))
    assert near_sets.linked(items, sides).tolist() == linked_plain(items, sides)


@pytest.mark.parametrize("kind", ["apart", "alike", "one hash in all"])
def test_thirty_thousand_short_sets_in_one_cell(kind):
    """Seconds and some 100 MB, whether they share a hash here and there, are near copies, or all have one in common."""
    r = np.random.default_rng(1)
    n = 30_000
    if kind == "alike":
        x = np.tile(np.arange(20, dtype=np.uint64), (n, 1))
        x[:, 19] = 1000 + np.arange(n)
    else:
        x = r.integers(0, 1 << 60, (n, 10)).astype(np.uint64)
        x[:, 0] = 5 if kind == "one hash in all" else r.integers(0, 3000, n)
    items = [np.sort(y) for y in x]
    began = time.time()
    tracemalloc.start()
    label = near_sets.linked(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.time() - began < 40 and peak < 300e6
    assert (label == (0 if kind == "alike" else np.arange(n))).all()


def test_nodes_are_known_by_128_bits():
    assert len(near_sets._digest(np.array([1, 2], np.uint64))) == 16
