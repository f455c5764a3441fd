"""Filter audit, source mix and spelling variants against brute force, on small and on odd inputs."""

from __future__ import annotations

import collections
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, mixing, spelling
from tidemark.llm.common import table, word_count
from tidemark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import ODD, WORDS, labels, none, odd  # noqa: F401


# 11
def audit_brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic). One order and step after the other."""
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, lang in docs:
        t = t or ""
        w = WORDS.findall(t)
        no = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        fails.append((lang or "", i, {x for x in no if no[x]}))
    rows = []
    for part in {p for p, _, _ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        sums = collections.Counter()
        here = []
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                earlier = set(order[:k])
                gone = [i for i, f in own if x in f and not f & earlier]
                sums[x] += len(gone)
                here.append([part, "".join(order), k + 1, x, sum(not f & (earlier | {x}) for _, f in own), len(gone), sum(x in f and bool(f & earlier) for _, f in own), sum(f == {x} for _, f in own), sum(i in good for i in gone), sum(i in toxic for i in gone)])
        rows += [(*r, sums[r[3]]) for r in here]
    return sorted(rows)


AUDIT = ("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(df):
    return sorted(tuple(r[c] for c in AUDIT) for r in df.collect())


def test_filter_audit(spark, odd, none, labels):  # noqa: F811
    rich = [(20 + i, t, lang) for i, (t, lang) in enumerate(itertools.product(["A B C " * 50, " ".join(map(str, range(120))), " ".join(f"W{i}" for i in range(150)) + " 50% #x", "short $"], ["en", None, ""]))]
    rows = [(i, t, s) for i, t, s in ODD] + rich + [(None, "short $", "en"), (None, None, None), (33, None, "en"), (20, "A B C " * 50, "en"), (20, "A B C " * 50, "en")]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, mask int, digest boolean")
    marks = [(1, 1, 0), (5, 1, 0), (7, 0, 1), (None, 1, 1), (10, None, 1), (10, 0, 0), (20, 1, 1), (23, 1, 0), (33, 1, 1), (26, 0, 1)]
    found = filter_audit.failures(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = audited(filter_audit.interactions(found))
    assert got == audit_brute(rows, marks) and any(r[6] for r in got) and any(r[8] for r in got)
    empty = docs.limit(0)
    assert filter_audit.interactions(filter_audit.failures(empty, labels)).count() == 0
    assert audited(filter_audit.interactions(filter_audit.failures(docs, labels.limit(0)))) == audit_brute(rows, [])


def test_filter_audit_query(spark, data):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(AUDIT)} FROM ({ORACLE_SQL['op11_filter_audit']})").fetchall()
    got = audited(QUERIES["op11_filter_audit"](spark, data))
    assert got == sorted(want)
    assert got == audit_brute(con.sql("SELECT doc_id, text, lang FROM documents").fetchall(), con.sql("SELECT * FROM labels").fetchall())


def test_incidence_matrices_add_up():
    names, m = filter_audit.incidence("ABC")
    assert len(names) == 18 and {x.shape for x in m.values()} == {(8, 18)}
    for c, (order, step) in enumerate(names):
        earlier = m["kept"][:, c - 1] if step > 1 else 1
        assert (m["kept"][:, c] + m["removed"][:, c] == earlier).all() and (m["unique_fails"][:, c] <= m["removed"][:, c]).all()


# 12
def targets_brute(sizes, weights=(5, 2, 1), most=3):
    """sizes: by source. Excess is shared again and again until no target is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        left = total - sum(capped.values())
        shares = sum(weight[s] for s in order if s not in capped)
        target = {s: capped[s] if s in capped else left * weight[s] / shares for s in order}
        above = [s for s in order if s not in capped and target[s] >= most * sizes[s]]
        if not above:
            return target
        capped |= {s: most * sizes[s] for s in above}


def check_mix(rows, most=3):
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = targets_brute(sizes, most=most)
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= most * r.size
        taken[r.source] += r.taken
    assert sum(taken.values()) <= sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= max(1, len(want)) for s in want)


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 500, "d": 2, None: 40}, {"a": 0, "b": 0}, {"": 7}, {"x": 5, "y": 0, "z": 100_000}):
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r.source: r.target for r in got} == pytest.approx(targets_brute(sizes))


def test_mix_of_odd_rows(spark, odd, none, data):  # noqa: F811
    more = [(None, "same words", None)] * 30 + [(None, None, "a")] * 10 + [(100 + i, "w " * (i % 50), "big") for i in range(500)] + [(700, "tiny", "small")]
    docs = spark.createDataFrame([(i, t, s, 1, 2.0) for i, t, s in [*ODD, *more]], "doc_id long, text string, source string, size int, target double").repartition(7)
    mix = mixing.mixed(docs)
    rows = mix.collect()
    by_row = collections.defaultdict(list)
    for r in rows:
        by_row[r.source, r.doc_id, r.digest, r.copy].append(r)
    assert len(by_row) == len(ODD) + len(more)
    want = collections.Counter((s, i, len(WORDS.findall(t or ""))) for i, t, s in [*ODD, *more])
    assert collections.Counter((k[0], k[1], v[0].size) for k, v in by_row.items()) == want
    # in the order of finish times, without gaps, each source at its share all along
    queue = sorted((r for r in rows if r.words), key=lambda r: r.position)
    assert [r.position for r in queue] == [0, *itertools.accumulate(r.words for r in queue)][:-1]
    assert [r.finish for r in queue] == sorted(r.finish for r in queue) and queue[-1].finish <= 1 + 1e-3
    served = collections.Counter()
    for r in queue:
        served[r.source] += r.words
        assert served[r.source] == pytest.approx(r.finish * r.target, abs=1)
    again = mixing.mixed(docs.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    other = mixing.mixed(docs, seed=1)
    assert {(r.doc_id, r.finish) for r in other.collect()} != {(r.doc_id, r.finish) for r in rows}
    assert mixing.mixed(docs.limit(0)).count() == 0
    half = [r for r in mixing.mixed(docs, budget=F.lit(2000)).collect() if r.words]
    assert sum(r.words for r in half) in range(2000 - 8, 2001)
    path = mixing.write_mix(mix)
    read = spark.read.parquet(path)
    assert read.agg(F.sum("words")).first()[0] == sum(r.words for r in queue)


def test_mix_query(spark, data):
    rows = QUERIES["op12_source_mix"](spark, data).collect()
    assert len(rows) == 200
    check_mix(rows)
    sizes = {i: len(WORDS.findall(t or "")) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()}
    assert {r.doc_id: r.size for r in rows} == sizes


def test_chunks_of_rows_that_are_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    docs = spark.createDataFrame([(1, "a b", "s")] * 100 + [(2, "c", "s")] * 3, "doc_id long, text string, source string")
    rows = mixing.single_rows(mixing.sized(docs)).collect()
    assert sorted((r.doc_id, r.copy) for r in rows) == [(1, k) for k in range(100)] + [(2, k) for k in range(3)]


def test_word_count(spark):
    texts = [t for _, t, _ in ODD if t is not None] + ["\x0b a\x0c\r\nb \x1c c d ", " "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", word_count(F.col("t")).alias("n")).collect()
    assert all(r.n == len(WORDS.findall(r.t)) for r in got)


# 13
def words_brute(docs):
    found = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_brute(words):
    """Words are compared that share a half or so: of two that are one edit apart, one half is alike."""
    halves = collections.defaultdict(set)
    for w in words:
        for k in {len(w) // 2, len(w) // 2 - 1, (len(w) + 1) // 2, (len(w) - 1) // 2}:
            halves[0, w[:k]].add(w)
            halves[1, w[len(w) - k :]].add(w)
    form, near = {}, {}
    for w in words:
        near[w] = {x for k in {len(w) // 2, len(w) // 2 - 1, (len(w) + 1) // 2, (len(w) - 1) // 2} for key in ((0, w[:k]), (1, w[len(w) - k :])) for x in halves[key] if one_edit(w, x)}
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words[form[w]] if form[w] else 0) for w in words)


def variant_rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def chain_docs():
    """Frequent and rare spellings, a chain of forms, ties, repeated letters, letters beyond ASCII, each in texts of their own."""
    counts = {"abcdef": 5, "abcdefg": 30, "abcdefgh": 160, "abcdefghi": 900, "xyzzyx": 25, "axyzzyx": 5, "xyzzyxa": 25, "aaaaaa": 50, "aaaaaaa": 6, "aabaaa": 6, "bookkeeper": 40, "bookeeper": 7, "bokkeeper": 8, "éèêëñü": 40, "éèêëñû": 8, "éèêëñ×": 8, "ÿÿÿÿÿÿ": 9, "lonely": 5, "rarest": 4}
    words = [w for w, n in counts.items() for _ in range(n)]
    random.Random(5).shuffle(words)
    return [(i, " ".join(words[k : k + 20])) for i, k in enumerate(range(0, len(words), 20))]


@pytest.mark.parametrize("shard, bundle", [(20_000, 32 << 20), (3, 32 << 20), (3, 200), (1, 1)])
def test_spelling_variants(spark, monkeypatch, shard, bundle):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "BUNDLE_BYTES", bundle)
    docs = chain_docs() + [(None, "Éèêëñü ABCDEFGHI abcdefghi"), (7, None), (7, ""), (8, "12 -- 中文"), (9, "lonely"), (9, "lonely"), (10, ("Lonely" + " z" * 50) * 3)]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    want = variants_brute(words_brute(docs))
    assert variant_rows(spelling.variants(df)) == want and any(r[2] != r[1] for r in want if r[1])


def test_no_words(spark):
    df = spark.createDataFrame([(1, "few words"), (2, None)], "doc_id long, text string")
    assert spelling.variants(df).count() == 0 and spelling.variants(df.limit(0)).count() == 0


def test_trie_finds_all_words_one_edit_away():
    r = random.Random(3)
    words = sorted({bytes(r.choices(b"ab\xff", k=r.randint(0, 7))) for _ in range(400)})
    t = spelling.Trie(spelling.trie(words, list(range(1, len(words) + 1))))
    for w in words + [bytes(r.choices(b"abc\xff", k=r.randint(0, 9))) for _ in range(200)]:
        got = list(t.near(w))
        assert sorted(got) == [(x, k + 1) for k, x in enumerate(words) if one_edit(w, x)]


def test_long_words_take_linear_time():
    words = sorted([b"a" * 100_000, b"a" * 100_001, b"ab" * 50_000, b"ba" * 50_000])
    t = spelling.Trie(spelling.trie(words, [1, 2, 3, 4]))
    assert [x for x in t.near(b"a" * 100_000)] == [(b"a" * 100_001, 2)] and list(t.near(b"ab" * 50_000)) == []


def test_slices_end_between_runs():
    text = "abc def  ghi" + "x" * 50 + " éé-" * 20
    for size in (1, 2, 7, 1000):
        cut = list(spelling.slices(text, size))
        assert "".join(cut) == text and [w for c in cut for w in spelling.RUN.findall(c)] == spelling.RUN.findall(text)


def test_spelling_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    got = variant_rows(QUERIES["op13_spelling_variants"](spark, folder))
    assert got == variants_brute(words_brute(docs)) and len(got) > 1000 and any(r[1] for r in got)
