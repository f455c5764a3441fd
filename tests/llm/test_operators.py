"""The training-data operators against brute force, on small and on odd inputs."""

from __future__ import annotations

import collections
import functools
import hashlib
import itertools
import pathlib
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, components, compression, fingerprints, html, packing, rules, simhash, substrings, tokens, warc
from tidemark.llm.common import batched, running_totals, scratch, shared_dir, table
from tidemark.llm.queries import ORACLE_SQL, QUERIES
from tidemark.llm.sample_pages import sample_page

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"p{i}" for i in range(70))
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, "plain text of a few words here", "a"), (2, None, "b"), (3, "", None), (4, "   \t\n ", "b"), (5, PASSAGE + " tail one", "a"), (6, "head two " + PASSAGE, "a"), (7, LONG, "c"), (8, "plain text of a few words here", "a"),
    (9, "Ünïcödé ﬁ Ａ　B   x", "a"), (9, "a repeated id", "a"), (10, "x" * 20_000, "c"), (11, "<|endoftext|> and 日本語 😀", "a"), (12, PASSAGE, "a"), (13, "PLAIN text of a few words here", "a"),
]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeats, and columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, s, 1, True) for i, t, s in ODD], "doc_id long, text string, source string, n_words int, kept boolean")


@pytest.fixture
def none(odd):
    return odd.limit(0)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (7, 0, 0), (None, 1, 0), (10, None, 1), (10, 0, 0)], "doc_id long, quality int, toxic int")


def texts(data):
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{data}/documents.parquet'").fetchall())


# 1 and 4
TOKENIZER = functools.cache(lambda: Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def tokenised(text):
    return TOKENIZER().encode(text or "", add_special_tokens=False).ids


def test_encoder_agrees_with_the_tokenizer():
    e = tokens.encoder()
    assert all(e.encode(t or "") == tokenised(t) for _, t, _ in ODD)


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_feistel_is_a_permutation(n):
    got = tokens.feistel(np.arange(n), n, 7)
    assert sorted(got) == list(range(n))
    assert n < 100 or (got != np.arange(n)).any() and (got != tokens.feistel(np.arange(n), n, 8)).any()


def test_training_order(spark, odd, none):
    path = scratch(spark, "order")
    tokens.write_training_order(odd.coalesce(2), path, shard_rows=4)
    rows = tokens.read_training_order(spark, path).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    want = collections.Counter(i for _, t, _ in ODD for i in [*tokenised(t), tokens.END])
    assert collections.Counter(i for r in rows for i in np.frombuffer(r.ids, "<u2").tolist()) == want
    again = scratch(spark, "order")
    tokens.write_training_order(odd.coalesce(2), again, shard_rows=4)
    assert tokens.read_training_order(spark, again).orderBy("position").collect() == rows
    empty = scratch(spark, "order")
    tokens.write_training_order(none, empty)
    assert tokens.read_training_order(spark, empty).count() == 0


def feistel_brute(x, n, key):
    """One number at a time, in plain integers."""
    bits = max(n - 1, 1).bit_length()
    half = max(1, (bits + 1) // 2)
    mask, whole = (1 << half) - 1, 2**64 - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(tokens.FEISTEL_ROUNDS):
            y = (right + key + r * 0x9E3779B97F4A7C15 & whole) * 0xBF58476D1CE4E5B9 & whole
            y = (y ^ y >> 31) * 0x94D049BB133111EB & whole
            left, right = right, left ^ (y ^ y >> 29) & mask
        x = left << half | right
        if x < n:
            return x


def order_files(path):
    return {f.parent.name: f.read_bytes() for f in pathlib.Path(path.removeprefix("file://")).rglob("part-*")}


def stream(path):
    """(doc_id, id) of every token of a table, in the order of its files' rows."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{path}') ORDER BY filename, file_row_number").fetchall()
    return [(-1 if i is None else i, x) for i, t in rows for x in [*tokenised(t), tokens.END]]


@pytest.mark.parametrize("shard_rows, block", [(7, 128 * 1024), (100, 2500), (7, 300)])
def test_training_order_is_the_permutation(spark, tmp_path, data, monkeypatch, shard_rows, block):
    """Sequence k of the stream of all tokens is at the slot that the permutation gives it, in shard slot // rows at row slot % rows, and the files are the
    same bytes however the table's files are split."""
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", block)
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").arrow().read_all()
    (tmp_path / "docs.parquet").mkdir()
    for k in range(3):
        pq.write_table(rows.slice(70 * k, 70), tmp_path / f"docs.parquet/{k}.parquet", row_group_size=9)
    docs = spark.read.parquet(f"file://{tmp_path}/docs.parquet")
    found = []
    for size in ("128m", "30k", "200k"):
        path = scratch(spark, "order")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            tokens.write_training_order(docs, path, key=99, shard_rows=shard_rows)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        found.append(order_files(path))
    assert found[0] == found[1] == found[2]
    whole = [(i, x) for k in range(3) for i, x in stream(tmp_path / f"docs.parquet/{k}.parquet")]
    n = -(-len(whole) // tokens.SEQUENCE)
    assert len(found[0]) == -(-n // shard_rows) and n > 20
    for k in range(n):
        own = whole[k * tokens.SEQUENCE : (k + 1) * tokens.SEQUENCE]
        slot = feistel_brute(k, n, 99)
        shard = np.frombuffer(found[0][f"shard={slot // shard_rows}"], tokens.RECORD)
        record = shard[slot % shard_rows]
        assert record["doc_id"] == own[0][0] and record["ids"][: record["length"]].tolist() == [x for _, x in own]
    got = tokens.read_training_order(spark, path).orderBy("position").collect()
    assert [r.position for r in got] == list(range(n))
    assert [r.doc_id for r in got] == [whole[k * tokens.SEQUENCE][0] for k in sorted(range(n), key=lambda k: feistel_brute(k, n, 99))]


def test_training_order_of_shuffled_rows(spark, data, monkeypatch):
    """What isn't a scan of files is in the order of its tasks. Blocks may be shorter than documents."""
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 1500)
    docs = table(spark, data, "documents").repartition(5, "doc_id")
    path = scratch(spark, "order")
    tokens.write_training_order(docs, path, shard_rows=7)
    rows = tokens.read_training_order(spark, path).collect()
    want = collections.Counter(x for t in texts(data).values() for x in [*tokenised(t), tokens.END])
    assert collections.Counter(x for r in rows for x in np.frombuffer(r.ids, "<u2").tolist()) == want
    assert sorted(r.position for r in rows) == list(range(-(-want.total() // tokens.SEQUENCE))) and sum(r.length < tokens.SEQUENCE for r in rows) <= 1


def check_packing(rows, docs, window=1024):
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for d, ids in docs.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            own = ids[at : at + r.length]
            assert r.start == at and len(own) == r.length and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.asarray(own, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    used = []
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        used.append(at)
    assert max(used, default=0) <= window
    return used


def test_packing_odd(spark, odd, none):
    once = odd.where("text <> 'a repeated id' or text is null")
    check_packing(packing.packed(once).collect(), {i: [*tokenised(t), 0] for i, t, _ in ODD if t != "a repeated id"})
    assert packing.packed(odd).agg(F.sum("length")).first()[0] == sum(len(tokenised(t)) + 1 for _, t, _ in ODD)
    assert packing.packed(none).count() == 0


def test_packing_whole(spark, data):
    used = check_packing(QUERIES["op4_packing"](spark, data).collect(), {d: [*tokenised(t), 0] for d, t in texts(data).items()})
    assert sum(u < 1024 for u in used) <= 1


def test_plan_uses_no_more_than_there_is():
    hist = np.random.default_rng(1).integers(0, 9, 1025)
    hist[0] = hist[1024] = 0
    used = np.zeros(1025, int)
    for lengths, n in packing.plan(hist):
        assert sum(lengths) == 1024
        np.add.at(used, lengths, n)
    assert (used <= hist).all() and used.sum() > 0.6 * hist.sum()


# 2
def test_warc(spark):
    big, small = "<p>" + "x" * 200, "tiny"
    pages = spark.createDataFrame([(3, "http://a", big), (1, None, big), (2, "http://b\r\nX: y", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", "é\r\n\r\n" * 60), (8, "u", "é\r\n\r\n" * 60), (None, "u", big), (1, "again", big)], "page_id long, url string, html string")
    raw, out = scratch(spark, "raw"), scratch(spark, "out")
    warc.write_archives(warc.page_records(pages), raw)
    warc.deduplicated(spark, raw, out)
    rows = collections.defaultdict(list)
    for r in warc.read_archives(spark, out).collect():
        rows[r.record_id].append((r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload)))
    assert rows["1"] == [("response", None, 203, big.encode())] * 2
    assert rows["2"] == rows["3"] == [("revisit", "1", 203, b"")]
    assert rows["4"] == rows["5"] == [("response", None, 4, b"tiny")]
    assert rows["6"] == [("response", None, 0, b"")]
    assert rows["7"][0][0] == "response" and rows["8"][0][:2] == ("revisit", "7")
    assert len(rows[None]) == 1
    empty = scratch(spark, "raw")
    warc.write_archives(warc.page_records(pages.limit(0)), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_oracle(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    got = QUERIES["op2_warc_revisits"](spark, data)
    want = con.execute(ORACLE_SQL["op2_warc_revisits"])
    names = [c[0] for c in want.description]
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


# 3
def dedup_brute(docs, width=50):
    first, out = {}, []
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = WORDS.findall(t or "")
        gone = set()
        for i in range(len(w) - width + 1):
            if first.setdefault(tuple(w[i : i + width]), d) < d:
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4 << 20, 1 << 20, 1 << 10), (1 << 13, 1 << 9, 1), (1 << 12, 1 << 14, 1)])
def test_substrings(spark, data, odd, none, monkeypatch, sizes):
    """One group and home, many of each, and senders of many groups."""
    for name, value in zip(("GROUP_BYTES", "HOME_HASHES", "SENT"), sizes):
        monkeypatch.setattr(substrings, name, value)
    plain = lambda df: sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect())
    assert plain(substrings.deduplicated(odd)) == dedup_brute([(i, t) for i, t, _ in ODD])
    assert plain(substrings.deduplicated(table(spark, data, "documents"))) == dedup_brute(texts(data).items())
    assert substrings.deduplicated(none).count() == 0
    assert {r.row.source for r in substrings.deduplicated(odd.withColumn("row", F.struct("source")), carry="row").collect()} == {"a", "b", "c", None}


def test_routes_stay_linear():
    """Rows and bytes for a hash, as senders pack them for homes, from some GB to 100 TB of text."""
    r, rows, took = np.random.default_rng(1), [], []
    for size in (5 * 10**9, 10**12, 10**13, 10**14):
        sender, homes = substrings.routes(size)
        hashes = sender // substrings.WORD_BYTES
        rows.append(homes / hashes)
        bits = (size // 150).bit_length() + 12
        own = r.integers(0, (1 << bits) // homes, hashes // homes, dtype=np.uint64)  # what a sender has for one home
        took.append(len(substrings._pack(np.unique(own) << np.uint64(64 - bits))) / len(own))
    assert max(rows) <= 1.01 / substrings.SENT and max(took) < 1.6 * took[0] < 5.5
    assert substrings.routes(10**13)[0] < 300 << 20


def test_word_hashes_do_not_depend_on_place():
    a, b = substrings.Words([b"one two three four", b""]), substrings.Words([b"zero", b"\tone  two\nthree four "])
    assert a.windows(3)[0] == b.windows(3)[1] and a.hash[0] == b.hash[1] and a.hash[0] != a.hash[1]
    assert [x.tolist() for x in (a.first, b.first)] == [[0, 4, 4], [0, 1, 5]]
    x, y = (substrings._digests(w, 3, np.array(at)) for w, at in ((a, [0, 1]), (b, [1, 2])))
    want = [hashlib.blake2b(t, digest_size=16).digest() for t in (b"one two three", b"two three four")]
    assert np.column_stack(x).tobytes() == np.column_stack(y).tobytes() == b"".join(want)


# 5
def counts_brute(x):
    w = WORDS.findall(x)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = collections.Counter(windows)
    covered = {j for i, k in enumerate(windows) if often[k] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in x.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered)


def test_counts(data):
    for x in [*(t or "" for _, t, _ in ODD), *texts(data).values(), "a b c d e f g h " * 2, "l\nl\n \nm\nl"]:
        assert rules.text_counts(x.encode())[:5] == counts_brute(x)


def test_rules_find_a_planted_condition():
    r = np.random.default_rng(0)
    x = {"a": r.random(600), "b": r.random(600)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.5)
    learned = rules.learn(x, bad)
    held = np.zeros(600, bool)
    for rule in learned:
        held |= rules._covers(rule, x, 600)
    assert (held == bad).mean() > 0.97
    assert rules.learn(x, np.zeros(600, bool)) == []


def test_quality_rules(spark, data, odd, none, labels):
    got = {r.doc_id: r for r in rules.judged(odd, labels).collect()}
    assert len(got) == 13 and got[1].base_failed and not got[2].kept and not got[5].base_failed
    assert rules.judged(none, labels).count() == 0 and rules.judged(odd, labels.limit(0)).count() == 14
    rows = QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.95


# 6
def test_page_texts(spark):
    trees = html.train(spark)
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>A title</h1><p>First&nbsp;words &amp; more<b> bold</b>text.<p>Second<br>part, with a number of words.</article><div class='ad'>Buy this now.</div><section id='comments'><h3>Comments</h3><p>Nice one, really.</p></section><footer>&copy; Someone</footer></body></html>"
    assert html.main_texts([page, "", "just words", "<script>var x = '</p>'", "<p>" + "word " * 30_000], trees)[:4] == ["A title First words & more boldtext. Second part, with a number of words.", "", "just words", ""]
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    assert [(r.page_id, r.n_chars) for r in html.extracted(pages, trees).orderBy("page_id").collect()] == [(1, 73), (1, 73), (2, 0), (3, 0)]
    assert html.extracted(pages.limit(0), trees).count() == 0


def test_extraction_on_unseen_pages(spark):
    trees, sources = html.train(spark), [sample_page(10**6 + k) for k in range(300)]

    def truth(source):
        page = html.Page(source)
        marked = list(page.marked)
        for i in range(1, len(marked)):
            marked[i] |= marked[page.parents[i]]
        return page.text(np.array(marked))

    assert np.mean([g == truth(s) for g, s in zip(html.main_texts(sources, trees), sources)]) > 0.93


def test_decoding_is_hierarchical():
    parents, ends = np.array([-1, 0, 1, 1, 0]), np.array([5, 4, 3, 4, 5])
    assert html.decode(np.array([1.0, -5.0, 1.0, 1.0, 2.0]), parents, ends, 0.0).tolist() == [True, False, False, False, True]
    assert html.decode(np.array([1.0, -1.0, 2.0, 2.0, 2.0]), parents, ends, 0.0).tolist() == [True] * 5


# 7
def fingerprint_brute(x):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def components_brute(fps, budget=2):
    up = {i: i for i, _ in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= budget:
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def test_fingerprints_and_components(spark, data, odd, none):
    docs = texts(data)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op7_simhash_components"](spark, data).collect()}
    fps = [(i, fingerprint_brute(t)) for i, t in docs.items()]
    assert {i: f for i, (f, _) in got.items()} == dict(fps)
    assert {i: c for i, (_, c) in got.items()} == components_brute(fps)
    rows = simhash.near_components(odd).collect()
    of = {(r.doc_id, r.fps[0]): r.component_id for r in rows}
    assert len(rows) == 14 and {c for (i, _), c in of.items() if i in (2, 3, 4)} == {2} and {c for (i, _), c in of.items() if i in (1, 8, 13)} == {1}
    assert simhash.near_components(none).count() == 0


@pytest.mark.parametrize("rows", [4096, 8])
@pytest.mark.parametrize("budget", [1, 2, 5])
def test_trie_join(spark, monkeypatch, rows, budget):
    """Links connect what the pairs within the budget do, of either kind, however node pairs are split, and are few."""
    monkeypatch.setattr(simhash, "PAIR_ROWS", rows)
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 6, dtype=np.uint64)
    near = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in r.integers(0, 64, (12, 2))}
    kinds = [{int(b) for b in base} | near | {0, 2**64 - 1, 3}, {*range(40), 2**63, *(int(x) for x in r.integers(0, 2**63, 30))}]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    number = {x: i for i, x in enumerate((k, v) for k, values in enumerate(kinds) for v in values)}
    df = spark.createDataFrame([(k, signed(v), (i, k)) for (k, v), i in number.items()], "kind int, fp long, node struct<id: long, tie: long>")
    links = [(x.u.id, x.v.id) for x in simhash.near_links(df, budget).collect()]
    assert joined_brute(number.values(), links) == joined_brute(number.values(), [(number[k, a], number[k, b]) for k, values in enumerate(kinds) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= budget])
    if rows > len(number):
        assert len(links) <= (budget + 1) * len(number)  # a star for each trie, not all pairs


def test_trie_pairs():
    r = np.random.default_rng(8)
    values = np.unique(np.concatenate([r.integers(0, 2**63, 60, dtype=np.uint64), np.uint64(7) << np.uint64(40) ^ r.integers(0, 2**12, 90, dtype=np.uint64)]))
    for budget in (0, 2, 6):
        found = [x for i, j in simhash.trie_pairs(values, [[0, len(values), 0, len(values), 0, 63]], budget) for x in zip(i.tolist(), j.tolist())]
        want = {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (int(values[i]) ^ int(values[j])).bit_count() <= budget}
        assert len(found) == len(want) and set(found) == want


def joined_brute(nodes, links):
    up = {i: i for i in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7), (300, 100)]
    got = {r.u: r.v for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 8
def test_classifier(spark, odd, none, labels):
    model = compression.fit(odd, labels)
    rows = compression.scored(odd.select("doc_id", "text"), model).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert compression.scored(none.select("doc_id", "text"), model).count() == 0
    compression.fit(odd, labels.limit(0)), compression.fit(none, labels)
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op8_compression_classifier"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.93


def test_classifier_never_sees_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    turned = labels.withColumn("quality", F.when(compression.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression.fit(docs, labels) == compression.fit(docs, turned)


# 9
def test_byte_bpe(spark, odd, none):
    own = byte_bpe.codec(byte_bpe.VOCABULARY)
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(byte_bpe.VOCABULARY), special_tokens={})
    for _, t, _ in [*ODD, (0, "नमस्ते \x00\x01 ́ '" + "ab" * 500 + " \r\n\n  ", None)]:
        assert np.frombuffer(own.encode(t or ""), "<u4").tolist() == theirs.encode_ordinary(t or "") and own.decode(own.encode(t or "")) == (t or "").encode()
    rows = byte_bpe.encoded(odd).collect()
    assert len(rows) == 14 and all(r.n_tokens * 4 == len(r.ids) for r in rows)
    assert byte_bpe.encoded(none).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.model_proto({b"a": 0, b"b": 2})


def test_byte_bpe_of_every_block():
    """Random code points of all blocks, those among them of which Unicode versions differ, between contractions and white space."""
    own = byte_bpe.codec(byte_bpe.VOCABULARY)
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(byte_bpe.VOCABULARY), special_tokens={})
    r, changed, some = random.Random(3), [*byte_bpe._differing()], [32, 9, 10, 0xA0, 0x85, 0x1C, 0x2003, 39, 115, 82, 0x17F, 97, 49, 0xB2, 0x4E00]
    for k in range(4000):
        block = r.randrange(0x1100) * 256
        pick = [lambda: r.randrange(0x110000), lambda: block + r.randrange(256), lambda: r.choice(changed or some), lambda: r.choice(some)]
        points = [r.choice([pick[k % 4], pick[3]])() for _ in range(r.randint(1, 40))]
        text = "".join(chr(x) for x in points if not 0xD800 <= x < 0xE000)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_byte_bpe_of_a_whole_table(spark):
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(byte_bpe.VOCABULARY), special_tokens={})
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op9_byte_bpe"](spark, folder).collect()}
    assert got.keys() == texts(folder).keys()
    for i, text in texts(folder).items():
        ids = np.asarray(theirs.encode_ordinary(text), "<u4")
        assert got[i] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# 10
def canonical(x):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold()).split())


def test_digests(spark, data, odd, none):
    docs = sorted(texts(data).items())
    rows = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, data).collect()}
    prints = {}
    for k, (i, t) in enumerate(docs):
        q, after = len(t) // 4, docs[(k + 1) % len(docs)][1]
        e = t[: len(t) - q] + after[:q]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert prints.setdefault(canonical(t), r.fingerprint) == r.fingerprint and prints.setdefault(canonical(e), r.edited_fingerprint) == r.edited_fingerprint
        assert (r.near_edited, r.near_next) == (float(canonical(t) == canonical(e)), float(canonical(t) == canonical(after)))
    assert len(set(prints.values())) == len(prints)
    got = collections.defaultdict(set)
    for r in fingerprints.fingerprint_report(odd).collect():
        got[r.fingerprint].add(r.doc_id)
    assert {1, 8, 13} in got.values() and {2, 3, 4} in got.values()
    assert fingerprints.fingerprint_report(none).count() == 0
    one = fingerprints.fingerprint_report(odd.where("doc_id = 1")).first()
    assert one.near_next == 1.0 and one.near_edited == 0.0


def test_digests_compare_bytes_where_hashes_collide(spark, odd):
    rows = fingerprints.fingerprint_report(odd.where("doc_id <> 9"), hashed=lambda c: F.lpad((F.length(c) % 2).cast("string"), 4, "0")).collect()
    of = {r.doc_id: r.fingerprint for r in rows}
    assert of[1] == of[8] == of[13] and of[2] == of[3] == of[4] and len(set(of.values())) == 8


def test_fingerprint_path_has_no_python(spark, data):
    plan = QUERIES["op10_fingerprints"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows_without_an_id(spark, labels):
    """Each operator keeps them and says what it says of others."""
    docs = spark.createDataFrame([(None, PASSAGE), (None, None), (4, PASSAGE), (4, "some other words")], "doc_id long, text string")
    path = scratch(spark, "order")
    tokens.write_training_order(docs.where("doc_id is null"), path)
    assert {r.doc_id for r in tokens.read_training_order(spark, path).collect()} == {-1}
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.deduplicated(docs).collect()) == [(0, 0), (0, 0), (4, 0), (4, 70)]
    assert packing.packed(docs).where("doc_id is null").agg(F.sum("length")).first()[0] == len(tokenised(PASSAGE)) + 2
    assert rules.judged(docs, labels).where("doc_id is null").count() == 2
    assert [r.component_id for r in simhash.near_components(docs).where("doc_id is null").orderBy("component_id").collect()] == [None, 4]
    assert compression.scored(docs, compression.fit(docs, labels)).count() == 4
    assert byte_bpe.encoded(docs).where("doc_id is null").count() == 2
    rows = fingerprints.fingerprint_report(docs).collect()
    assert len(rows) == 4 and sum(r.doc_id is None for r in rows) == 2


def test_running_totals(spark):
    r = np.random.default_rng(4)
    rows = [(g, i, int(x)) for g in "ab" for i, x in zip(r.permutation(90)[:70].tolist(), r.integers(0, 9, 70))]
    got = running_totals(spark.createDataFrame(rows, "g string, i long, x long"), "i", ["x"], 10, ("g",)).collect()
    assert len(got) == 140 and all(y.before_x == sum(x for g, i, x in rows if g == y.g and i < y.i) for y in got)
    none = running_totals(spark.createDataFrame([(3, 4), (90, 1)], "i long, x long"), "i", ["x"], 10)
    assert {(y.i, y.before_x) for y in none.collect()} == {(3, 0), (90, 4)}


def test_rules_judge_unseen_rows(spark):
    """Learned from two thirds of the labels, judged on the others."""
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    list_ = rules.learned(docs, labels.where("doc_id % 3 > 0"))
    judged = rules.counted(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), "doc_id", "quality").where(~rules.base_failed()).withColumn("kept", rules.verdict(list_)).collect()
    assert len(judged) > 50 and sum(r.kept == (r.quality == 1) for r in judged) >= 0.95 * len(judged)


def test_scores_against_plain_zstandard(spark, odd, labels):
    """Every score is the curve of the normalised difference of sizes over all pieces of the whole text."""
    folder = "/root/testdata/sf0.001"
    model = compression.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    assert model.good and model.bad and model.slope > 0
    packers = [zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for x in (model.good, model.bad)]
    for row in compression.scored(odd.select("doc_id", "text"), model).collect():
        raw = (row.text or "").encode()
        g, b = (sum(len(p.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)) for p in packers)
        d = (b - g) / (b + g) if raw else 0.0
        assert abs(row.score - 1 / (1 + np.exp(-(model.slope * d + model.offset)))) < 1e-9 and row.predicted == (row.score >= 0.7)


def test_excerpts_reach_both_ends(spark):
    texts_ = ["short", "x" * 16384, "a" * 2048 + "m" * 500_000 + "z" * 2048]
    got = [r.e for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "i int, text string").orderBy("i").select(compression.excerpt(F.col("text")).alias("e")).collect()]
    assert got[:2] == texts_[:2] and len(got[2]) == 8 * 2048 + 7 and got[2].startswith("a" * 2048) and got[2].endswith("z" * 2048)


def test_a_sessions_own_batch_sizes_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "77")
    assert batched(spark.range(3)).count() == 3 and spark.conf.get(name) == "77"
    spark.conf.unset(name)
    batched(spark.range(3))
    assert spark.conf.get(name) == "1000" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
    if before:
        spark.conf.set(name, before)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "local-cluster[3,2,3000]"

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_without_labels_every_score_is_a_half(spark, odd, labels):
    for none in (labels.limit(0), labels.withColumn("quality", F.lit(None).cast("int"))):
        got = compression.scored(odd.select("doc_id", "text"), compression.fit(odd, none)).collect()
        assert len(got) == 14 and {round(r.score, 6) for r in got} == {0.5} and {r.predicted for r in got} == {0}
        assert rules.learned(odd, none) == []


def test_ties_and_hot_rows_are_packed(spark, monkeypatch):
    """Rows that are the same in everything, with and without an id, over many buckets."""
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    rows = [(5, PASSAGE)] * 40 + [(None, "a b c")] * 40 + [(k, f"text {k} " * (k * 9)) for k in range(60)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sum(r.length for r in got) == sum(len(tokenised(t)) + 1 for _, t in rows)
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(sum(n for _, n in p) < 1024 for p in by_sequence.values()) <= 1
