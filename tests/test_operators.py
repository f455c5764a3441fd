"""Operators against plain Python, on small and on odd inputs."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.functions.maths import change, clip, first_nonzero, greatest_or_null, kelly, ratio
from tidemark.operators import joins, models, vectors, windows
from tidemark.operators.asof import asof_join
from tidemark.operators.backtest import scorecard
from tidemark.operators.calendar import era_year, month_of
from tidemark.operators.documents import split_text
from tidemark.operators.scoring import return_class, score_class
from tidemark.operators.windows import cross_rank, over, rolling_median, rolling_rank, streak
from tidemark.sources.tables import duplicates, read_csv, upsert, with_fallback

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def test_streak_golden(spark):
    flags = [False, False, True, True, True, False, True, True]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "k int, i int, f boolean")
    assert [r.s for r in streak(df, ["k"], ["i"], F.col("f"), "s").orderBy("i").collect()] == [0, 0, 1, 2, 3, 0, 1, 2]


@FEW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 12)), max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 12)), max_size=12), st.booleans(), st.booleans())
def test_asof(spark, left, right, strict, forward):
    a = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k int, t int, i int")
    b = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(right)], "k int, u int, v int")
    got = {r.i: (r.r_u, r.r_v) for r in asof_join(a, b, ["k"], "t", "u", direction="forward" if forward else "backward", strict=strict, order=["v"]).collect()}
    for i, (k, t) in enumerate(left):
        ok = [(u, v) for v, (kk, u) in enumerate(right) if kk == k and ((u > t or u == t and not strict) if forward else (u < t or u == t and not strict))]
        want = (None, None) if not ok else (max(x for x in ok if x[0] == min(u for u, _ in ok)) if forward else max(ok))
        assert got[i] == want
    if not forward:
        dealt = asof_join(a, b, ["k"], "t", "u", strict=strict, order=["v"], bucket=lambda at: F.floor(at / 4))
        assert {r.i: (r.r_u, r.r_v) for r in dealt.collect()} == got


def test_asof_does_not_look_ahead(spark):
    a = spark.createDataFrame([(1, 5), (1, 8)], "k int, t int")
    b = spark.createDataFrame([(1, 4, 1.0), (1, 7, 2.0), (1, 9, 3.0)], "k int, u int, v double")
    full = asof_join(a, b, ["k"], "t", "u").where("t = 5").collect()
    assert full == asof_join(a, b.where("u <= 5"), ["k"], "t", "u").where("t = 5").collect()


@FEW
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=14))
def test_rolling(spark, values):
    n = 4
    df = spark.createDataFrame([(1, i, None if v is None else float(v)) for i, v in enumerate(values)], "k int, i int, v double")
    w = over(["k"], ["i"])
    got = df.select("i", rolling_rank("v", w, n).alias("r"), rolling_median("v", w, n).alias("m")).orderBy("i").collect()
    for i, row in enumerate(got):
        held = [x for x in values[max(0, i - n + 1) : i + 1] if x is not None]
        if len(held) < n:
            assert row.r is None and row.m is None
        else:
            x = values[i]
            assert row.r == pytest.approx((sum(y < x for y in held) + (sum(y == x for y in held) + 1) / 2) / n)
            s = sorted(held)
            assert row.m == (s[1] + s[2]) / 2


def test_cross_rank_leaves_out_nulls_and_small_days(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0), (1, None), (2, 5.0)], "d int, v double")
    got = sorted((r.d, r.v or -1, r.r) for r in cross_rank(df, ["d"], "v", "r", 2).collect() if r.d == 1)
    assert got == [(1, -1, None), (1, 1.0, 0.5), (1, 1.0, 0.5), (1, 3.0, 1.0)]
    assert cross_rank(df, ["d"], "v", "r", 2).where("d = 2").first().r is None


def test_maths(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (None, 2.0, 3.0)], "a double, b double, c double")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    rows = df.select(ratio(a, b), change(b, c, 0.2), clip(b, 1, 5), first_nonzero(b, a, c), greatest_or_null(a, b)).collect()
    assert [tuple(r) for r in rows] == [(None, None, 1.0, 1.0, 1.0), (None, -0.2, 2.0, 2.0, None)]
    assert spark.range(1).select(kelly(F.lit(0.6), F.lit(1.0))).first()[0] == pytest.approx(0.2)


def test_labels(spark):
    df = spark.createDataFrame([(2.0, 0.02), (1.9, 0.021), (-2.0, -0.03), (0.0, None)], "s double, r double")
    assert [tuple(r) for r in df.select(score_class(F.col("s")), return_class(F.col("r"))).collect()] == [("UP", "NEUTRAL"), ("NEUTRAL", "UP"), ("DOWN", "DOWN"), ("NEUTRAL", None)]


def test_dates(spark):
    df = spark.createDataFrame([("R6年", dt.date(2024, 3, 15)), ("x", dt.date(2024, 3, 16))], "e string, d date")
    assert [tuple(r) for r in df.select(era_year(F.col("e")), month_of(F.col("d"))).collect()] == [(2024, dt.date(2024, 2, 1)), (None, dt.date(2024, 3, 1))]


def test_scorecard(spark):
    row = (250, 1.6, 10.0, 3.5, 12, 4, True)
    df = spark.createDataFrame([row, (10, -1.0, 60.0, 0.5, 1, 9, False)], "trades int, expectancy double, max_drawdown_pct double, profit_factor double, years int, params int, tested boolean")
    assert [(r.total, r.verdict) for r in scorecard(df).collect()] == [(100, "Deploy"), (0, "Abandon")]


def test_upsert_is_null_safe(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    b = spark.createDataFrame([(None, 9), (3, 3)], "k int, v int")
    assert sorted((r.k or 0, r.v) for r in upsert(a, b, ["k"]).collect()) == [(0, 9), (2, 2), (3, 3)]
    assert duplicates(a.union(a), ["k"]).count() == 2
    assert with_fallback(a, a.limit(0), ["k"]).count() == 2


def test_csv_with_undisclosed_figures(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("コード,値\n130A,*****\n1301,2.5\n".encode("cp932"))
    got = read_csv(spark, f"file://{p}", {"コード": ("code", "string"), "値": ("v", "double")}, "MS932").orderBy("code").collect()
    assert [tuple(r) for r in got] == [("1301", 2.5), ("130A", None)]


@FEW
@given(st.text(alphabet="ab .\n。", max_size=300))
def test_split_text(text):
    parts = split_text(text, 40, 10)
    assert all(0 < len(p) <= 40 for p in parts)
    assert {*"".join(text.split())} <= {*"".join("".join(parts).split())} or not text.strip()


def test_spread_ranks_and_quantiles(spark):
    r = np.random.default_rng(2)
    rows = [(g, float(v) if v < 90 else None) for g, v in zip("aab" * 300, r.integers(0, 100, 900))] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("id", F.monotonically_increasing_id())
    a, b = ({x.id: x.p and round(x.p, 9) for x in f(df, ["g"], "v", "p").collect()} for f in (windows.cross_rank, windows.spread_rank))
    assert a == b and len(a) == 901
    known = [v for _, v in rows if v is not None]
    shares = (0, 0.005, 0.37, 0.5, 0.995, 1)
    assert np.allclose(windows.exact_quantiles(df, "v", shares).first()[0], np.quantile(known, shares))
    assert windows.spread_rank(df.limit(0), ["g"], "v", "p").count() == 0


def test_vector_search_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 37)
    x = np.array(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").select("embedding").toPandas()["embedding"].tolist(), float)
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(3)
    q = rows.where("vec_id % 20 = 0")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = {i: 1 - unit @ unit[i] for i in range(0, len(x), 20)}
    got = vectors.nearest(q, rows, "vec_id", "embedding", k=10).groupBy("query").agg(F.array_sort(F.collect_list("neighbour")).alias("n")).collect()
    assert {g["query"]: g["n"] for g in got} == {i: sorted(np.lexsort((np.arange(len(x)), d))[:10].tolist()) for i, d in far.items()}
    near = vectors.nearest(q, rows, "vec_id", "embedding", most=0.5).select("query", "neighbour").collect()
    assert {(a, b) for a, b in near} == {(i, int(j)) for i, d in far.items() for j in np.flatnonzero(d <= 0.5)}
    found = plans.QUERIES["k10_vector_index"](spark, "/root/testdata/sf0.01").collect()
    assert len(found) == 10 * len(far) and sum(f.exact for f in found) >= 0.9 * len(found)


def test_similar_texts(spark):
    """Of each queried item the nearest others, by the angle of hashed tf-idf vectors, here worked out from all pairs."""
    x = models.text_features(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text"), "text").select("item_id", "tfidf").collect()
    v = {r.item_id: r.tfidf.toArray() for r in x}
    cosine = lambda a, b: float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b))
    got = plans.QUERIES["m8_text_similarity"](spark, "/root/testdata/sf0.001").collect()
    assert {g["query"] for g in got} == {i for i in v if i % 20 == 0}
    for i in {g["query"] for g in got}:
        best = sorted((cosine(v[i], v[j]) for j in v if j != i), reverse=True)[:3]
        assert np.allclose(sorted((g["similarity"] for g in got if g["query"] == i), reverse=True), best, atol=1e-5)


@FEW
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 30)), max_size=12), st.lists(st.tuples(st.integers(0, 1), st.integers(0, 30)), max_size=12), st.booleans(), st.booleans())
def test_asof_in_buckets(spark, left, right, strict, forward):
    a = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k int, t int, i int")
    b = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(right)], "k int, t int, v int")
    plain, spread = (asof_join(a, b, ["k"], "t", "t", direction="forward" if forward else "backward", strict=strict, order=["v"], bucket=f) for f in (None, lambda at: F.floor(at / 5)))
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, spread.collect()))


def test_equal_names_match_across_blocks(spark):
    a = spark.createDataFrame([("alpha",), ("(Beta) Ltd",), ("gamma",), ("??",)], "a string")
    b = spark.createDataFrame([("Alpha",), ("beta ltd",), ("Gama",), ("gxmmb",), ("!!",)], "b string")
    first = lambda c: F.substring(c, 1, 1)
    got = {r.a: (r.match, r.score) for r in joins.fuzzy_match(a, b, "a", "b", first("a"), F.lower(first("b")), 0.5).collect()}
    assert got == {"alpha": ("Alpha", 1.0), "(Beta) Ltd": ("beta ltd", 1.0), "gamma": ("Gama", 0.8), "??": (None, None)}


def test_pairs_of_parts(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART", 3)
    df = spark.createDataFrame([(g, i) for g, n in (("x", 11), ("y", 1), ("z", 4)) for i in range(n)] + [("z", 1)], "g string, i long")
    got = [tuple(r) for r in joins.group_pairs(df, ["g"], "i").collect()]
    assert sorted(got) == [(g, a, b) for g, n in (("x", 11), ("z", 4)) for a in range(n) for b in range(a + 1, n)]
