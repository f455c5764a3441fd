"""Steps whose work must not grow faster than their input, and the odd rows that they meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import calendar, factor, joins, pairs, screens, windows
from tidemark.plans import fixtures, studies
from tidemark.streaming import monitor


def test_days_are_looked_up_once(spark):
    days = spark.createDataFrame([("2020-01-03",), ("2020-01-06",)], "d string").select(F.to_date("d").alias("d"))
    df = spark.createDataFrame([(1, "2020-01-05"), (2, "2020-01-06"), (3, "2020-01-01"), (4, None), (5, "2020-01-05")], "id int, at string").withColumn("at", F.to_date("at"))
    got = calendar.on_or_before(df, calendar.trading_calendar(days, "d"), "at", "out")
    assert got.columns == ["id", "at", "out"]
    assert sorted((r.id, str(r.out)) for r in got.collect()) == [(1, "2020-01-03"), (2, "2020-01-06"), (3, "None"), (4, "None"), (5, "2020-01-03")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Window"):]  # the window's rows are distinct days


def test_siblings_of_several_groups(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART", 2)
    rows = [("a", i) for i in range(1, 8)] + [("b", i) for i in (2, 3, 4, 5)] + [("c", 9), ("c", 9)]
    want = set()
    groups = {g: sorted({i for h, i in rows if h == g}) for g in "abc"}
    direct = {(m[0], i) for m in groups.values() for i in m[1:]}
    for m in groups.values():
        want |= {(x, y) for x in m[1:] for y in m[1:] if x != y}
    got = [(r.leader, r.follower, r.kind) for r in joins.leader_pairs(spark.createDataFrame(rows, "g string, i int"), ["g"], "i").collect()]
    assert sorted(got) == sorted([(*p, "direct") for p in direct] + [(*p, "sibling") for p in want - direct])


def test_totals_without_a_pause_need_no_python(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, None), (2, None), (None, 2.0)], "user_id long, value double")
    got = monitor.running_totals(rows)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 3, 1.0), (2, 1, 0.0), (None, 1, 2.0)]


def test_audit_of_nulls_and_ties(spark, monkeypatch):
    monkeypatch.setattr(windows, "PIECES", 5)
    rows = [(i, "a" if i % 3 else None, float(i % 11) if i % 7 else None, int(i % 4 == 0)) for i in range(200)] + [(500, "one", 1.0, 1), (501, "none", None, 0)]
    df = spark.createDataFrame(rows, "id int, g string, s double, y int")
    want = df.withColumn("r", F.percent_rank().over(windows.over(["g"], ["s"]))).groupBy("g").agg(F.round(F.avg(F.when(F.col("y") == 1, F.col("r"))), 9).alias("m"))
    got = screens.leak_audit(df, ["id"], "g", "s", "y")
    assert "percent_rank" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.g, r.rows, r.repeated, None if r.mean_rank is None else round(r.mean_rank, 9)) for r in got.collect()} == {(r.g, sum(x[1] == r.g for x in rows), 0, r.m) for r in want.collect()}


def test_trimming_reads_each_column_once(spark):
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(400)], "a double, b double")
    got = factor.trimmed(df, ["a", "b"], 0.05, 0.95)
    assert "percentile_approx" not in got._jdf.queryExecution().optimizedPlan().toString()
    left = sorted(r.a for r in got.collect())
    assert left == [float(i) for i in range(20, 380)]
    assert factor.trimmed(df.limit(0), ["a", "b"], 0.05, 0.95).count() == 0


def test_factors_without_a_window(spark):
    rows = [(d, g, float(i * i % 7) if i % 5 else None) for i, (d, g) in enumerate((d, g) for d in (1, 2, None) for g in ("x", "y", None) for _ in range(4))]
    df = spark.createDataFrame(rows, "d int, g string, r double")
    got = factor.equal_weight_factors(df, "d", "r", ["g"])
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    mean = lambda v: sum(v) / len(v)
    for x in got.collect():
        mkt = mean([r for d, _, r in rows if d == x.d and r is not None])
        assert abs(x.mkt - mkt) < 1e-9 and abs(x.f_g - mean([r for d, g, r in rows if (d, g) == (x.d, x.g) and r is not None]) + mkt) < 1e-9


def test_ranks_of_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", None), ("a", 1.0), ("a", 2.0), ("b", None)], "g string, v double")
    got = windows.cross_rank(df, ["g"], "v", "r")
    assert sorted((r.g, str(r.v), None if r.r is None else round(r.r, 9)) for r in got.collect()) == [("a", "1.0", round(1 / 3, 9)), ("a", "2.0", round(2.5 / 3, 9)), ("a", "2.0", round(2.5 / 3, 9)), ("a", "None", None), ("b", "None", None)]


def test_residuals_are_dealt_by_rows(spark, data, monkeypatch):
    """Returns are stored once; a task of the join has a bounded part of them, whatever the session's partitions."""
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    t = fixtures.Tables(spark, data)
    got = studies._three_factors(t)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert t.tasks == 12 and plan.count(", 12)") >= 2 and "l_extendedprice" not in plan
    monkeypatch.setattr(fixtures, "TASK_ROWS", 10**9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, studies._three_factors(fixtures.Tables(spark, data)).collect()))


@pytest.mark.parametrize("name", ["d48_residual_clusters", "d48_ward_tree", "d48_ward_clusters", "d49_low_residual_pairs"])
def test_residuals_are_summed_once(spark, name, monkeypatch):
    made = []
    monkeypatch.setattr(studies, "_three_factors", lambda t, f=studies._three_factors: made.append(1) or f(t))
    files = {f.rsplit("/", 2)[-2].rsplit("-", 5)[0] for f in plans.QUERIES[name](spark, "/root/testdata/sf0.01").inputFiles()}
    assert made == [1] and files and not any("lineitem" in f for f in files)


def test_pairs_leave_a_task_as_columns():
    """Names of any kind, the smaller first, a block with itself once."""
    for a, b in (([5, 1, 3], [4, 2]), (["x", "b", "m"], ["c", "y"])):
        a, b = np.array(a, dtype=object if a[0] == "x" else None), np.array(b, dtype=object if a[0] == "x" else None)
        hit = np.array([[True, False], [True, True], [False, True]])
        got = pairs._found(a, b, hit, False, n=np.arange(6).reshape(3, 2))
        assert [*map(tuple, got.to_numpy())] == [(*sorted((a[i], b[j])), 2 * i + j) for i, j in ((0, 0), (1, 0), (1, 1), (2, 1))]
        own = pairs._found(a, a, np.ones((3, 3), bool), True)
        assert sorted(map(tuple, own.to_numpy())) == sorted((x, y) for x in a for y in a if x < y)
    assert pairs._found(a, b, hit & False, False).empty


def test_pairs_are_dealt_into_tasks_by_their_number(spark, monkeypatch):
    """However few bytes a group's items are; items without a group have no leader."""
    monkeypatch.setattr(joins, "PART", 4)
    monkeypatch.setattr(joins, "TASK_PAIRS", 100)
    rows = [("a", i) for i in range(70)] + [("b", i) for i in range(65, 75)] + [(None, 80), (None, 81), ("c", None), ("c", 90), ("c", 91)]
    df = spark.createDataFrame(rows, "g string, i int")
    groups = {"a": range(70), "b": range(65, 75), "c": range(90, 92)}
    want = {(g, x, y) for g, m in groups.items() for x in m for y in m if x < y}
    got = joins.group_pairs(df, ["g"], "i")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    direct = {(m[0], y) for m in groups.values() for y in m[1:]}
    siblings = {(x, y) for m in groups.values() for x in m[1:] for y in m[1:] if x != y} - direct
    led = joins.leader_pairs(df, ["g"], "i")
    assert sorted(map(tuple, led.collect())) == sorted([(*p, "direct") for p in direct] + [(*p, "sibling") for p in siblings])
    for x in (got, led.where("kind = 'sibling'")):
        made = [r.n for r in x.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(made) > 20 and max(made) < 1000
