"""The interval sweep against a plain search."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.joins import nearest_interval


def plain(points, intervals):
    out = []
    for p in points:
        key, at = p[0], p[1]
        own = sorted((i for i in intervals if i[0] == key and i[1] is not None and i[2] is not None and i[1] <= i[2]), key=lambda i: (i[1], i[3]))
        found = (None, None)
        if at is not None:
            hold = [i for i in own if i[1] <= at <= i[2]]
            gone = [i for i in own if i[2] < at]
            later = [i for i in own if i[1] > at]
            if hold:
                found = (hold[0][3], 0)
            elif gone:
                found = (max(gone, key=lambda i: i[2])[3], 1)
            elif later:
                found = (min(later, key=lambda i: i[1])[3], 2)
        out.append((*p, *found))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("bucket", [None, lambda t: F.floor(t / 7)])
def test_against_a_plain_search(spark, seed, bucket):
    r = random.Random(seed)
    spread = r.choice([12, 40])
    intervals = [(r.choice("aab"), lo := r.randint(0, spread), lo + r.choice([0, 0, 1, 3, 10, -2]), r.choice("pqrstu")) for _ in range(r.choice([3, 15, 40]))] + [("a", None, 5, "n"), ("a", 5, None, "n"), ("d", 1, 2, "z")]
    points = [(k, at, i) for i, (k, at) in enumerate((k, at) for k in "abc" for at in [*range(-2, spread + 12), None])] + [("a", 5, 0), ("a", 5, 0)]
    p = spark.createDataFrame(points, "k string, at int, v int")
    i = spark.createDataFrame(intervals, "k string, lo int, hi int, label string").repartition(3)
    assert rows(nearest_interval(p, i, "k", "at", "lo", "hi", "label", bucket)) == plain(points, intervals)


@pytest.mark.parametrize("kind", ["date", "timestamp", "double"])
def test_other_times(spark, kind):
    at = {"date": lambda n: dt.date(2020, 1, 1) + dt.timedelta(n), "timestamp": lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(hours=n), "double": float}[kind]
    intervals = [("a", at(3), at(6), 1), ("a", at(5), at(9), 2), ("a", at(9), at(9), 3), ("a", at(20), at(21), 4)]
    points = [("a", at(n), n) for n in range(25)]
    got = nearest_interval(spark.createDataFrame(points, f"k string, at {kind}, i int"), spark.createDataFrame(intervals, f"k string, lo {kind}, hi {kind}, v int"), "k", "at", "lo", "hi", "v")
    assert rows(got) == plain(points, intervals)


def test_none(spark):
    p = spark.createDataFrame([("a", 1)], "k string, at int")
    i = spark.createDataFrame([], "k string, lo int, hi int, label string")
    assert rows(nearest_interval(p, i, "k", "at", "lo", "hi", "label")) == [("a", 1, None, None)]
    assert nearest_interval(p.limit(0), i, "k", "at", "lo", "hi", "label").count() == 0


def test_points_never_meet_all_intervals(spark):
    """One key with many of both: as many rows leave the joins as points."""
    p = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").alias("at"))
    i = spark.range(10_000).select(F.lit("a").alias("k"), (F.col("id") * 2).alias("lo"), (F.col("id") * 2 + 5).alias("hi"), F.col("id").alias("v"))
    df = nearest_interval(p, i, "k", "at", "lo", "hi", "v", lambda t: F.floor(t / 1000))
    got = df.agg(F.count("*"), F.sum("v"), F.sum("match_kind")).first()
    assert got[0] == 20_000 and got[2] == 0 and got[1] == sum(max(0, -(-(at - 5) // 2)) for at in range(20_000))
