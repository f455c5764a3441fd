"""The stored index against the exact search: recall and how much of the rows is read."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import vectors
from tidemark.sources.tables import scratch_path


def recall(found, exact):
    truth = collections.defaultdict(set)
    for r in exact.collect():
        truth[r.query].add(r.neighbour)
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r.query].add(r.neighbour)
    assert all(len(g) == len(truth[q]) for q, g in got.items())
    return sum(len(got[q] & t) for q, t in truth.items()) / sum(map(len, truth.values()))


def test_recall_with_a_tenth_of_the_vectors(spark):
    """No clusters to speak of: all codes are compared, a sixteenth of the vectors' bytes, and the vectors of a twentieth of the rows."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = rows.where("vec_id % 20 = 0")
    index = vectors.vector_index(rows, "vec_id", "embedding", scratch_path(spark, "index"))
    stored = spark.read.parquet(index.path)
    assert stored.count() == rows.count() == stored.select("key").distinct().count()
    compared = 100
    assert compared <= rows.count() / 10
    code, unit = stored.agg(F.sum(F.length("code")), F.sum(F.length("unit"))).first()
    assert code * 16 <= unit
    exact = vectors.nearest(q, rows, "vec_id", "embedding", k=10)
    found = vectors.probe(index, q, "vec_id", "embedding", 10, refine=compared)
    assert recall(found, exact) >= 0.95
    far = {(r.query, r.neighbour): r.distance for r in exact.collect()}
    assert all(abs(far[r.query, r.neighbour] - r.distance) < 1e-5 for r in found.collect() if (r.query, r.neighbour) in far)
    again = vectors.probe(vectors.VectorIndex.opened(spark, index.path), q, "vec_id", "embedding", 10, refine=compared)
    assert sorted(again.collect()) == sorted(found.collect())


def test_clusters_are_read_by_few_lists(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 24))
    x = np.repeat(centres, 100, axis=0) + 0.15 * r.normal(size=(3000, 24))
    rows = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)] + [(5000, None, "c"), (5001, [0.0] * 24, "c")], "id long, v array<float>, list string").repartition(5)
    index = vectors.vector_index(rows, "id", "v", scratch_path(spark, "index"), lists=40)
    q = rows.where("id % 60 = 0")
    exact = vectors.nearest(q, rows, "id", "v", k=10)
    found = vectors.probe(index, q, "id", "v", 10, probes=3)
    assert recall(found, exact) >= 0.9
    stored = spark.read.parquet(index.path)
    sizes = {x["list"]: x["count"] for x in stored.groupBy("list").count().collect()}
    unit = np.stack([v / np.linalg.norm(v) for v in x[::60]]).astype(np.float32)
    read = [sum(sizes.get(int(l), 0) for l in near) for near in np.argsort((index.centres**2).sum(1) / 2 - unit @ index.centres.T, axis=1)[:, :3]]
    assert np.mean(read) <= 3001 / 10
    one = vectors.probe(index, rows.where("id = 60"), "id", "v", 10, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan and "INSET" in plan.upper() or "list#" in plan.split("PartitionFilters")[1][:80]


@pytest.mark.parametrize("lists", [None, 1])
def test_ties_repeats_and_empty_tables(spark, lists):
    rows = spark.createDataFrame([(i, [1.0, 0.0, float(i // 4)]) for i in range(40)], "id long, v array<double>")
    index = vectors.vector_index(rows, "id", "v", scratch_path(spark, "index"), lists=lists)
    got = vectors.probe(index, rows.where("id in (0, 5)"), "id", "v", 3).orderBy("query", "distance", "neighbour").collect()
    assert [(r.query, r.neighbour) for r in got] == [(0, 0), (0, 1), (0, 2), (5, 4), (5, 5), (5, 6)]
    empty = vectors.vector_index(rows.limit(0), "id", "v", scratch_path(spark, "index"))
    assert vectors.probe(empty, rows, "id", "v", 3).count() == 0
    assert vectors.probe(index, rows.limit(0), "id", "v", 3).count() == 0


def test_closest_leaves_one_row_a_neighbour(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = rows.where("vec_id % 20 = 0")
    want = {r.neighbour: r.d for r in vectors.nearest(q, rows, "vec_id", "embedding", most=0.9).groupBy("neighbour").agg(F.min("distance").alias("d")).collect()}
    got = {r.neighbour: r.distance for r in vectors.closest(q, rows, "vec_id", "embedding", 0.9).collect()}
    assert got == pytest.approx(want) and len(got) > 20


def test_sparse_vectors_give_what_dense_ones_do(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(vectors, "BLOCK", 50)
    r = np.random.default_rng(4)
    rows = []
    for i in range(170):
        places = sorted(r.choice(300, r.integers(0, 12), replace=False).tolist())
        v = Vectors.sparse(300, places, r.integers(1, 4, len(places)).astype(float).tolist())
        rows.append((i, v if i % 10 else Vectors.dense(v.toArray().tolist()), v.toArray().tolist()))
    df = spark.createDataFrame([(i, v, d) for i, v, d in rows] + [(900, None, None)], ["id", "v", "d"]).repartition(3)
    q = df.where("id % 7 = 0")
    got = vectors.nearest_sparse(q, df, "id", "v", 5, slice_=9).orderBy("query", "distance", "neighbour").collect()
    want = vectors.nearest(q, df, "id", "d", k=5).orderBy("query", "distance", "neighbour").collect()
    far = {(w.query, w.neighbour): w.distance for w in want}
    assert len(got) == len(want) == 5 * 25 and all(abs(far.get((g.query, g.neighbour), g.distance) - g.distance) < 1e-12 for g in got)
    by_query = lambda rows: {k: sorted(round(x.distance, 12) for x in rows if x.query == k) for k in {x.query for x in rows}}
    assert by_query(got) == by_query(want)
