"""The pipeline, stage by stage, against what each operator says of the stage's own input."""

import corpus_pipeline
from tidemark.llm import packing, rules
from tidemark.llm.common import table, written
from tests.llm.test_operators import dedup_brute


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    columns, kept = docs.dtypes, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, folder), "stage")
        assert docs.dtypes == columns
        kept[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    judged = {r.doc_id: r.base_failed for r in rules.counted(table(spark, folder, "documents"), "doc_id").withColumn("base_failed", rules.base_failed()).collect()}
    by_rules = kept["quality rules"]
    good = [i for i, q in labels.items() if q == 1 and not judged[i]]
    assert all(not judged[i] for i in by_rules) and sum(i in by_rules for i in good) / len(good) > 0.97
    by_class = kept["quality classifier"]
    assert by_class.keys() <= by_rules.keys() and sum(i in by_class for i in good) / len(good) > 0.9
    near = kept["SimHash near-dedup"]
    assert {t for t in by_class.values()} >= {t for t in near.values()} and len(set(near.values())) == len(near)
    want = {d: (n - gone) for d, n, gone, _ in dedup_brute(near.items())}
    assert {i: len(t.split()) for i, t in kept["substring dedup"].items()} == want
    last = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    assert last.columns == packing.packed(docs).columns and {r.doc_id for r in last.select("doc_id").distinct().collect()} == set(near)


def test_stages_take_an_empty_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
