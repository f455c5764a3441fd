"""From raw documents to packed sequences: quality rules, quality classifier, near-duplicates, repeated passages, packing.

All stages read whole texts of any length, take null texts for empty ones, give no rows for an empty table, and keep columns beside text as
they are, whatever their names; of equal rows each is judged by itself, and equally. Where a stage does otherwise, it says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import compression, near_sets, packing, rules, simhash, substrings
from tidemark.llm.common import joined, table, written

#: SimHash values of a text and bits by which they may differ for texts to be compared. Of texts that are alike in four fifths
#: of their five-word shingles, three-word values differ in 6.5 bits on average.
FINGERPRINTS, BITS = 8, 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep. Rules are learned from labelled rows of the corpus. Null and empty texts go."""
    learned = rules.learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = rules.counted(docs.select(F.struct(*docs.columns).alias("row"), "text"), "row")
    return counts.where(~rules.base_failed() & rules.verdict(learned)).select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good. It is fitted on labelled rows of the corpus, bad ones included."""
    model = compression.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = compression.scored(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return scored.where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id, with all rows that have this doc_id; rows without a doc_id stay.

    SimHash proposes, by the trie self-join: documents of which any of FINGERPRINTS is within BITS bits are in one block. In a
    block those are linked whose five-word shingles have a Jaccard similarity of 0.8 or more, so that no other text goes.
    """
    ids = docs.where("doc_id is not null").select("doc_id", "text")
    blocks = simhash.near_components(ids, budget=BITS, several=FINGERPRINTS)
    sizes = blocks.select("doc_id", F.col("component_id").alias("block"))
    sizes = written(sizes.distinct(), "blocks")
    shared = sizes.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    some = written(joined(sizes, shared, "block"), "candidates")
    near = ids.join(some.hint("merge"), "doc_id").select("doc_id", "text", "block")
    found = written(near_sets.near_components(written(near, "candidate-texts")), "components")
    gone = found.where("component_id < doc_id").select("doc_id").distinct()  # grows with the corpus: never broadcast
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that an earlier document has; n_chars counts what is left."""
    others = [c for c in docs.columns if c != "text"]
    done = substrings.deduplicated(docs.select("doc_id", "text", F.struct(*others).alias("row")), carry="row")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"row.{c}") for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("packing", packing_stage),
]

#: SQL can't express fitted rules, compressed sizes or tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
