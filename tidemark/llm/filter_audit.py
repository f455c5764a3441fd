"""How filters interact: what each removes, keeps and repeats, in every order of applying them, from one histogram of failures."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: Bit i of a mask stands for the i-th of these.
FILTERS = "ABCDE"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "shapley")


def incidence(filters: str = FILTERS) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The (order, step) of each column, and for each of OUTCOMES a matrix of whole numbers: a row for each mask, a column for each (order, step)."""
    k = len(filters)
    orders = np.array(list(itertools.permutations(range(k)))).reshape(math.factorial(k), k)
    bit = 1 << orders
    earlier = (bit.cumsum(1) - bit).ravel()
    bit, which = bit.ravel(), orders.ravel()
    mask = np.arange(1 << k)[:, None]
    fails, passed = mask & bit > 0, mask & earlier == 0
    removed = fails & passed
    by_filter = np.stack([removed[:, which == f].sum(1) for f in range(k)], 1)
    matrices = {"kept": ~fails & passed, "removed": removed, "redundant": fails & ~passed, "unique_fails": mask == bit, "shapley": by_filter[:, which]}
    names = [("".join(filters[f] for f in o), step + 1) for o in orders for step in range(k)]
    return names, {name: m.astype(np.int64) for name, m in matrices.items()}


def text_failures(text: Column, words: Column) -> list[Column]:
    """Conditions A to D, on a text that isn't null and the array of its words."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 100, 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows of ``docs`` by part and by the set of FILTERS that they fail, and how many of them are labelled.

    Texts are known by SHA-256. Rows that are alike in text, id and part are counted before they are shuffled, so neither a
    text nor an id with very many rows is dealt to one task; a text's first id is a minimum, summed up the same way, and is
    joined on text and id together. Ids with many texts are split by the join with ``labels``.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    failed = text_failures(F.col("text"), F.col("words"))
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failed)), F.lit(0))
    rows = rows.select(F.unhex(F.sha2("text", 256)).alias("digest"), "doc_id", "part", mask.alias("mask")).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", "n", (F.col("mask") + F.when(F.col("first") | F.col("doc_id").isNull(), 0).otherwise(1 << len(failed))).alias("mask"))
    mark = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(mark("quality"), mark("toxic"))
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    rows = known.unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    count = lambda c, name: F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("n"))), F.lit(0)).alias(name)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("quality", "good"), count("toxic", "toxic"))


def interactions(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part of ``found`` (part, mask, n, good, toxic), each order of ``filters`` and each step: counts of OUTCOMES, good_lost, toxic_lost.

    A part is three rows of 2^k counts, by mask; a product with each matrix of incidence() gives all orders and steps at once.
    """
    size, names = 1 << len(filters), incidence(filters)[0]
    stacked = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^k
    totals = (*OUTCOMES, "good_lost", "toxic_lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = incidence(filters)[1]
        orders, steps = pa.array([o for o, _ in names]), pa.array([s for _, s in names], pa.int32())
        letters = pa.array([o[s - 1] for o, s in names])
        for batch in batches:
            for part, cells in zip(batch.column(0), batch.column(1).to_pylist()):
                rows = np.zeros((3, size), np.int64)
                for c in cells:
                    rows[:, c["mask"]] += (c["n"], c["good"], c["toxic"])
                out = [rows[0] @ matrices[name] for name in OUTCOMES] + [rows[k] @ matrices["removed"] for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(names), pa.string()), orders, steps, letters, *map(pa.array, out)], names=["part", "filter_order", "step", "filter", *totals])

    return stacked.mapInArrow(run, "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} long" for c in totals))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text: empty. Null lang: the part ''. A null doc_id isn't larger than any, so its row never fails E and has no labels;
    rows that repeat the smallest doc_id of a text don't fail it either. A document is good or toxic if any row of its id in
    labels says so. Long texts are read whole, in SQL functions. No documents: no parts, no rows. Other columns are ignored."""
    return interactions(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
