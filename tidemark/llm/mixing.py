"""Mixing sources to target weights by weighted fair queueing: one order of all documents, in which each source gets its share all along."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import scratch, table, word_count, written

WEIGHTS = (5, 2, 1)
#: How often a source may be read.
MOST_READS = 3
#: Rows that are alike are put out by so many in one task.
CHUNK = 100_000


def targets(sources: DataFrame, budget: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_READS) -> DataFrame:
    """``sources`` (source, source_size, one row each) with number, weight, budget and target.

    Sources in code-point order, null last, have the ``weights`` in turn. A target is the smaller of ``most`` sizes and the
    weight's share of what those leave who stop there: with sources by rising size for their weight, those that stop come
    first, so running sums settle it. ``budget`` is the sum of sizes if not given. Windows are over one row a source.
    """
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    df = sources.withColumn("number", F.row_number().over(in_order) - 1)
    df = df.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), F.pmod("number", F.lit(len(weights))).cast("int") + 1), "budget": (F.sum("source_size").over(everything) if budget is None else budget).cast("long"), "ceiling": most * F.col("source_size")})
    rising = Window.orderBy(F.col("ceiling") / F.col("weight"), "number")
    before = lambda c: F.coalesce(F.sum(c).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("stops", F.col("ceiling").cast("double") * left <= F.col("weight").cast("double") * (F.col("budget") - before("ceiling")))
    given = F.sum(F.when(F.col("stops"), F.col("ceiling")).otherwise(0)).over(everything)
    shared = F.sum(F.when(~F.col("stops"), F.col("weight")).otherwise(0)).over(everything)
    fair = F.when(~F.col("stops"), F.col("weight").cast("double") * (F.col("budget") - given) / shared)
    return df.withColumn("target", F.coalesce(fair, F.col("ceiling").cast("double"))).drop("ceiling", "stops")


def ranged_totals(df: DataFrame, order: list[str], value: str, by: str | None = None) -> DataFrame:
    """``df``, written in ranges of ``order``, with before: the sum of ``value`` over the rows before it, of the same ``by``.

    ``order`` starts with ``by``, a whole number, if that is given, and settles all ties that matter. Each task adds up its
    own sorted range, batch by batch; what stood before a range comes from a table with a row for each range and group.
    """
    group = F.lit(0).cast("long") if by is None else F.col(by).cast("long")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_by": group, "_value": F.col(value).cast("long")})
    names = ranged.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, values = (np.asarray(batch.column(names.index(c))) for c in ("_by", "_value"))
            sums = np.cumsum(values) - values
            new = np.concatenate([[groups[0] != last], groups[1:] != groups[:-1]])
            starts = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            base = np.where(new[starts], sums[starts], -total)
            own = sums - base
            last, total = groups[-1], int(own[-1] + values[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*names, "before"])

    done = written(ranged.mapInArrow(run, ranged.withColumn("before", F.lit(0).cast("long")).schema), "ranges")
    ends = done.groupBy("_by", "_part").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_by", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    return done.join(ends, ["_by", "_part"]).withColumn("before", F.col("before") + F.col("_earlier")).drop("_by", "_part", "_value", "_earlier")


def sized(docs: DataFrame) -> DataFrame:
    """source, doc_id, digest of the text, size in words, and n: how many rows are alike in all of these."""
    rows = docs.select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("source", "doc_id", F.xxhash64("text").alias("digest"), word_count(F.col("text")).alias("size"))
    return rows.groupBy("source", "doc_id", "digest", "size").agg(F.count("*").alias("n"))


def single_rows(rows: DataFrame) -> DataFrame:
    """sized() with copy, a number for each of n rows that are alike. Where those are very many, they are dealt out in chunks."""
    few = rows.where(F.col("n") <= CHUNK).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    many = rows.where(F.col("n") > CHUNK).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))).repartition("digest", "doc_id", "start")
    many = many.withColumn("copy", F.explode(F.sequence("start", F.least(F.col("start") + CHUNK, "n") - 1))).drop("start")
    return few.unionByName(many).drop("n")


def mixed(docs: DataFrame, seed: int = 0, budget: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_READS) -> DataFrame:
    """The mix: a row for each time that a document is read, with finish, its virtual finish time, position, the words before it
    in the mix, and words, how many of it are taken.

    A source is read in an order shuffled by hash, up to ``most`` times over. A reading of a document ends at the source's words up to
    then divided by the source's target; the order of these times interleaves the sources by their targets at every point.
    What a source has after its target isn't read: the document in which it is reached is cut. The order of all is cut at
    the budget. Documents that aren't read have a row with 0 words, at the end. Sorting is by range, so no source or
    finish time is in one task; totals are kept by range. The same rows and seed give the same mix.
    """
    sizes = written(sized(docs), "sizes")
    sources = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), budget, weights, most)
    rows = single_rows(sizes).join(sources.select(F.col("source").alias("_s"), "number", "source_size", "target", "budget"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("shuffle", F.xxhash64(F.lit(seed), "doc_id", "digest", "copy"))
    own = ["number", "shuffle", "doc_id", "digest", "copy"]
    rows = ranged_totals(rows, own, "size", "number")
    quota = F.round("target").cast("long")
    start = lambda e: F.col("before") + e * F.col("source_size")
    reads = F.array(*(F.struct(F.lit(e).alias("reading"), start(e).alias("start"), F.least("size", quota - start(e)).alias("words")) for e in range(most)))
    rows = rows.withColumn("r", F.explode_outer(F.filter(reads, lambda r: r["words"] > 0))).select("*", "r.*").drop("r", "before").fillna(0, ["words"])
    finish = F.when(F.col("words") > 0, (F.col("start") + F.col("words")) / F.col("target")).otherwise(float("inf"))
    queue = ranged_totals(rows.withColumn("finish", finish), ["finish", *own], "words")
    return queue.withColumn("words", F.greatest(F.lit(0), F.least("words", F.col("budget") - F.col("before")))).withColumnRenamed("before", "position")


def write_mix(mix: DataFrame, path: str | None = None) -> str:
    """mixed() without what isn't read, as Parquet files that follow one another in the order of the mix."""
    path = path or scratch(mix.sparkSession, "mix")
    mix.where("words > 0").drop("budget").repartitionByRange("position").sortWithinPartitions("position").write.parquet(path)
    return path


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text: no words. Null source: a source of its own, the last. Rows that are alike in all of source, doc_id and text each keep a row and
    a place of their own; so do null ids. Documents and sources without words take none. Long texts are counted in SQL
    functions. No documents: no rows. Other columns are ignored."""
    mix = mixed(table(spark, sf_dir, "documents"))
    own = ["number", "shuffle", "doc_id", "digest", "copy"]
    one = mix.groupBy(*own).agg(*(F.max(c).alias(c) for c in ("source", "size", "source_size", "target")), F.sum("words").alias("taken"))
    return one.select("doc_id", "source", F.col("size").cast("long").alias("size"), "source_size", "target", "taken")
