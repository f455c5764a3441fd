"""Packing of documents into sequences of a fixed window: length combinations by non-negative least squares, then a greedy rest."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import batched, running_totals, table, written
from .tokens import encoder

WINDOW, END = 1024, 0
#: Rows that a bucket of running sums holds about.
BUCKET_ROWS = 2000


def combinations(hist: np.ndarray, window: int, partners: int = 3) -> np.ndarray:
    """Lengths that fill a window: every pair, and for each length triples with its ``partners`` most frequent companions.

    hist[l]: pieces of length l. Rows are sorted and padded with 0; only lengths that occur.
    """
    there = np.flatnonzero(hist[:window])
    found = {(a, window - a, 0) for a in there.tolist() if window - a <= a and hist[window - a]}
    often = there[np.argsort(-hist[there], kind="stable")][:64].tolist()
    for a in there.tolist():
        fitting = [b for b in often if window - a - b > 0 and hist[window - a - b]][:partners]
        found |= {tuple(sorted((a, b, window - a - b), reverse=True)) for b in fitting}
    return np.array(sorted(found), int).reshape(-1, 3)


def nonnegative_least_squares(combos: np.ndarray, hist: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """x >= 0 that minimises the squared distance between what the combinations use and ``hist``, by coordinate descent."""
    columns = [np.unique(c[c > 0], return_counts=True) for c in combos]
    x, rest = np.zeros(len(combos)), hist.astype(float).copy()
    norms = [float(m @ m) for _, m in columns]
    for _ in range(sweeps):
        moved = 0.0
        for k, (lengths, m) in enumerate(columns):
            step = max(-x[k], float(rest[lengths] @ m) / norms[k])
            if step:
                x[k] += step
                rest[lengths] -= step * m
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[list[int], int]]:
    """(lengths, repeats) that use no more pieces than there are: the solution rounded, cut where pieces run out, and then
    greedily repeated on the residuals."""
    combos, left = combinations(hist, window), hist.astype(int).copy()
    x = nonnegative_least_squares(combos, hist)
    repeats = np.zeros(len(combos), int)
    for wanted in (np.round(x), np.full(len(x), np.inf)):  # the solution first, then as often as what is left allows
        for k in np.argsort(-x, kind="stable"):
            lengths, m = np.unique(combos[k][combos[k] > 0], return_counts=True)
            n = int(min(wanted[k], *(left[lengths] // m)))
            left[lengths] -= n * m
            repeats[k] += n
    found = [(sorted(combos[k][combos[k] > 0].tolist(), reverse=True), int(repeats[k])) for k in np.flatnonzero(repeats)]
    return found


def tokenised(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, doc_tokens, crcs of its full windows, and the tail's ids, length and crc, for each row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("tail", pa.binary()), ("tail_length", pa.int32()), ("tail_crc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().encode
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids = [np.asarray([*encode(x.as_py() or ""), END], "<u4").tobytes() for x in part.column(1)]
                full = [len(x) // (4 * window) for x in ids]
                crcs = [[zlib.crc32(x[4 * window * i : 4 * window * (i + 1)]) for i in range(n)] for x, n in zip(ids, full)]
                tails = [x[4 * window * n :] for x, n in zip(ids, full)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array([len(x) // 4 for x in tails], pa.int32()), pa.array([zlib.crc32(x) for x in tails], pa.int64())], schema=schema)

    return batched(docs).selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>, tail binary, tail_length int, tail_crc long")


def packed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of all ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's full windows are sequences of their own. The tails, whose lengths make a histogram of ``window`` numbers,
    fill windows by the planned combinations: the r-th tail of a length takes that length's r-th place. What is left over
    is laid end to end and cut at the windows' ends, so at most one sequence is padded. Ranks and running sums are taken
    within buckets of some 2000 rows and shifted by sums over earlier buckets, which are summed up by neighbours first: no task
    sees all rows, and none sees all buckets.

    Null and empty texts are the closing id alone. Repeated rows are packed each. An empty table gives no rows. Other
    columns are ignored.
    """
    rows = written(tokenised(docs, window), "tokenised")
    buckets = max(1, rows.count() // BUCKET_ROWS)
    width = math.isqrt(buckets) + 1
    file = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1)
    rows = rows.withColumn("b", F.pmod(F.xxhash64("doc_id", "tail_crc", file, "_metadata.row_index"), F.lit(buckets)))  # repeated rows, too, are spread

    counts = rows.groupBy("b", "tail_length").agg(F.count("*").alias("n"), F.sum(F.size("crcs")).alias("full"))
    counts = written(counts, "counts")
    hist = np.zeros(window + 1, int)
    for r in counts.groupBy("tail_length").agg(F.sum("n").alias("n")).collect():
        hist[r["tail_length"]] = r["n"]
    hist[0], slots, used, sequence = 0, [], np.zeros(window + 1, int), 0
    for lengths, n in plan(hist, window):
        at = 0
        for length in lengths:
            slots.append((int(length), int(used[length]), int(used[length]) + n, sequence, at))
            used[length] += n
            at += length
        sequence += n
    spark = docs.sparkSession
    places = spark.createDataFrame(slots, "tail_length int, lo long, hi long, first_sequence long, place long")  # a few thousand rows, by the window
    used_by = spark.createDataFrame([(i, int(n)) for i, n in enumerate(used)], "tail_length int, used long")
    full = counts.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("n")).first()["n"]

    counts = running_totals(counts, "b", ["n"], width, ("tail_length",)).withColumnRenamed("before_n", "before").join(F.broadcast(used_by), "tail_length")  # 1024 rows
    over = F.greatest(F.lit(0), F.col("before") + F.col("n") - F.greatest("before", "used")) * F.col("tail_length")
    meta = counts.groupBy("b").agg(F.sum("full").alias("full"), F.sum(over).alias("rest"), F.map_from_entries(F.collect_list(F.struct("tail_length", F.struct("before", "used").alias("x")))).alias("ranks"))
    meta = running_totals(meta, "b", ["full", "rest"], width)
    meta = written(meta.select("b", "ranks", F.col("before_full").alias("full_before"), F.col("before_rest").alias("rest_before")), "meta")

    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "tail_crc", "doc_tokens")]
    rows = rows.join(meta.hint("merge"), "b").withColumn("x", F.col("ranks")[F.col("tail_length")]).drop("ranks")  # before any sort
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("b", "tail_length").orderBy(*order)) - 1)
    rows = rows.withColumn("rank", F.col("rank") + F.col("x.before")).withColumn("left", F.when(F.col("rank") >= F.col("x.used"), F.col("tail_length")).otherwise(0))
    run = Window.partitionBy("b").orderBy("tail_length", *order, "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"full_at": F.col("full_before") + F.sum(F.size("crcs")).over(run) - F.size("crcs"), "rest_at": F.col("rest_before") + F.sum("left").over(run) - F.col("left")}).drop("x")

    piece = lambda start, length, crc, seq, at: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), crc.cast("long").alias("ids_crc32"), seq.cast("long").alias("sequence_id"), at.cast("long").alias("offset"))
    w, length, tail_start = F.lit(window), F.col("tail_length"), F.size("crcs") * window
    whole = F.transform("crcs", lambda crc, i: piece(i * w, w, crc, F.lit(sequence) + F.col("full_at") + i, F.lit(0)))
    at = F.col("rest_at") % window
    head = F.least(length.cast("long"), w - at)
    first = F.lit(sequence + full) + F.floor(F.col("rest_at") / window)
    crc = lambda start, n: F.crc32(F.substring("tail", (start * 4 + 1).cast("int"), (n * 4).cast("int")))
    cut = F.when(head == length, F.array(piece(tail_start, length, F.col("tail_crc"), first, at))).otherwise(F.array(piece(tail_start, head, crc(F.lit(0), head), first, at), piece(tail_start + head, length - head, crc(head, length - head), first + 1, F.lit(0))))
    placed = F.array(piece(tail_start, length, F.col("tail_crc"), F.col("first_sequence") + F.col("rank") - F.col("lo"), F.col("place")))
    spot = F.broadcast(places.withColumnRenamed("tail_length", "for_length"))
    rows = rows.join(spot, (F.col("left") == 0) & (F.col("for_length") == length) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    tail = F.when(length == 0, F.array().cast("array<struct<start:bigint,length:bigint,ids_crc32:bigint,sequence_id:bigint,offset:bigint>>")).when(F.col("left") > 0, cut).otherwise(placed)
    return rows.select("doc_id", "doc_tokens", F.explode(F.concat(whole, tail)).alias("p")).select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are the closing id alone. Repeated rows and rows without an id are packed each; ties in order are
    broken by the files' rows. Long texts are cut into windows; an empty table gives no rows; other columns are ignored."""
    return packed(table(spark, sf_dir, "documents"))
