"""Search by vectors: exact, in blocks of queries against blocks of rows, and by a stored index of lists and codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Vectors of a block.
BLOCK = 2048


def _blocks(rows: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """Rows of a task, BLOCK at a time, as one row: their keys and their unit vectors end to end. Nothing is shuffled."""
    columns = [f"{name}_keys", f"{name}_unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.array([np.asarray(v, np.float64) for v in part.column(1).to_pylist()])
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=columns)

    return rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(run, f"{columns[0]} array<long>, {columns[1]} binary")


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int | None = None, most: float | None = None) -> DataFrame:
    """query, neighbour, distance (cosine): of each query the ``k`` nearest rows, or all rows up to ``most``; itself included.

    Every block of queries meets every block of rows, one matrix product each, wherever Spark puts the pair of blocks. Of
    a pair at most k rows for each query leave, and those are ranked in a window with a rank limit, so no task holds all
    candidates of a query. Rows without a vector aren't found; zero vectors are at distance 1 of all. Ties go to the smaller key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qk, qx, rk, rx in zip(*(c.to_pylist() for c in batch.columns)):
                if not qk or not rk:
                    continue
                q, r = (np.frombuffer(x, np.float64).reshape(len(n), -1) for x, n in ((qx, qk), (rx, rk)))
                far, own = 1 - q @ r.T, np.array(rk)
                if k is not None and k < len(rk):
                    edge = np.partition(far, k - 1, axis=1)[:, k - 1]
                    i, j = np.nonzero(far <= edge[:, None])  # ties at the edge too
                else:
                    i, j = np.nonzero(far <= (math.inf if most is None else most))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(qk)[i]), pa.array(own[j]), pa.array(far[i, j])], names=["query", "neighbour", "distance"])

    pairs = _blocks(queries, key, vector, "q").crossJoin(_blocks(rows, key, vector, "r"))
    found = pairs.mapInArrow(run, "query long, neighbour long, distance double")
    if most is not None:
        found = found.where(F.col("distance") <= most)
    return found if k is None else _top(found, k)


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _sparse_blocks(rows: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """_blocks() of vectors of pyspark.ml: how many places each vector has, the places and the values, end to end. Nothing is made dense."""
    columns = [f"{name}_{c}" for c in ("size", "keys", "lengths", "places", "values")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK).to_pylist()
                places = [np.asarray(r["v"]["indices"] if r["v"]["indices"] is not None else np.arange(len(r["v"]["values"])), np.int32) for r in part]
                values = [np.asarray(r["v"]["values"], float) for r in part]
                values = [v / n if (n := np.sqrt(v @ v)) > 0 else v for v in values]
                size = max((r["v"]["size"] or len(r["v"]["values"]) for r in part), default=0)
                flat = (np.array([len(p) for p in places], np.int32), np.concatenate(places), np.concatenate(values))
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([[r["k"] for r in part]], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in flat)], names=columns)

    rows = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.unwrap_udt(vector).alias("v"))
    return rows.mapInArrow(run, f"{columns[0]} int, {columns[1]} array<long>, {columns[2]} binary, {columns[3]} binary, {columns[4]} binary")


def nearest_sparse(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, slice_: int = 256) -> DataFrame:
    """nearest() for vectors of pyspark.ml with few values in many places: blocks travel as they are, and a task makes ``slice_`` vectors of
    either side dense at a time."""

    def dense(size: int, lengths: bytes, places: bytes, values: bytes) -> Iterator[np.ndarray]:
        n, p, v = np.frombuffer(lengths, np.int32), np.frombuffer(places, np.int32), np.frombuffer(values)
        ends = np.concatenate([[0], np.cumsum(n)])
        for a in range(0, len(n), slice_):
            b = min(a + slice_, len(n))
            out = np.zeros((b - a, size))
            out[np.repeat(np.arange(b - a), n[a:b]), p[ends[a] : ends[b]]] = v[ends[a] : ends[b]]
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                size = max(pair["q_size"], pair["r_size"])
                sides = {s: [pair[f"{s}_{c}"] for c in ("lengths", "places", "values")] for s in "qr"}
                at = 0
                for q in dense(size, *sides["q"]):
                    far = np.concatenate([1 - q @ r.T for r in dense(size, *sides["r"])], axis=1)
                    edge = np.partition(far, k - 1, axis=1)[:, k - 1] if k < far.shape[1] else np.full(len(q), np.inf)
                    i, j = np.nonzero(far <= edge[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(pair["q_keys"])[at + i]), pa.array(np.array(pair["r_keys"])[j]), pa.array(far[i, j])], names=["query", "neighbour", "distance"])
                    at += len(q)

    pairs = _sparse_blocks(queries, key, vector, "q").crossJoin(_sparse_blocks(rows, key, vector, "r"))
    return _top(pairs.mapInArrow(run, "query long, neighbour long, distance double"), k)


def closest(queries: DataFrame, rows: DataFrame, key: str, vector: str, most: float) -> DataFrame:
    """neighbour and distance of each row that is within ``most`` of some query: its least distance, which each pair of blocks reduces to one row a neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qk, qx, rk, rx in zip(*(c.to_pylist() for c in batch.columns)):
                if qk and rk:
                    q, r = (np.frombuffer(x, np.float64).reshape(len(n), -1) for x, n in ((qx, qk), (rx, rk)))
                    far = (1 - q @ r.T).min(axis=0)
                    near = np.flatnonzero(far <= most)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(rk)[near]), pa.array(far[near])], names=["neighbour", "distance"])

    pairs = _blocks(queries, key, vector, "q").crossJoin(_blocks(rows, key, vector, "r"))
    return pairs.mapInArrow(run, "neighbour long, distance double").groupBy("neighbour").agg(F.min("distance").alias("distance"))


def _means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k means of the rows of a bounded sample; a mean without rows stays where it is."""
    start = np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)
    centres = x[np.sort(start)].astype(np.float32)
    for _ in range(rounds):
        own = _nearest_mean(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, i], len(centres)) for i in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def _nearest_mean(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) / 2 - x @ centres.T).argmin(1)


@dataclass(frozen=True)
class VectorIndex:
    """A stored index: rows dealt into lists by the nearest centre, and for each row a code of a byte a piece for its distance from there.

    The table at ``path`` has a folder for each list and the columns key, code and unit; code is a small part of a row, and Parquet reads it
    without the vectors. centres: lists by dimensions. codes: pieces by 256 by dimensions of a piece.
    """

    path: str
    centres: np.ndarray
    codes: np.ndarray

    def save(self, spark: SparkSession) -> None:
        """Centres and codes next to the table, for opened()."""
        rows = [(name, list(x.shape), x.astype(np.float32).tobytes()) for name, x in (("centres", self.centres), ("codes", self.codes))]
        spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.parquet(f"{self.path}-model")

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(path, **{r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in spark.read.parquet(f"{path}-model").collect()})

    def lists_of(self, unit: np.ndarray) -> np.ndarray:
        return _nearest_mean(unit, self.centres)

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = (unit - self.centres[lists]).reshape(len(unit), len(self.codes), -1)
        return np.stack([_nearest_mean(rest[:, p], self.codes[p]) for p in range(len(self.codes))], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return self.centres[lists] + np.concatenate([self.codes[p][codes[:, p]] for p in range(len(self.codes))], 1)


def _unit(vectors: pa.Array) -> np.ndarray:
    x = np.array([np.asarray(v, np.float32) for v in vectors.to_pylist()], np.float32)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def vector_index(rows: DataFrame, key: str, vector: str, path: str, lists: int | None = None, pieces: int = 16, sample: int = 50_000, file_rows: int = 1_000_000, seed: int = 7) -> VectorIndex:
    """An index of all ``rows`` with a vector, stored at ``path``. Centres and codes are means of ``sample`` rows or so, taken by a hash of the key.

    The number of lists grows with the root of the rows unless given, and so many ``pieces`` at most divide the dimensions. Files hold about ``file_rows`` rows of
    one list, so a list of very many rows is many files.
    """
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("_v"))
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n))) < sample).select("_v")
    x = _unit(pa.table(some.toArrow()).column(0).combine_chunks()) if n else np.zeros((1, pieces), np.float32)
    pieces = max(p for p in range(1, pieces + 1) if x.shape[1] % p == 0)
    centres = _means(x, lists or max(1, min(1000, round(math.sqrt(n) / 2))), seed)
    rest = (x - centres[_nearest_mean(x, centres)]).reshape(len(x), pieces, -1)
    index = VectorIndex(path, centres, np.stack([_means(rest[:, p], 256, seed + p) for p in range(pieces)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(batch.column(1))
                own = index.lists_of(unit)
                code = index.encode(unit, own)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([u.tobytes() for u in unit], pa.binary())], names=["list", "key", "code", "unit"])

    found = rows.mapInArrow(run, "list int, key long, code binary, unit binary")
    salts = max(1, -(-n // file_rows))
    found.repartition("list", F.pmod(F.xxhash64("key"), F.lit(salts))).sortWithinPartitions("list", "key").write.partitionBy("list").parquet(path)
    index.save(rows.sparkSession)
    return index


def probe(index: VectorIndex, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None, refine: int | None = None) -> DataFrame:
    """query, neighbour, distance: the ``k`` nearest rows of each query, as far as codes tell; ties go to the smaller key.

    Codes of each query's ``probes`` nearest lists, by default of all, are read and compared; the ``refine`` best of them (ten times k) are the
    only rows whose vectors are compared. Lists that no query probes aren't read, and vectors are read in the lists of candidates. Where vectors
    come in clusters a few lists do; where they don't, their codes still stand for them.
    """
    spark, refine = queries.sparkSession, refine or 10 * k
    stored = spark.read.schema("key long, code binary, unit binary, list int").parquet(index.path)
    queries = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<float>").alias("_v"))
    every = probes is None or probes >= len(index.centres)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                unit, names = _unit(part.column(1)), np.asarray(part.column(0))
                if every:
                    blocks = [(-1, names, unit)]
                else:
                    near = np.argsort((index.centres * index.centres).sum(1) / 2 - unit @ index.centres.T, axis=1, kind="stable")[:, :probes]
                    blocks = [(l, names[m], unit[m]) for l in np.unique(near) if (m := (near == l).any(axis=1)).any()]
                yield pa.RecordBatch.from_arrays([pa.array([int(l) for l, *_ in blocks], pa.int32()), pa.array([n.tolist() for _, n, _ in blocks], pa.list_(pa.int64())), pa.array([u.tobytes() for *_, u in blocks], pa.binary())], names=["list", "q_keys", "q_unit"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0))
            for l in np.unique(own):
                part = batch.filter(pa.array(own == l))
                for at in range(0, part.num_rows, BLOCK):
                    piece = part.slice(at, BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array([l], pa.int32()), pa.array([piece.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(piece.column(2).to_pylist())], pa.binary())], names=["list", "r_keys", "r_code"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l, qk, qx, rk, rx in zip(*(c.to_pylist() for c in batch.columns)):
                q = np.frombuffer(qx, np.float32).reshape(len(qk), -1)
                near = index.decode(np.frombuffer(rx, np.uint8).reshape(len(rk), -1), np.full(len(rk), l))
                far = 1 - q @ near.T
                edge = np.partition(far, refine - 1, axis=1)[:, refine - 1] if refine < len(rk) else np.full(len(qk), np.inf)
                i, j = np.nonzero(far <= edge[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(qk)[i]), pa.array(np.array(rk)[j]), pa.array(far[i, j].astype(float)), pa.array(np.full(len(i), l, np.int32))], names=["query", "neighbour", "distance", "list"])

    asks = queries.mapInArrow(asked, "list int, q_keys array<long>, q_unit binary")
    codes = stored.select("list", "key", "code").mapInArrow(coded, "list int, r_keys array<long>, r_code binary")
    if every:
        pairs = asks.drop("list").crossJoin(codes)
    else:
        probed = [r["list"] for r in asks.select("list").distinct().collect()]  # of 1000 lists at most
        codes = stored.where(F.col("list").isin(probed)).select("list", "key", "code").mapInArrow(coded, "list int, r_keys array<long>, r_code binary")
        pairs = asks.join(codes, "list")
    found = pairs.select("list", "q_keys", "q_unit", "r_keys", "r_code").mapInArrow(compare, "query long, neighbour long, distance double, list int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    found = found.withColumn("_rank", rank).where(F.col("_rank") <= refine).select("query", "neighbour", "list")
    both = found.join(stored.select("list", F.col("key").alias("neighbour"), "unit"), ["list", "neighbour"]).join(queries, "query").select("query", "neighbour", "_v", "unit")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _unit(batch.column(2)).astype(float)
                r = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float32).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 - (q * r).sum(axis=1))], names=["query", "neighbour", "distance"])

    return _top(both.mapInArrow(exact, "query long, neighbour long, distance double"), k)
