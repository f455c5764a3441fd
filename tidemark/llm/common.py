"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: The words of a text: runs of anything but ASCII white space. bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """How many words a text has: each is replaced by one letter, and white space goes. No array of words is made."""
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[\x20\x09-\x0D]+", "")).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on this machine alone may lack it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = getattr(spark, "_tidemark_dir", None)
        if where is None:
            where = spark._tidemark_dir = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and a lost executor costs nothing but a reread."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete what written() wrote for ``df``; nothing that is still to run may read it."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Rows of one key from which on it is joined by a broadcast: of n rows, at most n / HOT_ROWS keys are.
HOT_ROWS = 100_000


def joined(rows: DataFrame, named: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` inner joined to ``named``, which has each ``key`` once and with it ``n``, how many of ``rows`` have it.

    A key of many rows isn't dealt to one task: such keys, of which there are few, are broadcast, and only others shuffled.
    """
    hot = F.broadcast(named.where(F.col(n) > HOT_ROWS).drop(n))
    rest = rows.join(hot.select(key), key, "left_anti").join(named.where(F.col(n) <= HOT_ROWS).drop(n), key)
    return rows.join(hot, key).unionByName(rest)


def hashed_share(df: DataFrame, key: str, rows: int, of: int) -> DataFrame:
    """About ``rows`` of the ``of`` rows of ``df``, by a hash of ``key``: a filter, so nothing is sorted or sent for the others."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(min(1.0, rows / max(1, of)) * (1 << 40)))


def running_totals(df: DataFrame, at: str, values: list[str], width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """df with before_v for each v of ``values``: its sum over the rows of ``by`` with a smaller ``at``, which is from 0 to about width ** 2.

    Rows are dealt out by ``width`` neighbours, and only the sums of those, ``width`` rows for each of ``by``, are in one window.
    """
    near, none = F.floor(F.col(at) / width), (Window.unboundedPreceding, -1)
    df = df.withColumn("_near", near)
    sums = df.groupBy(*by, "_near").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    w = Window.partitionBy(*by).orderBy("_near").rowsBetween(*none)
    sums = sums.select(*by, "_near", *(F.coalesce(F.sum(f"_{v}").over(w), F.lit(0)).alias(f"_{v}") for v in values))
    own = Window.partitionBy(*by, "_near").orderBy(at).rowsBetween(*none)
    df = df.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values}).join(sums, [*by, "_near"])
    return df.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"_{v}") for v in values}).drop("_near", *(f"_{v}" for v in values))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascending(x: np.ndarray) -> np.ndarray:
    """The different values of ``x``, sorted: numpy's unique() goes through a hash table, which takes many times as long."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


#: Bytes and rows of a batch that goes to a Python worker: batches are held on both sides, and texts can be long.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


def batched(df: DataFrame) -> DataFrame:
    """``df``, for a Python step. Spark reads the sizes of its batches from the session when a plan runs, so they are set there,
    unless the session has sizes of its own: those stay."""
    conf = df.sparkSession.conf
    own = conf.getAll
    for name, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        if name not in own:
            conf.set(name, str(value))
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
