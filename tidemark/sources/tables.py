"""Tables in and out: typed reads, fallbacks, upserts, replaced partitions, audits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; only a session on this machine alone may lack one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or f'file://{tempfile.gettempdir()}/tidemark').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what follows reads it as often as it likes, and so does a lost executor's successor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, columns: dict[str, tuple[str, str]], encoding: str = "UTF-8", undisclosed: str = "*****") -> DataFrame:
    """A CSV with a header: ``columns`` maps its names to (name, type). What isn't of the type, as the mark of undisclosed
    figures, is null. Charsets beyond the few that Spark allows by default, such as MS932, need its setting for the JVM's."""
    if not encoding.upper().startswith(("UTF", "ISO-8859-1", "US-ASCII")):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    raw = spark.read.option("header", "true").option("encoding", encoding).csv(path)
    return raw.select(*(F.nullif(F.trim(f"`{old}`"), F.lit(undisclosed)).try_cast(kind).alias(new) for old, (new, kind) in columns.items()))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def first_nonempty(*sources: DataFrame) -> DataFrame:
    """The first of the sources that has a row, else the last."""
    return next((s for s in sources[:-1] if not s.isEmpty()), sources[-1])


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary's rows, and fallback's for keys that it doesn't have."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def matched(a: str, b: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with the changes' rows in place of those of equal keys (null equals null), and new ones added; none deleted."""
    return target.alias("t").join(changes.alias("c"), matched("t", "c", keys), "left_anti").unionByName(changes, allowMissingColumns=True)


def replaced(target: DataFrame, changes: DataFrame, keys: Sequence[str], where: Column) -> DataFrame:
    """The target without the rows ``where`` holds or whose key changes, and the changes' rows."""
    return upsert(target.where(~F.coalesce(where, F.lit(False))), changes, keys)


def update_from(target: DataFrame, values: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The target with ``columns`` set from ``values`` where its key is there; other rows keep theirs."""
    v = values.select(*keys, *(F.col(c).alias(f"_v_{c}") for c in columns), F.lit(True).alias("_hit"))
    x = target.join(v, list(keys), "left")
    return x.select(*(F.when(F.col("_hit"), F.col(f"_v_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def write_days(df: DataFrame, path: str, by: str, clustered: Sequence[str]) -> None:
    """Replace the partitions that ``df`` has rows of, and only those; rows are sorted within files for pruning."""
    df.repartition(by).sortWithinPartitions(by, *clustered).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_clustered(df: DataFrame, name: str, path: str, buckets: int, key: str) -> DataFrame:
    """A table in buckets by ``key``: joins and groupings by it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
