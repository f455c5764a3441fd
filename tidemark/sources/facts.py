"""Facts from XML filings, paged sources as a Python data source, files by name."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FACTS = "name string, context string, value string"


def xml_facts(filings: DataFrame, key: str, xml: str) -> DataFrame:
    """key, name (without its namespace), context and value of each element with a contextRef; nothing for broken XML."""
    out = filings.select(key).withColumns({"name": F.lit(""), "context": F.lit(""), "value": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xml.etree.ElementTree as ET

        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError:
                    continue
                rows += [(k, e.tag.rpartition("}")[2].rpartition(":")[2], e.get("contextRef"), (e.text or "").strip()) for e in root.iter() if e.get("contextRef")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2, 3))], names=out.names)

    return filings.select(key, xml).mapInArrow(run, out)


def compared(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """status of each key: OK within the tolerance, DIFF beyond it, MISS where one side lacks it, NULL where a value is."""
    a = ours.select(*keys, F.col(value).alias("ours"), F.lit(True).alias("_a"))
    b = theirs.select(*keys, F.col(value).alias("theirs"), F.lit(True).alias("_b"))
    x = a.join(b, list(keys), "full")
    off = F.try_divide(F.abs(F.col("ours") - F.col("theirs")), F.abs("theirs"))
    status = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "MISS").when(F.col("ours").isNull() | F.col("theirs").isNull(), "NULL").when(F.coalesce(off < tolerance, F.col("ours") == F.col("theirs")), "OK").otherwise("DIFF")
    return x.select(*keys, status.alias("status"))


def name_parts(path: Column, names: Sequence[str]) -> list[Column]:
    """The parts of a file name between underscores, by position."""
    base = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return [F.get(F.split(base, "_"), i).alias(n) for i, n in enumerate(names)]


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and content of files: for one that only bytes describe."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def paged_items(responses: DataFrame, schema: str, page: str = "page", attempt: str = "attempt", status: str = "status", body: str = "body") -> DataFrame:
    """page, item and the fields of ``schema`` for the items of a service's pages, each asked for as often as it took.

    A page is what its last attempt with status 200 and a whole body says, {"items": [...]}; error answers and bodies that end early
    count as nothing. Pages that no attempt has brought give no rows: see missing_pages().
    """
    whole = f"items array<struct<{schema}>>, _broken string"
    x = responses.where(F.col(status) == 200).withColumn("_b", F.from_json(body, whole, {"columnNameOfCorruptRecord": "_broken"})).where("_b._broken is null and _b.items is not null")
    last = x.groupBy(page).agg(F.max_by("_b", attempt).alias("_b"))
    return last.select(page, F.posexplode("_b.items").alias("item", "_i")).select(page, "item", "_i.*")


def missing_pages(responses: DataFrame, schema: str, page: str = "page", **names: str) -> DataFrame:
    """Pages that were asked for and have no items."""
    return responses.select(page).distinct().join(paged_items(responses, schema, page, **names).select(page).distinct(), page, "left_anti")
