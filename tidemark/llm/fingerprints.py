"""Canonical exact digests of documents, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table, written

#: Flagged keys up to this count (pairs of longs, 32 MB) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: The key of rows without an id.
NO_ID = -(2**63)


def canonical(text: Column) -> Column:
    """NFKC, full case folding, runs of white space to one space, trimmed. Null counts as empty.

    ASCII texts, told by their byte count, take the short way with the same result.
    """
    icu = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(icu(fold(icu(text))))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(text: Column) -> Column:
    """128 bits: two xxhash64 with different seeds, as 32 hex digits."""
    part = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(part(text), part(F.lit(1), text))


def _suffixes(canon: DataFrame, key: list[str]) -> DataFrame:
    """key columns and suffix, for the rows (key, h, canon) whose hash stands for more than one byte string."""
    bad = canon.groupBy("h").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi").select("h")
    ranks = canon.join(bad, "h", "left_semi").groupBy("h", "canon").agg(F.lit(1).alias("one"))
    ranks = ranks.withColumn("suffix", F.concat(F.lit("-"), F.row_number().over(Window.partitionBy("h").orderBy("canon"))))
    return canon.join(ranks, ["h", "canon"]).select(*key, "suffix")


def following(docs: DataFrame) -> DataFrame:
    """key, n, next_key, prev_key, prev_n for each distinct id, ascending; after the last comes the first.

    Only ids and lengths are shuffled: ranges of ids are numbered inside, and what stands at their ends is joined from a
    table with a row for each range.
    """
    ids = docs.groupBy("key").agg(F.max("n").alias("n"))
    ids = written(ids.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ids")
    ends = ids.groupBy("part").agg(F.min("key").alias("first_key"), F.max(F.struct("key", "n")).alias("last"))
    round_ = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first_key").over(round_), F.first("first_key").over(whole)).alias("after"), F.coalesce(F.lag("last").over(round_), F.last("last").over(whole)).alias("before"))
    w = Window.partitionBy("part").orderBy("key")
    near = ids.select("part", "key", "n", F.lead("key").over(w).alias("next_key"), F.lag(F.struct("key", "n")).over(w).alias("prev"))
    near = near.join(F.broadcast(ends), "part").withColumn("prev", F.coalesce("prev", "before"))  # a row for each range
    return near.select("key", F.coalesce("next_key", "after").alias("next_key"), F.col("prev.key").alias("prev_key"), F.col("prev.n").alias("prev_n"))


def edited(docs: DataFrame, near: DataFrame) -> DataFrame:
    """docs with edited: the last quarter of each text replaced by the start of the next one.

    ``docs``: key, text. The text crosses the network once, as both joins read one exchange, and of the next text only as
    much as is used.
    """
    here = docs.join(near.hint("merge"), "key")
    starts = here.groupBy(F.col("prev_key").alias("key")).agg(F.min_by(F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")), F.xxhash64("text")).alias("start"))
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    return docs.join(starts.hint("merge"), "key", "left").withColumn("edited", F.concat(F.substring("text", F.lit(1), n - q), F.coalesce(F.substring("start", F.lit(1), q), F.lit(""))))


def fingerprint_report(docs: DataFrame, hashed: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is the wide hash of the canonical text; where one hash stands for different canonical bytes, their rank
    is appended, so that equal fingerprints mean equal bytes. Likeness is 1 for equal fingerprints and else 0, as an exact
    digest knows nothing between. Null text: empty. Repeated ids: each row keeps its own, and as a neighbour that one counts
    whose text hashes least. A null id sorts first. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    near = written(following(docs.select("key", F.length("text").alias("n"))), "following")
    both = edited(docs, near).select("key", F.length("text").alias("n"), F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("edited_canon"), F.xxhash64("text").alias("t"))
    found = written(both.select("key", "n", "edited_sha256", "t", hashed(F.col("canon")).alias("h"), hashed(F.col("edited_canon")).alias("eh")), "digests")

    sides = found.select("key", "t", F.explode(F.array(F.struct(F.lit(False).alias("edit"), F.col("h").alias("h")), F.struct(F.lit(True).alias("edit"), F.col("eh").alias("h")))).alias("s")).select("key", "t", "s.*")
    shared = sides.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1").select("h")
    shared = written(sides.join(shared, "h", "left_semi"), "shared")  # rows of buckets with more than one member
    if not (bad := _unequal(docs, near, shared, hashed)).isEmpty():
        found = found.join(bad.where("not edit").select("key", "t", F.col("suffix").alias("s")), ["key", "t"], "left").join(bad.where("edit").select("key", "t", F.col("suffix").alias("es")), ["key", "t"], "left")
        found = found.withColumns({"h": F.concat("h", F.coalesce("s", F.lit(""))), "eh": F.concat("eh", F.coalesce("es", F.lit("")))})
    after = near.select("key", "next_key").join(found.groupBy(F.col("key").alias("next_key")).agg(F.min_by("h", "t").alias("nh")), "next_key")
    like = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return found.join(after.select("key", "nh"), "key").select(F.nullif("key", F.lit(NO_ID)).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", F.col("h").alias("fingerprint"), F.col("eh").alias("edited_fingerprint"), like("h", "eh").alias("near_edited"), like("h", "nh").alias("near_next"))


def _unequal(docs: DataFrame, near: DataFrame, shared: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """key, t, edit, suffix of the rows in ``shared`` whose bucket holds different canonical bytes: compared byte by byte."""
    few = shared.count() <= BROADCAST_KEYS
    small = F.broadcast if few else lambda df: df
    edits = shared.where("edit").select("key").distinct()
    wanted = shared.select("key").union(near.join(small(edits), "key", "left_semi").select(F.col("next_key").alias("key"))).distinct()
    some = docs.join(small(wanted), "key", "left_semi").withColumn("t", F.xxhash64("text"))
    plain = some.join(small(shared.where("not edit").select("key", "t").distinct()), ["key", "t"]).select("key", "t", F.lit(False).alias("edit"), canonical(F.col("text")).alias("canon"))
    changed = edited(some, near).join(small(shared.where("edit").select("key", "t").distinct()), ["key", "t"]).select("key", "t", F.lit(True).alias("edit"), canonical(F.col("edited")).alias("canon"))
    canon = plain.unionByName(changed).withColumn("h", hashed(F.col("canon")))
    bad = written(canon.groupBy("h").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi").select("h"), "unequal")
    if bad.isEmpty():
        return canon.select("key", "t", "edit", F.lit("").alias("suffix")).limit(0)
    return written(_suffixes(canon.join(bad, "h", "left_semi"), ["key", "t", "edit"]).distinct(), "suffixes")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text: empty. Repeated ids: each row keeps its own, and as a neighbour that one counts whose text hashes least. A
    null id sorts first. A single document is its own neighbour; an empty table gives no rows; other columns are ignored."""
    return fingerprint_report(table(spark, sf_dir, "documents"))
