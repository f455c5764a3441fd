"""As-of joins without a range join: one sort of both sides together."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, *, direction: Literal["backward", "forward"] = "backward", strict: bool = False,
    tolerance: Column | None = None, prefix: str = "r_", order: Sequence[str] = (), bucket: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Each left row with the nearest right row of its key that isn't later (backward) or earlier (forward) than it.

    strict: equal times don't match. tolerance: a condition on the columns ``left_at`` and prefix + right_at beyond which a
    match is dropped. Of right rows at one time the last in ``order`` counts. Right columns get the prefix. Both sides are
    unioned and sorted once by key and time, so that no key is joined to all its times; left rows without a match stay.
    Null keys match each other, as in a grouping; null times match nothing.

    bucket: for keys that hold a large part of all rows, a function that never falls as time grows, such as the month.
    Keys are then dealt out by bucket, too, and each bucket's last right row is carried on by a table with a row for each
    key and bucket (forward: the first one of the buckets after it).
    """
    back = direction == "backward"
    payload = [c for c in right.columns if c not in keys]
    r = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*payload).alias("_r"), F.struct(*(F.col(c) for c in order), F.lit(0)).alias("_order"))
    row = F.struct(*left.columns)
    x = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), row.alias("_l"))
    both = x.unionByName(r, allowMissingColumns=True)
    side = F.col("_side").desc() if strict else F.col("_side").asc()  # at equal times: who comes first
    at = F.col("_at").asc() if back else F.col("_at").desc()
    parts = [*keys]
    if bucket is not None:
        both = both.withColumn("_bucket", bucket(F.col("_at")))
        parts.append("_bucket")
    w = Window.partitionBy(*parts).orderBy(at, side, F.col("_order").asc()).rowsBetween(Window.unboundedPreceding, 0)
    match = F.when(F.col("_at").isNotNull(), F.last("_r", ignorenulls=True).over(w))
    both = both.withColumn("_m", match).where("_side = 1") if bucket is None else _carried(both.withColumn("_m", match), parts, back)
    out = both.select("_l.*", *(F.col(f"_m.{c}").alias(prefix + c) for c in payload))
    if tolerance is not None:
        ok = F.coalesce(tolerance, F.lit(False))
        out = out.withColumns({prefix + c: F.when(ok, F.col(prefix + c)) for c in payload if prefix + c != prefix + right_at})
        out = out.withColumn(prefix + right_at, F.when(ok, F.col(prefix + right_at)))
    return out


def _carried(both: DataFrame, parts: Sequence[str], back: bool) -> DataFrame:
    """Left rows; those without a match in their bucket get the last right row of the buckets before it, or the first of those after."""
    *keys, b = parts
    right = both.where("_side = 0").groupBy(*parts, "_at").agg(F.max_by("_r", "_order").alias("_r"))
    last = right.groupBy(*parts).agg((F.max_by if back else F.min_by)("_r", "_at").alias("_last"))
    last = both.where("_side = 1").select(*parts).distinct().unionByName(last, allowMissingColumns=True).groupBy(*parts).agg(F.first("_last", ignorenulls=True).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(F.col(b).asc() if back else F.col(b).desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).select(*(F.col(p).alias(f"_k{i}") for i, p in enumerate(parts)), "_carry")
    same = F.lit(True)
    for i, p in enumerate(parts):
        same = same & F.col(p).eqNullSafe(F.col(f"_k{i}"))
    out = both.where("_side = 1").join(last, same, "left")
    return out.withColumn("_m", F.when(F.col("_at").isNotNull(), F.coalesce("_m", "_carry")))
