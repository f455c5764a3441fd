"""Point-in-time consensus and statements: revisions, standalone quarters, expectations, surprises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import change, clip, ratio
from .joins import prioritised
from .windows import latest_by, over


def consensus_merged(snapshots: DataFrame, keys: Sequence[str], at: str, source: str, primary: str, secondary: str, measures: Sequence[str], filled: Sequence[str], tie: Sequence[Column], as_of: Column | None = None) -> DataFrame:
    """The latest snapshot of each key and source, up to ``as_of``; the second source fills the measures in ``filled`` only."""
    if as_of is not None:
        snapshots = snapshots.where(F.col(at) <= as_of)
    latest = latest_by(snapshots.where(F.col(source).isin(primary, secondary)), [*keys, source], [F.col(at).desc(), *tie])
    side = lambda s: latest.where(F.col(source) == s).select(*keys, at, *measures)
    return prioritised(side(primary), side(secondary), keys, [at, *filled])


def standalone_quarters(statements: DataFrame, keys: Sequence[str], year: str, quarter: str, revised: Sequence[Column], measures: Sequence[str]) -> DataFrame:
    """Quarter values from sums within the fiscal year: the latest revision of each, less the one of the quarter before.

    A missing or null quarter before counts as 0. The year's sum, FY, becomes 4Q.
    """
    latest = latest_by(statements, [*keys, year, quarter], revised)
    number = F.when(F.col(quarter) == "FY", 4).otherwise(F.substring(quarter, 1, 1).cast("int"))
    w = over([*keys, year], [F.col("_q")])
    out = latest.withColumn("_q", number)
    out = out.withColumns({m: F.col(m) - F.coalesce(F.lag(m).over(w), F.lit(0)) for m in measures})
    return out.withColumn(quarter, F.concat(F.col("_q").cast("string"), F.lit("Q"))).drop("_q")


def growth_features(quarters: DataFrame, keys: Sequence[str], year: str, quarter: str, measure: str, bound: float = 5.0) -> DataFrame:
    """yoy against the same quarter of the last earlier year, qoq against the quarter before, turnaround (now > 0, then < 0)."""
    year_ago = F.lag(measure).over(over([*keys, quarter], [year]))
    before = F.lag(measure).over(over([*keys], [year, quarter]))
    out = quarters.withColumns({"yoy": change(F.col(measure), year_ago, bound), "qoq": change(F.col(measure), before, bound), "_ago": year_ago})
    return out.withColumn("turnaround", F.coalesce((F.col(measure) > 0) & (F.col("_ago") < 0), F.lit(False))).drop("_ago")


def surprise(actual: Column, forecast: Column, done: Column, quarters_left: Column, bound: float = 5.0) -> tuple[Column, Column]:
    """Progress of the year (done / forecast), and the quarter against the even share of what was left of the forecast."""
    implied = ratio(forecast - done, quarters_left)
    return ratio(done, forecast), clip(ratio(actual - implied, F.abs(implied)), -bound, bound)


def announcement_calendar(planned: DataFrame, actual: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Planned (S) and actual (A) announcements as one table, numbered by revision within key and kind."""
    both = planned.select(*keys, at, F.lit("S").alias("record_type")).unionByName(actual.select(*keys, at, F.lit("A").alias("record_type"))).distinct()
    return both.withColumn("revision", F.row_number().over(over([*keys, "record_type"], [at])))


def first_flag(df: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, out: str) -> DataFrame:
    """Whether a mark of the key lies on or before the row's date."""
    first = marks.groupBy(*keys).agg(F.min(at).alias("_first"))
    return df.join(first, list(keys), "left").withColumn(out, F.coalesce(F.col("_first") <= F.col(at), F.lit(False))).drop("_first")
