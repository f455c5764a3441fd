"""Trading calendars: dates with their number, and shifts by trading days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .asof import asof_join


def trading_calendar(dates: DataFrame, at: str) -> DataFrame:
    """d and its number, from 1. A calendar has some thousand rows, whatever the panel has; it alone is sorted as a whole."""
    return dates.select(F.col(at).alias("d")).where("d is not null").distinct().withColumn("n", F.row_number().over(Window.orderBy("d")))


def shift_days(df: DataFrame, calendar: DataFrame, at: str, by: int, out: str) -> DataFrame:
    """The trading day ``by`` days after ``at`` (before, if negative); null outside the calendar or if ``at`` isn't in it."""
    here = F.broadcast(calendar.select(F.col("d").alias(at), (F.col("n") + by).alias("_n")))
    there = F.broadcast(calendar.select(F.col("n").alias("_n"), F.col("d").alias(out)))
    return df.join(here, at, "left").join(there, "_n", "left").drop("_n")


def on_or_before(df: DataFrame, calendar: DataFrame, at: str, out: str) -> DataFrame:
    """The last trading day that isn't after ``at``."""
    c = calendar.select(F.lit(1).alias("_k"), F.col("d"))
    days = df.select(F.lit(1).alias("_k"), F.to_date(at).alias("_day")).distinct()  # a row for each day, so that one task may hold them
    found = asof_join(days, c, ["_k"], "_day", "d", prefix="_c_").select("_day", F.col("_c_d").alias(out))
    return df.withColumn("_day", F.to_date(at)).join(F.broadcast(found), "_day", "left").drop("_day")


def in_session(at: Column) -> Column:
    """Before the close: 15:00 until 2024-11-04, 15:30 from 2024-11-05 on."""
    minute = F.hour(at) * 60 + F.minute(at)
    return minute < F.when(F.to_date(at) < F.lit("2024-11-05").cast("date"), 15 * 60).otherwise(15 * 60 + 30)


def fiscal_roll(year: Column, quarter: Column) -> tuple[Column, Column]:
    """The period after a disclosure: FY is followed by 1Q of the next year, 3Q by FY."""
    after = F.when(quarter == "FY", "1Q").when(quarter == "1Q", "2Q").when(quarter == "2Q", "3Q").when(quarter == "3Q", "FY")
    return F.when(quarter == "FY", year + 1).otherwise(year), after


def era_year(text: Column) -> Column:
    """Western year of a Japanese era date such as R6, H30 or S64 in front of a text; null if there is none."""
    era = F.regexp_extract(text, r"^([RHS])(\d+)", 1)
    n = F.regexp_extract(text, r"^([RHS])(\d+)", 2).try_cast("int")
    return F.when(era == "R", n + 2018).when(era == "H", n + 1988).when(era == "S", n + 1925)


def month_of(published: Column) -> Column:
    """The month that a monthly figure is about: up to the 15th it is the month before, then this one."""
    return F.trunc(F.when(F.dayofmonth(published) <= 15, F.add_months(published, -1)).otherwise(published), "month")
