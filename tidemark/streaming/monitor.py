"""A monitor of disclosures: dedup, enrichment, windows, sessions, ranked results; each runs as a stream and as a batch."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

log = logging.getLogger(__name__)

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the parquet files in ``folder``."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """First of each event_id; ids are forgotten ``delay`` after their time, so state is bounded."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def enriched(events: DataFrame, names: DataFrame) -> DataFrame:
    """Events with the dimension's columns: a stream-static join."""
    return events.join(names, "user_id", "left")


def tumbling(events: DataFrame, size: str = "1 day", delay: str | None = None) -> DataFrame:
    """n and total by event_type and window; with ``delay``, late events up to it are waited for and windows are forgotten then.

    Without it no window is ever closed: for batches, and streams that end.
    """
    x = events.withWatermark("ts", delay) if delay else events
    return x.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", delay: str | None = None) -> DataFrame:
    """n by event_type and overlapping window; ``delay`` as in tumbling()."""
    x = events.withWatermark("ts", delay) if delay else events
    return x.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def bursts(events: DataFrame, gap: str = "6 hours", delay: str | None = None) -> DataFrame:
    """Sessions of a user: events with gaps under ``gap``; ``delay`` as in tumbling()."""
    x = events.withWatermark("ts", delay) if delay else events
    return x.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def running_totals(events: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """user_id, n and total so far after each batch, kept in state by user; a user without events for ``quiet_ms`` is forgotten
    and starts anew, so that state is bounded by the users of that time. Without ``quiet_ms`` it is a plain aggregation, whose state is the same."""
    if not quiet_ms:
        return events.groupBy("user_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.nanvl(F.col("value").cast("double"), F.lit(0.0))), F.lit(0.0)).alias("total"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        state.setTimeoutDuration(quiet_ms)
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def matched_within(left: DataFrame, right: DataFrame, minutes: int, delay: str = "1 day") -> DataFrame:
    """Stream-stream join: right events of the same user up to ``minutes`` after a left one."""
    a = left.withWatermark("ts", delay).select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = right.withWatermark("ts", delay).select(F.col("user_id").alias("_u"), F.col("event_id").alias("second_id"), F.col("ts").alias("second_ts"))
    return a.join(b, F.expr(f"user_id = _u AND second_ts > first_ts AND second_ts <= first_ts + INTERVAL {minutes} MINUTES")).drop("_u")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there, then stop: catching up, and starting again after a failure, are the same call."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_retrying(job: Callable[[], None], tries: int = 5, wait: float = 1.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run ``job``, which goes on where it stopped, until it ends well; returns how often it failed. After each error it waits, twice
    as long as before up to ``longest`` seconds, as sources that refuse too many calls ask for; the last error is raised."""
    for failed in range(tries):
        try:
            job()
            return failed
        except Exception:
            log.warning("run %d of %d failed", failed + 1, tries, exc_info=True)
            if failed + 1 == tries:
                raise
            sleep(min(wait * 2**failed, longest))
    return tries


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def keyed_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink in which a batch that comes again replaces itself: at least once becomes exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
