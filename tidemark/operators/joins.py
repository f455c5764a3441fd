"""Joins that aren't plain equi-joins, and set operations that say where a row comes from."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .asof import asof_join

Names = Sequence[str]
#: Items of a part of a group whose pairs are made, and pairs of a task, about.
PART, TASK_PAIRS = 256, 1 << 24


def prioritised(primary: DataFrame, fallback: DataFrame, keys: Names, only_fallback: Names = ()) -> DataFrame:
    """Full outer join by ``keys``: primary's values come first; columns in ``only_fallback`` are filled from fallback too.

    With ``only_fallback`` other columns of fallback never fill a gap.
    """
    fill = set(only_fallback)
    p = primary.select(*keys, *(F.col(c).alias(f"_p_{c}") for c in primary.columns if c not in keys))
    f = fallback.select(*keys, *(F.col(c).alias(f"_f_{c}") for c in fallback.columns if c not in keys))
    values = [c for c in primary.columns if c not in keys]
    pick = lambda c: F.coalesce(f"_p_{c}", f"_f_{c}") if not fill or c in fill else F.col(f"_p_{c}")
    return p.join(f, list(keys), "full").select(*keys, *(pick(c).alias(c) for c in values))


def window_join(events: DataFrame, panel: DataFrame, keys: Names, event_at: str, panel_at: str, before: int, after: int) -> DataFrame:
    """Panel rows within ``before`` and ``after`` days of an event of their key.

    Events are spread over their days, so that it is an equi-join: for narrow windows, some fifteen days or so.
    """
    spread = events.withColumn("_day", F.explode(F.sequence(F.date_sub(event_at, before), F.date_add(event_at, after))))
    other = panel.withColumn("_day", F.col(panel_at))
    return spread.join(other, [*keys, "_day"]).drop("_day")


def _met(items: DataFrame, group: Names, item: str, *kinds: str) -> DataFrame:
    """x, an item, and _y, items of its group that are alike in ``kinds`` (x_ and y_ before their names): each two items of a group meet once, in either order.

    A group's pairs are cut into cells of PART items by PART times as many or fewer, which are dealt into tasks by the number of pairs, not by bytes.
    """
    n = items.groupBy(*group).agg(F.count("*").alias("_n"))
    pairs = n.agg(F.sum(F.col("_n").cast("double") * F.col("_n"))).first()[0] or 0
    tasks = max(items.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / TASK_PAIRS))
    x = items.join(n, list(group)).withColumns({"_rows": F.ceil(F.col("_n") / PART), "_columns": F.ceil(F.col("_n") / PART / PART)})
    x = x.withColumn("_part", F.pmod(F.xxhash64(item), "_rows"))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    keys = [*group, "_row", "_column"]
    a = x.select(*group, F.col("_part").alias("_row"), each("_columns").alias("_column"), F.col(item).alias("x"), *(F.col(k).alias(f"x_{k}") for k in kinds))
    b = x.groupBy(*group, *kinds, "_rows", "_columns", "_part").agg(F.collect_list(item).alias("_y"))
    b = b.select(*group, each("_rows").alias("_row"), F.pmod("_part", "_columns").alias("_column"), "_y", *(F.col(k).alias(f"y_{k}") for k in kinds))
    return a.repartition(tasks, *keys).join(b.repartition(tasks, *keys), keys)


def group_pairs(df: DataFrame, group: Names, item: str) -> DataFrame:
    """a < b for each two items of a group; a task has a bounded number of pairs or so, whatever the groups' sizes."""
    met = _met(df.select(*group, item).distinct(), group, item)
    return met.select(*group, F.col("x").alias("a"), F.explode("_y").alias("b")).where("a < b")


def nearest_two_sides(events: DataFrame, panel: DataFrame, key: str, event_at: str, at: str, k: int) -> DataFrame:
    """key, event_at, side, k, at: the ``k`` nearest times of the event's key before it (PREV) and after it (AFTER).

    Each panel row brings the k - 1 times next to it along, so one as-of join for each side finds all: an event is never
    joined to all rows of its key.
    """
    out = None
    for side, direction, near in (("PREV", "backward", F.lag), ("AFTER", "forward", F.lead)):
        times = F.array(F.col(at), *(near(at, i).over(Window.partitionBy(key).orderBy(at)) for i in range(1, k)))
        found = asof_join(events, panel.select(key, at, times.alias("_times")), [key], event_at, at, direction=direction, strict=True)
        one = found.select(key, event_at, F.lit(side).alias("side"), F.posexplode("r__times").alias("k", at)).where(F.col(at).isNotNull()).withColumn("k", F.col("k") + 1)
        out = one if out is None else out.unionByName(one)
    return out


def leader_pairs(df: DataFrame, group: Names, item: str) -> DataFrame:
    """leader, follower, kind: each group's least item leads the others (direct); those are pairs of siblings.

    Siblings that are a direct pair elsewhere are left out, and so are items without a group. The pairs of a group are the square of its items;
    parts of it are paired in tasks of their own, and they aren't shuffled unless both items are in several groups.
    """
    items = df.select(*group, F.col(item).alias("follower")).dropna(subset=list(group)).distinct()
    direct = items.withColumn("leader", F.min("follower").over(Window.partitionBy(*group))).where("leader <> follower")
    many = items.groupBy("follower").agg((F.count("*") > 1).alias("many"))
    marked = direct.join(many, "follower").select(*group, "follower", "many")
    met = _met(marked, group, "follower", "many").where("not (x_many and y_many)")
    once = met.select(F.col("x").alias("leader"), F.explode("_y").alias("follower")).where("leader <> follower")
    direct = direct.select("leader", "follower").distinct()
    again = group_pairs(marked.where("many"), group, "follower").select(F.inline(F.array(F.struct(F.col("a").alias("leader"), F.col("b").alias("follower")), F.struct(F.col("b").alias("leader"), F.col("a").alias("follower")))))
    again = again.distinct()  # only two items of several groups each meet in another group
    siblings = once.unionByName(again.join(direct, ["leader", "follower"], "left_anti"))
    return direct.withColumn("kind", F.lit("direct")).unionByName(siblings.withColumn("kind", F.lit("sibling")))


def provenance(a: DataFrame, b: DataFrame, keys: Names, names: tuple[str, str, str]) -> DataFrame:
    """Full outer join with hit_type: ``names`` for rows in both, only in a, only in b."""
    x, y = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    kind = F.when(F.col("_a") & F.col("_b"), names[0]).when(F.col("_a"), names[1]).otherwise(names[2])
    return x.join(y, list(keys), "full").withColumn("hit_type", kind).drop("_a", "_b")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / the longer length, 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def fuzzy_match(left: DataFrame, right: DataFrame, name: str, target: str, block: Column, other_block: Column, least: float) -> DataFrame:
    """Each left row with the best right row: an equal normalised name, whatever its block, else the most similar one of its block
    from ``least`` on.

    Both are equi-joins; of equal names the smallest target counts. Rows without a match have nulls, and names without a
    letter or digit match nothing exactly.
    """
    clean = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    x = left.withColumns({"_block": block, "_name": clean(F.col(name))})
    y = right.select(F.col(target), clean(F.col(target)).alias("_target"), other_block.alias("_block"))
    exact = x.where(F.col("_name") != "").join(y.drop("_block"), F.col("_name") == F.col("_target")).groupBy(name).agg(F.min(target).alias("match")).withColumn("score", F.lit(1.0))
    scored = x.join(exact.select(name), name, "left_anti").join(y, "_block").withColumn("score", similarity(F.col("_name"), F.col("_target"))).where(F.col("score") >= least)
    best = scored.groupBy(name).agg(F.max_by(target, F.struct("score", F.expr(f"-xxhash64({target})"))).alias("match"), F.max("score").alias("score"))
    return left.join(best.unionByName(exact), name, "left")


#: The first value of a type that times may have.
_FIRST = {"date": "0001-01-01", "timestamp": "0001-01-01", "timestamp_ntz": "0001-01-01", "double": "-Infinity", "float": "-Infinity", "bigint": str(-(2**63)), "int": str(-(2**31))}


def _interval_states(intervals: DataFrame, key: str, lo: str, hi: str, value: str) -> DataFrame:
    """key, _t, _on and _past_: what holds at each time at which an interval starts or ends, and what holds after it until the next.

    Each state has held (value and end of the interval that holds), gone (the last one that has ended) and next (the first one to start).
    In the order of their starts, an interval has the times that none before it has, which begin after the latest end before
    it; so those pieces don't overlap, and a running maximum finds them.
    """
    x = intervals.select(F.col(key).alias("_key"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.struct(F.col(value).alias("v")).alias("_v")).where(F.col("_lo") <= F.col("_hi"))
    by_start = Window.partitionBy("_key").orderBy("_lo", "_v")
    before = F.max("_hi").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_before", before)
    later = F.col("_before") >= F.col("_lo")  # its piece begins after that end
    piece = F.when(F.col("_before").isNull() | (F.col("_hi") > F.col("_before")), F.struct("_v", F.col("_hi").alias("end")))
    kind = dict(x.dtypes)["_lo"]
    none = lambda c: F.lit(None).cast(x.withColumn("_p", piece).schema["_p" if c == "held" else "_v"].dataType)
    row = lambda t, on=None, past=None, gone=None, start=None: F.struct(t.alias("_t"), (none("held") if on is None else on).alias("on"), (none("held") if past is None else past).alias("past"), (F.lit(None).cast(x.select(F.struct("_lo", "_v").alias("s")).schema["s"].dataType) if gone is None else gone).alias("gone"), (none("next") if start is None else start).alias("start"))
    happens = [
        row(F.lit(_FIRST[kind]).cast(kind)),
        row(F.col("_lo"), on=F.when(~F.coalesce(later, F.lit(False)), piece), start=F.col("_v")),
        row(F.when(later, F.col("_before")).otherwise(F.col("_lo")), past=F.when(later, piece)),
        row(F.col("_hi"), gone=F.struct("_lo", "_v")),
    ]
    at = x.select("_key", F.inline(F.array(*happens))).groupBy("_key", "_t").agg(F.max("on").alias("on"), F.max("past").alias("past"), F.min("gone").alias("gone"), F.min("start").alias("start"))
    up, down = Window.partitionBy("_key").orderBy("_t"), Window.partitionBy("_key").orderBy(F.col("_t").desc())
    earlier, so_far = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    latest = F.coalesce("past", "on")
    following = last("start", down.rowsBetween(Window.unboundedPreceding, -1))
    state = lambda held, gone: F.struct(held.alias("held"), gone["_v"].alias("gone"), following.alias("next"))
    return at.select(F.col("_key").alias(key), "_t", state(F.coalesce("on", last(latest, earlier)), last("gone", earlier)).alias("_on"), state(last(latest, so_far), last("gone", so_far)).alias("_past"))


def nearest_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, lo: str, hi: str, value: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """``points`` with ``value`` of the interval that holds ``at``, else of the last one that ended before, else of the first one to start, and
    match_kind: 0, 1, 2, or null for a key without intervals.

    Of intervals that hold a point the one with the earliest start counts; of equal ends the one with the earlier start, and of
    equal starts the smallest value. States between starts and ends come from sorts of the intervals alone, and a point gets its
    state by one as-of join, so the work grows with points and intervals, not with their products; ``bucket`` deals out hot keys
    as in asof_join(). Intervals that end before they start, or lack an end, don't count; null times match nothing.
    """
    states = _interval_states(intervals, key, lo, hi, value).withColumnRenamed("_t", "t").withColumnsRenamed({"_on": "on", "_past": "past"})
    x = asof_join(points.select(F.col(key), F.struct(*points.columns).alias("_row"), F.col(at).alias("_at_")), states, [key], "_at_", "t", prefix="_s_", bucket=bucket)
    state = lambda part: F.when(F.col("_s_t") == F.col("_at_"), F.col(f"_s_on.{part}")).otherwise(F.col(f"_s_past.{part}"))
    held, gone, following = state("held"), state("gone"), state("next")
    holds = F.coalesce(F.col("_at_") <= held["end"], F.lit(False))
    found = F.when(holds, held["_v"]).otherwise(F.coalesce(gone, following))
    kind = F.when(holds, 0).when(gone.isNotNull(), 1).when(following.isNotNull(), 2)
    kept = [F.col(f"_row.{c}").alias(c) for c in points.columns if c not in (value, "match_kind")]
    return x.select(*kept, found["v"].alias(value), kind.alias("match_kind"))
