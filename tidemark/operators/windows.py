"""Windows over panels: rolling and cross-sectional statistics, streaks, fills, revisions.

Rows of a panel are told apart by ``keys`` and ordered by ``order``; each operator is one shuffle by ``keys`` at most, and
none if the input is dealt out by them already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

Names = Sequence[str]


def over(keys: Names, order: Sequence[str | Column] = (), rows: tuple[int, int] | None = None) -> WindowSpec:
    w = Window.partitionBy(*keys)
    if order:
        w = w.orderBy(*order)
    return w.rowsBetween(*rows) if rows else w


def rolling(agg: Column, counted: Column, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    """``agg`` over the last n rows, null until ``counted`` has min_periods (n by default) non-null values there."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(counted).over(frame) >= (n if min_periods is None else min_periods), agg.over(frame))


def rolling_rank(value: str, w: WindowSpec, n: int) -> Column:
    """Percentile rank of the current value among the last n, ties averaged; null until there are n non-null values."""
    frame, x = w.rowsBetween(1 - n, 0), F.col(value)
    held = F.collect_list(x).over(frame)
    less, equal = F.size(F.filter(held, lambda v: v < x)), F.size(F.filter(held, lambda v: v == x))
    return F.when((F.count(x).over(frame) >= n) & x.isNotNull(), (less + (equal + 1) / 2) / F.count(x).over(frame))


def rolling_median(value: str, w: WindowSpec, n: int) -> Column:
    """Median of the last n values; null until all are there."""
    frame = w.rowsBetween(1 - n, 0)
    held = F.array_sort(F.collect_list(F.col(value)).over(frame))
    return F.when(F.count(value).over(frame) >= n, (F.element_at(held, F.lit((n + 1) // 2)) + F.element_at(held, F.lit(n // 2 + 1))) / 2)


def cross_rank(df: DataFrame, by: Names, value: str, out: str, least: int = 1) -> DataFrame:
    """Percentile rank of ``value`` among the rows of ``by``, ties averaged, nulls left out; null under ``least`` values."""
    x = df.withColumn("_rank", F.rank().over(over(by, [value]))).withColumn("_ties", F.count(value).over(over([*by, value])))  # one sort serves all
    x = x.withColumns({"_n": F.count(value).over(over(by)), "_all": F.count("*").over(over(by))})
    rank = F.col("_rank") - (F.col("_all") - F.col("_n")) + (F.col("_ties") - 1) / 2  # nulls come first
    return x.withColumn(out, F.when(F.col(value).isNotNull() & (F.col("_n") >= least), rank / F.col("_n"))).drop("_rank", "_ties", "_n", "_all")


#: Pieces that a group's values are cut into by spread_rank() and exact_quantiles().
PIECES = 200


def pieces(df: DataFrame, by: Names, value: str, *more: str) -> DataFrame:
    """df with _piece, which grows with ``value``: how many of the group's approximate quantiles are less. Null without a value.
    ``more`` columns get _piece1 and so on by the same reading."""
    values = [value, *more]
    edges = df.groupBy(*by).agg(*(F.percentile_approx(v, [k / PIECES for k in range(1, PIECES)], 10_000).alias(f"_edges{i}") for i, v in enumerate(values)))
    x = df.join(F.broadcast(edges), list(by)) if by else df.crossJoin(F.broadcast(edges))  # a row for each group, of which there are few
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(PIECES.bit_length()))))  # halves: a comparison for each doubling of PIECES, not one for each edge
    for i, v in enumerate(values):
        edges, held = F.col(f"_edges{i}"), F.col(v)
        less = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(edges, at + step - 1) < held, step).otherwise(0))  # noqa: B023
        x = x.withColumn(f"_piece{i or ''}", F.when(held.isNotNull(), less))
    return x.drop(*(f"_edges{i}" for i in range(len(values))))


def _before(x: DataFrame, by: Names, piece: str = "_piece") -> DataFrame:
    """by, _piece, _here (rows of the piece), _before (rows of the group's earlier ones) and _all; PIECES rows for each group."""
    counts = x.where(F.col(piece).isNotNull()).groupBy(*by, piece).agg(F.count("*").alias("_here"))
    w = over(by, [piece], (Window.unboundedPreceding, -1)) if by else Window.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    all_ = over(by) if by else Window.partitionBy()
    return counts.withColumns({"_before": F.coalesce(F.sum("_here").over(w), F.lit(0)), "_all": F.sum("_here").over(all_)})


def spread_rank(df: DataFrame, by: Names, value: str, out: str) -> DataFrame:
    """cross_rank() for few and large groups, null keys left out: a group is cut at its approximate quantiles, ranks are taken
    within pieces, and the rows of earlier pieces are added, so that no task sorts a whole group. Exact, as equal values
    are in one piece."""
    return spread_ranks(df, by, {value: out})


def spread_ranks(df: DataFrame, by: Names, ranks: dict[str, str], ties: bool = True) -> DataFrame:
    """spread_rank() of several columns. ``df`` is read a few times: give a stored table where it is much work.

    Without ``ties`` equal values get the first of their ranks, and the rank is how many are less as a share of the others."""
    x = done = pieces(df, by, *ranks)
    for i, (value, out) in enumerate(ranks.items()):
        piece = f"_piece{i or ''}"
        done = done.withColumn("_rank", F.rank().over(over([*by, piece], [value])))
        if ties:
            done = done.withColumn("_ties", F.count(value).over(over([*by, piece, value]))).withColumn("_rank", F.col("_rank") + (F.col("_ties") - 1) / 2).drop("_ties")
        done = done.join(F.broadcast(_before(x, by, piece)), [*by, piece], "left")
        rank = F.col("_rank") + F.col("_before")
        share = rank / F.col("_all") if ties else F.when(F.col("_all") > 1, (rank - 1) / (F.col("_all") - 1)).otherwise(0.0)
        done = done.withColumn(out, F.when(F.col(value).isNotNull(), share)).drop(piece, "_rank", "_here", "_before", "_all")
    return done


def exact_quantiles(df: DataFrame, value: str, shares: Names) -> DataFrame:
    """One row with _q, the interpolated quantiles of a whole column: only the pieces that hold the wanted places are sorted."""
    x = pieces(df.select(value), [], value)
    places = _before(x, [])
    at = F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("_all") - 1) * F.lit(float(s))).alias("at")) for i, s in enumerate(shares)))
    ends = places.select("_piece", "_here", "_before", F.explode(at).alias("q")).select("_piece", "_here", "_before", "q.i", (F.col("q.at") - F.floor("q.at")).alias("part"), F.explode(F.array(F.struct(F.floor("q.at").alias("place"), F.lit(False).alias("up")), F.struct(F.ceil("q.at").alias("place"), F.lit(True).alias("up")))).alias("e"))
    ends = ends.where((F.col("e.place") >= F.col("_before")) & (F.col("e.place") < F.col("_before") + F.col("_here")))
    wanted = x.join(F.broadcast(ends.select("_piece", "_before").distinct()), "_piece").groupBy("_piece", "_before", value).agg(F.count("*").alias("_n"))  # equal values once
    wanted = wanted.withColumn("_end", F.col("_before") + F.sum("_n").over(over(["_piece"], [value])))
    found = wanted.drop("_before").join(F.broadcast(ends.select("_piece", "i", "part", F.col("e.place").alias("_at"), "e.up")), "_piece").where("_at < _end and _at >= _end - _n").groupBy("i", "part").agg(F.max(F.when(~F.col("up"), F.col(value))).alias("lo"), F.max(F.when(F.col("up"), F.col(value))).alias("hi"))
    return found.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("v")))), lambda q: q["v"]).alias("_q"))


def streak(df: DataFrame, keys: Names, order: Names, flag: Column, out: str) -> DataFrame:
    """How many rows in a row, this one included, ``flag`` has been true; 0 where it isn't or is null."""
    held = F.coalesce(flag, F.lit(False))
    island = F.sum((~held).cast("int")).over(over(keys, order))
    df = df.withColumns({"_held": held, "_island": island})
    return df.withColumn(out, F.sum(F.col("_held").cast("int")).over(over([*keys, "_island"], order, (Window.unboundedPreceding, 0)))).drop("_held", "_island")


def forward_fill(value: str, w: WindowSpec, limit: int) -> Column:
    """The last non-null value of this row and the ``limit`` before it."""
    return F.last(value, ignorenulls=True).over(w.rowsBetween(-limit, 0))


def latest_by(df: DataFrame, keys: Names, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``: give a full order, so that ties don't depend on chance."""
    return top_n(df, keys, order, 1)


def top_n(df: DataFrame, keys: Names, order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key, with their number as ``rank``. Spark keeps n rows of a key a task before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(over(keys, order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def drawdown(equity: str, keys: Names, order: Names) -> Column:
    """How far ``equity`` is below its highest value so far, as a share of that: 0 or less."""
    peak = F.max(equity).over(over(keys, order, (Window.unboundedPreceding, 0)))
    return F.try_divide(F.col(equity), peak) - 1


def compound(r: Column, w: WindowSpec) -> Column:
    """Running product of 1 + r; a null return counts as 0."""
    return F.product(1 + F.coalesce(r, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def true_range(high: str, low: str, close_before: Column, strict: bool = False) -> Column:
    """Greatest of high - low and the distances to the last close. ``strict``: null without a last close; else that is skipped."""
    parts = [F.col(high) - F.col(low), F.abs(F.col(high) - close_before), F.abs(F.col(low) - close_before)]
    out = F.greatest(*parts)
    return F.when(close_before.isNotNull(), out) if strict else out


def near_triggers(df: DataFrame, keys: Names, at: str, order: Names, seconds: int) -> DataFrame:
    """Rows that follow another row of their key within ``seconds``, with gap_micros; ``order`` breaks ties of time."""
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(over(keys, [at, *order])).cast("timestamp"))
    return df.withColumn("gap_micros", gap).where(F.col("gap_micros") <= seconds * 1_000_000)
