"""Rule scores as sums of conditions, with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bands(x: Column, *steps: tuple[str, float, float]) -> Column:
    """Points of the first step (">" or "<", bound, points) that x is beyond; 0 for none or null."""
    out = None
    for sign, bound, points in steps:
        held = x > bound if sign == ">" else x < bound
        out = F.when(held, float(points)) if out is None else out.when(held, float(points))
    return F.coalesce(out.otherwise(0.0), F.lit(0.0))


#: Points of a price that is so many times the earnings' growth.
PEG_STEPS = (("<", 0.5, 2), ("<", 1, 1), (">", 10, -3), (">", 5, -2), (">", 2, -1))
#: Expected progress of the year by quarter.
EXPECTED = {"1Q": 0.25, "2Q": 0.5, "3Q": 0.75}


def earnings_score(x: DataFrame) -> DataFrame:
    """score and reasons of a statement from its features (null: not known).

    quarter; progress, revision, consensus_ordinary, consensus_net, qoq, yoy, eps_change, op_change, growth_gap, dividend_change,
    achievement, per, growth as numbers; selloff, special_dividend, buyback, split, low_profit, turnaround, undisclosed_next as
    booleans; market_cap. Guidance and performance are summed up and cut to +-3 each before they are added.
    """
    c = F.col
    unless = lambda n, points: F.when(c(n), 0.0).otherwise(points)  # noqa: E731  a flag that isn't known doesn't hold
    is_fy = c("quarter") == "FY"
    expected = F.coalesce(*(F.when(c("quarter") == q, e) for q, e in EXPECTED.items()))
    deviation = F.when(F.abs(c("consensus_net")) > F.coalesce(F.abs(c("consensus_ordinary")), F.lit(-1.0)), c("consensus_net")).otherwise(c("consensus_ordinary"))
    # values that bands compare again and again are columns first: Spark then compiles them, and the points of groups, as methods of their own
    columns = x.columns
    x = x.withColumns({"_pace": F.try_divide(c("progress"), expected), "_deviation": deviation, "_eps": F.when(c("split"), None).otherwise(c("eps_change")), "_peg": F.when(c("split") | ~(c("growth") > 0), None).otherwise(F.try_divide(c("per"), c("growth") * 100))})
    x = x.withColumn("_peg_points", bands(c("_peg"), *PEG_STEPS))
    eps = c("_eps")
    parts: dict[str, Column] = {
        "progress": bands(c("_pace"), (">", 1.2, 1), ("<", 0.8, -1)),
        "revision": bands(c("revision"), (">", 0.001, 1), ("<", -0.001, -1)),
        "consensus": bands(c("_deviation"), (">", 0.1, 3), (">", 0.05, 2), (">", 0, 1), ("<", -0.3, -5), ("<", -0.2, -4), ("<", -0.1, -3), ("<", -0.05, -2), ("<", 0, -1)),
        "undisclosed": F.when(c("undisclosed_next") & (c("market_cap") >= 3000), -1.0).otherwise(0.0),
        "selloff": F.when(c("selloff"), -2.0).otherwise(0.0),
        "special_dividend": F.when(c("special_dividend"), 1.0).otherwise(0.0),
        "buyback": F.when(c("buyback"), 2.0).otherwise(0.0),
        "dividend": unless("split", bands(c("dividend_change"), ("<", -0.2, -3), ("<", -0.05, -2), (">", 0.05, 1))),
        "qoq": unless("low_profit", bands(c("qoq"), (">", 0.5, 1), ("<", -0.5, -2))),
        "split": F.when(c("split"), 1.0).otherwise(0.0),
        "achievement": F.when(is_fy, bands(c("achievement"), ("<", 0.65, -2), ("<", 0.8, -1))).otherwise(0.0),
    }
    against = eps * c("op_change") <= 0
    guidance = F.when(is_fy, bands(eps, (">", 0.1, 2), ("<", -0.1, -2)) + F.when(against, 0.0).otherwise(bands(c("op_change"), (">", 0.1, 1), ("<", -0.1, -1))) + unless("low_profit", bands(c("growth_gap"), (">", 0.2, 1), ("<", -0.2, -1))) + c("_peg_points")).otherwise(0.0)
    results = unless("low_profit", bands(c("yoy"), (">", 0.3, 1), ("<", -0.3, -1))) + F.when(c("turnaround"), F.when(c("yoy").isNotNull(), 2.0).otherwise(1.0)).otherwise(0.0) + F.when(is_fy, 0.0).otherwise(c("_peg_points"))
    x = x.withColumns({"_guidance": guidance, "_results": results})
    within = lambda n: F.when(c(n) > 3, 3.0).when(c(n) < -3, -3.0).otherwise(c(n))
    parts |= {"guidance": within("_guidance"), "performance": within("_results")}
    total = None
    for p in parts.values():
        total = p if total is None else total + p
    reasons = F.array_compact(F.array(*(F.when(p != 0, F.concat(F.lit(f"{n} "), F.format_number(p, 0))) for n, p in parts.items())))
    return x.withColumns({"score": total, "reasons": reasons}).select(*columns, "score", "reasons")


def score_class(score: Column) -> Column:
    return F.when(score >= 2, "UP").when(score <= -2, "DOWN").otherwise("NEUTRAL")


def return_class(r: Column) -> Column:
    return F.when(r > 0.02, "UP").when(r < -0.02, "DOWN").when(r.isNotNull(), "NEUTRAL")


def outcome(predicted: Column, actual: Column) -> Column:
    """check without an actual class, neutral where none was predicted, else hit or miss."""
    return F.when(actual.isNull(), "check").when(predicted == "NEUTRAL", "neutral").when(predicted == actual, "hit").otherwise("miss")


def accuracy(df: DataFrame, score: str, r: str) -> DataFrame:
    """n, share of hits among directed predictions, correlation of score and return; by predicted class its mean and median."""
    x = df.withColumns({"predicted": score_class(F.col(score)), "actual": return_class(F.col(r))})
    return x.groupBy("predicted").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("actual")).cast("double")).alias("hit_rate"), F.avg(r).alias("mean"), F.median(r).alias("median"))


def late_filing_score(x: DataFrame) -> DataFrame:
    """score and reasons from cheap, cash_rich, parent_share, late_days, repeated."""
    c = F.col
    parts = {"cheap": F.when(c("pbr") < 0.7, 2).when(c("pbr") < 1, 1), "cash": F.when(c("cash_share") > 0.5, 2).when(c("cash_share") > 0.3, 1), "parent": F.when(c("parent_share") > 0.5, 3).when(c("parent_share") > 0.3, 1), "late": F.when(c("late_days") >= 30, 2).when(c("late_days") >= 7, 1), "again": F.when(c("repeated"), 1)}
    total = None
    for p in parts.values():
        total = F.coalesce(p, F.lit(0)) if total is None else total + F.coalesce(p, F.lit(0))
    return x.withColumns({"score": total, "reasons": F.array_compact(F.array(*(F.when(p.isNotNull(), F.lit(n)) for n, p in parts.items())))})
