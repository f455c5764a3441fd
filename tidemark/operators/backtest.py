"""Events, forward returns, portfolios, and what came of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.maths import normal_tail, ratio
from .asof import asof_join
from .windows import compound, drawdown, over, top_n


def forward_returns(signals: DataFrame, panel: DataFrame, calendar: DataFrame, horizons: tuple[int, ...], side: str | None = None) -> DataFrame:
    """f<h> for each horizon: the close h days of the market's calendar later over the signal's close, less 1; SHORT negated."""
    prices = panel.join(F.broadcast(calendar), "d").select("ticker", F.col("n").alias("_n"), F.col("close").alias("_close"))
    x = signals.join(F.broadcast(calendar), "d", "left")
    for h in horizons:
        later = prices.select("ticker", (F.col("_n") - h).alias("n"), F.col("_close").alias("_later"))
        r = ratio(F.col("_later"), F.col("close")) - 1
        x = x.join(later, ["ticker", "n"], "left").withColumn(f"f{h}", r if side is None else F.when(F.col(side) == "SHORT", -r).otherwise(r)).drop("_later")
    return x.drop("n")


def own_forward_returns(panel: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """f<h> by each ticker's own rows."""
    return panel.withColumns({f"f{h}": ratio(F.lead("close", h).over(over(["ticker"], ["d"])), F.col("close")) - 1 for h in horizons})


def signal_test(returns: DataFrame, by: list[str], value: str, least: int = 30) -> DataFrame:
    """n, mean, win rate, t and p (two-sided, normal) of returns by group; groups under ``least`` values are left out."""
    g = returns.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"), F.stddev_samp(value).alias("sd"))
    t = ratio(F.col("mean"), F.col("sd") / F.sqrt("n"))
    return g.where(F.col("n") >= least).withColumn("t", t).withColumn("p", normal_tail(F.col("t")))


def event_study(events: DataFrame, panel: DataFrame, back: tuple[int, ...], ahead: tuple[int, ...]) -> DataFrame:
    """Returns before and after each event, from the last trade day of its ticker that isn't after it."""
    wide = panel.select("ticker", "d", "close", "volume", *(( ratio(F.col("close"), F.lag("close", k).over(over(["ticker"], ["d"]))) - 1).alias(f"b{k}") for k in back), *((ratio(F.lead("close", k).over(over(["ticker"], ["d"])), F.col("close")) - 1).alias(f"a{k}") for k in ahead), ratio(F.avg("volume").over(over(["ticker"], ["d"], (-20, -1))), F.avg("volume").over(over(["ticker"], ["d"], (-100, -1)))).alias("volume_ratio"))
    return asof_join(events, wide, ["ticker"], "event_d", "d", prefix="")


def with_benchmark(study: DataFrame, market: DataFrame, back: tuple[int, ...], ahead: tuple[int, ...]) -> DataFrame:
    """An event study with the market's returns over its own days before (m_b<k>) and after (m_a<k>) each anchor day."""
    w = Window.orderBy("d")  # a row for each day
    m = market.select("d", *((ratio(F.col("close"), F.lag("close", k).over(w)) - 1).alias(f"m_b{k}") for k in back), *((ratio(F.lead("close", k).over(w), F.col("close")) - 1).alias(f"m_a{k}") for k in ahead))
    return study.join(F.broadcast(m), "d", "left")


def split_summary(returns: DataFrame, at: str, cut: Column, values: list[str]) -> DataFrame:
    """sample (train before ``cut``, test from there on), value, n, mean, win_rate, t of each of ``values``: what was chosen on
    one is seen on the other."""
    x = returns.select(F.when(F.col(at) < cut, "train").otherwise("test").alias("sample"), F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).alias("r")) for v in values))).alias("x")).select("sample", "x.*")
    g = x.where("r is not null").groupBy("sample", "value").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.stddev_samp("r").alias("_sd"))
    return g.withColumn("t", ratio(F.col("mean"), F.col("_sd") / F.sqrt("n"))).drop("_sd")


def event_shorts(events: DataFrame, panel: DataFrame, hold: int, cost: float) -> DataFrame:
    """Shorts sold at the open of the ticker's row after each event and bought back at the close ``hold`` rows after that one."""
    w = over(["ticker"], ["d"])
    wide = panel.select("ticker", "d", F.lead("open", 1).over(w).alias("entry"), F.lead("close", 1 + hold).over(w).alias("exit"))
    x = asof_join(events, wide, ["ticker"], "event_d", "d", prefix="")
    return x.withColumn("net", -(ratio(F.col("exit"), F.col("entry")) - 1) - cost).where("net is not null")


def abnormal_returns(events: DataFrame, panel: DataFrame, market: DataFrame, holds: tuple[int, ...]) -> DataFrame:
    """car<h>: the ticker's return over its next h rows less the market's over its own next h days."""
    own = panel.select("ticker", "d", *((ratio(F.lead("close", h).over(over(["ticker"], ["d"])), F.col("close")) - 1).alias(f"_o{h}") for h in holds))
    m = market.select(F.col("d"), *((ratio(F.lead("close", h).over(Window.orderBy("d")), F.col("close")) - 1).alias(f"_m{h}") for h in holds))
    x = asof_join(events, own.join(F.broadcast(m), "d"), ["ticker"], "event_d", "d", prefix="")
    return x.withColumns({f"car{h}": F.col(f"_o{h}") - F.col(f"_m{h}") for h in holds}).drop(*(f"_{k}{h}" for k in "om" for h in holds))


def signal_portfolio(signals: DataFrame, panel: DataFrame, calendar: DataFrame, hold: int, per_day: int, least_volume: float, cost: float) -> DataFrame:
    """Trades: on a day and side the ``per_day`` steepest signals of enough volume; in at the next open, out at the close
    ``hold`` market days after the signal, less the round trip's cost."""
    chosen = top_n(signals.where(F.col("volume") >= least_volume), ["d", "side"], [F.abs("slope").desc(), F.col("ticker")], per_day)
    prices = panel.join(F.broadcast(calendar), "d").select("ticker", "n", "open", "close")
    x = chosen.select("ticker", "d", "side", "slope").join(F.broadcast(calendar), "d")
    x = x.join(prices.select("ticker", (F.col("n") - 1).alias("n"), F.col("open").alias("entry")), ["ticker", "n"]).join(prices.select("ticker", (F.col("n") - hold).alias("n"), F.col("close").alias("exit")), ["ticker", "n"])
    r = ratio(F.col("exit"), F.col("entry")) - 1
    return x.withColumn("net", F.when(F.col("side") == "SHORT", -r).otherwise(r) - cost).drop("n")


def overlapping_holds(panel: DataFrame, score: str, share: float, hold: int) -> DataFrame:
    """Equal-weighted daily return of all names that were among the day's top ``share`` on one of the ``hold`` days before."""
    cut = panel.groupBy("d").agg(F.percentile(score, 1 - share).alias("_cut"))
    x = panel.join(cut, "d").withColumn("_in", (F.col(score) >= F.col("_cut")).cast("int"))
    x = x.withColumns({"held": F.max("_in").over(over(["ticker"], ["d"], (-hold, -1))), "r": ratio(F.col("close"), F.lag("close").over(over(["ticker"], ["d"]))) - 1})
    return x.where("held = 1 and r is not null").groupBy("d").agg(F.avg("r").alias("r"), F.count("*").alias("names"))


def equity_curve(daily: DataFrame, keys: list[str], at: str, r: str) -> DataFrame:
    """equity (1 at the start, compounded) and drawdown."""
    return daily.withColumn("equity", compound(F.col(r), over(keys, [at]))).withColumn("drawdown", drawdown("equity", keys, [at]))


def sharpe(r: str, kind: str, days: float = 252.0, hold: int = 1) -> Column:
    """There is no one Sharpe ratio: daily (sample deviation, days a year), trades (by the days of a hold), weekly, or population."""
    sd, year = (F.stddev_pop(r) if kind == "population" else F.stddev_samp(r)), {"daily": days, "population": days, "weekly": 52.0, "trades": days / hold}[kind]
    return ratio(F.avg(r), sd) * math.sqrt(year)


def performance(returns: DataFrame, keys: list[str], at: str, r: str) -> DataFrame:
    """n, total return, Sharpe ratio, deepest drawdown, win rate, profit factor (null without losses) by key."""
    curve = equity_curve(returns, keys, at, r)
    x = F.col(r)
    return curve.groupBy(*keys).agg(F.count(r).alias("n"), (F.max_by("equity", at) - 1).alias("total"), sharpe(r, "daily").alias("sharpe"), F.min("drawdown").alias("max_drawdown"), F.avg((x > 0).cast("double")).alias("win_rate"), ratio(F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x))).alias("profit_factor"))


def net_stages(daily: DataFrame, r: str, turnover: str, cost: float, borrow: float, tax: float) -> DataFrame:
    """gross, after cost and borrowing, and after a tax on gains."""
    net = F.col(r) - F.col(turnover) * cost - borrow / 252
    return daily.withColumns({"gross": F.col(r), "net": net, "after_tax": F.when(net > 0, net * (1 - tax)).otherwise(net)})


def paper_profit(signals: DataFrame, panel: DataFrame, stake: float) -> DataFrame:
    """Profit of each signal from its day's open to the close by side, and summed up over days."""
    x = signals.join(panel.select("ticker", "d", "open", "close"), ["ticker", "d"])
    r = ratio(F.col("close"), F.col("open")) - 1
    x = x.withColumn("profit", stake * F.when(F.col("side") == "SHORT", -r).otherwise(r))
    daily = x.groupBy("d").agg(F.sum("profit").alias("profit"), F.count("*").alias("trades"))
    return daily.withColumn("cumulative", F.sum("profit").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each day


def vector_backtest(panel: DataFrame, signal: str, capital: float, commission: float, slippage: float) -> DataFrame:
    """Equity of each ticker for positions in {1, -1, 0}: the last day's signal earns today's return, changes cost their share."""
    w = over(["ticker"], ["d"])
    x = panel.withColumn("position", F.coalesce(F.lag(signal).over(w), F.lit(0)))
    x = x.withColumn("traded", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0))))
    r = F.col("position") * F.coalesce(ratio(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)) - F.col("traded") * (commission + slippage)
    x = x.withColumn("r", r)
    return x.withColumn("equity", capital * compound(F.col("r"), w))


def accepted(metrics: DataFrame, least_sharpe: float, least_wins: float, deepest: float) -> DataFrame:
    """passed, by the limits."""
    ok = (F.col("sharpe") >= least_sharpe) & (F.col("win_rate") >= least_wins) & (F.abs("max_drawdown") <= deepest)
    return metrics.withColumn("passed", F.coalesce(ok, F.lit(False)))


def scorecard(m: DataFrame) -> DataFrame:
    """Five scores of up to 20 points from trades, expectancy, max_drawdown_pct, profit_factor, years, params, tested; verdict."""
    n, e, dd, pf, y, p = (F.col(c) for c in ("trades", "expectancy", "max_drawdown_pct", "profit_factor", "years", "params"))
    cut = lambda c: c.cast("int")
    sample = F.when(n < 30, 0).when(n < 100, 8 + cut((n - 30) / 70 * 7)).when(n < 200, 15 + cut((n - 100) / 100 * 5)).otherwise(20)
    expectancy = F.when(e <= 0, 0).when(e < 0.5, 5 + cut(e / 0.5 * 5)).when(e < 1.5, 10 + cut((e - 0.5) * 8)).otherwise(20)
    depth = F.when(dd < 20, 12).otherwise(cut(12 * (50 - dd) / 30))
    factor = F.when(pf < 1, 0).when(pf >= 3, 8).otherwise(cut((pf - 1) / 2 * 8))
    risk = F.when(dd >= 50, 0).otherwise(depth + factor)
    robust = F.when(y < 5, 0).when(y < 10, 5 + cut((y - 5) / 5 * 10)).otherwise(15) + F.when(p <= 4, 5).when(p <= 6, 3).when(p == 7, 1).otherwise(0)
    friction = F.when(F.col("tested"), 20).otherwise(0)
    x = m.withColumns({"sample_points": sample, "expectancy_points": expectancy, "risk_points": risk, "robust_points": robust, "friction_points": friction})
    total = F.least(F.greatest(F.col("sample_points") + F.col("expectancy_points") + F.col("risk_points") + F.col("robust_points") + F.col("friction_points"), F.lit(0)), F.lit(100))
    return x.withColumn("total", total).withColumn("verdict", F.when(total >= 70, "Deploy").when(total >= 40, "Refine").otherwise("Abandon"))


def weekday_place(day: str | Column) -> Column:
    """A day's place among weekdays, Monday to Friday: even numbers, two apart, and the odd one after Friday's for a weekend."""
    n = F.unix_date(F.col(day) if isinstance(day, str) else day) + 3  # day 0 is a Monday then
    return (10 * F.floor(n / 7) + F.least(2 * F.pmod(n, F.lit(7)), F.lit(9))).cast("long")


def weekday_before(day: str) -> Column:
    """The last weekday before a day."""
    n = F.pmod(F.unix_date(day) + 3, F.lit(7))
    return F.date_sub(F.col(day), F.when(n == 0, 3).when(n == 6, 2).otherwise(1))


def window_maxima(scores: DataFrame, events: DataFrame, key: str, at: str, event_at: str, columns: Sequence[str], windows: Sequence[int], business: bool = True) -> DataFrame:
    """events with column_w for each of ``columns`` and ``windows``: the largest value of the event's key from w days before it to the last one before, null
    without any. Days are weekdays, or all days if not ``business``.

    An event stands among its key's rows at the day before it, and its values come from windows over a range of days there: one
    shuffle by key, and no event meets rows outside of its windows.
    """
    place = weekday_place if business else (lambda d: 2 * F.unix_date(d).cast("long"))
    before = lambda d: weekday_place(weekday_before(d)) if business else place(F.date_sub(d, 1))
    rows = scores.select(F.col(key).alias("_key"), place(at).alias("_at"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(columns)))
    asked = events.select(F.col(key).alias("_key"), before(event_at).alias("_at"), F.struct(*events.columns).alias("_event"))
    both = rows.unionByName(asked, allowMissingColumns=True)
    over_ = lambda n: over(["_key"], ["_at"]).rangeBetween(-2 * (n - 1), 0)
    found = both.select("_event", *(F.max(f"_{i}").over(over_(n)).alias(f"{c}_{n}") for i, c in enumerate(columns) for n in windows))
    return found.where("_event is not null").select("_event.*", *(f"{c}_{n}" for c in columns for n in windows))


def detection_rates(maxima: DataFrame, columns: Sequence[str], windows: Sequence[int], thresholds: Sequence[float]) -> DataFrame:
    """window_days, threshold and for each column detected_, total_ and rate_ (of events with a value, those that reach the threshold), and delta, the
    last column's rate less the first one's. Everything is counted in one aggregate."""
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    cells = [
        F.struct(F.lit(n).alias("window_days"), F.lit(float(t)).alias("threshold"), *(x for c in columns for x in (count(F.col(f"{c}_{n}") >= t).alias(f"detected_{c}"), F.count(f"{c}_{n}").alias(f"total_{c}"))))
        for n in windows for t in thresholds
    ]
    x = maxima.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))
    rates = {f"rate_{c}": ratio(F.col(f"detected_{c}"), F.col(f"total_{c}")) for c in columns}
    return x.withColumns(rates).withColumn("delta", F.col(f"rate_{columns[-1]}") - F.col(f"rate_{columns[0]}"))


def detection_lift(scores: DataFrame, events: DataFrame, key: str, at: str, event_at: str, columns: Sequence[str], windows: Sequence[int], thresholds: Sequence[float]) -> DataFrame:
    """column, window, threshold, tpr, fpr, lift, n_events and n_others over a whole universe: on the days before events, how often the names of
    events, and how often all other names, had a score of the threshold or more within the last ``window`` rows.

    An event counts on its name's last row up to the weekday before it; the others are all rows on any of those days. Infinite
    lift stands for no false alarm; a rate of no rows is 0. One shuffle by name for the maxima, then one aggregate for the grid.
    """
    w = over([key], [at])
    held = scores.select(key, at, *(F.max(c).over(w.rowsBetween(1 - n, 0)).alias(f"{c}_{n}") for c in columns for n in windows))
    wanted = events.select(key, weekday_before(event_at).alias("_day"))
    hits = asof_join(wanted, scores.select(key, at), [key], "_day", at, prefix="_").select(key, F.col(f"_{at}").alias(at)).dropna().distinct()
    days = hits.select(at).distinct()
    rows = held.join(days, at, "left_semi").join(hits.withColumn("_hit", F.lit(True)), [key, at], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    cells = [
        F.struct(F.lit(c).alias("score"), F.lit(n).alias("window_days"), F.lit(float(t)).alias("threshold"), count(F.col("_hit") & (F.col(f"{c}_{n}") >= t)).alias("_tp"), count(~F.col("_hit") & (F.col(f"{c}_{n}") >= t)).alias("_fp"))
        for c in columns for n in windows for t in thresholds
    ]
    x = rows.agg(count(F.col("_hit")).alias("n_events"), count(~F.col("_hit")).alias("n_others"), F.array(*cells).alias("_cells")).select("n_events", "n_others", F.inline("_cells"))
    rate = lambda a, n: F.coalesce(ratio(F.col(a), F.col(n)), F.lit(0.0))
    x = x.withColumns({"tpr": rate("_tp", "n_events"), "fpr": rate("_fp", "n_others")}).drop("_tp", "_fp")
    return x.withColumn("lift", F.when(F.col("fpr") > 0, F.try_divide("tpr", "fpr")).otherwise(float("inf")))
