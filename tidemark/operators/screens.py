"""Screens and trades that span several tables: guidance, supply chains, value, portfolios by year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import change, first_nonzero, ratio
from .asof import asof_join
from .joins import window_join
from .windows import over, spread_ranks, top_n


def guidance_screen(years: DataFrame, prices: DataFrame, growth: float, sold_off: float, least_hits: int, least_rate: float) -> DataFrame:
    """Companies that guide low, are sold off for it, and land high, again and again.

    years: ticker, fy, disclosed, previous, initial (guidance), actual. weak: initial over previous at most ``growth``; sold
    off: the close on the first trade day after the disclosure over the last one before at most ``sold_off``; landed: actual
    over initial at least ``growth``. Years with a missing or non-positive base don't count.
    """
    ok = (F.col("previous") > 0) & (F.col("initial") > 0) & F.col("actual").isNotNull()
    before = asof_join(years.where(ok), prices.select("ticker", "d", "close"), ["ticker"], "disclosed", "d", strict=True, prefix="b_")
    both = asof_join(before, prices.select("ticker", "d", "close"), ["ticker"], "disclosed", "d", direction="forward", strict=True, prefix="a_")
    x = both.withColumns({"weak": change(F.col("initial"), F.col("previous")) <= growth, "fell": ratio(F.col("a_close"), F.col("b_close")) - 1 <= sold_off, "landed": change(F.col("actual"), F.col("initial")) >= growth})
    weak_and_fell = F.col("weak") & F.col("fell")
    g = x.groupBy("ticker").agg(F.count_if(weak_and_fell).alias("tries"), F.count_if(weak_and_fell & F.col("landed")).alias("hits"), F.avg(change(F.col("actual"), F.col("initial"))).alias("mean_landing"))
    g = g.withColumn("rate", ratio(F.col("hits"), F.col("tries")))
    return g.where((F.col("hits") >= 1) & ((F.col("hits") >= least_hits) | (F.col("rate") >= least_rate)))


def cascade_trades(pairs: DataFrame, events: DataFrame, prices: DataFrame, calendar: DataFrame, most_days: int, cost: float, borrow: float) -> DataFrame:
    """Trades in followers after their leader's event.

    events: ticker, event_d, intraday. The reaction is the event day's move (intraday) or the next day's; its sign is the
    trade's. In at the open of the day after the reaction; out at the close before the follower's own next event, and after
    ``most_days`` trading days at the latest; shorts pay for borrowing.
    """
    px = prices.join(F.broadcast(calendar), "d").select("ticker", "n", "open", "close")
    ev = events.join(F.broadcast(calendar), F.col("event_d") == F.col("d")).select("ticker", F.col("n").alias("event_n"), "intraday")
    start = F.col("event_n") - F.col("intraday").cast("int")
    r = ev.withColumn("_n", start).join(px.select("ticker", F.col("n").alias("_n"), F.col("close").alias("_c0")), ["ticker", "_n"])
    r = r.withColumn("_m", F.col("_n") + 1).join(px.select("ticker", F.col("n").alias("_m"), F.col("close").alias("_c1")), ["ticker", "_m"])
    r = r.select(F.col("ticker").alias("leader"), "event_n", F.col("_m").alias("reaction_n"), (ratio(F.col("_c1"), F.col("_c0")) - 1).alias("reaction")).where("reaction <> 0")
    x = r.join(pairs, "leader")
    own = ev.select(F.col("ticker").alias("follower"), F.col("event_n").alias("next_n"))
    x = asof_join(x, own, ["follower"], "event_n", "next_n", direction="forward", strict=True, prefix="f_")
    x = x.withColumns({"entry_n": F.col("reaction_n") + 1, "exit_n": F.least(F.coalesce(F.col("f_next_n") - 1, F.col("reaction_n") + 1 + most_days), F.col("reaction_n") + 1 + most_days)}).where("exit_n > entry_n")
    x = x.join(px.select(F.col("ticker").alias("follower"), F.col("n").alias("entry_n"), F.col("open").alias("entry")), ["follower", "entry_n"]).join(px.select(F.col("ticker").alias("follower"), F.col("n").alias("exit_n"), F.col("close").alias("exit")), ["follower", "exit_n"])
    side = F.when(F.col("reaction") > 0, 1).otherwise(-1)
    days = F.col("exit_n") - F.col("entry_n")
    return x.withColumns({"side": side, "days": days, "net": side * (ratio(F.col("exit"), F.col("entry")) - 1) - 2 * cost - F.when(F.col("reaction") < 0, borrow * days / 252).otherwise(0.0)})


def pair_filter(trades: DataFrame, keys: list[str], at: str, net: str, n: int, least: float) -> DataFrame:
    """Trades of pairs whose last n earlier trades won often enough: nothing later is looked at."""
    frame = over(keys, [at], (-n, -1))
    wins = F.avg((F.col(net) > 0).cast("double")).over(frame)
    return trades.withColumn("hit_rate", F.when(F.count(net).over(frame) == n, wins)).where(F.col("hit_rate") >= least)


def reactions(events: DataFrame, prices: DataFrame, days: int) -> DataFrame:
    """Last close before and first close after an event within ``days`` calendar days, by date, and the extremes, by price."""
    x = window_join(events, prices.select("ticker", "d", "close"), ["ticker"], "event_d", "d", days, days)
    after, before = F.col("d") > F.col("event_d"), F.col("d") < F.col("event_d")
    return x.groupBy("ticker", "event_d").agg(F.max_by(F.when(before, F.col("close")), F.when(before, F.col("d"))).alias("last_before"), F.min_by(F.when(after, F.col("close")), F.when(after, F.col("d"))).alias("first_after"), F.max("close").alias("highest"), F.min("close").alias("lowest"))


def yearly_portfolio(scores: DataFrame, prices: DataFrame, year: str, score: str, share: float, cost: float) -> DataFrame:
    """Mean return of each year's top share of names, in at the first close from June on, out at the last until the next May."""
    ranked = scores.withColumns({"_rank": F.row_number().over(over([year], [F.col(score).desc(), F.col("ticker")])), "_n": F.count("*").over(over([year]))})
    chosen = ranked.where(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share)))
    x = prices.withColumn(year, F.year(F.add_months("d", -5))).join(chosen.select("ticker", year), ["ticker", year])
    one = x.groupBy(year, "ticker").agg((ratio(F.max_by("close", "d"), F.min_by("close", "d")) - 1).alias("r"))
    return one.groupBy(year).agg((F.avg("r") - 2 * cost).alias("mean"), F.count("*").alias("names"))


def net_cash_screen(companies: DataFrame, least: float) -> DataFrame:
    """Companies whose net cash is a large part of their market value.

    cash, short_securities, long_securities, liabilities, shares, own_shares, price; forecast, actual (profit). Missing
    parts count as 0; long securities at 70 percent; the profit is the forecast, else the actual one.
    """
    part = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    net = part("cash") + part("short_securities") + 0.7 * part("long_securities") - part("liabilities")
    value = F.col("price") * (F.col("shares") - part("own_shares"))
    x = companies.withColumns({"market_value": value, "net_cash": net, "net_cash_ratio": ratio(net, value), "profit": first_nonzero(F.col("forecast"), F.col("actual"))})
    return x.withColumn("per", ratio(F.col("market_value"), F.col("profit"))).where(F.col("net_cash_ratio") >= least)


def training_rows(panel: DataFrame, events: DataFrame, positive_days: int) -> DataFrame:
    """label 1 on the ``positive_days`` rows up to the ticker's first event, 0 before; rows after it are left out."""
    first = events.groupBy("ticker").agg(F.min("event_d").alias("event_d"))
    x = panel.join(first, "ticker", "left").where("event_d is null or d <= event_d")
    back = F.row_number().over(over(["ticker"], [F.col("d").desc()]))
    return x.withColumn("label", F.when(F.col("event_d").isNotNull() & (back <= positive_days), 1).otherwise(0))


def leak_audit(rows: DataFrame, keys: list[str], by: str, score: str, label: str) -> DataFrame:
    """By group: rows, how many repeat a key, and where positives stand by score (0 lowest, 1 highest)."""
    x = rows.withColumn("_g", F.struct(by))  # a struct, as null is a group, too
    x = spread_ranks(x.select("_g", *keys, score, label), ["_g"], {score: "_r"}, ties=False)
    n, m, positive = F.count("*"), F.count(score), F.col(label) == 1
    # the share is among rows with a score; those without one come before them
    ranks = F.coalesce(F.sum(F.when(positive, F.col("_r"))), F.lit(0.0)) * (m - 1) + F.count(F.when(positive, F.col("_r"))) * (n - m)
    mean = F.when(F.count_if(positive) > 0, F.when(n > 1, ranks / (F.count_if(positive) * (n - 1))).otherwise(0.0))
    return x.groupBy("_g").agg(n.alias("rows"), (n - F.count_distinct(*keys)).alias("repeated"), mean.alias("mean_rank")).select(f"_g.{by}", "rows", "repeated", "mean_rank")


def primary_documents(docs: DataFrame, event: str, at: str, title: Column, tie: str) -> DataFrame:
    """One document for each event: first those whose title names it, then the latest."""
    return top_n(docs.withColumn("_named", title.cast("int")), [event], [F.col("_named").desc(), F.col(at).desc(), F.col(tie)], 1).drop("_named")


def month_alerts(values: DataFrame, key: str, month: str, value: str, bound: float) -> DataFrame:
    """Each month's value against the nearest month before it that has one: NEW without one, ALERT beyond the bound, else OK."""
    before = F.last(value, ignorenulls=True).over(over([key], [month], (-10_000, -1)))
    x = values.withColumn("reference", before)
    return x.withColumn("status", F.when(F.col("reference").isNull(), "NEW").when(F.abs(change(F.col(value), F.col("reference"))) > bound, "ALERT").otherwise("OK"))


#: Fixed value: the difference up to which shown numbers agree.
TOLERANCE = 0.5


def shown_places(x: Column) -> Column:
    """Decimal places of a number that is shown with ten significant digits and no zeros at the end."""
    whole = F.floor(F.abs(x))
    free = F.when(whole == 0, 10).otherwise(F.greatest(F.lit(0), 10 - F.length(whole.cast("string"))))
    unit = F.pow(F.lit(10.0), free)
    digits = (F.rint(F.abs(x) * unit) / unit).try_cast("decimal(38,10)").cast("string")
    return F.coalesce(F.length(F.regexp_extract(digits, r"\.([0-9]*[1-9])0*$", 1)), F.lit(0))


def reconciled(rows: DataFrame, own: str, other: str, scale: Column, offset: Column, tolerance: float = TOLERANCE) -> DataFrame:
    """rows with status and diff: ``own`` (a text) times ``scale`` plus ``offset`` against ``other`` (a text) at the places that it shows.

    Rows whose own value is no number aren't compared and are left out. NODATA: there is no other value. NON_NUMERIC: it is no
    number. Else diff is the least distance of the own value, rounded, cut off or rounded up to the other's places, from the other
    (0 within 1e-9), to three places; OK up to ``tolerance``, beyond it NG.
    """
    mine = F.col(own).try_cast("double") * scale + offset
    theirs = F.col(other).try_cast("double")
    unit = F.pow(F.lit(10.0), shown_places(theirs))
    far = F.least(*(F.abs(theirs - f(mine * unit) / unit) for f in (F.rint, F.floor, F.ceil)))
    far = F.when(far < 1e-9, 0.0).otherwise(far)
    status = F.when(F.col(other).isNull(), "NODATA").when(theirs.isNull(), "NON_NUMERIC").when(far <= tolerance, "OK").otherwise("NG")
    return rows.where(mine.isNotNull()).withColumns({"status": status, "diff": F.round(far, 3)})
