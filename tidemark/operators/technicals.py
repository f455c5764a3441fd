"""Price panels (ticker, d, open, high, low, close, volume): beta, anchored VWAP, dormancy and ignition, breakouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.maths import clip, ratio, sigmoid
from .windows import cross_rank, over, rolling, rolling_median, rolling_rank, streak, true_range

KEY, AT = ["ticker"], ["d"]
_ALL = (Window.unboundedPreceding, Window.currentRow)


def w() -> Window:
    return over(KEY, AT)


def pct_change(column: str = "close", k: int = 1) -> Column:
    return ratio(F.col(column), F.lag(column, k).over(w())) - 1


def rolling_beta(panel: DataFrame, market: DataFrame, n: int = 20, least: int = 15) -> DataFrame:
    """beta of daily returns against ``market`` (d, close) over n rows, population moments; null under ``least`` pairs."""
    m = market.withColumn("market_return", ratio(F.col("close"), F.lag("close").over(Window.orderBy("d"))) - 1).select("d", "market_return")  # a row for each day
    x = panel.withColumn("own_return", pct_change()).join(F.broadcast(m), "d", "left")
    both = F.col("own_return").isNotNull() & F.col("market_return").isNotNull()
    frame = w().rowsBetween(1 - n, 0)
    a, b = F.when(both, F.col("own_return")), F.when(both, F.col("market_return"))
    beta = ratio(F.covar_pop(a, b).over(frame), F.var_pop(b).over(frame))
    return x.withColumn("observations", F.count(a).over(frame)).withColumn("beta", F.when(F.col("observations") >= least, beta))


def anchored_vwap(panel: DataFrame, anchor: str = "week") -> DataFrame:
    """vwap since the week's or year's start, and its volume-weighted deviation bands (upper, lower)."""
    p = F.date_trunc(anchor, F.col("d")).cast("date")
    x = panel.withColumns({"anchor": p, "tp": (F.col("high") + F.col("low") + F.col("close")) / 3})
    run = over(["ticker", "anchor"], AT, _ALL)
    v = F.sum("volume").over(run)
    mean = ratio(F.sum(F.col("tp") * F.col("volume")).over(run), v)
    square = ratio(F.sum(F.col("tp") * F.col("tp") * F.col("volume")).over(run), v)
    x = x.withColumns({"vwap": mean, "sigma": F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))})
    return x.withColumns({"upper": F.col("vwap") + F.col("sigma"), "lower": F.col("vwap") - F.col("sigma")})


def band_touches(bands: DataFrame, slope: float = 2e-4, guard: float = 0.03, lookback: int = 5) -> DataFrame:
    """LONG and SHORT signals where a price comes back to a rising upper or a falling lower band.

    Rows without a deviation are left out before anything is looked back on; a ticker needs lookback + 2 rows.
    """
    x = bands.where("sigma > 0").withColumns({"_n": F.row_number().over(w()), "_all": F.count("*").over(over(KEY)), "_c": F.lag("close").over(w()), "_u": F.lag("upper").over(w()), "_l": F.lag("lower").over(w()), "_u5": F.lag("upper", lookback).over(w()), "_l5": F.lag("lower", lookback).over(w())})
    x = x.where((F.col("_all") >= lookback + 2) & (F.col("_n") > lookback))
    up, down = (F.col("upper") - F.col("_u5")) / (F.col("_u5") + 1e-9), (F.col("lower") - F.col("_l5")) / (F.abs("_l5") + 1e-9)
    long_ = (up > slope) & (F.col("_c") > F.col("_u")) & (F.col("low") <= F.col("upper")) & (F.col("close") > F.col("upper") * (1 - guard))
    short = (down < -slope) & (F.col("_c") < F.col("_l")) & (F.col("high") >= F.col("lower")) & (F.col("close") < F.col("lower") * (1 + guard))
    hits = F.array_compact(F.array(F.when(long_, F.struct(F.lit("LONG").alias("side"), up.alias("slope"))), F.when(short, F.struct(F.lit("SHORT").alias("side"), down.alias("slope")))))
    return x.withColumn("hit", F.explode(hits)).select(*bands.columns, "hit.side", "hit.slope")


def technical_features(panel: DataFrame) -> DataFrame:
    """Returns, volume ratio, ATR and volatility, gap and day ranges, impact, and forward labels."""
    tr = true_range("high", "low", F.lag("close").over(w()), strict=True)
    x = panel.withColumns({"tr": tr, "r1": pct_change(), "gap": ratio(F.col("open"), F.lag("close").over(w())) - 1, "day": ratio(F.col("close"), F.col("open")) - 1, "hl": ratio(F.col("high"), F.col("low"))})
    back = lambda n: w().rowsBetween(1 - n, 0)
    return x.withColumns({
        **{f"r{k}": pct_change(k=k) for k in (5, 10, 20, 40)}, "volume_ratio": ratio(F.col("volume"), F.avg("volume").over(back(20))), "atr": F.avg("tr").over(back(14)), "vola20": F.stddev_samp("r1").over(back(20)), "vola60": F.stddev_samp("r1").over(back(60)),
        "gap5": F.avg("gap").over(back(5)), "gap20": F.avg("gap").over(back(20)), "impact": ratio(F.abs("r1"), F.col("volume")), "high20": F.max("high").over(back(20)), "low20": F.min("low").over(back(20)),
        "forward_high": ratio(F.max("high").over(w().rowsBetween(1, 20)), F.col("close")) - 1, "forward_low": ratio(F.min("low").over(w().rowsBetween(1, 20)), F.col("close")) - 1,
    })


def dormancy_ignition(panel: DataFrame, band: int = 20, history: int = 120, span: int = 60, least_rows: int = 180, quiet: float = 0.2, market: DataFrame | None = None) -> DataFrame:
    """How quiet a price has been (dormancy) times how hard it moves now (ignition), per row; tickers of ``least_rows`` rows.

    With ``market`` (d, close) the five-day abnormal return over the average range is a fifth part of ignition.
    """
    x = panel.withColumn("_rows", F.count("*").over(over(KEY))).where(F.col("_rows") >= least_rows).drop("_rows")
    mean, sd = rolling(F.avg("close"), F.col("close"), w(), band), rolling(F.stddev_samp("close"), F.col("close"), w(), band)
    x = x.withColumns({"sma": mean, "sd": sd, "tr": true_range("high", "low", F.lag("close").over(w()))})
    x = x.withColumns({"width": ratio(4 * F.col("sd"), F.col("sma")), "upper": F.col("sma") + 2 * F.col("sd"), "atr": rolling(F.avg("tr"), F.col("tr"), w(), band), "range60": ratio(rolling(F.max("high"), F.col("high"), w(), span) - rolling(F.min("low"), F.col("low"), w(), span), F.col("sma"))})
    x = x.withColumns({"width_rank": rolling_rank("width", w(), history), "volume_rank": rolling_rank("volume", w(), history), "range_rank": rolling_rank("range60", w(), history)})
    x = streak(x, KEY, AT, F.col("width_rank") < quiet, "quiet_days")
    bonus = F.sqrt(clip(F.col("quiet_days") / history, 0, 1))
    calm = lambda c: F.coalesce(1 - F.col(c), F.lit(0.0))
    part = lambda a, b: F.coalesce(clip(ratio(a, b), 0, 1), F.lit(0.0))
    donchian = F.max("close").over(w().rowsBetween(-span, -1))
    parts = [part(ratio(F.col("volume"), rolling(F.avg("volume"), F.col("volume"), w(), band)), F.lit(5.0)), part(F.col("close") - F.col("upper"), F.col("atr")), part(F.col("close") - donchian, F.col("atr")), part(F.col("close") - F.col("open"), F.col("high") - F.col("low") + 1e-9)]
    if market is not None:
        m = market.withColumn("_m5", ratio(F.col("close"), F.lag("close", 5).over(Window.orderBy("d"))) - 1).select("d", "_m5")
        x = x.join(F.broadcast(m), "d", "left")
        parts.append(part(pct_change(k=5) - F.col("_m5"), ratio(F.col("atr"), F.col("close")) * 5**0.5))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    x = x.withColumns({"bonus": bonus, "dormancy": calm("width_rank") * calm("volume_rank") * calm("range_rank") * bonus, "ignition": total / len(parts), "darvas": F.col("close") > F.max("high").over(w().rowsBetween(-20, -1))})
    return x.withColumn("momentum", F.col("dormancy") * F.col("ignition"))


def blended(scores: DataFrame, least: int = 50, alpha: float = 0.5) -> DataFrame:
    """Dormancy from a blend of each name's own history and the day's cross-section; own, cross, 0 where one is missing."""
    x = scores.withColumn("volume_level", ratio(F.col("volume"), rolling_median("volume", w(), 120)))
    x = cross_rank(x, AT, "width", "width_cs", least)
    x = cross_rank(x, AT, "volume_level", "volume_cs", least)
    mix = lambda ts, cs: F.coalesce(alpha * (1 - F.col(ts)) + (1 - alpha) * (1 - F.col(cs)), 1 - F.col(ts), 1 - F.col(cs), F.lit(0.0))
    return x.withColumn("dormancy_v2", mix("width_rank", "width_cs") * mix("volume_rank", "volume_cs") * F.coalesce(1 - F.col("range_rank"), F.lit(0.0)) * (0.5 + 0.5 * F.col("bonus")))


def squeeze_breakout(scores: DataFrame, quiet: float = 0.1, days: int = 20, volume: float = 2.0) -> DataFrame:
    """Rows that cross above the band after ``days`` of a narrow one, on ``volume`` times the mean."""
    x = streak(scores, KEY, AT, F.col("width_rank") < quiet, "_s")
    lag = lambda c: F.lag(c).over(w())
    x = x.withColumns({"_s1": lag("_s"), "_c1": lag("close"), "_u1": lag("upper"), "_v": ratio(F.col("volume"), rolling(F.avg("volume"), F.col("volume"), w(), 20))})
    return x.where((F.col("_s1") >= days) & (F.col("_c1") <= F.col("_u1")) & (F.col("close") > F.col("upper")) & (F.col("_v") >= volume)).select(*scores.columns, F.col("_v").alias("volume_ratio"))


def donchian_breakout(panel: DataFrame, days: int = 60, volume: float = 1.5) -> DataFrame:
    """Rows that close above the highest close of the ``days`` before, the first day that they do, on enough volume."""
    x = panel.withColumn("level", rolling(F.max("close"), F.col("close"), w(), days)).withColumn("level", F.lag("level").over(w()))
    x = x.withColumns({"_c1": F.lag("close").over(w()), "_l1": F.lag("level").over(w()), "volume_ratio": ratio(F.col("volume"), rolling(F.avg("volume"), F.col("volume"), w(), 20))})
    return x.where((F.col("close") > F.col("level")) & (F.col("_c1") <= F.col("_l1")) & (F.col("volume_ratio") >= volume)).drop("_c1", "_l1")


def weekly_closes(panel: DataFrame) -> DataFrame:
    """The close of each ticker's last day of a week (from Monday), and the return from the week before."""
    x = panel.groupBy("ticker", F.date_trunc("week", F.col("d")).cast("date").alias("week")).agg(F.max_by("close", "d").alias("close"), F.max("d").alias("last_day"))
    return x.withColumn("r", ratio(F.col("close"), F.lag("close").over(over(KEY, ["week"]))) - 1)


def sma_timing(panel: DataFrame, n: int = 200) -> DataFrame:
    """The mean of n closes, the distance to it, and whether the price is above."""
    x = panel.withColumn("sma", rolling(F.avg("close"), F.col("close"), w(), n))
    return x.withColumns({"distance": ratio(F.col("close"), F.col("sma")) - 1, "above": F.col("close") > F.col("sma")})


def timing_stance(panel: DataFrame, assets: list, inverted: list, n: int = 200) -> DataFrame:
    """d, buys, stance: how many of ``assets`` (tickers) are above their mean of n closes, those ``inverted``, such as yields,
    below it, on days when all have one."""
    x = sma_timing(panel.where(F.col("ticker").isin(assets)), n).where("sma is not null")
    buy = F.when(F.col("ticker").isin(inverted), F.col("close") < F.col("sma")).otherwise(F.col("above"))
    g = x.groupBy("d").agg(F.count_if(buy).alias("buys"), F.count("*").alias("_n")).where(F.col("_n") == len(assets)).drop("_n")
    return g.withColumn("stance", F.when(F.col("buys") >= 4, "on").when(F.col("buys") >= 3, "rather on").when(F.col("buys") >= 2, "neutral").otherwise("off"))


def tail_risk(days: DataFrame, high: str, low: str, mood: str, high_share: float, low_share: float, mood_from: float) -> DataFrame:
    """days with conditions (how many of three hold) and signal (all do): ``high`` in its top, ``low`` in its bottom, ``mood`` from a
    fixed value on. Gaps are filled from before. There is a row for each day."""
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    x = days.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in (high, low, mood)})
    edges = x.agg(F.percentile(high, high_share).alias("_hi"), F.percentile(low, low_share).alias("_lo"))
    x = x.crossJoin(F.broadcast(edges))
    held = [F.coalesce(c, F.lit(False)).cast("int") for c in (F.col(high) >= F.col("_hi"), F.col(low) <= F.col("_lo"), F.col(mood) >= mood_from)]
    x = x.withColumn("conditions", held[0] + held[1] + held[2])
    return x.withColumn("signal", F.col("conditions") == 3).drop("_hi", "_lo")


def sector_excess(panel: DataFrame, market: DataFrame, sectors: DataFrame, n: int) -> DataFrame:
    """d, sector, excess, label: the mean return over n rows of a sector's tickers less the market's over its own, and what to do."""
    x = panel.select("ticker", "d", (ratio(F.col("close"), F.lag("close", n).over(w())) - 1).alias("_r")).where("_r is not null").join(F.broadcast(sectors), "ticker")
    m = market.select("d", (ratio(F.col("close"), F.lag("close", n).over(Window.orderBy("d"))) - 1).alias("_m"))
    g = x.groupBy("d", "sector").agg(F.avg("_r").alias("_r")).join(F.broadcast(m), "d").where("_m is not null")
    g = g.select("d", "sector", (100 * (F.col("_r") - F.col("_m"))).alias("excess"))
    return g.withColumn("label", F.when(F.col("excess") > 1, "BUY").when(F.col("excess") < -1, "SELL").otherwise("FLAT"))


def regime(market: DataFrame, a: Column, b: Column) -> DataFrame:
    """Shares of four phases from two scores in [-1, 1]: products of logistic curves, made to add up to 1."""
    up, right = sigmoid(3 * a), sigmoid(3 * b)
    raw = {"boom": up * right, "late": (1 - up) * right, "early": up * (1 - right), "bust": (1 - up) * (1 - right)}
    total = raw["boom"] + raw["late"] + raw["early"] + raw["bust"]
    return market.withColumns({k: v / total for k, v in raw.items()})
