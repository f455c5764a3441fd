"""Market analytics: fundamentals, technicals, events, backtests, factors, owners, scores."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.maths import change, normalised, ratio
from ..operators import backtest, factor, fundamentals, ownership, pairs, scoring, technicals
from ..operators.asof import asof_join
from ..operators.windows import latest_by, over, top_n
from .fixtures import ROW, query, rounded

c = F.col


def w():
    return over(["ticker"], ["d"])

_ROW_DESC = "l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC"


# Point-in-time fundamentals
def _consensus(t, as_of=None):
    return rounded(fundamentals.consensus_merged(t.consensus, ["ticker", "fy", "q"], "dated", "source", "A", "B", ["sales", "profit"], ["profit"], [c(x).desc() for x in ROW], as_of), 4)


_CONSENSUS = f"""WITH l AS (SELECT * FROM consensus WHERE dated <= {{as_of}} QUALIFY row_number() OVER (PARTITION BY ticker, fy, q, source ORDER BY dated DESC, {_ROW_DESC}) = 1)
    SELECT ticker, fy, q, coalesce(a.dated, b.dated) AS dated, round(a.sales, 4) AS sales, round(coalesce(a.profit, b.profit), 4) AS profit FROM (SELECT * FROM l WHERE source = 'A') a FULL JOIN (SELECT * FROM l WHERE source = 'B') b USING (ticker, fy, q)"""
query("d1_consensus_merged", _consensus, _CONSENSUS.format(as_of="DATE '9999-12-31'"))
query("d2_consensus_as_of", lambda t: _consensus(t, F.lit("1998-06-30").cast("date")), _CONSENSUS.format(as_of="DATE '1998-06-30'"))


def _standalone(t):
    return fundamentals.standalone_quarters(t.fin_cum, ["ticker"], "fy", "q", [c("disclosed").desc(), c("sales").desc()], ["sales"])


_STANDALONE = """WITH r AS (SELECT * FROM fin_cum QUALIFY row_number() OVER (PARTITION BY ticker, fy, q ORDER BY disclosed DESC, sales DESC) = 1),
    s AS (SELECT ticker, fy, n || 'Q' AS q, n, disclosed, sales - coalesce(lag(sales) OVER (PARTITION BY ticker, fy ORDER BY n), 0) AS sales FROM r) """
query("d3_standalone_quarters", lambda t: rounded(_standalone(t), 4), _STANDALONE + "SELECT ticker, fy, q, n, disclosed, round(sales, 4) AS sales FROM s")
query("d4_latest_disclosure", lambda t: latest_by(t.fin_cum, ["ticker"], [c("disclosed").desc(), c("n").desc(), c("sales").desc()]).select("ticker", "disclosed", "q", F.when(c("q") == "FY", c("fy") + 1).otherwise(c("fy")).alias("current_fy")), "SELECT ticker, disclosed, q, CASE WHEN q = 'FY' THEN fy + 1 ELSE fy END AS current_fy FROM fin_cum QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY disclosed DESC, n DESC, sales DESC) = 1")
query("d12_growth", lambda t: rounded(fundamentals.growth_features(_standalone(t).select("ticker", "fy", "q", "sales"), ["ticker"], "fy", "q", "sales")), _STANDALONE + ", g AS (SELECT *, lag(sales) OVER (PARTITION BY ticker, q ORDER BY fy) AS ago, lag(sales) OVER (PARTITION BY ticker ORDER BY fy, q) AS bef FROM s) SELECT ticker, fy, q, round(sales, 6) AS sales, CASE WHEN ago <> 0 THEN round(least(greatest((sales - ago) / abs(ago), -5), 5), 6) END AS yoy, CASE WHEN bef <> 0 THEN round(least(greatest((sales - bef) / abs(bef), -5), 5), 6) END AS qoq, coalesce(sales > 0 AND ago < 0, false) AS turnaround FROM g")
query("d13_feature_attach", lambda t: rounded(asof_join(t.bars.select("ticker", "d"), t.fin_cum.where("disclosed is not null").groupBy("ticker", "disclosed").agg(F.max("sales").alias("sales")), ["ticker"], "d", "disclosed"), 4), "WITH f AS (SELECT ticker, disclosed, max(sales) AS sales FROM fin_cum GROUP BY 1, 2) SELECT b.ticker, b.d, max(disclosed) AS r_disclosed, round(arg_max(sales, disclosed), 4) AS r_sales FROM (SELECT ticker, d FROM bars) b LEFT JOIN f ON f.ticker = b.ticker AND f.disclosed <= b.d GROUP BY 1, 2")
query("d31_prior_flag", lambda t: fundamentals.first_flag(t.orders.select(c("o_orderkey"), c("o_custkey").alias("k"), F.to_date("o_orderdate").alias("at")), t.orders.where("o_orderpriority like '1%'").select(c("o_custkey").alias("k"), F.to_date("o_orderdate").alias("at")), ["k"], "at", "flag"), "SELECT o_orderkey, o_custkey AS k, CAST(o_orderdate AS DATE) AS at, coalesce(CAST(o_orderdate AS DATE) >= m, false) AS flag FROM orders LEFT JOIN (SELECT o_custkey AS k2, min(CAST(o_orderdate AS DATE)) AS m FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) ON k2 = o_custkey")
query("d32_clipped_ratio", lambda t: rounded(t.fin_quarters.withColumn("g", change(c("own").cast("double"), F.lag("own").over(over(["ticker"], ["fy", "n"])).cast("double"), 5)).select("ticker", "fy", "n", "g")), "SELECT ticker, fy, n, CASE WHEN p <> 0 THEN round(least(greatest((own - p) / abs(p), -5), 5), 6) END AS g FROM (SELECT ticker, fy, n, CAST(own AS DOUBLE) AS own, CAST(lag(own) OVER (PARTITION BY ticker ORDER BY fy, n) AS DOUBLE) AS p FROM fin_quarters)")
query("d64_announcements", lambda t: fundamentals.announcement_calendar(t.fin_cum.select("ticker", "fy", "q", c("disclosed").alias("dated")), t.fin_cum.select("ticker", "fy", "q", F.date_add("disclosed", 1).alias("dated")), ["ticker", "fy", "q"], "dated"), "SELECT *, CAST(row_number() OVER (PARTITION BY ticker, fy, q, record_type ORDER BY dated) AS INTEGER) AS revision FROM (SELECT ticker, fy, q, disclosed AS dated, 'S' AS record_type FROM fin_cum UNION SELECT ticker, fy, q, disclosed + 1, 'A' FROM fin_cum)")


def _surprise(t):
    x = t.fin_quarters.select("ticker", "fy", "n", c("own").cast("double").alias("own"))
    x = x.withColumns({"done": F.sum("own").over(over(["ticker", "fy"], ["n"])), "year": F.sum("own").over(over(["ticker", "fy"])) * 1.05})
    p, s = fundamentals.surprise(c("own"), c("year"), c("done") - c("own"), 5 - c("n"))
    return rounded(x.select("ticker", "fy", "n", p.alias("progress"), s.alias("surprise")))


query("d69_implied_quarter", _surprise, "WITH x AS (SELECT ticker, fy, n, CAST(own AS DOUBLE) AS own, sum(CAST(own AS DOUBLE)) OVER (PARTITION BY ticker, fy ORDER BY n) AS done, sum(CAST(own AS DOUBLE)) OVER (PARTITION BY ticker, fy) * 1.05 AS y FROM fin_quarters), z AS (SELECT *, (y - (done - own)) / nullif(5 - n, 0) AS i FROM x) SELECT ticker, fy, n, round((done - own) / nullif(y, 0), 6) AS progress, CASE WHEN i <> 0 THEN round(least(greatest((own - i) / abs(i), -5), 5), 6) END AS surprise FROM z")

# Technicals
_BETA = """WITH m AS (SELECT d, close / lag(close) OVER (ORDER BY d) - 1 AS mr FROM market), x AS (SELECT b.ticker, b.d, close / lag(close) OVER (PARTITION BY ticker ORDER BY b.d) - 1 AS r, mr FROM bars b LEFT JOIN m ON m.d = b.d),
    y AS (SELECT ticker, d, count(CASE WHEN r IS NOT NULL THEN mr END) OVER w AS n, covar_pop(CASE WHEN mr IS NOT NULL THEN r END, CASE WHEN r IS NOT NULL THEN mr END) OVER w / nullif(var_pop(CASE WHEN r IS NOT NULL THEN mr END) OVER w, 0) AS b FROM x WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING))
    SELECT ticker, d, n AS observations, CASE WHEN n >= 15 THEN round(b, 4) END AS beta FROM y"""


def rolling_beta(t):
    return rounded(technicals.rolling_beta(t.bars, t.market).select("ticker", "d", "observations", "beta"), 4)


query("d5_rolling_beta", rolling_beta, _BETA)
_VWAP = """WITH x AS (SELECT *, CAST(date_trunc('{anchor}', d) AS DATE) AS anchor, (high + low + close) / 3 AS tp FROM {bars}),
    y AS (SELECT *, sum(tp * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap, sum(tp * tp * volume) OVER w / nullif(sum(volume) OVER w, 0) AS sq FROM x WINDOW w AS (PARTITION BY ticker, anchor ORDER BY d ROWS UNBOUNDED PRECEDING)),
    z AS (SELECT *, sqrt(greatest(sq - vwap * vwap, 0)) AS sigma FROM y) """
for _a in ("week", "year"):
    query(f"d6_vwap_{_a}", lambda t, a=_a: rounded(technicals.anchored_vwap(t.bars, a).select("ticker", "d", "vwap", F.when(c("sigma") > 0.01, c("sigma")).alias("sigma")), 3), _VWAP.format(anchor=_a, bars="bars") + "SELECT ticker, d, round(vwap, 3) AS vwap, CASE WHEN sigma > 0.01 THEN round(sigma, 3) END AS sigma FROM z")
_TOUCH = _VWAP.format(anchor="year", bars="bars10") + """, v AS (SELECT *, vwap + sigma AS upper, vwap - sigma AS lower FROM z WHERE sigma > 0.001),
    l AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY ticker) AS m, lag(close) OVER w AS c1, lag(upper) OVER w AS u1, lag(lower) OVER w AS l1, lag(upper, 5) OVER w AS u5, lag(lower, 5) OVER w AS l5 FROM v WINDOW w AS (PARTITION BY ticker ORDER BY d)),
    s AS (SELECT *, (upper - u5) / (u5 + 1e-9) AS up, (lower - l5) / (abs(l5) + 1e-9) AS down FROM l WHERE m >= 7 AND n > 5),
    sig AS (SELECT ticker, d, close, volume, 'LONG' AS side, up AS slope FROM s WHERE up > 2e-4 AND c1 > u1 AND low <= upper AND close > upper * 0.97 UNION ALL SELECT ticker, d, close, volume, 'SHORT', down FROM s WHERE down < -2e-4 AND c1 < l1 AND high >= lower AND close < lower * 1.03) """


def touches(t):
    return technicals.band_touches(technicals.anchored_vwap(t.bars10, "year").where("sigma > 0.001"))


query("d7_band_touches", lambda t: rounded(touches(t).select("ticker", "d", "side", "slope")), _TOUCH + "SELECT ticker, d, side, round(slope, 6) AS slope FROM sig")
query("d8_forward_returns", lambda t: rounded(backtest.forward_returns(touches(t).select("ticker", "d", "side", "close"), t.bars10, t.calendar, (1, 3, 5, 10), "side").drop("close")), _TOUCH + "SELECT g.ticker, g.d, side, " + ", ".join(f"round(CASE WHEN side = 'SHORT' THEN -(b{h}.close / g.close - 1) ELSE b{h}.close / g.close - 1 END, 6) AS f{h}" for h in (1, 3, 5, 10)) + " FROM sig g JOIN calendar k ON k.d = g.d " + " ".join(f"LEFT JOIN calendar k{h} ON k{h}.n = k.n + {h} LEFT JOIN bars10 b{h} ON b{h}.ticker = g.ticker AND b{h}.d = k{h}.d" for h in (1, 3, 5, 10)))


def _ttest(t):
    x = backtest.own_forward_returns(t.bars, (5,)).withColumn("side", F.when(c("close") > c("open"), "UP").otherwise("DOWN"))
    return rounded(backtest.signal_test(x, ["ticker", "side"], "f5"), 5)


query("d9_signal_test", _ttest, """WITH x AS (SELECT ticker, CASE WHEN close > open THEN 'UP' ELSE 'DOWN' END AS side, lead(close, 5) OVER (PARTITION BY ticker ORDER BY d) / close - 1 AS f FROM bars),
    g AS (SELECT ticker, side, count(f) AS n, avg(f) AS mean, avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, stddev_samp(f) AS sd FROM x WHERE f IS NOT NULL GROUP BY 1, 2), z AS (SELECT *, mean / nullif(sd / sqrt(n), 0) AS t FROM g WHERE n >= 30), e AS (SELECT *, abs(t) / sqrt(2) AS a, 1 / (1 + 0.3275911 * abs(t) / sqrt(2)) AS k FROM z)
    SELECT ticker, side, n, round(mean, 5) AS mean, round(win_rate, 5) AS win_rate, round(sd, 5) AS sd, round(t, 5) AS t, round(k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-a * a), 5) AS p FROM e""")
query("d10_vwap_backtest", lambda t: rounded(backtest.signal_portfolio(touches(t), t.bars10, t.calendar, 10, 3, 20, 0.002).select("ticker", "d", "side", "net")), _TOUCH + ", ch AS (SELECT * FROM sig WHERE volume >= 20 QUALIFY row_number() OVER (PARTITION BY d, side ORDER BY abs(slope) DESC, ticker) <= 3) SELECT ch.ticker, ch.d, side, round(CASE WHEN side = 'SHORT' THEN -(x.close / e.open - 1) ELSE x.close / e.open - 1 END - 0.002, 6) AS net FROM ch JOIN calendar k ON k.d = ch.d JOIN calendar k1 ON k1.n = k.n + 1 JOIN calendar k2 ON k2.n = k.n + 10 JOIN bars10 e ON e.ticker = ch.ticker AND e.d = k1.d JOIN bars10 x ON x.ticker = ch.ticker AND x.d = k2.d")
query("d11_technical_features", lambda t: rounded(technicals.technical_features(t.bars10).select("ticker", "d", "r1", "r5", "r20", "gap", "day", "volume_ratio", "atr", "vola20", "impact", "forward_high", "forward_low"), 5), """WITH x AS (SELECT *, lag(close) OVER w AS c1, close / lag(close) OVER w - 1 AS r1, close / lag(close, 5) OVER w - 1 AS r5, close / lag(close, 20) OVER w - 1 AS r20, open / lag(close) OVER w - 1 AS gap, close / open - 1 AS day FROM bars10 WINDOW w AS (PARTITION BY ticker ORDER BY d)),
    y AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr FROM x)
    SELECT ticker, d, round(r1, 5) AS r1, round(r5, 5) AS r5, round(r20, 5) AS r20, round(gap, 5) AS gap, round(day, 5) AS day, round(volume / avg(volume) OVER w20, 5) AS volume_ratio, round(avg(tr) OVER w14, 5) AS atr, round(stddev_samp(r1) OVER w20, 5) AS vola20, round(abs(r1) / volume, 5) AS impact, round(max(high) OVER f / close - 1, 5) AS forward_high, round(min(low) OVER f / close - 1, 5) AS forward_low
    FROM y WINDOW w20 AS (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING), w14 AS (PARTITION BY ticker ORDER BY d ROWS 13 PRECEDING), f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)""")

# Dormancy, ignition and breakouts share their first steps.
_pr = lambda col: f"CASE WHEN len({col}_h) >= 120 AND {col} IS NOT NULL THEN (len(list_filter({col}_h, lambda x: x < {col})) + (len(list_filter({col}_h, lambda x: x = {col})) + 1) / 2) / len({col}_h) END"
_hist = lambda col: f"list({col}) FILTER ({col} IS NOT NULL) OVER w120 AS {col}_h"
_DORMANT = f"""WITH a AS (SELECT *, CASE WHEN count(*) OVER w20 >= 20 THEN avg(close) OVER w20 END AS sma, CASE WHEN count(*) OVER w20 >= 20 THEN stddev_samp(close) OVER w20 END AS sd, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, count(*) OVER (PARTITION BY ticker) AS m FROM bars10 WINDOW w AS (PARTITION BY ticker ORDER BY d), w20 AS (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING)),
    b AS (SELECT *, 4 * sd / nullif(sma, 0) AS width, sma + 2 * sd AS upper, CASE WHEN count(*) OVER w20 >= 20 THEN avg(tr) OVER w20 END AS atr, CASE WHEN count(*) OVER w60 >= 60 THEN (max(high) OVER w60 - min(low) OVER w60) / nullif(sma, 0) END AS range60, CASE WHEN count(*) OVER w20 >= 20 THEN avg(volume) OVER w20 END AS mv FROM a WHERE m >= 180 WINDOW w20 AS (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING), w60 AS (PARTITION BY ticker ORDER BY d ROWS 59 PRECEDING)),
    h AS (SELECT *, {_hist('width')}, {_hist('volume')}, {_hist('range60')} FROM b WINDOW w120 AS (PARTITION BY ticker ORDER BY d ROWS 119 PRECEDING)),
    r AS (SELECT *, {_pr('width')} AS width_rank, {_pr('volume')} AS volume_rank, {_pr('range60')} AS range_rank FROM h),
    g AS (SELECT *, sum(CASE WHEN width_rank < 0.2 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY d) AS isl FROM r),
    q AS (SELECT *, sum(CASE WHEN width_rank < 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, isl ORDER BY d) AS quiet FROM g),
    i AS (SELECT *, sqrt(least(greatest(quiet / 120, 0), 1)) AS bonus, max(close) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS don, close > max(high) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS darvas FROM q),
    s AS (SELECT *, coalesce(1 - width_rank, 0) * coalesce(1 - volume_rank, 0) * coalesce(1 - range_rank, 0) * bonus AS dormancy, ((CASE WHEN mv IS NULL THEN 0 ELSE least(greatest(volume / mv / 5, 0), 1) END) + (CASE WHEN atr > 0 AND upper IS NOT NULL THEN least(greatest((close - upper) / atr, 0), 1) ELSE 0 END) + (CASE WHEN atr > 0 AND don IS NOT NULL THEN least(greatest((close - don) / atr, 0), 1) ELSE 0 END) + least(greatest((close - open) / (high - low + 1e-9), 0), 1)) / 4 AS ignition FROM i) """
query("d16_dormancy_ignition", lambda t: rounded(technicals.dormancy_ignition(t.bars10).select("ticker", "d", "quiet_days", "dormancy", "ignition", "momentum", "darvas"), 5), _DORMANT + "SELECT ticker, d, CAST(quiet AS BIGINT) AS quiet_days, round(dormancy, 5) AS dormancy, round(ignition, 5) AS ignition, round(dormancy * ignition, 5) AS momentum, darvas FROM s")
query("d17_blended_dormancy", lambda t: rounded(technicals.blended(technicals.dormancy_ignition(t.bars10), 5).select("ticker", "d", "width_cs", "dormancy_v2"), 5), _DORMANT + """, z AS (SELECT *, CASE WHEN count(*) OVER w >= 120 THEN volume / nullif(median(volume) OVER w, 0) END AS vl FROM s WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 119 PRECEDING)),
    y AS (SELECT *, CASE WHEN width IS NOT NULL AND count(width) OVER (PARTITION BY d) >= 5 THEN (rank() OVER (PARTITION BY d ORDER BY width NULLS LAST) + (count(width) OVER (PARTITION BY d, width) - 1) / 2) / count(width) OVER (PARTITION BY d) END AS wc, CASE WHEN vl IS NOT NULL AND count(vl) OVER (PARTITION BY d) >= 5 THEN (rank() OVER (PARTITION BY d ORDER BY vl NULLS LAST) + (count(vl) OVER (PARTITION BY d, vl) - 1) / 2) / count(vl) OVER (PARTITION BY d) END AS vc FROM z)
    SELECT ticker, d, round(wc, 5) AS width_cs, round(coalesce(0.5 * (1 - width_rank) + 0.5 * (1 - wc), 1 - width_rank, 1 - wc, 0) * coalesce(0.5 * (1 - volume_rank) + 0.5 * (1 - vc), 1 - volume_rank, 1 - vc, 0) * coalesce(1 - range_rank, 0) * (0.5 + 0.5 * bonus), 5) AS dormancy_v2 FROM y""")
query("d18_abnormal_ignition", lambda t: rounded(technicals.dormancy_ignition(t.bars10, market=t.market).select("ticker", "d", "ignition"), 5), _DORMANT + ", mk AS (SELECT d, close / lag(close, 5) OVER (ORDER BY d) - 1 AS m5 FROM market), y AS (SELECT s.*, s.close / lag(s.close, 5) OVER (PARTITION BY ticker ORDER BY s.d) - 1 - m5 AS car FROM s LEFT JOIN mk ON mk.d = s.d) SELECT ticker, d, round((4 * ignition + CASE WHEN atr > 0 AND car IS NOT NULL THEN least(greatest(car / (atr / close * sqrt(5)), 0), 1) ELSE 0 END) / 5, 5) AS ignition FROM y")
query("d19_squeeze_breakout", lambda t: rounded(technicals.squeeze_breakout(technicals.dormancy_ignition(t.bars10), 0.3, 3, 1.0).select("ticker", "d", "volume_ratio"), 5), _DORMANT + ", k AS (SELECT *, sum(CASE WHEN width_rank < 0.3 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY d) AS g2 FROM s), l AS (SELECT *, sum(CASE WHEN width_rank < 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, g2 ORDER BY d) AS st FROM k), m2 AS (SELECT *, lag(st) OVER w AS s1, lag(close) OVER w AS c1, lag(upper) OVER w AS u1 FROM l WINDOW w AS (PARTITION BY ticker ORDER BY d)) SELECT ticker, d, round(volume / mv, 5) AS volume_ratio FROM m2 WHERE s1 >= 3 AND c1 <= u1 AND close > upper AND volume / mv >= 1.0")
query("d20_donchian_breakout", lambda t: rounded(technicals.donchian_breakout(t.bars10, 60, 1.5).select("ticker", "d", "level", "volume_ratio"), 4), "WITH x AS (SELECT *, CASE WHEN count(*) OVER w60 >= 60 THEN max(close) OVER w60 END AS hi, CASE WHEN count(*) OVER w20 >= 20 THEN volume / avg(volume) OVER w20 END AS vr FROM bars10 WINDOW w60 AS (PARTITION BY ticker ORDER BY d ROWS 59 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING)), y AS (SELECT *, lag(hi) OVER w AS level, lag(close) OVER w AS c1, lag(hi, 2) OVER w AS l1 FROM x WINDOW w AS (PARTITION BY ticker ORDER BY d)) SELECT ticker, d, round(level, 4) AS level, round(vr, 4) AS volume_ratio FROM y WHERE close > level AND c1 <= l1 AND vr >= 1.5")
query("d44_sma_timing", lambda t: rounded(technicals.sma_timing(t.bars10).where("sma is not null").select("ticker", "d", "sma", "above"), 4), "SELECT ticker, d, round(avg(close) OVER w, 4) AS sma, close > avg(close) OVER w AS above FROM bars10 WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 199 PRECEDING) QUALIFY count(*) OVER w >= 200")


def _tail(t):
    m = t.market.withColumn("r", c("close") / F.lag("close").over(Window.orderBy("d")) - 1)
    q = m.agg(F.percentile("r", 0.9).alias("hi"), F.percentile("close", 0.25).alias("lo"))
    return m.crossJoin(F.broadcast(q)).select("d", (F.coalesce(c("r") > c("hi"), F.lit(False)) & (c("close") > c("lo"))).alias("signal"))


query("d45_tail_risk", _tail, "WITH m AS (SELECT d, close, close / lag(close) OVER (ORDER BY d) - 1 AS r FROM market) SELECT d, coalesce(r > (SELECT quantile_cont(r, 0.9) FROM m), false) AND close > (SELECT quantile_cont(close, 0.25) FROM m) AS signal FROM m")


def _regime(t):
    w = Window.orderBy("d")
    x = t.market.withColumns({"a": normalised(c("close") / F.lag("close", 40).over(w) - 1, -0.5, 0.5), "b": normalised(c("close") / F.avg("close").over(w.rowsBetween(-62, 0)) - 1, -0.5, 0.5)})
    return rounded(technicals.regime(x.where("a is not null"), c("a"), c("b")).select("d", "boom", "late", "early", "bust"))


query("d46_regime", _regime, "WITH x AS (SELECT d, least(greatest((close / lag(close, 40) OVER (ORDER BY d) - 1) / 0.5, -1), 1) AS a, lag(close, 40) OVER (ORDER BY d) AS p, least(greatest((close / avg(close) OVER (ORDER BY d ROWS 62 PRECEDING) - 1) / 0.5, -1), 1) AS b FROM market), y AS (SELECT d, 1 / (1 + exp(-3 * a)) AS u, 1 / (1 + exp(-3 * b)) AS v FROM x WHERE p IS NOT NULL) SELECT d, round(u * v, 6) AS boom, round((1 - u) * v, 6) AS late, round(u * (1 - v), 6) AS early, round((1 - u) * (1 - v), 6) AS bust FROM y")


def _sector_week(t):
    x = technicals.weekly_closes(t.bars).join(F.broadcast(t.master.select("ticker", "sector")), "ticker").where("r is not null")
    return rounded(x.groupBy("sector", "week").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.count("*").alias("n")).where("n >= 3"), 5)


_WEEKLY = "WITH k AS (SELECT ticker, CAST(date_trunc('week', d) AS DATE) AS week, arg_max(close, d) AS close FROM bars GROUP BY 1, 2), r AS (SELECT ticker, week, close / lag(close) OVER (PARTITION BY ticker ORDER BY week) - 1 AS r FROM k) "
query("d51_sector_weekly", _sector_week, _WEEKLY + "SELECT sector, week, round(avg(r), 5) AS mean, round(stddev_samp(r), 5) AS sd, count(*) AS n FROM r JOIN master USING (ticker) WHERE r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3")

# Events and backtests
query("d14_event_study", lambda t: rounded(backtest.event_study(t.corp_events, t.bars, (5, 20), (1, 5)), 5), "WITH p AS (SELECT ticker, d, close, volume, close / lag(close, 5) OVER w - 1 AS b5, close / lag(close, 20) OVER w - 1 AS b20, lead(close, 1) OVER w / close - 1 AS a1, lead(close, 5) OVER w / close - 1 AS a5, avg(volume) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) / avg(volume) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS vr FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)) SELECT e.ticker, e.event_d, p.d, round(close, 5) AS close, round(volume, 5) AS volume, round(b5, 5) AS b5, round(b20, 5) AS b20, round(a1, 5) AS a1, round(a5, 5) AS a5, round(vr, 5) AS volume_ratio FROM corp_events e ASOF LEFT JOIN p ON p.ticker = e.ticker AND e.event_d >= p.d")
query("d15_abnormal_returns", lambda t: rounded(backtest.abnormal_returns(t.corp_events, t.bars, t.market, (20, 60)).select("ticker", "event_d", "d", "car20", "car60"), 5), "WITH m AS (SELECT d, lead(close, 20) OVER (ORDER BY d) / close - 1 AS m20, lead(close, 60) OVER (ORDER BY d) / close - 1 AS m60 FROM market), p AS (SELECT b.ticker, b.d, lead(close, 20) OVER w / close - 1 - m20 AS c20, lead(close, 60) OVER w / close - 1 - m60 AS c60 FROM bars b JOIN m ON m.d = b.d WINDOW w AS (PARTITION BY ticker ORDER BY b.d)) SELECT e.ticker, e.event_d, p.d, round(c20, 5) AS car20, round(c60, 5) AS car60 FROM corp_events e ASOF LEFT JOIN p ON p.ticker = e.ticker AND e.event_d >= p.d")
query("d22_detection_grid", lambda t: rounded(t.bars10.withColumn("score", F.max("volume").over(w().rowsBetween(-30, -1))).withColumn("hit", c("ticker") % 2 == 0).crossJoin(F.broadcast(t.spark.createDataFrame([(60.0,), (90.0,), (120.0,)], "th double"))).groupBy("th").agg(F.avg(F.when(c("hit"), (c("score") >= c("th")).cast("double"))).alias("tpr"), F.avg(F.when(~c("hit"), (c("score") >= c("th")).cast("double"))).alias("fpr")), 5), "WITH x AS (SELECT ticker % 2 = 0 AS hit, max(volume) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS score FROM bars10) SELECT th, round(avg(CASE WHEN hit THEN CASE WHEN score >= th THEN 1.0 WHEN score < th THEN 0.0 END END), 5) AS tpr, round(avg(CASE WHEN NOT hit THEN CASE WHEN score >= th THEN 1.0 WHEN score < th THEN 0.0 END END), 5) AS fpr FROM x, (VALUES (60.0::DOUBLE), (90.0), (120.0)) v(th) GROUP BY 1")
query("d41_net_stages", lambda t: rounded(backtest.net_stages(t.market.withColumn("r", F.coalesce(c("close") / F.lag("close").over(Window.orderBy("d")) - 1, F.lit(0.0))).withColumn("turnover", F.lit(0.5)), "r", "turnover", 0.001, 0.02, 0.2).select("d", "gross", "net", "after_tax")), "WITH x AS (SELECT d, coalesce(close / lag(close) OVER (ORDER BY d) - 1, 0) AS r FROM market), y AS (SELECT d, r, r - 0.5 * 0.001 - 0.02 / 252 AS net FROM x) SELECT d, round(r, 6) AS gross, round(net, 6) AS net, round(CASE WHEN net > 0 THEN net * 0.8 ELSE net END, 6) AS after_tax FROM y")
query("d42_paper_profit", lambda t: rounded(backtest.paper_profit(touches(t).select("ticker", "d", "side"), t.bars10, 1e5), 2), _TOUCH + ", pp AS (SELECT g.d, 1e5 * CASE WHEN side = 'SHORT' THEN -(b.close / b.open - 1) ELSE b.close / b.open - 1 END AS p FROM sig g JOIN bars10 b ON b.ticker = g.ticker AND b.d = g.d), yy AS (SELECT d, sum(p) AS profit, count(*) AS trades FROM pp GROUP BY 1) SELECT d, round(profit, 2) AS profit, trades, round(sum(profit) OVER (ORDER BY d), 2) AS cumulative FROM yy")
query("d43_overlapping_holds", lambda t: rounded(backtest.overlapping_holds(t.bars, "volume", 0.2, 20), 5), "WITH q AS (SELECT *, quantile_cont(volume, 0.8) OVER (PARTITION BY d) AS cut FROM bars), x AS (SELECT d, max(CASE WHEN volume >= cut THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS held, close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS r FROM q) SELECT d, round(avg(r), 5) AS r, count(*) AS names FROM x WHERE held = 1 AND r IS NOT NULL GROUP BY 1")


def _performance(t):
    r = technicals.weekly_closes(t.bars10).where("r is not null").select("ticker", "week", (F.log1p(c("r")) / 10).alias("r"))
    return rounded(backtest.performance(r, ["ticker"], "week", "r"), 5)


query("x9_d73_performance", _performance, "WITH k AS (SELECT ticker, CAST(date_trunc('week', d) AS DATE) AS week, arg_max(close, d) AS close FROM bars10 GROUP BY 1, 2), r AS (SELECT ticker, week, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY week)) / 10 AS r FROM k QUALIFY r IS NOT NULL), e AS (SELECT *, product(1 + r) OVER (PARTITION BY ticker ORDER BY week ROWS UNBOUNDED PRECEDING) AS eq FROM r), f AS (SELECT *, eq / max(eq) OVER (PARTITION BY ticker ORDER BY week ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e) SELECT ticker, count(r) AS n, round(arg_max(eq, week) - 1, 5) AS total, round(avg(r) / stddev_samp(r) * sqrt(252), 5) AS sharpe, round(min(dd), 5) AS max_drawdown, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 5) AS win_rate, round(sum(CASE WHEN r > 0 THEN r END) / nullif(-sum(CASE WHEN r < 0 THEN r END), 0), 5) AS profit_factor FROM f GROUP BY 1")
query("d67_vector_backtest", lambda t: rounded(backtest.vector_backtest(t.bars.withColumn("close", F.log("close") + 100).withColumn("s", F.when(c("volume") > 80, 1).when(c("volume") < 20, -1).otherwise(0)), "s", 1.0, 0.0005, 0.0005).select("ticker", "d", "position", "equity"), 4), "WITH x AS (SELECT ticker, d, ln(close) + 100 AS close, CASE WHEN volume > 80 THEN 1 WHEN volume < 20 THEN -1 ELSE 0 END AS s FROM bars), y AS (SELECT *, coalesce(lag(s) OVER w, 0) AS position, coalesce(close / lag(close) OVER w - 1, 0) AS cr FROM x WINDOW w AS (PARTITION BY ticker ORDER BY d)), z AS (SELECT *, position * cr - abs(position - coalesce(lag(position) OVER (PARTITION BY ticker ORDER BY d), 0)) * 0.001 AS r FROM y) SELECT ticker, d, CAST(position AS INTEGER) AS position, round(product(1 + r) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING), 4) AS equity FROM z")


def _card(t):
    x = t.bars10.groupBy("ticker").agg((F.count("*") % 300).alias("trades"), (F.avg("volume") / 60).alias("expectancy"), (F.min("close") % 60).alias("max_drawdown_pct"), (F.max("volume") % 4).alias("profit_factor"), (c("ticker") + 1).alias("years"), (c("ticker") % 9).alias("params"), (c("ticker") % 2 == 0).alias("tested"))
    return backtest.scorecard(x).select("ticker", "sample_points", "expectancy_points", "risk_points", "robust_points", "friction_points", "total", "verdict")


query("d60_scorecard", _card, """WITH x AS (SELECT ticker, count(*) % 300 AS n, avg(volume) / 60 AS e, min(close) % 60 AS dd, max(volume) % 4 AS pf, ticker + 1 AS y, ticker % 9 AS p FROM bars10 GROUP BY ticker),
    s AS (SELECT ticker, CASE WHEN n < 30 THEN 0 WHEN n < 100 THEN 8 + trunc((n - 30) / 70 * 7) WHEN n < 200 THEN 15 + trunc((n - 100) / 100 * 5) ELSE 20 END AS a, CASE WHEN e <= 0 THEN 0 WHEN e < 0.5 THEN 5 + trunc(e / 0.5 * 5) WHEN e < 1.5 THEN 10 + trunc((e - 0.5) * 8) ELSE 20 END AS b, CASE WHEN dd >= 50 THEN 0 ELSE (CASE WHEN dd < 20 THEN 12 ELSE trunc(12 * (50 - dd) / 30) END) + (CASE WHEN pf < 1 THEN 0 WHEN pf >= 3 THEN 8 ELSE trunc((pf - 1) / 2 * 8) END) END AS r, (CASE WHEN y < 5 THEN 0 WHEN y < 10 THEN 5 + trunc((y - 5) / 5 * 10) ELSE 15 END) + (CASE WHEN p <= 4 THEN 5 WHEN p <= 6 THEN 3 WHEN p = 7 THEN 1 ELSE 0 END) AS o, CASE WHEN ticker % 2 = 0 THEN 20 ELSE 0 END AS f FROM x)
    SELECT ticker, a::INTEGER AS sample_points, b::INTEGER AS expectancy_points, r::INTEGER AS risk_points, o::INTEGER AS robust_points, f AS friction_points, least(a + b + r + o + f, 100)::INTEGER AS total, CASE WHEN a + b + r + o + f >= 70 THEN 'Deploy' WHEN a + b + r + o + f >= 40 THEN 'Refine' ELSE 'Abandon' END AS verdict FROM s""")
query("d66_acceptance", lambda t: backtest.accepted(t.bars.groupBy("ticker").agg((F.avg("volume") / 50).alias("sharpe"), F.avg((c("close") > c("open")).cast("double")).alias("win_rate"), (F.min("low") / F.max("high") - 1).alias("max_drawdown")), 0.5, 0.35, 0.9995).select("ticker", "passed"), "SELECT ticker, avg(volume) / 50 >= 0.5 AND avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) >= 0.35 AND abs(min(low) / max(high) - 1) <= 0.9995 AS passed FROM bars GROUP BY 1")
query("d72_buy_and_hold", lambda t: rounded(t.bars.withColumn("rel", c("close") / F.first("close").over(over(["ticker"], ["d"], (Window.unboundedPreceding, 0)))).groupBy("d").agg(F.avg("rel").alias("equity"), F.count("*").alias("names")), 5), "SELECT d, round(avg(rel), 5) AS equity, count(*) AS names FROM (SELECT d, close / first_value(close) OVER (PARTITION BY ticker ORDER BY d) AS rel FROM bars) GROUP BY 1")
query("d75_snapshot", lambda t: rounded(top_n(t.bars.where("d <= date'1999-06-30'"), ["ticker"], [c("d").desc()], 250, "rn").groupBy("ticker").agg(F.max(F.when(c("rn") == 1, c("close"))).alias("last"), F.max("high").alias("high52"), F.min("low").alias("low52"), F.avg(F.when(c("rn") <= 50, c("volume"))).alias("volume50"), F.count("*").alias("n")).where("n >= 10"), 5), "WITH x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS rn FROM bars WHERE d <= DATE '1999-06-30' QUALIFY rn <= 250) SELECT ticker, round(max(CASE WHEN rn = 1 THEN close END), 5) AS last, round(max(high), 5) AS high52, round(min(low), 5) AS low52, round(avg(CASE WHEN rn <= 50 THEN volume END), 5) AS volume50, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 10")

# Cross-sections and factors
query("d54_quantile_table", lambda t: rounded(factor.quantile_buckets(backtest.own_forward_returns(t.bars, (5,)), ["ticker"], "volume", 5, "bucket").groupBy("bucket", (c("close") > c("open")).alias("up")).agg(F.avg("f5").alias("mean"), F.count("f5").alias("n")), 5), "WITH x AS (SELECT *, lead(close, 5) OVER (PARTITION BY ticker ORDER BY d) / close - 1 AS f5 FROM bars), e AS (SELECT ticker, list_distinct(quantile_cont(volume, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS q0 FROM bars GROUP BY 1), y AS (SELECT x.*, list_sort(q0) AS q FROM x JOIN e USING (ticker)), z AS (SELECT *, CAST(1 + len(list_filter(list_slice(q, 2, len(q) - 1), lambda v: v < volume)) AS INTEGER) AS bucket FROM y) SELECT bucket, close > open AS up, round(avg(f5), 5) AS mean, count(f5) AS n FROM z GROUP BY 1, 2")
query("m1_spearman", lambda t: rounded(factor.spearman(backtest.own_forward_returns(t.bars, (5,)), ["ticker"], "volume", "f5").select("ticker", "n", "ic", "pearson"), 5), "WITH x AS (SELECT ticker, volume, lead(close, 5) OVER (PARTITION BY ticker ORDER BY d) / close - 1 AS f FROM bars QUALIFY f IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY volume) + (count(*) OVER (PARTITION BY ticker, volume) - 1) / 2 AS a, rank() OVER (PARTITION BY ticker ORDER BY f) + (count(*) OVER (PARTITION BY ticker, f) - 1) / 2 AS b FROM x) SELECT ticker, count(*) AS n, round(corr(a, b), 5) AS ic, round(corr(volume, f), 5) AS pearson FROM r GROUP BY 1 HAVING count(*) >= 10")
query("m4_rank_sum", lambda t: rounded(factor.rank_sum_test(t.orders.withColumn("urgent", c("o_orderpriority") == "1-URGENT"), ["o_orderstatus"], "o_totalprice", "urgent"), 4), "WITH r AS (SELECT o_orderstatus, o_orderpriority = '1-URGENT' AS g, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2 AS r FROM orders), s AS (SELECT o_orderstatus, sum(r) FILTER (g) AS rs, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2 FROM r GROUP BY 1) SELECT o_orderstatus, n1, n2, round(rs - n1 * (n1 + 1) / 2, 4) AS u, round((rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 4) AS z FROM s")
query("m11_lift", lambda t: rounded(factor.lift_at(t.bars.withColumn("label", c("close") > c("open")).withColumn("s", c("volume") + c("ticker") / 100 + F.datediff("d", F.lit("1990-01-01").cast("date")) / 1e6), ["ticker"], "s", "label", (0.05, 0.2)), 5), "WITH x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY volume + ticker / 100 + (d - DATE '1990-01-01') / 1e6 DESC) AS rk, count(*) OVER (PARTITION BY ticker) AS n, avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY ticker) AS base, CASE WHEN close > open THEN 1.0 ELSE 0.0 END AS y FROM bars) SELECT ticker, share, count(*) AS n, round(avg(y) / nullif(max(base), 0), 5) AS lift FROM x, (VALUES (0.05::DOUBLE), (0.2)) v(share) WHERE rk <= greatest(1, floor(n * share)) GROUP BY ALL")
query("t5_long_short", lambda t: factor.long_short(t.bars.select("ticker", "d", "volume"), "d", "volume", 3, "ticker"), "SELECT ticker, d, volume, CASE WHEN row_number() OVER (PARTITION BY d ORDER BY volume DESC, ticker) <= 3 THEN 'LONG' WHEN row_number() OVER (PARTITION BY d ORDER BY volume, ticker) <= 3 THEN 'SHORT' ELSE 'NONE' END AS position FROM bars")
query("d21_a21_factors", lambda t: rounded(factor.equal_weight_factors(t.bars.join(F.broadcast(t.master.select("ticker", "sector", "size")), "ticker").withColumn("r", F.log(c("close") / F.lag("close").over(w()))).where("r is not null"), "d", "r", ["sector", "size"]).select("ticker", "d", "mkt", "f_sector", "f_size"), 5), "WITH x AS (SELECT b.ticker, d, sector, size, ln(close / lag(close) OVER (PARTITION BY b.ticker ORDER BY d)) AS r FROM bars b JOIN master USING (ticker) QUALIFY r IS NOT NULL) SELECT ticker, d, round(avg(r) OVER (PARTITION BY d), 5) AS mkt, round(avg(r) OVER (PARTITION BY d, sector) - avg(r) OVER (PARTITION BY d), 5) AS f_sector, round(avg(r) OVER (PARTITION BY d, size) - avg(r) OVER (PARTITION BY d), 5) AS f_size FROM x")


def _residuals(t):
    x = t.bars.withColumn("r", F.log(c("close") / F.lag("close").over(w()))).where("r is not null").withColumn("mkt", F.avg("r").over(over(["d"]))).withColumn("y", F.year("d"))
    return rounded(factor.factor_residuals(x.select("ticker", "d", "y", "r", "mkt"), ["mkt"], "r", ["ticker", "y"]).select("ticker", "d", "residual", "r_squared"), 5)


query("d47_m6_residuals", _residuals, "WITH x AS (SELECT ticker, d, year(d) AS y, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY d)) AS r FROM bars QUALIFY r IS NOT NULL), m AS (SELECT *, avg(r) OVER (PARTITION BY d) AS mkt FROM x), g AS (SELECT ticker, y, regr_slope(r, mkt) AS b, regr_intercept(r, mkt) AS a, regr_r2(r, mkt) AS r2, count(*) AS n FROM m GROUP BY 1, 2) SELECT ticker, d, CASE WHEN n >= 30 THEN round(r - a - b * mkt, 5) END AS residual, CASE WHEN n >= 30 THEN round(r2, 5) END AS r_squared FROM m JOIN g USING (ticker, y)")


def _pairs(t):
    m = t.bars.groupBy("ticker", F.trunc("d", "month").alias("m")).agg(F.avg(F.log("close")).alias("x")).join(F.broadcast(t.master.select("ticker", "sector")), "ticker")
    return rounded(pairs.pair_correlations(m, "sector", "ticker", "m", "x", 24), 5)


query("d48_d49_pair_correlations", _pairs, "WITH m AS (SELECT ticker, date_trunc('month', d) AS m, avg(ln(close)) AS x, any_value(sector) AS sector FROM bars JOIN master USING (ticker) GROUP BY 1, 2) SELECT a.sector, a.ticker AS a, b.ticker AS b, round(corr(a.x, b.x), 5) AS r, count(*) AS n FROM m a JOIN m b ON a.sector = b.sector AND a.m = b.m AND a.ticker < b.ticker GROUP BY 1, 2, 3 HAVING count(*) >= 24")
query("d52_lag_correlation", lambda t: rounded(factor.lag_correlation(t.bars10, ["ticker"], "d", "volume", "close", (0, 1, 5, 20)), 5), "WITH l AS (SELECT volume, close AS y0, lead(close, 1) OVER w AS y1, lead(close, 5) OVER w AS y5, lead(close, 20) OVER w AS y20 FROM bars10 WINDOW w AS (PARTITION BY ticker ORDER BY d)), u AS (SELECT 0 AS lag, volume AS x, y0 AS y FROM l UNION ALL SELECT 1, volume, y1 FROM l UNION ALL SELECT 5, volume, y5 FROM l UNION ALL SELECT 20, volume, y20 FROM l), r AS (SELECT lag, rank() OVER (PARTITION BY lag ORDER BY x) + (count(*) OVER (PARTITION BY lag, x) - 1) / 2 AS a, rank() OVER (PARTITION BY lag ORDER BY y) + (count(*) OVER (PARTITION BY lag, y) - 1) / 2 AS b FROM u WHERE y IS NOT NULL) SELECT lag, count(*) AS n, round(corr(a, b), 5) AS ic FROM r GROUP BY 1")


def _kill(t):
    daily = factor.spearman(t.bars.withColumn("f1", F.log(F.lead("close").over(w()) / c("close"))).select("d", "volume", "f1").repartition(t.tasks, "d"), ["d"], "volume", "f1", 5).select("d", "ic")
    return rounded(factor.kill_switch(daily, "d", "ic", 20, 0.0).select("d", "rolling_ic", "killed", "switched"), 5)


query("d40_kill_switch", _kill, "WITH x AS (SELECT d, volume, ln(lead(close) OVER (PARTITION BY ticker ORDER BY d) / close) AS f FROM bars QUALIFY f IS NOT NULL), r AS (SELECT d, rank() OVER (PARTITION BY d ORDER BY volume) + (count(*) OVER (PARTITION BY d, volume) - 1) / 2 AS a, rank() OVER (PARTITION BY d ORDER BY f) + (count(*) OVER (PARTITION BY d, f) - 1) / 2 AS b FROM x), i AS (SELECT d, CASE WHEN isnan(corr(a, b)) THEN NULL ELSE corr(a, b) END AS ic FROM r GROUP BY 1 HAVING count(*) >= 5), k AS (SELECT d, CASE WHEN count(ic) OVER w >= 10 THEN avg(ic) OVER w END AS ric FROM i WINDOW w AS (ORDER BY d ROWS 19 PRECEDING)), z AS (SELECT d, ric, coalesce(ric < 0, false) AS killed FROM k) SELECT d, round(ric, 5) AS rolling_ic, killed, killed <> coalesce(lag(killed) OVER (ORDER BY d), false) AS switched FROM z")
query("d57_fee_spread", lambda t: rounded(factor.weighted_spread(t.bars.join(F.broadcast(t.master.select("ticker", "sector")), "ticker").withColumn("m", F.trunc("d", "month")), ["sector", "m"], "volume", c("ticker") % 3 == 0)), "SELECT sector, CAST(date_trunc('month', d) AS DATE) AS m, round(avg(volume) FILTER (ticker % 3 = 0) - avg(volume) FILTER (ticker % 3 <> 0), 6) AS spread, count(*) FILTER (ticker % 3 = 0) AS n_with, count(*) FILTER (ticker % 3 <> 0) AS n_without FROM bars JOIN master USING (ticker) GROUP BY 1, 2")
query("d59_quadrants", lambda t: rounded(t.bars.join(t.bars.groupBy("d").agg(F.median("close").alias("mc"), F.median("volume").alias("mv")), "d").withColumn("quadrant", F.concat(F.when(c("close") > c("mc"), "rich").otherwise("cheap"), F.lit("-"), F.when(c("volume") > c("mv"), "busy").otherwise("calm"))).groupBy("quadrant").agg(F.avg(F.log(c("close") / c("open"))).alias("mean"), F.count("*").alias("n")), 5), "WITH m AS (SELECT *, median(close) OVER (PARTITION BY d) AS mc, median(volume) OVER (PARTITION BY d) AS mv FROM bars) SELECT CASE WHEN close > mc THEN 'rich' ELSE 'cheap' END || '-' || CASE WHEN volume > mv THEN 'busy' ELSE 'calm' END AS quadrant, round(avg(ln(close / open)), 5) AS mean, count(*) AS n FROM m GROUP BY 1")

# Owners
_TYPES = "CASE WHEN s % 5 = 0 THEN 'INDIVIDUAL' WHEN s % 5 = 1 THEN 'TRUST_BANK' WHEN s % 5 = 2 THEN 'ASSET_MGMT' WHEN s % 5 = 3 THEN 'COMPANY' ELSE 'UNKNOWN' END"


def _owner_kind():
    n = F.substring_index("name", "#", -1).cast("int") % 5
    return F.when(n == 0, "INDIVIDUAL").when(n == 1, "TRUST_BANK").when(n == 2, "ASSET_MGMT").when(n == 3, "COMPANY").otherwise("UNKNOWN")


query("d25_owner_features", lambda t: rounded(ownership.owner_features(t.holders, ["company"], "json", _owner_kind(), 200), 5), f"WITH h AS (SELECT *, {_TYPES} AS kind FROM holder_list), k AS (SELECT name, count(DISTINCT company) >= 200 AS famous FROM h WHERE kind = 'INDIVIDUAL' GROUP BY 1) SELECT company, arg_min(CASE WHEN kind NOT IN ('TRUST_BANK', 'UNKNOWN') THEN name END, CASE WHEN kind NOT IN ('TRUST_BANK', 'UNKNOWN') THEN rn END) AS real_top, count(*) FILTER (kind IN ('INDIVIDUAL', 'ASSET_MGMT')) AS owners, round(coalesce(sum(ratio) FILTER (kind IN ('INDIVIDUAL', 'ASSET_MGMT')), 0), 5) AS owner_ratio, coalesce(bool_or(famous), false) AS famous FROM h LEFT JOIN k USING (name) GROUP BY 1")
query("d26_name_types", lambda t: t.supplier.select("s_suppkey", ownership.name_type(F.concat(F.element_at(F.array(*(F.lit(x) for x in ("Ｍａｓｔｅｒ Trust Bank", "State Street Nominee", "Alpha Capital", "Beta Insurance Co.", "Taro Yamada", "Gamma Holdings", "42"))), (c("s_suppkey") % 7 + 1).cast("int")), F.lit("")), ownership.RULES).alias("kind")), "SELECT s_suppkey, ['TRUST_BANK', 'CUSTODIAN', 'ASSET_MGMT', 'INSURANCE', 'INDIVIDUAL', 'COMPANY', 'UNKNOWN'][CAST(s_suppkey % 7 AS INTEGER) + 1] AS kind FROM supplier")
query("d77_single_company_names", lambda t: rounded(ownership.single_company_names(t.order_holders, ["company"], "json")), "SELECT name, min(company) AS company, round(max(ratio), 6) AS ratio FROM order_list GROUP BY 1 HAVING count(DISTINCT company) = 1")
query("d35_pairs", lambda t: t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("leader")).join(t.customer, "c_nationkey").where("leader <> c_custkey").groupBy("leader").agg(F.count("*").alias("followers")), "SELECT leader, count(*) AS followers FROM (SELECT c_nationkey, min(c_custkey) AS leader FROM customer GROUP BY 1) JOIN customer USING (c_nationkey) WHERE leader <> c_custkey GROUP BY 1")

# Scores
query("d29_d30_d78_classes", lambda t: rounded(scoring.accuracy(backtest.own_forward_returns(t.bars, (1,)).withColumn("s", (c("volume") % 7) - 3), "s", "f1"), 5), "WITH x AS (SELECT volume % 7 - 3 AS s, lead(close) OVER (PARTITION BY ticker ORDER BY d) / close - 1 AS r FROM bars), y AS (SELECT *, CASE WHEN s >= 2 THEN 'UP' WHEN s <= -2 THEN 'DOWN' ELSE 'NEUTRAL' END AS predicted, CASE WHEN r > 0.02 THEN 'UP' WHEN r < -0.02 THEN 'DOWN' WHEN r IS NOT NULL THEN 'NEUTRAL' END AS actual FROM x) SELECT predicted, count(*) AS n, round(avg(CASE WHEN predicted = actual THEN 1.0 WHEN actual IS NOT NULL THEN 0.0 END), 5) AS hit_rate, round(avg(r), 5) AS mean, round(median(r), 5) AS median FROM y GROUP BY 1")
query("d70_reaction", lambda t: rounded(asof_join(t.corp_events.withColumn("intraday", c("ticker") % 2 == 0), t.bars.select("ticker", "d", (ratio(c("close"), F.lag("close").over(w())) - 1).alias("same"), (ratio(F.lead("close").over(w()), c("close")) - 1).alias("next")), ["ticker"], "event_d", "d").select("ticker", "event_d", F.when(c("intraday"), c("r_same")).otherwise(c("r_next")).alias("reaction"))), "WITH p AS (SELECT ticker, d, close / lag(close) OVER w - 1 AS same, lead(close) OVER w / close - 1 AS nxt FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)) SELECT e.ticker, e.event_d, round(CASE WHEN e.ticker % 2 = 0 THEN same ELSE nxt END, 6) AS reaction FROM corp_events e ASOF LEFT JOIN p ON p.ticker = e.ticker AND e.event_d >= p.d")
query("d62_reconciliation", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(c("l_tax") == 0, "NODATA").when(F.least(*(F.abs(c("l_discount") * k - c("l_tax")) for k in (1, 10, 100))) < 0.005, "OK").otherwise("NG").alias("status")), "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN 'NODATA' WHEN least(abs(l_discount * 1 - l_tax), abs(l_discount * 10 - l_tax), abs(l_discount * 100 - l_tax)) < 0.005 THEN 'OK' ELSE 'NG' END AS status FROM lineitem")
query("d79_exclusions", lambda t: t.customer.join(t.orders.where("o_orderstatus = 'P' and o_orderpriority not like '5%'").select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority NOT LIKE '5%')")
query("d81_flatten", lambda t: t.events.select("event_id", F.explode_outer(F.from_json("props", "map<string,string>")).alias("key", "value")), "SELECT event_id, u.key, json_extract_string(props, '$.' || u.key) AS value FROM events, LATERAL (SELECT unnest(json_keys(props)) AS key) u")
query("d84_adjustments", lambda t: t.part.select("p_partkey", "p_size").crossJoin(F.broadcast(t.spark.createDataFrame([("same", 1, 0), ("plus", 1, 100), ("scale", 10, 0), ("negate", -1, 0)], "kind string, k int, o int"))).where((c("p_size") * c("k") + c("o")) % 7 == 0).groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds")), "SELECT p_partkey, string_agg(kind, ',' ORDER BY kind) AS kinds FROM part, (VALUES ('same', 1, 0), ('plus', 1, 100), ('scale', 10, 0), ('negate', -1, 0)) v(kind, k, o) WHERE (p_size * k + o) % 7 = 0 GROUP BY 1")
