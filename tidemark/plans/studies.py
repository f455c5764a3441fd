"""Studies in whole: statements of eight measures, benchmarks, factor residuals, series tests, model areas, positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest, factor, fundamentals, models, pairs, resampling, screens, series, technicals
from ..operators.windows import over
from ..sources.tables import stored
from .fixtures import query, rounded
from .research import _model_rows

c = F.col
w = lambda: over(["ticker"], ["d"])

# D3: eight measures, of all lines and of odd ones
_MEASURES = {f"{side}{name}": (column, odd) for side, odd in (("", False), ("own_", True)) for name, column in (("sales", "l_extendedprice"), ("operating", "l_quantity"), ("ordinary", "l_discount"), ("net", "l_tax"))}


def _statements(t):
    amount = lambda column, odd: F.sum(F.when((c("l_linenumber") % 2 == 1) | F.lit(not odd), c(column).cast("decimal(18,2)")).otherwise(0))
    x = t.lineitem.groupBy(c("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("fy"), F.quarter("l_shipdate").alias("n")).agg(F.max(F.to_date("l_shipdate")).alias("disclosed"), *(amount(*v).alias(k) for k, v in _MEASURES.items()))
    x = x.withColumns({k: F.sum(k).over(over(["ticker", "fy"], ["n"])).cast("double") for k in _MEASURES})
    x = x.select("ticker", "fy", F.when(c("n") == 4, "FY").otherwise(F.concat(c("n").cast("string"), F.lit("Q"))).alias("q"), "n", "disclosed", *_MEASURES)
    return x.unionByName(x.where("(ticker + n) % 7 = 0").withColumns({"disclosed": F.date_add("disclosed", 5), **{k: c(k) * 1.01 for k in _MEASURES}}))


def _eight_measures(t):
    return rounded(fundamentals.standalone_quarters(_statements(t), ["ticker"], "fy", "q", [c("disclosed").desc()], list(_MEASURES)), 4)


_each = lambda form: ", ".join(form.format(k=k, col=col, test="l_linenumber % 2 = 1" if odd else "true") for k, (col, odd) in _MEASURES.items())
query("d3_eight_measures", _eight_measures, f"""
    WITH o AS (SELECT l_suppkey AS ticker, year(l_shipdate) AS fy, quarter(l_shipdate) AS n, max(CAST(l_shipdate AS DATE)) AS disclosed,
                      {_each("sum(CASE WHEN {test} THEN CAST({col} AS DECIMAL(18,2)) ELSE 0 END) AS {k}")} FROM lineitem GROUP BY 1, 2, 3),
    s AS (SELECT ticker, fy, n, disclosed, {_each("CAST(sum({k}) OVER y AS DOUBLE) AS {k}")} FROM o WINDOW y AS (PARTITION BY ticker, fy ORDER BY n)),
    a AS (SELECT * FROM s UNION ALL SELECT ticker, fy, n, disclosed + 5, {_each("{k} * 1.01")} FROM s WHERE (ticker + n) % 7 = 0),
    r AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY ticker, fy, n ORDER BY disclosed DESC) = 1)
    SELECT ticker, fy, n || 'Q' AS q, n, disclosed, {_each("round({k} - coalesce(lag({k}) OVER (PARTITION BY ticker, fy ORDER BY n), 0), 4) AS {k}")} FROM r""")

# D14 and D15: all windows, benchmark returns; train and test
_BACK, _AHEAD, _HOLDS = (5, 10, 20, 40), (1, 3, 5), (60, 120, 250)


def _study(t):
    x = backtest.event_study(t.corp_events, t.bars, _BACK, _AHEAD)
    return rounded(backtest.with_benchmark(x, t.market, _BACK, _AHEAD).drop("close", "volume", "volume_ratio"), 5)


def _windows(prefix: str, order: str) -> str:
    back = [f"close / lag(close, {k}) OVER ({order}) - 1 AS {prefix}b{k}" for k in _BACK]
    return ", ".join(back + [f"lead(close, {k}) OVER ({order}) / close - 1 AS {prefix}a{k}" for k in _AHEAD])


_names = [f"{p}{s}{k}" for p in ("", "m_") for s, ks in (("b", _BACK), ("a", _AHEAD)) for k in ks]
query("d14_benchmark_study", _study, f"""
    WITH p AS (SELECT ticker, d, {_windows("", "PARTITION BY ticker ORDER BY d")} FROM bars), m AS (SELECT d, {_windows("m_", "ORDER BY d")} FROM market)
    SELECT e.ticker, e.event_d, p.d, {", ".join(f"round({n}, 5) AS {n}" for n in _names)}
    FROM corp_events e ASOF LEFT JOIN p ON p.ticker = e.ticker AND e.event_d >= p.d LEFT JOIN m ON m.d = p.d""")


def _split(t):
    x = backtest.abnormal_returns(t.corp_events, t.bars, t.market, _HOLDS)
    return rounded(backtest.split_summary(x, "event_d", F.lit("1996-01-01").cast("date"), [f"car{h}" for h in _HOLDS]), 5)


query("d15_train_test", _split, f"""
    WITH m AS (SELECT d, {", ".join(f"lead(close, {h}) OVER (ORDER BY d) / close - 1 AS m{h}" for h in _HOLDS)} FROM market),
    p AS (SELECT b.ticker, b.d, {", ".join(f"lead(close, {h}) OVER w / close - 1 - m{h} AS c{h}" for h in _HOLDS)} FROM bars b JOIN m ON m.d = b.d WINDOW w AS (PARTITION BY ticker ORDER BY b.d)),
    e AS (SELECT e.event_d, p.* FROM corp_events e ASOF LEFT JOIN p ON p.ticker = e.ticker AND e.event_d >= p.d),
    u AS ({" UNION ALL ".join(f"SELECT event_d, 'car{h}' AS value, c{h} AS r FROM e" for h in _HOLDS)})
    SELECT CASE WHEN event_d < DATE '1996-01-01' THEN 'train' ELSE 'test' END AS sample, value, count(*) AS n, round(avg(r), 5) AS mean,
           round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 5) AS win_rate, round(avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0), 5) AS t
    FROM u WHERE r IS NOT NULL GROUP BY 1, 2""")
query("d53_event_shorts", lambda t: rounded(backtest.event_shorts(t.corp_events, t.bars, 10, 0.002).select("ticker", "event_d", "net"), 5), """
    WITH p AS (SELECT ticker, d, lead(open, 1) OVER w AS entry, lead(close, 11) OVER w AS exit FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d))
    SELECT e.ticker, e.event_d, round(-(exit / entry - 1) - 0.002, 5) AS net FROM corp_events e ASOF JOIN p ON p.ticker = e.ticker AND e.event_d >= p.d WHERE exit / entry IS NOT NULL""")

# D44, D45, D46, D62, D82
query("d44_stance", lambda t: technicals.timing_stance(t.bars10, [0, 1, 2, 3, 4], [4]), """
    WITH x AS (SELECT ticker, d, close, avg(close) OVER s AS sma, count(*) OVER s AS k FROM bars10 WHERE ticker < 5 WINDOW s AS (PARTITION BY ticker ORDER BY d ROWS 199 PRECEDING)),
    g AS (SELECT d, count(*) FILTER (CASE WHEN ticker = 4 THEN close < sma ELSE close > sma END) AS buys, count(*) AS n FROM x WHERE k >= 200 GROUP BY 1)
    SELECT d, buys, CASE WHEN buys >= 4 THEN 'on' WHEN buys >= 3 THEN 'rather on' WHEN buys >= 2 THEN 'neutral' ELSE 'off' END AS stance FROM g WHERE n = 5""")
def _days(t):
    x = t.lineitem.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum("l_extendedprice").alias("turnover"), F.sum("l_quantity").alias("volume"))
    return x.select("d", F.when(F.dayofmonth("d") % 3 > 0, c("turnover")).alias("a"), (c("turnover") / c("volume")).alias("b"), (c("volume") / 40).alias("m"))


query("d45_three_conditions", lambda t: technicals.tail_risk(_days(t), "a", "b", "m", 0.9, 0.25, 70.0).select("d", "conditions", "signal"), """
    WITH x AS (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) AS turnover, sum(l_extendedprice) / sum(l_quantity) AS b, sum(l_quantity) / 40 AS m FROM lineitem GROUP BY 1),
    y AS (SELECT d, last_value(CASE WHEN day(d) % 3 > 0 THEN turnover END IGNORE NULLS) OVER (ORDER BY d) AS a, b, m FROM x),
    z AS (SELECT d, coalesce(a >= (SELECT quantile_cont(a, 0.9) FROM y), false)::INTEGER + coalesce(b <= (SELECT quantile_cont(b, 0.25) FROM y), false)::INTEGER + coalesce(m >= 70, false)::INTEGER AS conditions FROM y)
    SELECT d, conditions, conditions = 3 AS signal FROM z""")
query("d46_sector_excess", lambda t: rounded(technicals.sector_excess(t.bars, t.market, t.master.select("ticker", "sector"), 20), 4), """
    WITH x AS (SELECT b.ticker, d, sector, close / lag(close, 20) OVER (PARTITION BY b.ticker ORDER BY d) - 1 AS r FROM bars b JOIN master USING (ticker)),
    m AS (SELECT d, close / lag(close, 20) OVER (ORDER BY d) - 1 AS m FROM market),
    g AS (SELECT d, sector, avg(r) AS r FROM x WHERE r IS NOT NULL GROUP BY 1, 2), e AS (SELECT d, sector, 100 * (r - m) AS excess FROM g JOIN m USING (d) WHERE m IS NOT NULL)
    SELECT d, sector, round(excess, 4) AS excess, CASE WHEN excess > 1 THEN 'BUY' WHEN excess < -1 THEN 'SELL' ELSE 'FLAT' END AS label FROM e""")


def _reconciled(t):
    cents = F.round(c("l_extendedprice") * 100).cast("long")
    digits = F.when(c("l_partkey") % 11 == 0, "n/a").otherwise(cents.cast("string"))
    tenths = F.floor(cents / 10)
    far = F.concat((F.floor(tenths / 10) + c("l_partkey") % 3).cast("string"), F.lit(".0"))
    other = F.when(c("l_partkey") % 7 == 0, None).when(c("l_partkey") % 13 == 0, "-").when(c("l_partkey") % 5 == 0, far).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")))
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", digits.alias("own"), other.alias("other"))
    return rounded(screens.reconciled(x, "own", "other", F.lit(0.01), F.lit(0.0)), 4)


query("d62_display_match", _reconciled, """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100, 0) AS BIGINT) AS k FROM lineitem WHERE l_partkey % 11 > 0),
    y AS (SELECT *, CAST(k AS VARCHAR) AS own, CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN '-' WHEN l_partkey % 5 = 0 THEN (k // 100 + l_partkey % 3) || '.0' ELSE (k // 100) || '.' || (k // 10 % 10) END AS other,
                 CASE WHEN l_partkey % 5 = 0 THEN (k // 100 + l_partkey % 3)::DOUBLE ELSE (k // 10) / 10::DOUBLE END AS v FROM x),
    z AS (SELECT *, CASE WHEN v = floor(v) THEN 1 ELSE 10 END AS unit, k * 0.01::DOUBLE AS m FROM y),
    d AS (SELECT *, least(abs(v - round_even(m * unit, 0) / unit), abs(v - floor(m * unit) / unit), abs(v - ceil(m * unit) / unit)) AS far FROM z)
    SELECT l_orderkey, l_linenumber, l_partkey, own, other, CASE WHEN other IS NULL THEN 'NODATA' WHEN other = '-' THEN 'NON_NUMERIC' WHEN far <= 0.5 THEN 'OK' ELSE 'NG' END AS status,
           CASE WHEN other IS NULL OR other = '-' THEN NULL WHEN far < 1e-9 THEN 0.0 ELSE round(far, 3) END AS diff FROM d""")

# D22 and D74: two scores before events, in windows of days
_WINDOWS, _BOUNDS = (10, 15, 30, 60, 90), (0.5, 0.8, 0.95, 1.2)


def _two_scores(t):
    return t.bars.select("ticker", "d", (c("volume") / 50).alias("a"), (c("turnover") / 50_000).alias("b"))


def _detection_deltas(t):
    maxima = backtest.window_maxima(_two_scores(t), t.corp_events, "ticker", "d", "event_d", ["a", "b"], _WINDOWS)
    return rounded(backtest.detection_rates(maxima, ["a", "b"], _WINDOWS, _BOUNDS), 5)


query("d74_detection_deltas", _detection_deltas, f"""
    WITH s AS (SELECT ticker, d, volume / 50 AS a, turnover / 50000 AS b FROM bars),
    k AS (SELECT DISTINCT x::DATE AS day, sum(CASE WHEN isodow(x) <= 5 THEN 1 ELSE 0 END) OVER (ORDER BY x) AS n, isodow(x) <= 5 AS work FROM generate_series(DATE '1994-01-03', DATE '2003-01-01', INTERVAL 1 DAY) g(x)),
    e AS (SELECT ticker, event_d, n - CASE WHEN work THEN 1 ELSE 0 END AS last FROM corp_events JOIN k ON day = event_d), wk AS (SELECT n, day FROM k WHERE work),
    m AS (SELECT w.n AS window_days, e.ticker, e.event_d, max(a) AS a, max(b) AS b FROM e, (VALUES {', '.join(f'({n})' for n in _WINDOWS)}) w(n), wk p, wk q, s
          WHERE p.n = e.last - w.n + 1 AND q.n = e.last AND s.ticker = e.ticker AND s.d BETWEEN p.day AND q.day GROUP BY 1, 2, 3),
    g AS (SELECT window_days, t AS threshold, count(*) FILTER (a >= t) AS detected_a, count(a) AS total_a, count(*) FILTER (b >= t) AS detected_b, count(b) AS total_b FROM m, (VALUES {', '.join(f'({x}::DOUBLE)' for x in _BOUNDS)}) v(t) GROUP BY 1, 2)
    SELECT *, round(detected_a / total_a, 5) AS rate_a, round(detected_b / total_b, 5) AS rate_b, round(detected_b / total_b - detected_a / total_a, 5) AS delta FROM g""")

query("d22_detection_lift", lambda t: rounded(backtest.detection_lift(_two_scores(t), t.corp_events, "ticker", "d", "event_d", ["a", "b"], (10, 30, 90), _BOUNDS), 5), f"""
    WITH s AS (SELECT ticker, d, volume / 50 AS a, turnover / 50000 AS b FROM bars),
    h AS (SELECT DISTINCT x.ticker, s.d FROM (SELECT ticker, event_d - CASE isodow(event_d) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS day FROM corp_events) x ASOF JOIN s ON s.ticker = x.ticker AND x.day >= s.d),
    m AS ({" UNION ALL ".join(f"SELECT ticker, d, '{x}' AS score, {n} AS window_days, max({x}) OVER (PARTITION BY ticker ORDER BY d ROWS {n - 1} PRECEDING) AS v FROM s" for x in "ab" for n in (10, 30, 90))}),
    r AS (SELECT m.*, h.ticker IS NOT NULL AS hit FROM m LEFT JOIN h USING (ticker, d) WHERE d IN (SELECT d FROM h)),
    g AS (SELECT score, window_days, t AS threshold, count(*) FILTER (hit) AS n_events, count(*) FILTER (NOT hit) AS n_others, count(*) FILTER (hit AND v >= t) AS tp, count(*) FILTER (NOT hit AND v >= t) AS fp FROM r, (VALUES {', '.join(f'({x}::DOUBLE)' for x in _BOUNDS)}) v(t) GROUP BY 1, 2, 3)
    SELECT score, window_days, threshold, n_events, n_others, round(tp / n_events, 5) AS tpr, round(fp / n_others, 5) AS fpr, CASE WHEN fp > 0 THEN round((tp / n_events) / (fp / n_others), 5) ELSE 'Infinity'::DOUBLE END AS lift FROM g""")

query("d82_positions", lambda t: rounded(factor.positions(t.bars.select("ticker", "d", (c("close") / c("open") - 1).alias("s")), "d", "s", 3, "ticker", F.month("d") == 2, 1e5), 6), """
    WITH x AS (SELECT ticker, d, close / open - 1 AS s FROM bars),
    p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY d ORDER BY s DESC, ticker) <= 3 THEN 'LONG' WHEN row_number() OVER (PARTITION BY d ORDER BY s, ticker) <= 3 THEN 'SHORT' ELSE 'NONE' END AS position, CAST(row_number() OVER (PARTITION BY d ORDER BY abs(s) DESC, ticker) AS INTEGER) AS rank FROM x)
    SELECT ticker, d, round(s, 6) AS s, position, rank, CASE WHEN month(d) = 2 OR position = 'NONE' THEN 0.0 ELSE 100000.0 END AS size FROM p""")


# D47 to D49: three factors, what they leave, and how that moves together
def _factor_panel(t):
    x = t.bars.join(F.broadcast(t.master.select("ticker", "sector", "area", "size")), "ticker").withColumn("r", F.log(c("close") / F.lag("close").over(w()))).where("r is not null")
    x = stored(x.select("ticker", "d", "r", "area", "size"), "returns")  # for the means, and for what they are joined to
    return factor.equal_weight_factors(x, "d", "r", ["area", "size"]).withColumn("y", F.year("d"))


def _three_factors(t):
    x = _factor_panel(t).select("ticker", "d", "y", "r", "mkt", "f_area", "f_size").repartition(t.tasks, "ticker", "y")  # sums and residuals follow it
    return rounded(factor.factor_residuals(x, ["mkt", "f_area", "f_size"], "r", ["ticker", "y"]), 6)


query("d47_three_factors", _three_factors)


def _months(t):
    """Sums by month, a small table that what follows reads several times."""
    x = _three_factors(t).where("residual is not null").groupBy("ticker", "y", F.trunc("d", "month").alias("m")).agg(F.sum("residual").alias("e"))
    return stored(x, "months")


def _residual_clusters(t):
    return models.correlation_clusters(_months(t), "ticker", "m", "e", 6, 4).select("ticker", "cluster")


query("d48_residual_clusters", _residual_clusters)


def _stable_pairs(t):
    x = t.bars.join(F.broadcast(t.master.select("ticker", "sector")), "ticker").withColumn("r", F.log(c("close") / F.lag("close").over(w()))).where("r is not null")
    x = x.withColumn("e", c("r") - F.avg("r").over(over(["d"]))).groupBy("sector", "ticker", F.trunc("d", "month").alias("m")).agg(F.sum("e").alias("e")).withColumn("y", F.year("m"))
    return rounded(pairs.low_pairs(x, "sector", "ticker", "m", "y", "e", 0.7, 6, 3).drop("mean"), 5)


query("d49_stable_pairs", _stable_pairs, """
    WITH x AS (SELECT b.ticker, d, sector, ln(close / lag(close) OVER (PARTITION BY b.ticker ORDER BY d)) AS r FROM bars b JOIN master USING (ticker) QUALIFY r IS NOT NULL),
    e AS (SELECT ticker, sector, d, r - avg(r) OVER (PARTITION BY d) AS e FROM x), m AS (SELECT sector, ticker, date_trunc('month', d) AS m, sum(e) AS e FROM e GROUP BY 1, 2, 3),
    p AS (SELECT a.sector, a.ticker AS a, b.ticker AS b, year(a.m) AS y, abs(corr(a.e, b.e)) AS r, count(*) AS n FROM m a JOIN m b ON a.sector = b.sector AND a.m = b.m AND a.ticker < b.ticker GROUP BY 1, 2, 3, 4 HAVING count(*) >= 6)
    SELECT sector, a, b, count(*) AS years, round(max(r), 5) AS worst FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND max(r) <= 0.7""")


def _monthly_residuals(t):
    return _months(t).join(F.broadcast(t.master.select("ticker", "sector")), "ticker")


query("d49_low_residual_pairs", lambda t: rounded(pairs.low_pairs(_monthly_residuals(t), "sector", "ticker", "m", "y", "e", 0.5, 6, 3, absolute=False), 5))
query("d48_ward_tree", lambda t: rounded(pairs.ward_tree(_monthly_residuals(t), ["sector"], "ticker", "m", "e", 12), 5))
query("d48_ward_clusters", lambda t: pairs.ward_clusters(_monthly_residuals(t), ["sector"], "ticker", "m", "e", height=0.95, least=12))


def _factor_movers(t):
    """D50: the twenty names whose own moves, which no factor explains, add up to most over a period."""
    x = _three_factors(t).where("d >= '2001-01-01' and residual is not null").groupBy("ticker").agg(F.sum(c("alpha") + c("residual")).alias("own"), F.sum("r").alias("total"))
    return rounded(x.orderBy(F.abs("own").desc(), "ticker").limit(20), 5)


query("d50_factor_movers", _factor_movers)

# M5, M9, M10, M11
def _tuned(t):
    scored = models.tuned_walk_forward(_model_rows(t), "y", ["day", "gap", "volume_ratio", "r5", "r20"], "label", [1998, 2000, 2002])
    return rounded(series.curve_areas(scored, ["y", "depth"], "score", "label"), 3)


query("m9_tuned_walk_forward", _tuned)

_DAY_FEATURES = ["day", "gap", "volume_ratio", "r5", "r20"]


def _rare_rows(t):
    """Rows of the panel of all names; those that rise very much within five days are the rare ones."""
    x = technicals.technical_features(t.bars).withColumn("f5", F.lead("close", 5).over(w()) / c("close") - 1)
    x = x.dropna(subset=["f5", *_DAY_FEATURES])
    return x.select((c("ticker") * 100_000 + F.unix_date("d")).alias("id"), "ticker", "d", F.year("d").alias("y"), *_DAY_FEATURES, F.quarter("d").alias("quarter"), F.dayofweek("d").alias("weekday"), (c("f5") > 30).cast("double").alias("label"))


def _resampled(t):
    scored = models.resampled_walk_forward(_rare_rows(t), "y", "id", _DAY_FEATURES, ["quarter", "weekday"], "label", [1998, 2000, 2002])
    return rounded(series.curve_areas(scored, ["y", "resampled"], "score", "label"), 3)


query("m9_resampled_walk_forward", _resampled)


def _buyers(t):
    """Customers by their orders; one with a large urgent order that is partly done is rare."""
    o = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), (F.sum(c("o_totalprice").cast("decimal(18,2)")).cast("double") / 1e5).alias("total"), F.max(F.when((c("o_orderstatus") == "P") & (c("o_totalprice") > 400_000) & c("o_orderpriority").like("1%"), 1).otherwise(0)).alias("label"))
    return t.customer.join(o, "c_custkey").select("c_custkey", "label", c("n").cast("double").alias("n"), "total", (c("c_acctbal") / 1e3).alias("balance"), "c_mktsegment", "c_nationkey")


query("m9_tomek_links", lambda t: resampling.tomek_links(_buyers(t), "c_custkey", "label", ["n", "total", "balance"], ["c_mktsegment", "c_nationkey"]), """
    WITH o AS (SELECT o_custkey AS id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e5 AS total, max(CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 AND o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS label FROM orders GROUP BY 1),
    x AS (SELECT o.*, c_acctbal / 1e3 AS balance, c_mktsegment AS s, c_nationkey AS k FROM o JOIN customer ON c_custkey = id),
    f AS (SELECT a.id, a.label, b.id AS near, b.label AS other, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.n - b.n) * (a.n - b.n) + (a.total - b.total) * (a.total - b.total) + (a.balance - b.balance) * (a.balance - b.balance) + CASE WHEN a.s <> b.s THEN 1 ELSE 0 END + CASE WHEN a.k <> b.k THEN 1 ELSE 0 END), b.id) AS r
          FROM x a JOIN x b ON a.id <> b.id QUALIFY r = 1)
    SELECT f.id AS rare, g.id AS other FROM f JOIN f g ON f.near = g.id AND g.near = f.id WHERE f.label = 1 AND g.label = 0""")


def _between(t):
    new = resampling.between_neighbours(_buyers(t), "c_custkey", "label", ["n", "total", "balance"], ["c_mktsegment", "c_nationkey"], 0.5)
    return rounded(new, 6)


query("m9_between_neighbours", _between)
query("m5_unit_roots", lambda t: rounded(series.unit_roots(technicals.weekly_closes(t.bars10).select("ticker", "week", F.log("close").alias("x")), ["ticker"], "week", "x", 0), 4), """
    WITH k AS (SELECT ticker, CAST(date_trunc('week', d) AS DATE) AS week, ln(arg_max(close, d)) AS x FROM bars10 GROUP BY 1, 2),
    l AS (SELECT ticker, x - lag(x) OVER p AS dx, lag(x) OVER p AS x1 FROM k WINDOW p AS (PARTITION BY ticker ORDER BY week) QUALIFY x1 IS NOT NULL),
    g AS (SELECT ticker, count(*) AS n, regr_slope(dx, x1) AS b, regr_syy(dx, x1) AS syy, regr_sxx(dx, x1) AS sxx FROM l GROUP BY 1)
    SELECT ticker, n, CASE WHEN n >= 30 THEN round(b, 4) END AS rho, CASE WHEN n >= 30 THEN round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 4) END AS t FROM g""")
query("m5_vector_autoregression", lambda t: rounded(series.vector_autoregression(_days(t).select("d", (c("b") / 1000).alias("a"), (c("m") / 10).alias("b")), "d", ["a", "b"], 2), 4))
query("m5_many_tests", lambda t: rounded(series.corrected(t.lineitem.groupBy("l_suppkey", "l_returnflag").agg((F.sum(c("l_discount").cast("decimal(18,2)")).cast("double") % 1).alias("p")).select("l_suppkey", "l_returnflag", F.when(c("p") > 0, c("p")).alias("p")), ["l_returnflag"], "p"), 5), """
    WITH x AS (SELECT l_suppkey, l_returnflag, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) % 1 AS p FROM lineitem GROUP BY 1, 2),
    y AS (SELECT l_suppkey, l_returnflag, CASE WHEN p > 0 THEN p END AS p FROM x),
    r AS (SELECT *, count(p) OVER (PARTITION BY l_returnflag) AS n, count(p) OVER (PARTITION BY l_returnflag ORDER BY p RANGE UNBOUNDED PRECEDING) AS k FROM y WHERE p IS NOT NULL)
    SELECT l_suppkey, l_returnflag, round(p, 5) AS p, round(least(1, min(p * n / k) OVER (PARTITION BY l_returnflag ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 5) AS q, round(least(1, p * n), 5) AS bonferroni FROM r
    UNION ALL SELECT l_suppkey, l_returnflag, NULL, NULL, NULL FROM y WHERE p IS NULL""")
query("m11_areas", lambda t: rounded(series.curve_areas(t.bars10.select("ticker", (c("volume") % 50).alias("s"), (c("close") > c("open")).alias("y")), ["ticker"], "s", "y"), 5), """
    WITH x AS (SELECT ticker, volume % 50 AS s, CASE WHEN close > open THEN 1.0 ELSE 0.0 END AS y FROM bars10), u AS (SELECT ticker, s, sum(y) AS p, sum(1 - y) AS q FROM x GROUP BY 1, 2),
    k AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM u WINDOW w AS (PARTITION BY ticker ORDER BY s DESC))
    SELECT ticker, CAST(sum(p + q) AS BIGINT) AS n, round(sum(q * (tp - p / 2)) / nullif(sum(p) * sum(q), 0), 5) AS roc, round(sum(p * tp / (tp + fp)) / nullif(sum(p), 0), 5) AS pr FROM k GROUP BY 1""")
query("m10_group_folds", lambda t: rounded(series.curve_areas(models.group_folds(_model_rows(t), "ticker", ["day", "gap", "volume_ratio", "r5", "r20"], "label"), ["fold"], "score", "label"), 3))
