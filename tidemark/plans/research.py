"""Longer studies: guidance, cascades, portfolios by year, models, filings, pages, and the remaining small operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.maths import clip, ratio
from ..operators import backtest, factor, models, screens, series, technicals, vectors
from ..operators.asof import asof_join
from ..operators.windows import latest_by, over, top_n
from ..sources import facts, tables
from ..streaming import monitor
from .fixtures import query, rounded
from .texts import scratch

c = F.col


def w():
    return over(["ticker"], ["d"])


# Guidance and cascades
def _years(t):
    x = t.fin_quarters.groupBy("ticker", "fy").agg(F.sum("own").cast("double").alias("actual"), F.min("disclosed").alias("disclosed"))
    y = over(["ticker"], ["fy"])
    return x.withColumns({"previous": F.lag("actual").over(y), "initial": c("actual") * (0.8 + (c("ticker") * 7 + c("fy")) % 5 / 10)})


_YEARS = "WITH y AS (SELECT *, lag(actual) OVER (PARTITION BY ticker ORDER BY fy) AS previous, actual * (0.8::DOUBLE + (ticker * 7 + fy) % 5 / 10::DOUBLE) AS initial FROM (SELECT ticker, fy, CAST(sum(own) AS DOUBLE) AS actual, min(disclosed) AS disclosed FROM fin_quarters GROUP BY 1, 2))"
query("d33_j7_guidance_screen", lambda t: rounded(screens.guidance_screen(_years(t), t.bars, -0.0, 0.2, 1, 0.3).select("ticker", "tries", "hits", "mean_landing", "rate"), 5), _YEARS + """, z AS (SELECT y.ticker, y.fy, initial, previous, actual, (SELECT arg_max(close, d) FROM bars b WHERE b.ticker = y.ticker AND b.d < disclosed) AS b, (SELECT arg_min(close, d) FROM bars b WHERE b.ticker = y.ticker AND b.d > disclosed) AS a FROM y WHERE previous > 0 AND initial > 0),
    f AS (SELECT *, coalesce((initial - previous) / abs(previous) <= 0, false) AND coalesce(a / b - 1 <= 0.2, false) AS wf, (actual - initial) / abs(initial) AS land FROM z), g AS (SELECT ticker, count(*) FILTER (wf) AS tries, count(*) FILTER (wf AND land >= 0) AS hits, avg(land) AS ml FROM f GROUP BY 1) SELECT ticker, tries, hits, round(ml, 5) AS mean_landing, round(hits / nullif(tries, 0), 5) AS rate FROM g WHERE hits >= 1""")


def _cascade(t):
    pairs = t.master.groupBy("sector").agg(F.min("ticker").alias("leader")).join(t.master.select("sector", c("ticker").alias("follower")), "sector").where("leader <> follower").select("leader", "follower")
    return screens.cascade_trades(pairs, t.corp_events.withColumn("intraday", c("ticker") % 2 == 0), t.bars10.select((c("ticker") + 1).alias("ticker"), "d", "open", "close").unionByName(t.bars.where("ticker > 10 or ticker = 0").select("ticker", "d", "open", "close")), t.calendar, 60, 0.001, 0.02)


query("d36_cascade_trades", lambda t: rounded(_cascade(t).select("leader", "follower", "event_n", "side", "days", "net"), 5), """WITH px AS (SELECT ticker + 1 AS ticker, n, open, close FROM bars10 JOIN calendar USING (d) UNION ALL SELECT ticker, n, open, close FROM bars JOIN calendar USING (d) WHERE ticker > 10 OR ticker = 0),
    ev AS (SELECT ticker, n, ticker % 2 = 0 AS intra FROM corp_events JOIN calendar ON d = event_d), r AS (SELECT ev.ticker AS leader, ev.n AS event_n, p1.n AS rn, p1.close / p0.close - 1 AS rx FROM ev JOIN px p0 ON p0.ticker = ev.ticker AND p0.n = ev.n - CASE WHEN intra THEN 1 ELSE 0 END JOIN px p1 ON p1.ticker = ev.ticker AND p1.n = p0.n + 1 WHERE p1.close / p0.close - 1 <> 0),
    pr AS (SELECT m.l AS leader, master.ticker AS follower FROM (SELECT sector, min(ticker) AS l FROM master GROUP BY 1) m JOIN master USING (sector) WHERE m.l <> master.ticker),
    x AS (SELECT leader, follower, event_n, rn + 1 AS en, rx, least(coalesce((SELECT min(n) FROM ev WHERE ev.ticker = follower AND n > event_n) - 1, rn + 61), rn + 61) AS xn FROM r JOIN pr USING (leader))
    SELECT leader, follower, event_n, CASE WHEN rx > 0 THEN 1 ELSE -1 END AS side, (xn - en)::INTEGER AS days, round(CASE WHEN rx > 0 THEN 1 ELSE -1 END * (b.close / a.open - 1) - 0.002 - CASE WHEN rx < 0 THEN 0.02 * (xn - en) / 252 ELSE 0 END, 5) AS net FROM x JOIN px a ON a.ticker = follower AND a.n = en JOIN px b ON b.ticker = follower AND b.n = xn WHERE xn > en""")
query("d37_reactions", lambda t: rounded(screens.reactions(t.corp_events, t.bars, 5), 5), "SELECT ticker, event_d, round(arg_max(close, d) FILTER (d < event_d), 5) AS last_before, round(arg_min(close, d) FILTER (d > event_d), 5) AS first_after, round(max(close), 5) AS highest, round(min(close), 5) AS lowest FROM corp_events JOIN bars USING (ticker) WHERE d BETWEEN event_d - 5 AND event_d + 5 GROUP BY 1, 2")
query("d38_pair_filter", lambda t: rounded(screens.pair_filter(t.bars10.withColumn("net", c("close") - c("open")).select("ticker", "d", "net"), ["ticker"], "d", "net", 10, 0.6).select("ticker", "d", "hit_rate"), 5), "SELECT ticker, d, round(h, 5) AS hit_rate FROM (SELECT ticker, d, CASE WHEN count(*) OVER w = 10 THEN avg(CASE WHEN close - open > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w END AS h FROM bars10 WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE h >= 0.6::DOUBLE")
query("d34_hold_backtest", lambda t: rounded(backtest.own_forward_returns(t.bars, (5,)).join(t.corp_events.withColumnRenamed("event_d", "d"), ["ticker", "d"], "left_semi").where("f5 is not null").groupBy("ticker").agg(F.count("*").alias("n"), F.avg("f5").alias("mean"), F.avg((c("f5") > 0).cast("double")).alias("win")), 5), "SELECT ticker, count(*) AS n, round(avg(f), 5) AS mean, round(avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END), 5) AS win FROM (SELECT ticker, d, lead(close, 5) OVER (PARTITION BY ticker ORDER BY d) / close - 1 AS f FROM bars) b WHERE f IS NOT NULL AND EXISTS (SELECT 1 FROM corp_events e WHERE e.ticker = b.ticker AND e.event_d = b.d) GROUP BY 1")
query("d65_yearly_portfolio", lambda t: rounded(screens.yearly_portfolio(t.fin_quarters.groupBy("ticker", c("fy").alias("y")).agg(F.sum("own").cast("double").alias("s")), t.bars, "y", "s", 0.1, 0.001), 4), "WITH s AS (SELECT ticker, fy AS y, row_number() OVER (PARTITION BY fy ORDER BY CAST(sum(own) AS DOUBLE) DESC, ticker) AS rk, count(*) OVER (PARTITION BY fy) AS n FROM fin_quarters GROUP BY 1, 2), p AS (SELECT y, b.ticker, arg_max(close, d) / arg_min(close, d) - 1 AS r FROM bars b JOIN s ON s.ticker = b.ticker AND s.y = year(d - INTERVAL 5 MONTH) WHERE rk <= greatest(1, floor(n * 0.1)) GROUP BY 1, 2) SELECT y, round(avg(r) - 0.002, 4) AS mean, count(*) AS names FROM p GROUP BY 1")


def _companies(t):
    return t.master.select("ticker", F.abs("balance").alias("cash"), F.when(c("ticker") % 3 == 0, c("balance") / 2).alias("short_securities"), (c("ticker") * 10.0).alias("long_securities"), F.when(c("ticker") % 2 == 0, F.lit(900.0)).alias("liabilities"), F.lit(100.0).alias("shares"), F.when(c("ticker") % 5 == 0, F.lit(10.0)).alias("own_shares"), (c("ticker") + 20.0).alias("price"), F.when(c("ticker") % 4 > 0, c("ticker") - 8.0).alias("forecast"), F.lit(50.0).alias("actual"))


query("d55_net_cash", lambda t: rounded(screens.net_cash_screen(_companies(t), 0.3).select("ticker", "market_value", "net_cash_ratio", "per"), 5), "WITH x AS (SELECT ticker, abs(balance) + coalesce(CASE WHEN ticker % 3 = 0 THEN balance / 2 END, 0) + 0.7 * (ticker * 10.0) - coalesce(CASE WHEN ticker % 2 = 0 THEN 900.0 END, 0) AS net, (ticker + 20.0) * (100.0 - CASE WHEN ticker % 5 = 0 THEN 10.0 ELSE 0 END) AS mv, coalesce(nullif(CASE WHEN ticker % 4 > 0 THEN ticker - 8.0 END, 0), 50.0) AS pf FROM master) SELECT ticker, round(mv::DOUBLE, 5) AS market_value, round(net::DOUBLE / mv::DOUBLE, 5) AS net_cash_ratio, round(mv::DOUBLE / pf::DOUBLE, 5) AS per FROM x WHERE net::DOUBLE / mv::DOUBLE >= 0.3")
query("d63_compare", lambda t: facts.compared(t.customer.where("c_custkey % 7 > 0").select("c_custkey", F.when(c("c_custkey") % 11 > 0, c("c_acctbal")).alias("v")), t.customer.where("c_custkey % 5 > 0").select("c_custkey", F.when(c("c_custkey") % 3 == 0, c("c_acctbal") * 1.05).otherwise(c("c_acctbal")).alias("v")), ["c_custkey"], "v"), "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN 'MISS' WHEN c_custkey % 11 = 0 THEN 'NULL' WHEN c_custkey % 3 = 0 AND c_acctbal <> 0 THEN 'DIFF' ELSE 'OK' END AS status FROM customer WHERE c_custkey % 7 > 0 OR c_custkey % 5 > 0")
query("d68_month_alerts", lambda t: rounded(screens.month_alerts(t.bars.groupBy("ticker", F.trunc("d", "month").alias("m")).agg(F.sum("volume").alias("v")).withColumn("v", F.when(F.month("m") % 5 > 0, c("v"))), "ticker", "m", "v", 0.3), 4), "WITH x AS (SELECT ticker, CAST(date_trunc('month', d) AS DATE) AS m, CASE WHEN month(date_trunc('month', d)) % 5 > 0 THEN sum(volume) END AS v FROM bars GROUP BY ticker, date_trunc('month', d)), y AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reference FROM x) SELECT ticker, m, round(v, 4) AS v, round(reference, 4) AS reference, CASE WHEN reference IS NULL THEN 'NEW' WHEN abs((v - reference) / abs(reference)) > 0.3 THEN 'ALERT' ELSE 'OK' END AS status FROM y")
query("d23_training_rows", lambda t: screens.training_rows(t.bars.select("ticker", "d"), t.corp_events, 20).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("label").alias("positive")), "WITH f AS (SELECT ticker, min(event_d) AS e FROM corp_events GROUP BY 1), x AS (SELECT b.ticker, b.d, e, row_number() OVER (PARTITION BY b.ticker ORDER BY b.d DESC) AS k FROM bars b LEFT JOIN f ON f.ticker = b.ticker WHERE e IS NULL OR b.d <= e) SELECT ticker, count(*) AS n, sum(CASE WHEN e IS NOT NULL AND k <= 20 THEN 1 ELSE 0 END)::BIGINT AS positive FROM x GROUP BY 1")
query("d24_w30_year_features", lambda t: rounded(t.bars.withColumn("y", F.year(F.add_months("d", -5))).withColumn("rk", F.row_number().over(Window.partitionBy("ticker", "y").orderBy(c("d").desc()))).groupBy("ticker", "y").agg(*(F.max(F.when(c("rk") == k, c("close"))).alias(f"c{k}") for k in (1, 10, 40))), 5), "WITH x AS (SELECT ticker, year(d - INTERVAL 5 MONTH) AS y, close, row_number() OVER (PARTITION BY ticker, year(d - INTERVAL 5 MONTH) ORDER BY d DESC) AS rk FROM bars) SELECT ticker, y, " + ", ".join(f"round(max(close) FILTER (rk = {k}), 5) AS c{k}" for k in (1, 10, 40)) + " FROM x GROUP BY 1, 2")


def _earnings(t):
    """Strictly earlier price, consensus up to the day, and the last disclosure before."""
    x = t.fin_cum.select("ticker", "fy", "q", "disclosed", "sales")
    x = asof_join(x, t.bars.select("ticker", "d", "close"), ["ticker"], "disclosed", "d", strict=True, prefix="p_")
    x = asof_join(x, t.consensus.where("source = 'A'").groupBy("ticker", "dated").agg(F.max("sales").alias("estimate")), ["ticker"], "disclosed", "dated", prefix="c_")
    return rounded(x.select("ticker", "fy", "q", "disclosed", c("p_close").alias("close_before"), clip(ratio(c("sales") - c("c_estimate"), F.abs("c_estimate")), -5, 5).alias("deviation"), ratio(c("p_close"), c("sales")).alias("multiple")), 5)


query("d27_earnings_features", _earnings, "WITH e AS (SELECT ticker, dated, max(sales) AS estimate FROM consensus WHERE source = 'A' GROUP BY 1, 2), x AS (SELECT f.*, (SELECT arg_max(close, d) FROM bars b WHERE b.ticker = f.ticker AND b.d < f.disclosed) AS p, (SELECT arg_max(estimate, dated) FROM e WHERE e.ticker = f.ticker AND e.dated <= f.disclosed) AS est FROM fin_cum f) SELECT ticker, fy, q, disclosed, round(p, 5) AS close_before, CASE WHEN est <> 0 THEN round(least(greatest((sales - est) / abs(est), -5), 5), 5) END AS deviation, round(p / nullif(sales, 0), 5) AS multiple FROM x")
query("d71_ic_table", lambda t: rounded(factor.spearman(technicals.technical_features(t.bars).withColumn("f5", F.lead("close", 5).over(w()) / c("close") - 1).select("f5", F.inline(F.array(*(F.struct(F.lit(n).alias("factor"), c(n).alias("x")) for n in ("day", "gap", "volume_ratio"))))), ["factor"], "x", "f5", few=True).select("factor", "n", "ic"), 4), "WITH b AS (SELECT close / open - 1 AS day, open / lag(close) OVER w - 1 AS gap, volume / avg(volume) OVER (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING) AS vr, lead(close, 5) OVER w / close - 1 AS f FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)), u AS (SELECT 'day' AS factor, day AS x, f FROM b UNION ALL SELECT 'gap', gap, f FROM b UNION ALL SELECT 'volume_ratio', vr, f FROM b), r AS (SELECT factor, rank() OVER (PARTITION BY factor ORDER BY x) + (count(*) OVER (PARTITION BY factor, x) - 1) / 2 AS p, rank() OVER (PARTITION BY factor ORDER BY f) + (count(*) OVER (PARTITION BY factor, f) - 1) / 2 AS q FROM u WHERE x IS NOT NULL AND f IS NOT NULL) SELECT factor, count(*) AS n, round(corr(p, q), 4) AS ic FROM r GROUP BY 1 HAVING count(*) >= 10")
def _windows(t):
    """Calendar days, one score, one bound."""
    maxima = backtest.window_maxima(t.bars.select("ticker", "d", "volume"), t.corp_events, "ticker", "d", "event_d", ["volume"], (10, 30), business=False)
    return rounded(backtest.detection_rates(maxima, ["volume"], (10, 30), (45,)).select(c("window_days").alias("days"), c("rate_volume").alias("rate"), c("total_volume").alias("events")), 5)


query("d74_detection_windows", _windows, "WITH x AS (SELECT days, e.ticker, event_d, max(volume) AS m FROM corp_events e JOIN bars b ON b.ticker = e.ticker, (VALUES (10), (30)) v(days) WHERE d < event_d AND d >= event_d - days::INTEGER GROUP BY 1, 2, 3) SELECT days, round(avg(CASE WHEN m >= 45 THEN 1.0 ELSE 0.0 END), 5) AS rate, count(*) AS events FROM x GROUP BY 1")
query("d76_last_history", lambda t: rounded(top_n(t.bars.where("d <= date'1999-06-30'"), ["ticker"], [c("d").desc()], 5, "rn").select("ticker", "d", "rn", F.coalesce(F.when(c("volume") > 20, c("high")), c("close")).alias("high")), 5), "SELECT ticker, d, CAST(row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS INTEGER) AS rn, round(coalesce(CASE WHEN volume > 20 THEN high END, close), 5) AS high FROM bars WHERE d <= DATE '1999-06-30' QUALIFY rn <= 5")
query("d83_exchange_universe", lambda t: t.supplier.where(c("s_name").rlike("[0-9]")).join(t.customer.select(c("c_custkey").alias("s_suppkey")).where("s_suppkey % 4 = 0"), "s_suppkey", "left_anti").join(F.broadcast(t.nation), c("s_nationkey") == c("n_nationkey"), "left").select("s_suppkey", "n_name"), "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE regexp_matches(s_name, '[0-9]') AND s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)")
query("d58_rank_forward", lambda t: rounded(factor.quantile_buckets(t.bars.withColumn("f1", F.log(F.lead("close").over(w()) / c("close"))), ["d"], "volume", 3, "bucket").groupBy("bucket").agg(F.avg("f1").alias("mean"), F.count("*").alias("n")), 4), "WITH x AS (SELECT *, ln(lead(close) OVER (PARTITION BY ticker ORDER BY d) / close) AS f FROM bars), e AS (SELECT d, quantile_cont(volume, [0, 0.3333333333333333, 0.6666666666666666, 1.0]) AS q0 FROM bars GROUP BY 1), y AS (SELECT f, volume, list_sort(list_distinct(q0)) AS q FROM x JOIN e USING (d)) SELECT CAST(1 + len(list_filter(list_slice(q, 2, len(q) - 1), lambda v: v < volume)) AS INTEGER) AS bucket, round(avg(f), 4) AS mean, count(*) AS n FROM y GROUP BY 1")
query("m12_leak_audit", lambda t: rounded(screens.leak_audit(t.lineitem.withColumn("y", (c("l_quantity") > 45).cast("int")), ["l_orderkey", "l_linenumber"], "l_returnflag", "l_extendedprice", "y"), 5), "WITH x AS (SELECT *, percent_rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r FROM lineitem) SELECT l_returnflag, count(*) AS rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated, round(avg(r) FILTER (l_quantity > 45), 5) AS mean_rank FROM x GROUP BY 1")
query("v16_primary_documents", lambda t: screens.primary_documents(t.documents, "source", "n_chars", c("text").rlike("License"), "doc_id").select("source", "doc_id"), "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN regexp_matches(text, 'License') THEN 1 ELSE 0 END DESC, n_chars DESC, doc_id) = 1")


# Filings, pages, files
def _filings(t):
    x = t.customer.select("c_custkey", F.when(c("c_custkey") % 10 == 0, "<broken").otherwise(F.concat(F.lit("<x:xbrl xmlns:x='u' xmlns:j='v'><j:NetSales contextRef='Now'>"), c("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("</j:NetSales><j:Note>n</j:Note><j:Name contextRef='Now'> "), c("c_name"), F.lit(" </j:Name></x:xbrl>"))).alias("xml"))
    return facts.xml_facts(x, "c_custkey", "xml")


query("s11_s12_xml_facts", _filings, "SELECT c_custkey, 'NetSales' AS name, 'Now' AS context, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS value FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 'Name', 'Now', c_name FROM customer WHERE c_custkey % 10 <> 0")


_ORDER = "o_orderkey long, o_custkey long, o_totalprice double"


def _responses(t):
    """What a service would say that has the orders in pages of a hundred keys: some pages at the second or third attempt, after errors and bodies cut short."""
    x = t.orders.groupBy(F.floor(c("o_orderkey") / 100).alias("page")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey", "o_totalprice"))).alias("items"))
    body = F.to_json(F.struct("page", (c("page") + 1).alias("next"), "items"))
    slow = F.struct(F.lit(1).alias("attempt"), F.lit(429).alias("status"), F.lit('{"error": "slow down"}').alias("body"))
    cut = F.struct(F.lit(2).alias("attempt"), F.lit(200).alias("status"), F.substring(body, F.lit(1), F.length(body) - 5).alias("body"))
    good = F.struct(F.lit(3).alias("attempt"), F.lit(200).alias("status"), body.alias("body"))
    tries = F.when(c("page") % 5 == 0, F.array(slow, cut, good)).when(c("page") % 3 == 0, F.array(slow, good)).otherwise(F.array(good))
    return x.select("page", F.inline(tries))


query("s14_paged_source", lambda t: facts.paged_items(_responses(t), _ORDER), """
    SELECT o_orderkey // 100 AS page, (row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) - 1)::INTEGER AS item, o_orderkey, o_custkey, o_totalprice FROM orders""")
query("f16_file_names", lambda t: t.customer.select("c_custkey", *facts.name_parts(F.concat(F.lit("file:/a/b/"), c("c_custkey").cast("string"), F.lit("_20240105_"), c("c_mktsegment"), F.lit(".pdf")), ["code", "day", "kind"])), "SELECT c_custkey, c_custkey::VARCHAR AS code, '20240105' AS day, c_mktsegment AS kind FROM customer")


def _files(t):
    path = scratch(t, "blobs")
    t.nation.select(F.concat("n_name", F.lit("!")).alias("value"), c("n_nationkey").alias("k")).repartition(3, "k").select("value").write.text(path)
    return facts.files(t.spark, path, "part-*").agg(F.sum("length").alias("bytes"), F.sum(F.size(F.split(c("content").cast("string"), "!")) - 1).alias("names"))


query("s8_s9_files", _files, "SELECT sum(strlen(n_name) + 2)::BIGINT AS bytes, count(*) AS names FROM nation")


def _appended(t):
    path = scratch(t, "appended")
    x = t.nation.select("n_nationkey", "n_name")
    x.where("n_nationkey < 10").write.parquet(path)
    x.where("n_nationkey >= 10").write.mode("append").parquet(path)
    x.where("n_nationkey < 3").write.mode("overwrite").parquet(path + "-short")
    return t.spark.read.parquet(path).withColumn("kept", F.lit(True)).join(t.spark.read.parquet(path + "-short").select("n_nationkey", F.lit(True).alias("short")), "n_nationkey", "left")


query("k1_k2_append_truncate", _appended, "SELECT n_nationkey, n_name, true AS kept, CASE WHEN n_nationkey < 3 THEN true END AS short FROM nation")


def _clustered(t):
    import uuid

    name = f"bars_{uuid.uuid4().hex}"
    x = tables.write_clustered(t.bars.select("ticker", "volume"), name, scratch(t, "clustered"), 8, "ticker")
    out = x.groupBy("ticker").agg(F.sum("volume").alias("volume"))
    t.spark.sql(f"DROP TABLE {name}")  # its files stay, and are read by their path
    return out


query("k9_clustered_table", _clustered, "SELECT ticker, sum(volume) AS volume FROM bars GROUP BY 1")


# A stream that stops and goes on
def _resumed(t):
    path, out, state = scratch(t, "events"), scratch(t, "out"), scratch(t, "state")
    e = t.events.select("event_id", c("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    job = lambda: monitor.run_available(monitor.source(t.spark, path).select("event_id", "value"), out, state)
    e.where("event_id % 2 = 0").coalesce(1).write.parquet(path)
    job()
    e.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(path)
    job()
    job()
    return rounded(t.spark.read.parquet(out), 6)


def _retried(t):
    """A stream that fails after its first batch and once before its second, and is run again."""
    path, out, state, runs = scratch(t, "events"), scratch(t, "out"), scratch(t, "state"), []
    e = t.events.select("event_id", c("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    e.where("event_id % 2 = 0").coalesce(1).write.parquet(path)

    def job():
        runs.append(1)
        if len(runs) == 2:
            raise ConnectionError("refused")
        monitor.run_available(monitor.source(t.spark, path).select("event_id", "value"), out, state)
        if len(runs) == 1:
            e.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(path)
            raise TimeoutError("no answer")

    monitor.run_retrying(job, wait=0.01)
    return rounded(t.spark.read.parquet(out), 6)


query("st11_retried_stream", _retried, "SELECT event_id, round(value, 6) AS value FROM events")
query("st8_st9_k13_resumed_stream", _resumed, "SELECT event_id, round(value, 6) AS value FROM events")


# Learned models and iterative studies: no SQL
def _index(t):
    """Ten neighbours of every twentieth vector by the index, and whether the exact search finds each, too."""
    index = vectors.vector_index(t.embeddings, "vec_id", "embedding", scratch(t, "index"))
    q = t.embeddings.where("vec_id % 20 = 0")
    near = vectors.probe(index, q, "vec_id", "embedding", 10)
    exact = vectors.nearest(q, t.embeddings, "vec_id", "embedding", k=10).select("query", "neighbour", F.lit(True).alias("exact"))
    return rounded(near.join(exact, ["query", "neighbour"], "left").na.fill(False, ["exact"]), 5)


query("k10_vector_index", _index)


def _lead_lag(t):
    x = technicals.weekly_closes(t.bars10).where("r is not null").groupBy("week").pivot("ticker", list(range(10))).agg(F.first(F.log1p("r"))).na.fill(0.0)
    x = x.select(c("week").alias("d"), *(c(str(i)).alias(f"n{i}") for i in range(10)))
    classes = {f"n{i}": (1, -1, 0)[i % 3] for i in range(10)}
    leaders, followers = ({n: k for n, k in classes.items() if (n < "n6") == side} for side in (True, False))
    return rounded(factor.lead_lag_signals(x, "d", leaders, followers, c("d") < "1997-01-01", 60), 6)


query("d39_m7_lead_lag", _lead_lag)
query("d53_prewhitened", lambda t: rounded(models.prewhitened(technicals.weekly_closes(t.bars10).where("r is not null").select("ticker", "week", F.log1p("r").alias("r")), ["ticker"], "week", "r", 2).groupBy("ticker").agg(F.count("innovation").alias("n"), F.avg("innovation").alias("mean")), 5))




def _market_leads(t):
    """Weekly returns of the market against those of each name."""
    m = technicals.weekly_closes(t.market.select(F.lit(0).alias("ticker"), "d", "close")).select("week", F.log1p("r").alias("m"))
    x = technicals.weekly_closes(t.bars10).select("ticker", "week", F.log1p("r").alias("r"))
    return x.join(F.broadcast(m), "week")  # a row for each week


query("d53_cross_correlations", lambda t: rounded(series.cross_correlations(_market_leads(t), ["ticker"], "week", "m", "r", range(9)), 5))


def _model_rows(t):
    x = technicals.technical_features(t.bars10).withColumn("f5", F.lead("close", 5).over(w()) / c("close") - 1).where("f5 is not null and vola20 is not null and r20 is not null")
    return x.select("ticker", "d", F.year("d").alias("y"), "day", "gap", "volume_ratio", "r5", "r20", (c("f5") > 0).cast("double").alias("label"))


def _walk(t, kind):
    scored = models.walk_forward(_model_rows(t), "y", ["day", "gap", "volume_ratio", "r5", "r20"], "label", [1999, 2000, 2002], kind)
    return rounded(factor.lift_at(scored, ["y"], "score", "label", (0.05, 0.2)), 3)


query("m9_forest_walk_forward", lambda t: _walk(t, "forest"))
query("m10_boosted_walk_forward", lambda t: _walk(t, "boosted"))


def _similar_texts(t):
    """The three nearest items of every twentieth one, by the angle of their tf-idf vectors of character n-grams."""
    x = models.text_features(t.benchmark.select("item_id", "text"), "text").select("item_id", "tfidf")
    near = vectors.nearest_sparse(x.where("item_id % 20 = 0"), x, "item_id", "tfidf", 4).where("query <> neighbour")
    return rounded(near.select("query", "neighbour", (1 - c("distance")).alias("similarity")), 5)


query("m8_text_similarity", _similar_texts)
query("a9_latest_prices", lambda t: rounded(latest_by(t.bars, ["ticker"], [c("d").desc()]).select("ticker", "d", "close"), 5), "SELECT ticker, max(d) AS d, round(arg_max(close, d), 5) AS close FROM bars GROUP BY 1")
