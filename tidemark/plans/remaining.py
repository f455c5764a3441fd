"""The small operators that the other queries don't show by themselves."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.maths import greatest_or_null, ratio
from ..operators import factor
from ..operators.windows import latest_by, over, top_n
from ..sources.tables import matched
from ..streaming import monitor
from .fixtures import nudge, query, rounded
from .texts import _latest

c = F.col


def w():
    return over(["ticker"], ["d"])


query("p1_p4_projection", lambda t: t.orders.select(c("o_orderkey").cast("string").alias("id"), F.to_date("o_orderdate").alias("day"), c("o_totalprice").cast("decimal(12,2)").cast("string").alias("price")).where(c("id").isin("1", "5", "7", "33")), "SELECT o_orderkey::VARCHAR AS id, o_orderdate::DATE AS day, o_totalprice::DECIMAL(12,2)::VARCHAR AS price FROM orders WHERE o_orderkey IN (1, 5, 7, 33)")


def _optional(t, status=None, least=None):
    """A filter for each parameter that is given."""
    x = t.orders
    for condition in (None if status is None else c("o_orderstatus") == status, None if least is None else c("o_totalprice") >= least):
        x = x if condition is None else x.where(condition)
    return x.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


query("p11_optional_parameters", lambda t: _optional(t, least=100_000), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE (NULL IS NULL OR o_orderstatus = NULL) AND o_totalprice >= 100000 GROUP BY 1")
query("p12_absolute_trim", lambda t: rounded(t.bars.withColumn("r", ratio(c("close"), F.lag("close").over(w())) - 1).where("abs(r) < 0.5").groupBy("ticker").agg(F.count("*").alias("n"), F.avg("r").alias("mean")), 5), "SELECT ticker, count(*) AS n, round(avg(r), 5) AS mean FROM (SELECT ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS r FROM bars) WHERE abs(r) < 0.5 GROUP BY 1")
query("j5_one_row_cross", lambda t: rounded(t.customer.crossJoin(F.broadcast(t.customer.agg(F.avg("c_acctbal").alias("mean")))).where("c_acctbal > 2 * mean").select("c_custkey", (c("c_acctbal") / c("mean")).alias("times")), 5), "SELECT c_custkey, round(c_acctbal / (SELECT avg(c_acctbal) FROM customer), 5) AS times FROM customer WHERE c_acctbal > 2 * (SELECT avg(c_acctbal) FROM customer)")
query("j14_planned_not_done", lambda t: t.fin_cum.where("q = '1Q'").select("ticker", "fy").distinct().join(t.fin_cum.where("q = '1Q' and ticker % 7 <> 3").select("ticker", "fy"), ["ticker", "fy"], "left_anti"), "SELECT DISTINCT ticker, fy FROM fin_cum WHERE q = '1Q' AND ticker % 7 = 3")
query("j15_null_safe_exists", lambda t: t.customer.select("c_custkey", F.when(c("c_nationkey") > 5, c("c_nationkey")).alias("k")).alias("a").join(t.nation.where("n_nationkey < 9").select(F.when(c("n_nationkey") > 5, c("n_nationkey")).alias("k")).alias("b"), matched("a", "b", ["k"]), "left_semi"), "SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN c_nationkey END AS k FROM customer WHERE c_nationkey < 9")
query("j18_week_close", lambda t: rounded(t.bars.groupBy("ticker", F.date_trunc("week", "d").cast("date").alias("week")).agg(F.max("d").alias("last_day"), F.max_by("close", "d").alias("close")), 6), "SELECT ticker, date_trunc('week', d)::DATE AS week, max(d) AS last_day, round(arg_max(close, d), 6) AS close FROM bars GROUP BY 1, 2")
query("j24_j25_aligned", lambda t: rounded(t.bars10.where("ticker = 1").select("d", c("close").alias("a")).join(t.bars10.where("ticker = 2").select("d", c("close").alias("b")), on="d").select("d", (c("a") - c("b")).alias("gap")), 4), "SELECT d, round(a.close - b.close, 4) AS gap FROM (SELECT * FROM bars10 WHERE ticker = 1) a JOIN (SELECT * FROM bars10 WHERE ticker = 2) b USING (d)")
query("a11_a13_having_distinct", lambda t: t.orders.select("o_custkey", "o_orderpriority").distinct().groupBy("o_custkey").agg(F.count("*").alias("kinds")).where("kinds >= 4"), "SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 4")
query("a15_last_known", lambda t: rounded(t.consensus.groupBy("ticker").agg(F.max_by("profit", F.when(c("profit").isNotNull(), F.struct("dated", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))).alias("profit")), 5), "SELECT ticker, round(last(profit ORDER BY dated, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) FILTER (profit IS NOT NULL), 5) AS profit FROM consensus GROUP BY 1")
query("a19_unstack", lambda t: t.bars.groupBy(F.year("d").alias("y")).pivot("ticker", [1, 2, 3]).agg(F.sum("volume")).select("y", c("1").alias("t1"), c("2").alias("t2"), c("3").alias("t3")), "SELECT year(d) AS y, sum(volume) FILTER (ticker = 1) AS t1, sum(volume) FILTER (ticker = 2) AS t2, sum(volume) FILTER (ticker = 3) AS t3 FROM bars GROUP BY 1")
query("a25_counts_by_keys", lambda t: t.lineitem.groupBy(F.to_date("l_shipdate").alias("day"), "l_returnflag").agg(F.count("*").alias("n")), "SELECT l_shipdate::DATE AS day, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
query("w2_nth_row", lambda t: rounded(t.bars.withColumn("k", F.row_number().over(over(["ticker"], [c("d").desc()]))).where("k = 3").select("ticker", "d", "close"), 6), "SELECT ticker, d, round(close, 6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d DESC) = 3")
query("w10_case_order", lambda t: latest_by(t.orders, ["o_custkey"], [F.when(c("o_orderstatus") == "P", 0).when(c("o_orderstatus") == "O", 1).otherwise(2), c("o_orderdate").desc(), c("o_orderkey")]).select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) = 1")
query("w18_shifted_max", lambda t: rounded(t.bars.select("ticker", "d", F.max("close").over(w().rowsBetween(-60, -1)).alias("level")), 6), "SELECT ticker, d, round(max(close) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 6) AS level FROM bars")
query("w23_w24_recent_members", lambda t: t.bars.select("ticker", "d", F.max((c("volume") > 40).cast("int")).over(w().rowsBetween(-20, -1)).alias("held")), "SELECT ticker, d, max(CASE WHEN volume > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS held FROM bars")
query("w27_self_correlation", lambda t: rounded(factor.lag_correlation(t.bars10, ["ticker"], "d", "volume", "volume", (1, 5)), 5), "WITH l AS (SELECT volume AS x, lead(volume, 1) OVER w AS y1, lead(volume, 5) OVER w AS y5 FROM bars10 WINDOW w AS (PARTITION BY ticker ORDER BY d)), u AS (SELECT 1 AS lag, x, y1 AS y FROM l UNION ALL SELECT 5, x, y5 FROM l), r AS (SELECT lag, rank() OVER (PARTITION BY lag ORDER BY x) + (count(*) OVER (PARTITION BY lag, x) - 1) / 2 AS a, rank() OVER (PARTITION BY lag ORDER BY y) + (count(*) OVER (PARTITION BY lag, y) - 1) / 2 AS b FROM u WHERE y IS NOT NULL) SELECT lag, count(*) AS n, round(corr(a, b), 5) AS ic FROM r GROUP BY 1")
query("w28_market_lag", lambda t: rounded(t.market.select("d", (c("close") / F.lag("close").over(Window.orderBy("d")) - 1).alias("r")), 6), "SELECT d, round(close / lag(close) OVER (ORDER BY d) - 1, 6) AS r FROM market")
query("w29_nulls_last", lambda t: t.consensus.withColumn("k", F.row_number().over(over(["ticker"], [c("profit").asc_nulls_last(), *("l_orderkey l_linenumber l_partkey l_extendedprice l_quantity dated".split())]))).where("k <= 2").select("ticker", "k", "l_orderkey"), "SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY profit NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, dated) AS INTEGER) AS k, l_orderkey FROM consensus QUALIFY k <= 2")
query("t1_t7_ordered_limit", lambda t: rounded(t.lineitem.orderBy(c("l_shipdate").desc(), "l_orderkey", "l_linenumber", "l_partkey").limit(25).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), 2), "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity, 2) AS l_quantity FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
query("t4_extremes", lambda t: rounded(t.customer.orderBy(c("c_acctbal").desc(), "c_custkey").limit(5).unionByName(t.customer.orderBy("c_acctbal", "c_custkey").limit(5)).select("c_custkey", "c_acctbal"), 2), "(SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer ORDER BY customer.c_acctbal DESC, c_custkey LIMIT 5) UNION ALL (SELECT c_custkey, round(c_acctbal, 2) FROM customer ORDER BY customer.c_acctbal, c_custkey LIMIT 5)")
query("t8_tail", lambda t: rounded(t.market.orderBy(c("d").desc()).limit(10).orderBy("d"), 5), "SELECT d, round(close, 5) AS close FROM market ORDER BY d DESC LIMIT 10")
query("u2_concat_frames", lambda t: t.customer.select("c_custkey", "c_mktsegment").unionByName(t.supplier.select(c("s_suppkey").alias("c_custkey"), F.lit(1).alias("extra")), allowMissingColumns=True), "SELECT c_custkey, c_mktsegment, NULL::INTEGER AS extra FROM customer UNION ALL SELECT s_suppkey, NULL, 1 FROM supplier")
query("f1_nulls", lambda t: rounded(t.consensus.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("profit", F.lit(0.0)).alias("filled"), F.nullif(c("l_quantity"), F.lit(1.0)).alias("q"), greatest_or_null(c("profit"), c("l_quantity")).alias("strict"), F.greatest("profit", "l_quantity").alias("loose")), 4), "SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(profit, 0), 4) AS filled, round(nullif(l_quantity, 1), 4) AS q, CASE WHEN profit IS NOT NULL THEN round(greatest(profit, l_quantity), 4) END AS strict, round(greatest(profit, l_quantity), 4) AS loose FROM consensus")
query("f7_period_ladder", lambda t: t.documents.select("doc_id", F.coalesce(F.nullif(F.regexp_extract("text", r"(20\d\d)", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"(\d{4})", 1), F.lit("")), F.concat(F.lit("n"), c("lang"))).alias("period")), r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '(20\d\d)', 1), ''), nullif(regexp_extract(text, '(\d{4})', 1), ''), 'n' || lang) AS period FROM documents")
query("f12_f13_arrays_structs", lambda t: t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("a")).select("n_regionkey", F.size("a").alias("n"), c("a")[0]["n_name"].alias("first"), F.exists("a", lambda x: x["n_nationkey"] == 7).alias("has7")), "SELECT n_regionkey, count(*)::INTEGER AS n, first(n_name ORDER BY n_nationkey) AS first, bool_or(n_nationkey = 7) AS has7 FROM nation GROUP BY 1")
query("f15_units", lambda t: rounded(t.orders.select("o_orderkey", (c("o_totalprice") * F.when(c("o_orderstatus") == "F", 1e6).when(c("o_orderstatus") == "O", 1e8).otherwise(1.0)).alias("yen")), 0), "SELECT o_orderkey, round(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 1e6 WHEN 'O' THEN 1e8 ELSE 1.0 END, 0) AS yen FROM orders")


def _movers(t):
    x = t.bars.join(F.broadcast(t.master.select("ticker", "sector")), "ticker").withColumn("r", F.log(c("close") / F.lag("close").over(w()))).where("r is not null")
    x = x.withColumn("residual", c("r") - F.avg("r").over(over(["d", "sector"]))).where("d >= date'2001-01-01'")
    x = x.groupBy("ticker").agg(F.sum("residual").alias("own"), F.sum("r").alias("total"))
    return rounded(top_n(x.withColumn("one", F.lit(1)), ["one"], [F.round(F.abs("own") + nudge(6), 6).desc(), c("ticker")], 20).drop("one"), 5)


query("d50_unique_movers", _movers, "WITH x AS (SELECT b.ticker, d, sector, ln(close / lag(close) OVER (PARTITION BY b.ticker ORDER BY d)) AS r FROM bars b JOIN master USING (ticker) QUALIFY r IS NOT NULL), y AS (SELECT ticker, d, r, r - avg(r) OVER (PARTITION BY d, sector) AS e FROM x), g AS (SELECT ticker, sum(e) AS own, sum(r) AS total FROM y WHERE d >= DATE '2001-01-01' GROUP BY 1) SELECT ticker, round(own, 5) AS own, round(total, 5) AS total FROM g QUALIFY row_number() OVER (ORDER BY round(abs(own), 6) DESC, ticker) <= 20")
query("d21_entry_gate", lambda t: rounded(t.bars10.withColumns({"hi": F.max("high").over(w().rowsBetween(-249, 0)), "lo": F.min("low").over(w().rowsBetween(-249, 0)), "v": F.avg("volume").over(w().rowsBetween(-49, 0)), "n": F.count("*").over(w().rowsBetween(-249, 0))}).where("n = 250 and close >= 0.1 * hi and close >= 1.3 * lo and v >= 50").select("ticker", "d", "close"), 6), "SELECT ticker, d, round(close, 6) AS close FROM (SELECT *, max(high) OVER y AS hi, min(low) OVER y AS lo, avg(volume) OVER (PARTITION BY ticker ORDER BY d ROWS 49 PRECEDING) AS v, count(*) OVER y AS n FROM bars10 WINDOW y AS (PARTITION BY ticker ORDER BY d ROWS 249 PRECEDING)) WHERE n = 250 AND close >= 0.1 * hi AND close >= 1.3 * lo AND v >= 50")
query("st6_scored_stream", lambda t: _latest(t, lambda e: e.where("event_type <> 'error'").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("score", F.when(c("k") > 66, 2).when(c("k") > 33, 1).otherwise(0)).groupBy("user_id").agg(F.sum("score").alias("score")), []), "WITH e AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0) SELECT user_id, sum(CASE WHEN k > 66 THEN 2 WHEN k > 33 THEN 1 ELSE 0 END)::BIGINT AS score FROM (SELECT user_id, json_extract_string(props, '$.k')::INTEGER AS k FROM e WHERE event_type <> 'error') GROUP BY 1")
query("st_batch_tumbling", lambda t: rounded(monitor.tumbling(t.events), 4), "SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
