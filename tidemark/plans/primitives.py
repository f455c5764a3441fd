"""Relational building blocks: sources, sinks, predicates, joins, aggregates, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.maths import change, clip, first_nonzero, kelly, labelled_coalesce, normalised, ratio, sigmoid
from ..operators.asof import asof_join
from ..operators.calendar import era_year, fiscal_roll, in_session, month_of, on_or_before, shift_days
from ..operators.factor import trimmed
from ..operators.joins import fuzzy_match, group_pairs, leader_pairs, nearest_interval, nearest_two_sides, prioritised, provenance, window_join
from ..operators.windows import cross_rank, drawdown, forward_fill, latest_by, near_triggers, over, rolling, rolling_median, rolling_rank, streak, top_n
from ..sources.tables import duplicates, first_nonempty, replaced, update_from, upsert, with_fallback
from .fixtures import query, rounded

c = F.col


def w():
    return over(["ticker"], ["d"])


# Sources and sinks
query("s3_parameters", lambda t: t.spark.sql("SELECT l_returnflag, count(*) AS n FROM {li} WHERE l_quantity >= :least AND array_contains(:modes, l_returnflag) GROUP BY 1", args={"least": 10, "modes": F.array(F.lit("A"), F.lit("N"))}, li=t.lineitem), "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_returnflag IN ('A', 'N') GROUP BY 1")
query("s15_unpivot", lambda t: rounded(t.bars.unpivot(["ticker", "d"], ["open", "close"], "kind", "price")), "SELECT ticker, d, 'open' AS kind, round(open, 6) AS price FROM bars UNION ALL SELECT ticker, d, 'close', round(close, 6) FROM bars")
query("s16_literal_relation", lambda t: t.spark.sql("SELECT inline(array(named_struct('k', 1, 'v', 'a'), named_struct('k', 2, 'v', 'b')))").join(t.region, c("k") == c("r_regionkey")).select("k", "v", "r_name"), "SELECT k, v, r_name FROM (VALUES (1, 'a'), (2, 'b')) x(k, v) JOIN region ON k = r_regionkey")
query("s17_first_source", lambda t: first_nonempty(t.orders.where("o_totalprice < 0"), t.orders.where("o_orderstatus = 'F'")).groupBy("o_orderpriority").agg(F.count("*").alias("n")), "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
query("s18_fallback", lambda t: with_fallback(t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("main").alias("origin")), t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.lit("fallback").alias("origin")), ["c_custkey"]), "SELECT c_custkey, 'main' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'fallback' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
query("k4_upsert", lambda t: rounded(upsert(t.customer.select("c_custkey", "c_acctbal"), t.customer.where("c_custkey % 5 = 0").select((c("c_custkey") + 10).alias("c_custkey"), (c("c_acctbal") + 1).alias("c_acctbal")), ["c_custkey"]), 2), "WITH ch AS (SELECT c_custkey + 10 AS c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 5 = 0) SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM ch UNION ALL SELECT c_custkey, round(c_acctbal, 2) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ch)")
query("k5_replace_range", lambda t: replaced(t.orders.select("o_orderkey", "o_orderstatus"), t.orders.where("o_orderkey % 100 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")), ["o_orderkey"], c("o_orderkey") < 500), "SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 500 AND o_orderkey % 100 <> 0")
query("k6_duplicate_audit", lambda t: duplicates(t.lineitem, ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
query("k7_update_from", lambda t: update_from(t.supplier.select("s_suppkey", "s_name"), t.supplier.where("s_acctbal < 0").select("s_suppkey", F.lit("negative").alias("s_name")), ["s_suppkey"], ["s_name"]), "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'negative' ELSE s_name END AS s_name FROM supplier")
query("k8_status_update", lambda t: t.orders.select("o_orderkey", F.when(c("o_orderkey").isin(1, 2, 3, 5, 8), "done").otherwise(c("o_orderstatus")).alias("status")), "SELECT o_orderkey, CASE WHEN o_orderkey IN (1, 2, 3, 5, 8) THEN 'done' ELSE o_orderstatus END AS status FROM orders")

# Predicates and labels
query("p2_except", lambda t: t.nation.drop("n_regionkey"), "SELECT * EXCLUDE (n_regionkey) FROM nation")
query("p3_p6_predicates", lambda t: t.part.where(c("p_size").between(5, 20) & c("p_name").like("%a%") & ~c("p_type").like("%Z%") & c("p_brand").isNotNull()).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_name LIKE '%a%' AND p_type NOT LIKE '%Z%' AND p_brand IS NOT NULL")
query("p5_array_membership", lambda t: t.documents.select("doc_id", F.split("text", " ").alias("w")).where(F.array_contains("w", "the") & F.exists("w", lambda x: F.length(x) > 12)).select("doc_id"), "SELECT doc_id FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE list_contains(w, 'the') AND len(list_filter(w, lambda x: length(x) > 12)) > 0")
query("p7_regex", lambda t: t.documents.where(c("text").rlike("[0-9]{3}") & ~c("text").rlike("License")).select("doc_id"), "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}') AND NOT regexp_matches(text, 'License')")
query("p8_case_label", lambda t: t.orders.select("o_orderkey", F.when(c("o_totalprice") > 200000, "big").when(c("o_totalprice") > 100000, "mid").otherwise("small").alias("bucket")), "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS bucket FROM orders")


def _labelled(t):
    x = t.consensus.select("l_orderkey", "l_linenumber", "l_partkey", "sales", F.when(c("source") == "A", c("profit")).alias("profit"), F.when(c("sales") > 30000, c("sales")).alias("big"))
    value, name = labelled_coalesce(profit=c("profit"), big=c("big"), sales=c("sales"))
    return rounded(x.select("l_orderkey", "l_linenumber", "l_partkey", value.alias("value"), name.alias("used")), 4)


query("p9_labelled_coalesce", _labelled, "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, sales, CASE WHEN source = 'A' THEN profit END AS profit, CASE WHEN sales > 30000 THEN sales END AS big FROM consensus) SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(profit, big, sales), 4) AS value, CASE WHEN profit IS NOT NULL THEN 'profit' WHEN big IS NOT NULL THEN 'big' ELSE 'sales' END AS used FROM x")
query("p10_first_nonzero", lambda t: rounded(t.lineitem.select(*["l_orderkey", "l_linenumber", "l_partkey"], first_nonzero(c("l_tax"), c("l_discount"), c("l_quantity")).alias("v")), 4), "SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(nullif(l_tax, 0), nullif(l_discount, 0), nullif(l_quantity, 0)), 4) AS v FROM lineitem")
query("p13_quantile_trim", lambda t: rounded(trimmed(t.lineitem.select("l_orderkey", "l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"], 0.005, 0.995).groupBy().agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")), 2), "WITH a AS (SELECT l_extendedprice, l_quantity FROM lineitem WHERE l_extendedprice BETWEEN (SELECT quantile_cont(l_extendedprice, 0.005) FROM lineitem) AND (SELECT quantile_cont(l_extendedprice, 0.995) FROM lineitem)) SELECT count(*) AS n, round(sum(l_quantity), 2) AS q FROM a WHERE l_quantity BETWEEN (SELECT quantile_cont(l_quantity, 0.005) FROM a) AND (SELECT quantile_cont(l_quantity, 0.995) FROM a)")
query("p14_keyword_classifier", lambda t: t.documents.select("doc_id", (c("text").rlike("the|der|de ") & ~c("text").rlike("@")).alias("hit")), "SELECT doc_id, regexp_matches(text, 'the|der|de ') AND NOT regexp_matches(text, '@') AS hit FROM documents")
query("p15_universe", lambda t: t.supplier.join(t.lineitem.where("l_quantity > 49"), c("s_suppkey") == c("l_suppkey"), "left_semi").join(t.nation.where("n_regionkey < 3"), c("s_nationkey") == c("n_nationkey"), "left_semi").select("s_suppkey"), "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")

# Joins
query("j1_j2_dimension", lambda t: rounded(t.bars.join(t.master.select("ticker", "sector"), "ticker", "left").groupBy("sector").agg(F.sum("turnover").alias("turnover"), F.count("*").alias("n")), 2), "SELECT sector, round(sum(turnover), 2) AS turnover, count(*) AS n FROM bars LEFT JOIN master USING (ticker) GROUP BY 1")
query("j3_full_outer_priority", lambda t: rounded(prioritised(t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_acctbal", "c_mktsegment"), t.customer.where("c_custkey % 3 = 0").select("c_custkey", (c("c_acctbal") * 2).alias("c_acctbal"), F.lit("B").alias("c_mktsegment")), ["c_custkey"], ["c_acctbal"]), 2), "SELECT c_custkey, round(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_acctbal * 2 END, 2) AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
query("j6_window_join", lambda t: rounded(window_join(t.corp_events, t.bars.select("ticker", "d", "close"), ["ticker"], "event_d", "d", 5, 5).groupBy("ticker", "event_d").agg(F.count("*").alias("n"), F.max("close").alias("top"), F.min_by("close", "d").alias("first_close"), F.max_by("close", "d").alias("last_close"))), "SELECT ticker, event_d, count(*) AS n, round(max(close), 6) AS top, round(arg_min(close, d), 6) AS first_close, round(arg_max(close, d), 6) AS last_close FROM corp_events JOIN bars USING (ticker) WHERE d BETWEEN event_d - 5 AND event_d + 5 GROUP BY 1, 2")
_ASOF = "SELECT e.ticker, e.event_d, {pick}(b.d) AS r_d, round(arg_{pick}(b.close, b.d), 6) AS r_close FROM corp_events e LEFT JOIN bars b ON b.ticker = e.ticker AND b.d {op} e.event_d{more} GROUP BY 1, 2"
for _name, _direction, _strict, _op, _pick in (("j8_asof_backward", "backward", False, "<=", "max"), ("j9_asof_strict", "backward", True, "<", "max"), ("j10_asof_forward", "forward", True, ">", "min")):
    query(_name, lambda t, d=_direction, s=_strict: rounded(asof_join(t.corp_events, t.bars.select("ticker", "d", "close"), ["ticker"], "event_d", "d", direction=d, strict=s, tolerance=F.abs(F.datediff("r_d", "event_d")) <= 7 if d == "forward" else None)), _ASOF.format(op=_op, pick=_pick, more=" AND b.d <= e.event_d + 7" if _direction == "forward" else ""))
query("j8_asof_bucketed", lambda t: rounded(asof_join(t.corp_events, t.bars.select("ticker", "d", "close"), ["ticker"], "event_d", "d", bucket=lambda at: F.trunc(at, "year"))), _ASOF.format(op="<=", pick="max", more=""))
query("j11_offset_rows", lambda t: rounded(t.bars.select("ticker", "d", F.lag("close", 3).over(w()).alias("before"), F.lead("close", 3).over(w()).alias("after"))), "SELECT ticker, d, round(lag(close, 3) OVER w, 6) AS before, round(lead(close, 3) OVER w, 6) AS after FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)")
query("j12_j13_semi_anti", lambda t: t.customer.join(t.orders.where("o_orderstatus = 'P'"), c("c_custkey") == c("o_custkey"), "left_semi").join(t.orders.where("o_orderpriority like '1%'").select(c("o_custkey").alias("k")), c("c_custkey") == c("k"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
query("j16_row_range_mean", lambda t: rounded(t.bars.select("ticker", "d", F.avg("volume").over(w().rowsBetween(-20, -1)).alias("mean20"))), "SELECT ticker, d, round(avg(volume) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS mean20 FROM bars")
query("j17_latest_by_max", lambda t: rounded(t.bars.groupBy("ticker").agg(F.max("d").alias("d"), F.max_by("close", "d").alias("close"))), "SELECT ticker, max(d) AS d, round(arg_max(close, d), 6) AS close FROM bars GROUP BY 1")


def _intervals(t):
    spans = t.corp_events.groupBy("ticker").agg(F.min("event_d").alias("lo0"), F.max("event_d").alias("hi0")).select("ticker", F.inline(F.array(F.struct(c("lo0").alias("lo"), F.date_add("lo0", 300).alias("hi"), F.lit("early").alias("label")), F.struct(F.date_sub("hi0", 300).alias("lo"), c("hi0").alias("hi"), F.lit("late").alias("label"))))).where("label = 'early' or lo > date'1996-01-01'")
    points = t.bars.select("ticker", "d")
    return nearest_interval(points, spans, "ticker", "d", "lo", "hi", "label")


query("j19_interval_lookup", _intervals, """WITH b AS (SELECT ticker, min(event_d) AS lo0, max(event_d) AS hi0 FROM corp_events GROUP BY 1), s AS (SELECT ticker, lo0 AS lo, lo0 + 300 AS hi, 'early' AS label FROM b UNION ALL SELECT ticker, hi0 - 300, hi0, 'late' FROM b WHERE hi0 - 300 > DATE '1996-01-01'),
    j AS (SELECT p.ticker, p.d, label, lo, CASE WHEN d BETWEEN lo AND hi THEN 0 WHEN hi < d THEN 1 WHEN lo > d THEN 2 END AS k, CASE WHEN d BETWEEN lo AND hi THEN 0 WHEN hi < d THEN d - hi WHEN lo > d THEN lo - d END AS far FROM (SELECT ticker, d FROM bars) p LEFT JOIN s USING (ticker))
    SELECT ticker, d, first(label ORDER BY k, far, lo, label) AS label, CAST(min(k) AS INTEGER) AS match_kind FROM j GROUP BY 1, 2""")
query("j20_group_pairs", lambda t: group_pairs(t.supplier, ["s_nationkey"], "s_suppkey"), "SELECT a.s_nationkey, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
query("j21_sibling_pairs", lambda t: leader_pairs(t.supplier, ["s_nationkey"], "s_suppkey"), "WITH m AS (SELECT s_nationkey, min(s_suppkey) AS l FROM supplier GROUP BY 1), d AS (SELECT l AS leader, s_suppkey AS follower, s_nationkey FROM supplier JOIN m USING (s_nationkey) WHERE l <> s_suppkey) SELECT leader, follower, 'direct' AS kind FROM d UNION ALL SELECT a.follower, b.follower, 'sibling' FROM d a JOIN d b USING (s_nationkey) WHERE a.follower <> b.follower")
query("j22_fuzzy", lambda t: rounded(fuzzy_match(t.nation.select("n_name"), t.nation.select(F.concat(c("n_name"), F.lit(" x")).alias("target")), "n_name", "target", F.substring("n_name", 1, 1), F.substring("target", 1, 1), 0.5)), "WITH s AS (SELECT a.n_name, b.n_name || ' x' AS target, regexp_replace(lower(a.n_name), '[^a-z0-9]', '', 'g') AS p, regexp_replace(lower(b.n_name || ' x'), '[^a-z0-9]', '', 'g') AS q FROM nation a JOIN nation b ON a.n_name[1] = b.n_name[1]) SELECT n_name, arg_max(target, 1 - levenshtein(p, q) / greatest(length(p), length(q))) AS match, round(max(1 - levenshtein(p, q) / greatest(length(p), length(q))), 6) AS score FROM s WHERE 1 - levenshtein(p, q) / greatest(length(p), length(q)) >= 0.5 GROUP BY 1")
query("j23_unnest", lambda t: t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")), "SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS i, u.line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS i) u")

# Aggregates
query("a1_a6_aggregates", lambda t: rounded(t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("disc"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(c("l_quantity") > 40).alias("large"), F.stddev_samp("l_quantity").alias("sd"), F.bool_or(c("l_discount") > 0.09).alias("deep"), F.min("l_partkey").alias("any_part"))), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS q, round(avg(l_discount), 6) AS disc, round(min(l_tax), 6) AS lo, round(max(l_tax), 6) AS hi, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_quantity > 40) AS large, round(stddev_samp(l_quantity), 6) AS sd, bool_or(l_discount > 0.09) AS deep, min(l_partkey) AS any_part FROM lineitem GROUP BY 1, 2")
query("a4_manual_pivot", lambda t: rounded(t.lineitem.groupBy("l_suppkey").agg(*(F.max(F.when(c("l_linenumber") == k, c("l_extendedprice"))).alias(f"line{k}") for k in (1, 2, 3)))), "SELECT l_suppkey, " + ", ".join(f"round(max(CASE WHEN l_linenumber = {k} THEN l_extendedprice END), 6) AS line{k}" for k in (1, 2, 3)) + " FROM lineitem GROUP BY 1")
query("a8_a10_collected", lambda t: t.customer.groupBy("c_nationkey").agg(F.array_join(F.slice(F.array_sort(F.collect_list(c("c_custkey"))), 1, 3).cast("array<string>"), ",").alias("first3"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("segments"), F.max_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("richest")).where("first3 is not null"), "SELECT c_nationkey, array_to_string(list_slice(list(c_custkey ORDER BY c_custkey), 1, 3), ',') AS first3, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments, first(c_name ORDER BY c_acctbal DESC, c_custkey DESC) AS richest FROM customer GROUP BY 1")
query("a14_keep_first_last", lambda t: rounded(latest_by(t.orders, ["o_custkey"], [c("o_orderdate"), c("o_orderkey")]).select("o_custkey", c("o_orderkey").alias("first_order")).join(latest_by(t.orders, ["o_custkey"], [c("o_orderdate").desc(), c("o_orderkey").desc()]).select("o_custkey", c("o_orderkey").alias("last_order")), "o_custkey")), "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order FROM orders GROUP BY 1")
query("a16_top_n", lambda t: rounded(top_n(t.orders, ["o_custkey"], [c("o_totalprice").desc(), c("o_orderkey")], 3, "rank").select("o_custkey", "o_orderkey", "o_totalprice", "rank"), 2), "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 3")
query("a17_quantiles", lambda t: rounded(t.orders.groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("median"), F.percentile("o_totalprice", 0.9).alias("q90"), F.avg("o_totalprice").alias("mean")), 4), "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS q90, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
query("a18_pivot", lambda t: t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0), "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
query("a20_two_stage", lambda t: rounded(t.market.groupBy(F.date_trunc("week", "d").cast("date").alias("week")).agg(F.avg("close").alias("mean")).withColumn("rolling", F.avg("mean").over(Window.orderBy("week").rowsBetween(-7, 0)))), "SELECT week, round(mean, 6) AS mean, round(avg(mean) OVER (ORDER BY week ROWS 7 PRECEDING), 6) AS rolling FROM (SELECT CAST(date_trunc('week', d) AS DATE) AS week, avg(close) AS mean FROM market GROUP BY 1)")
query("a22_compound_month", lambda t: rounded(t.market.withColumn("r", c("close") / F.lag("close").over(Window.orderBy("d")) - 1).groupBy(F.trunc("d", "month").alias("month")).agg((F.product(1 + F.coalesce(c("r"), F.lit(0.0))) - 1).alias("total"))), "SELECT CAST(date_trunc('month', d) AS DATE) AS month, round(product(1 + coalesce(r, 0)) - 1, 6) AS total FROM (SELECT d, close / lag(close) OVER (ORDER BY d) - 1 AS r FROM market) GROUP BY 1")
query("a23_correlation", lambda t: rounded(t.lineitem.groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"))), "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
query("a24_argmax_row", lambda t: t.bars.groupBy("ticker").agg(F.max_by(F.struct("d", "volume"), F.struct("volume", "d")).alias("m")).select("ticker", "m.d", "m.volume"), "SELECT ticker, last(d ORDER BY volume, d) AS d, last(volume ORDER BY volume, d) AS volume FROM bars GROUP BY 1")

# Windows
query("w1_latest_revision", lambda t: rounded(latest_by(t.fin_cum, ["ticker", "fy", "q"], [c("disclosed").desc(), c("sales").desc()]), 2), "SELECT ticker, fy, q, n, disclosed, round(sales, 2) AS sales FROM fin_cum QUALIFY row_number() OVER (PARTITION BY ticker, fy, q ORDER BY disclosed DESC, sales DESC) = 1")
query("w4_w7_moving", lambda t: rounded(t.bars.select("ticker", "d", F.avg("close").over(w().rowsBetween(-19, 0)).alias("ma"), F.max("high").over(w().rowsBetween(-19, 0)).alias("hi"), F.min("low").over(w().rowsBetween(-19, 0)).alias("lo"), F.max("high").over(w().rowsBetween(1, 20)).alias("ahead"), F.stddev_samp("close").over(w().rowsBetween(-19, 0)).alias("sd"), F.count("*").over(w().rowsBetween(-19, 0)).alias("n")), 5), "SELECT ticker, d, round(avg(close) OVER w, 5) AS ma, round(max(high) OVER w, 5) AS hi, round(min(low) OVER w, 5) AS lo, round(max(high) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), 5) AS ahead, round(stddev_samp(close) OVER w, 5) AS sd, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING)")
query("w8_anchored_sum", lambda t: t.bars.select("ticker", "d", F.sum("volume").over(Window.partitionBy("ticker", F.date_trunc("week", "d")).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)).alias("volume")), "SELECT ticker, d, sum(volume) OVER (PARTITION BY ticker, date_trunc('week', d) ORDER BY d ROWS UNBOUNDED PRECEDING) AS volume FROM bars")
query("w11_nearest_two_sides", lambda t: nearest_two_sides(t.corp_events, t.bars.select("ticker", "d"), "ticker", "event_d", "d", 2), "SELECT ticker, event_d, CASE WHEN d < event_d THEN 'PREV' ELSE 'AFTER' END AS side, CAST(row_number() OVER (PARTITION BY ticker, event_d, d < event_d ORDER BY abs(d - event_d)) AS INTEGER) AS k, d FROM corp_events JOIN bars USING (ticker) WHERE d <> event_d QUALIFY k <= 2")
query("w12_revision_number", lambda t: t.fin_cum.select("ticker", "fy", "q", "disclosed", F.row_number().over(over(["ticker", "fy", "q"], ["disclosed", "sales"])).alias("revision")), "SELECT ticker, fy, q, disclosed, CAST(row_number() OVER (PARTITION BY ticker, fy, q ORDER BY disclosed, sales) AS INTEGER) AS revision FROM fin_cum")
query("w13_rolling_rank", lambda t: rounded(t.bars10.select("ticker", "d", rolling_rank("volume", w(), 60).alias("rank"))), "SELECT ticker, d, CASE WHEN len(h) >= 60 THEN round((len(list_filter(h, lambda x: x < volume)) + (len(list_filter(h, lambda x: x = volume)) + 1) / 2) / len(h), 6) END AS rank FROM (SELECT ticker, d, volume, list(volume) OVER (PARTITION BY ticker ORDER BY d ROWS 59 PRECEDING) AS h FROM bars10)")
query("w14_cross_rank", lambda t: rounded(cross_rank(t.bars.select("ticker", "d", "volume"), ["d"], "volume", "rank")), "SELECT ticker, d, volume, round((rank() OVER (PARTITION BY d ORDER BY volume) + (count(*) OVER (PARTITION BY d, volume) - 1) / 2) / count(*) OVER (PARTITION BY d), 6) AS rank FROM bars")
query("w15_rolling_median", lambda t: rounded(t.bars10.select("ticker", "d", rolling_median("close", w(), 21).alias("m"))), "SELECT ticker, d, CASE WHEN count(close) OVER w >= 21 THEN round(median(close) OVER w, 6) END AS m FROM bars10 WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 20 PRECEDING)")
query("w16_rolling_correlation", lambda t: rounded(t.bars10.select("ticker", "d", rolling(F.corr("close", "volume"), c("close"), w(), 30).alias("r")), 5), "SELECT ticker, d, CASE WHEN count(close) OVER w >= 30 THEN round(corr(close, volume) OVER w, 5) END AS r FROM bars10 WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 29 PRECEDING)")
query("w17_streak", lambda t: streak(t.bars.select("ticker", "d", "volume"), ["ticker"], ["d"], c("volume") > 25, "run"), "WITH x AS (SELECT ticker, d, volume, volume > 25 AS f, sum(CASE WHEN volume > 25 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY d) AS g FROM bars) SELECT ticker, d, volume, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, g ORDER BY d) AS BIGINT) AS run FROM x")
query("w19_returns", lambda t: rounded(t.bars.select("ticker", "d", (ratio(c("close"), F.lag("close", 5).over(w())) - 1).alias("r5"), F.log(c("close") / F.lag("close").over(w())).alias("log_r"))), "SELECT ticker, d, round(close / nullif(lag(close, 5) OVER w, 0) - 1, 6) AS r5, round(ln(close / lag(close) OVER w), 6) AS log_r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)")
query("w20_forward_fill", lambda t: rounded(t.calendar.crossJoin(F.broadcast(t.bars.select("ticker").distinct())).join(t.bars.select("ticker", "d", "close"), ["ticker", "d"], "left").select("ticker", "d", forward_fill("close", w(), 3).alias("filled"))), "WITH x AS (SELECT k.ticker, c.d, b.close FROM calendar c CROSS JOIN (SELECT DISTINCT ticker FROM bars) k LEFT JOIN bars b ON b.ticker = k.ticker AND b.d = c.d) SELECT ticker, d, round(last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS filled FROM x")
query("w21_drawdown", lambda t: rounded(t.bars.select("ticker", "d", "close").withColumn("dd", drawdown("close", ["ticker"], ["d"]))), "SELECT ticker, d, round(close, 6) AS close, round(close / max(close) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) - 1, 6) AS dd FROM bars")
query("w22_trailing_hit_rate", lambda t: rounded(t.bars.withColumn("win", (c("close") > c("open")).cast("double")).select("ticker", "d", F.when(F.count("win").over(w().rowsBetween(-20, -1)) == 20, F.avg("win").over(w().rowsBetween(-20, -1))).alias("rate"))), "SELECT ticker, d, CASE WHEN count(*) OVER w = 20 THEN round(avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) OVER w, 6) END AS rate FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
query("w25_w26_counts", lambda t: t.bars.select("ticker", "d", (F.row_number().over(w()) - 1).alias("i"), F.count("*").over(over(["d"])).alias("names")), "SELECT ticker, d, CAST(row_number() OVER (PARTITION BY ticker ORDER BY d) - 1 AS INTEGER) AS i, count(*) OVER (PARTITION BY d) AS names FROM bars")
query("w31_competition_rank", lambda t: t.orders.select("o_custkey", "o_orderkey", F.rank().over(Window.partitionBy("o_custkey").orderBy(F.to_date("o_orderdate").desc())).alias("rank")), "SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC) AS INTEGER) AS rank FROM orders")

# Order, top rows, sets
query("t2_ranked_top", lambda t: rounded(t.orders.orderBy(c("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice").withColumn("rank", F.row_number().over(Window.orderBy(c("o_totalprice").desc(), "o_orderkey"))), 2), "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 50")
query("t3_custom_order", lambda t: t.customer.select("c_custkey", "c_mktsegment", F.when(c("c_mktsegment") == "BUILDING", 0).when(c("c_acctbal") < 0, 2).otherwise(1).alias("k")).orderBy("k", c("c_custkey").desc()).limit(40), "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS k FROM customer ORDER BY k, c_custkey DESC LIMIT 40")
query("t6_top_share", lambda t: t.bars.join(t.bars.groupBy("d").agg(F.percentile("volume", 0.8).alias("cut")), "d").where("volume >= cut").select("ticker", "d"), "SELECT ticker, d FROM (SELECT ticker, d, volume, quantile_cont(volume, 0.8) OVER (PARTITION BY d) AS cut FROM bars) WHERE volume >= cut")
query("u1_union_all", lambda t: t.supplier.select(c("s_suppkey").alias("id"), F.lit("s").alias("kind")).unionByName(t.customer.select(c("c_custkey").alias("id"), F.lit("c").alias("kind"))), "SELECT s_suppkey AS id, 's' AS kind FROM supplier UNION ALL SELECT c_custkey, 'c' FROM customer")
query("u3_provenance", lambda t: provenance(t.customer.where("c_custkey % 2 = 0").select("c_custkey"), t.customer.where("c_custkey % 3 = 0").select("c_custkey"), ["c_custkey"], ("BOTH", "KEYWORD_ONLY", "VECTOR_ONLY")), "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'BOTH' WHEN c_custkey % 2 = 0 THEN 'KEYWORD_ONLY' ELSE 'VECTOR_ONLY' END AS hit_type FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
query("u4_u5_sets", lambda t: t.bars.select("ticker").intersect(t.supplier.select(c("s_suppkey").alias("ticker"))).join(t.corp_events.where("event_d > date'2001-06-01'").select("ticker"), "ticker", "left_anti"), "SELECT DISTINCT ticker FROM bars WHERE ticker IN (SELECT s_suppkey FROM supplier) AND ticker NOT IN (SELECT ticker FROM corp_events WHERE event_d > DATE '2001-06-01')")

# Scalars
query("f2_f3_maths", lambda t: rounded(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", ratio(c("l_tax"), c("l_discount")).alias("safe"), sigmoid(c("l_discount") * 10 - 0.5).alias("s"), normalised(c("l_quantity"), 10, 40).alias("n"), clip(c("l_quantity"), 5, 45).alias("clipped"), change(c("l_tax"), c("l_discount"), 5).alias("chg"))), "SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax / nullif(l_discount, 0), 6) AS safe, round(1 / (1 + exp(-(l_discount * 10 - 0.5))), 6) AS s, round(least(greatest((l_quantity - 25.0) / 15, -1), 1), 6) AS n, round(least(greatest(l_quantity, 5), 45), 6) AS clipped, CASE WHEN l_discount <> 0 THEN round(least(greatest((l_tax - l_discount) / abs(l_discount), -5), 5), 6) END AS chg FROM lineitem")
query("f4_dates", lambda t: t.orders.select("o_orderkey", F.date_sub(F.to_date("o_orderdate"), 30).alias("before"), F.date_trunc("week", "o_orderdate").cast("date").alias("week"), F.last_day("o_orderdate").alias("month_end"), F.date_format("o_orderdate", "yyyyMM").alias("ym"), F.weekofyear("o_orderdate").alias("iso_week"), F.unix_date(F.to_date("o_orderdate")).alias("days"), month_of(F.to_date("o_orderdate")).alias("about")), "SELECT o_orderkey, CAST(o_orderdate AS DATE) - 30 AS before, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, last_day(o_orderdate) AS month_end, strftime(o_orderdate, '%Y%m') AS ym, CAST(weekofyear(o_orderdate) AS INTEGER) AS iso_week, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS days, CAST(date_trunc('month', CASE WHEN day(o_orderdate) <= 15 THEN o_orderdate - INTERVAL 1 MONTH ELSE o_orderdate END) AS DATE) AS about FROM orders")
query("f5_trading_shift", lambda t: shift_days(shift_days(t.corp_events, t.calendar, "event_d", 3, "later"), t.calendar, "event_d", -1, "earlier"), "SELECT e.ticker, e.event_d, l.d AS later, b.d AS earlier FROM corp_events e JOIN calendar c ON c.d = e.event_d LEFT JOIN calendar l ON l.n = c.n + 3 LEFT JOIN calendar b ON b.n = c.n - 1")
query("f5_on_or_before", lambda t: on_or_before(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("od")), t.calendar, "od", "trade_day"), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS od, (SELECT max(d) FROM calendar WHERE d <= CAST(o_orderdate AS DATE)) AS trade_day FROM orders")
query("f6_era_year", lambda t: t.region.select("r_regionkey", era_year(F.element_at(F.array(F.lit("R6"), F.lit("H30"), F.lit("S64"), F.lit("X1"), F.lit("R1年")), c("r_regionkey") + 1)).alias("y")), "SELECT r_regionkey, [2024, 2018, 1989, NULL, 2019][r_regionkey + 1] AS y FROM region")
query("f8_fiscal_roll", lambda t: t.fin_cum.select("ticker", "fy", "q", "disclosed", *(x.alias(n) for x, n in zip(fiscal_roll(c("fy"), c("q")), ("next_fy", "next_q")))), "SELECT ticker, fy, q, disclosed, CASE WHEN q = 'FY' THEN fy + 1 ELSE fy END AS next_fy, CASE q WHEN 'FY' THEN '1Q' WHEN '1Q' THEN '2Q' WHEN '2Q' THEN '3Q' ELSE 'FY' END AS next_q FROM fin_cum")
query("f9_f10_strings", lambda t: t.part.select("p_partkey", F.lpad(c("p_size").cast("string"), 4, "0").alias("padded"), F.upper(F.substring("p_name", 1, 4)).alias("head"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("number"), F.regexp_replace("p_type", "[AEIOU]", "").alias("cons"), F.element_at(F.split("p_name", " "), 1).alias("first_word")), r"SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, upper(substr(p_name, 1, 4)) AS head, regexp_extract(p_brand, '(\d+)', 1) AS number, regexp_replace(p_type, '[AEIOU]', '', 'g') AS cons, string_split(p_name, ' ')[1] AS first_word FROM part")
query("f11_json", lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
query("st10_session_rule", lambda t: t.events.select("event_id", in_session(c("ts") + F.expr("INTERVAL 300 DAYS")).alias("open")), "SELECT event_id, hour(ts + INTERVAL 300 DAY) * 60 + minute(ts + INTERVAL 300 DAY) < CASE WHEN CAST(ts + INTERVAL 300 DAY AS DATE) < DATE '2024-11-05' THEN 900 ELSE 930 END AS open FROM events")
query("d61_kelly", lambda t: rounded(t.lineitem.groupBy("l_suppkey").agg(F.avg((c("l_quantity") > 25).cast("double")).alias("p"), (F.avg("l_discount") / F.avg("l_tax")).alias("b")).select("l_suppkey", kelly(c("p"), c("b"), 0.5).alias("stake"))), "SELECT l_suppkey, round(greatest(p - (1 - p) / nullif(b, 0), 0) * 0.5, 6) AS stake FROM (SELECT l_suppkey, avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END) AS p, avg(l_discount) / avg(l_tax) AS b FROM lineitem GROUP BY 1)")
query("d80_near_triggers", lambda t: near_triggers(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", ["event_id"], 300).select("event_id", "user_id", "gap_micros"), "SELECT event_id, user_id, gap AS gap_micros FROM (SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap <= 300000000")
