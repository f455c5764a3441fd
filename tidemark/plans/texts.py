"""Documents, vectors, files, streams and learned models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import documents as docs, vectors
from ..operators.scoring import earnings_score, late_filing_score, outcome, return_class, score_class
from ..sources import tables
from ..streaming import monitor
from .fixtures import Tables, query, rounded

c = F.col


def scratch(t: Tables, name: str) -> str:
    return tables.scratch_path(t.spark, name)


# Documents
query("v1_normalise", lambda t: t.documents.select("doc_id", F.sha2(docs.normalise(c("text")), 256).alias("digest")), r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\v\f　]+', ' ', 'g'), ' *\r?\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
query("v2_fixed_chunks", lambda t: docs.fixed_chunks(t.documents, "doc_id", "text", 400, 50).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk_text")).alias("longest"), F.min_by("chunk_text", "chunk_index").alias("first"), F.max_by("chunk_text", "chunk_index").alias("last")), "WITH n AS (SELECT doc_id, text, greatest(ceil((length(text) - 50) / 350), 1)::BIGINT AS n FROM documents WHERE length(text) > 0), k AS (SELECT doc_id, i, substr(text, (i * 350 + 1)::BIGINT, 400) AS ch FROM n, LATERAL (SELECT unnest(range(n)) AS i) u) SELECT doc_id, count(*) AS chunks, max(length(ch))::INTEGER AS longest, arg_min(ch, i) AS first, arg_max(ch, i) AS last FROM k GROUP BY 1")
query("v2_recursive_chunks", lambda t: docs.chunks(t.documents, "doc_id", "text"))


def _sections(t):
    x = docs.fixed_chunks(t.documents, "doc_id", "text", 400, 0)
    return docs.sections(x, "doc_id", r"([A-Z][a-z]{8,})").select("doc_id", "chunk_index", "section")


_SECTIONS = "WITH k AS (SELECT doc_id, i::INTEGER AS chunk_index, substr(text, (i * 400 + 1)::BIGINT, 400) AS ch FROM (SELECT doc_id, text, greatest(ceil(length(text) / 400), 1)::BIGINT AS n FROM documents WHERE length(text) > 0), LATERAL (SELECT unnest(range(n)) AS i) u), s AS (SELECT doc_id, chunk_index, last_value(nullif(regexp_extract(ch, '([A-Z][a-z]{8,})', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS section FROM k) "
query("v3_x7_sections", _sections, _SECTIONS + "SELECT * FROM s")
query("v4_section_filter", lambda t: docs.section_filter(_sections(t), "doc_id", ["Nothing"], 0.5, ["Ofanthering"]).groupBy("doc_id").agg(F.count("*").alias("n")), _SECTIONS + "SELECT doc_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY chunk_index) AS i, count(*) OVER (PARTITION BY doc_id, section) AS m FROM s) WHERE coalesce(section <> 'Nothing', true) AND (coalesce(section <> 'Ofanthering', true) OR i <= greatest(1, floor(m * 0.5))) GROUP BY 1")
query("v5_line_counts", lambda t: t.documents.select("doc_id", F.size(F.split("text", "\n")).alias("pages"), F.regexp_count("text", F.lit(r"\d")).alias("digits")), "SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS pages, len(regexp_extract_all(text, '[0-9]'))::INTEGER AS digits FROM documents")
query("v6_truncation", lambda t: t.documents.select("doc_id", F.length(F.substring("text", F.lit(1), F.when(c("lang") == "en", 1000).otherwise(500))).alias("kept")), "SELECT doc_id, length(substr(text, 1, CASE WHEN lang = 'en' THEN 1000 ELSE 500 END))::INTEGER AS kept FROM documents")
query("v7_category", lambda t: t.documents.select("doc_id", F.when(c("text").rlike("License"), "legal").when(c("text").rlike(r"@"), "contact").when(c("text").rlike(r"\|"), "table").otherwise("prose").alias("category")), "SELECT doc_id, CASE WHEN regexp_matches(text, 'License') THEN 'legal' WHEN regexp_matches(text, '@') THEN 'contact' WHEN contains(text, '|') THEN 'table' ELSE 'prose' END AS category FROM documents")
query("v8_theme_search", lambda t: docs.theme_hits(t.documents, "source", "text", ["the", "th[a-z]+ing"]), "SELECT source, count(*) AS hits, max(length(text))::INTEGER AS longest FROM documents WHERE regexp_matches(text, 'the') AND regexp_matches(text, 'th[a-z]+ing') GROUP BY 1")


def _vector_hits(t, most):
    return vectors.closest(t.embeddings.where("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", most).withColumnRenamed("neighbour", "vec_id")


_VECTOR = "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id % 20 = 0), h AS (SELECT vec_id, min(1 - list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(q, lambda x: x::DOUBLE)) / (sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) * sqrt(list_dot_product(list_transform(q, lambda x: x::DOUBLE), list_transform(q, lambda x: x::DOUBLE))))) AS distance FROM embeddings, q GROUP BY 1 HAVING distance <= {most}) "
query("v9_f14_vector_search", lambda t: rounded(_vector_hits(t, 0.8), 5), _VECTOR.format(most=0.8) + "SELECT vec_id, round(distance, 5) AS distance FROM h")
query("v10_hybrid", lambda t: docs.hybrid(t.documents.where(c("text").rlike("License")).select(c("doc_id").alias("vec_id"), F.lit(1).alias("hits")), _vector_hits(t, 0.8), "vec_id").select("vec_id", "hit_type", "type_order"), _VECTOR.format(most=0.8) + ", k AS (SELECT doc_id AS vec_id FROM documents WHERE regexp_matches(text, 'License')) SELECT vec_id, CASE WHEN a AND b THEN 'BOTH' WHEN a THEN 'KEYWORD_ONLY' ELSE 'VECTOR_ONLY' END AS hit_type, CASE WHEN a AND b THEN 0 WHEN b AND a IS NULL THEN 1 ELSE 2 END AS type_order FROM (SELECT vec_id, true AS a FROM k) FULL JOIN (SELECT vec_id, true AS b FROM h) USING (vec_id)")
query("v11_theme_evolution", lambda t: docs.theme_evolution(t.events.withColumn("period", F.when(F.dayofmonth("ts") <= 10, "prior").when(F.dayofmonth("ts") <= 20, "mid").otherwise("recent")).groupBy("user_id", "period").agg(F.count("*").alias("n")), "user_id", "period", "n"), "WITH x AS (SELECT user_id, count(*) FILTER (day(ts) <= 10) AS prior, count(*) FILTER (day(ts) BETWEEN 11 AND 20) AS mid, count(*) FILTER (day(ts) > 20) AS recent FROM events GROUP BY 1) SELECT user_id, prior, mid, recent, concat_ws('+', CASE WHEN prior = 0 AND mid = 0 AND recent > 0 THEN 'new' END, CASE WHEN recent > mid AND mid >= prior AND mid > 0 THEN 'rising' END, CASE WHEN recent < mid AND mid > 0 THEN 'fading' END, CASE WHEN prior > 0 AND mid = 0 AND recent > 0 THEN 'revived' END) AS signals FROM x")
query("v12_reconstruct", lambda t: docs.reconstruct(docs.fixed_chunks(t.documents, "doc_id", "text", 400, 0), "doc_id").select("doc_id", "n_chunks", F.sha2("text", 256).alias("digest")), "SELECT doc_id, greatest(ceil(length(text) / 400), 1)::BIGINT AS n_chunks, sha256(text) AS digest FROM documents WHERE length(text) > 0")
query("v13_quality_gate", lambda t: rounded(t.documents.select("doc_id", docs.quality_ratio(c("text")).alias("ratio")), 5), r"SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}\p{N}\p{P}\s]', '', 'g')) / nullif(length(text), 0), 5) AS ratio FROM documents")
query("v15_mentions", lambda t: docs.mentions(t.documents, "text", t.nation.select(F.lower(F.substring("n_name", 1, 3)).alias("k"), "n_name"), "k", "n_name").groupBy("n_name").agg(F.count("*").alias("n")), "SELECT n_name, count(*) AS n FROM documents JOIN nation ON contains(lower(text), lower(substr(n_name, 1, 3))) GROUP BY 1")
query("s13_page_items", lambda t: docs.page_items(t.pages, "page_id", "html"), "WITH l AS (SELECT page_id, x.l AS l, x.n AS n FROM (SELECT page_id, regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1) AS ls FROM pages), LATERAL (SELECT unnest(ls) AS l, generate_subscripts(ls, 1) AS n) x) SELECT page_id, (n - 1)::INTEGER AS list, (y.i - 1)::INTEGER AS item, trim(regexp_replace(y.t, '<[^>]*>', '', 'g')) AS text FROM (SELECT page_id, n, regexp_extract_all(l, '(?s)<li>(.*?)</li>', 1) AS ts FROM l), LATERAL (SELECT unnest(ts) AS t, generate_subscripts(ts, 1) AS i) y")
query("v14_html_counts", lambda t: t.pages.select("page_id", F.regexp_count("html", F.lit("<li>")).alias("items"), F.element_at(F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), 1), 1).alias("heading")), "SELECT page_id, len(regexp_extract_all(html, '<li>'))::INTEGER AS items, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)[1] AS heading FROM pages")


# Scores
def _features(t):
    k = c("l_orderkey") % 11
    num = lambda a, b: ((c("l_partkey") * a + c("l_suppkey") * b) % 41 - 20) / 20.0
    return t.lineitem.select("l_orderkey", "l_partkey", F.element_at(F.array(F.lit("1Q"), F.lit("2Q"), F.lit("3Q"), F.lit("FY")), (c("l_orderkey") % 4 + 1).cast("int")).alias("quarter"), F.abs(num(1, 3)).alias("progress"), num(3, 1).alias("revision"), F.when(k > 2, num(5, 2)).alias("consensus_ordinary"), F.when(k > 4, num(2, 7)).alias("consensus_net"), num(7, 1).alias("qoq"), F.when(k > 1, num(1, 9)).alias("yoy"), num(9, 4).alias("eps_change"), num(4, 9).alias("op_change"), num(6, 5).alias("growth_gap"), num(8, 3).alias("dividend_change"), F.abs(num(3, 8)).alias("achievement"), (c("l_quantity") / 2).alias("per"), num(5, 6).alias("growth"), (k == 1).alias("selloff"), (k == 2).alias("special_dividend"), (k == 3).alias("buyback"), (k == 4).alias("split"), (k == 5).alias("low_profit"), (k == 6).alias("turnaround"), (k == 7).alias("undisclosed_next"), c("l_extendedprice").alias("market_cap"))


def _score_sql() -> str:
    num = lambda a, b: f"((l_partkey * {a} + l_suppkey * {b}) % 41 - 20) / 20.0::DOUBLE"
    step = lambda x, *s: "CASE " + " ".join(f"WHEN {x} {o} {b} THEN {p}" for o, b, p in s) + " ELSE 0 END"
    peg = step("(per / nullif(growth * 100, 0))", ("<", 0.5, 2), ("<", 1, 1), (">", 10, -3), (">", 5, -2), (">", 2, -1))
    return f"""WITH f AS (SELECT l_orderkey, l_partkey, l_orderkey % 11 AS k, ['1Q', '2Q', '3Q', 'FY'][(l_orderkey % 4 + 1)::INTEGER] AS quarter, abs({num(1, 3)}) AS progress, {num(3, 1)} AS revision, CASE WHEN l_orderkey % 11 > 2 THEN {num(5, 2)} END AS co, CASE WHEN l_orderkey % 11 > 4 THEN {num(2, 7)} END AS cn, {num(7, 1)} AS qoq, CASE WHEN l_orderkey % 11 > 1 THEN {num(1, 9)} END AS yoy, {num(9, 4)} AS eps0, {num(4, 9)} AS op, {num(6, 5)} AS gap, {num(8, 3)} AS dv, abs({num(3, 8)}) AS ach, l_quantity / 2 AS per, {num(5, 6)} AS growth, l_extendedprice AS cap FROM lineitem),
    g AS (SELECT *, CASE WHEN k <> 4 THEN eps0 END AS eps, CASE WHEN abs(cn) > coalesce(abs(co), -1) THEN cn ELSE co END AS dev, progress / CASE quarter WHEN '1Q' THEN 0.25 WHEN '2Q' THEN 0.5 WHEN '3Q' THEN 0.75 END AS pr FROM f),
    s AS (SELECT *, {step('pr', ('>', 1.2, 1), ('<', 0.8, -1))} + {step('revision', ('>', 0.001, 1), ('<', -0.001, -1))} + {step('dev', ('>', 0.1, 3), ('>', 0.05, 2), ('>', 0, 1), ('<', -0.3, -5), ('<', -0.2, -4), ('<', -0.1, -3), ('<', -0.05, -2), ('<', 0, -1))} + CASE WHEN k = 7 AND cap >= 3000 THEN -1 ELSE 0 END + CASE k WHEN 1 THEN -2 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END + CASE WHEN k <> 4 THEN {step('dv', ('<', -0.2, -3), ('<', -0.05, -2), ('>', 0.05, 1))} ELSE 0 END + CASE WHEN k <> 5 THEN {step('qoq', ('>', 0.5, 1), ('<', -0.5, -2))} ELSE 0 END + CASE WHEN quarter = 'FY' THEN {step('ach', ('<', 0.65, -2), ('<', 0.8, -1))} ELSE 0 END AS direct,
        CASE WHEN quarter = 'FY' THEN {step('eps', ('>', 0.1, 2), ('<', -0.1, -2))} + CASE WHEN eps IS NULL OR sign(eps) = sign(op) THEN {step('op', ('>', 0.1, 1), ('<', -0.1, -1))} ELSE 0 END + CASE WHEN k <> 5 THEN {step('gap', ('>', 0.2, 1), ('<', -0.2, -1))} ELSE 0 END + CASE WHEN k <> 4 AND growth > 0 THEN {peg} ELSE 0 END ELSE 0 END AS guidance,
        CASE WHEN k <> 5 THEN {step('yoy', ('>', 0.3, 1), ('<', -0.3, -1))} ELSE 0 END + CASE WHEN k = 6 THEN CASE WHEN yoy IS NOT NULL THEN 2 ELSE 1 END ELSE 0 END + CASE WHEN quarter <> 'FY' AND k <> 4 AND growth > 0 THEN {peg} ELSE 0 END AS perf FROM g)
    SELECT l_orderkey, l_partkey, (direct + least(greatest(guidance, -3), 3) + least(greatest(perf, -3), 3))::DOUBLE AS score, CASE WHEN direct + least(greatest(guidance, -3), 3) + least(greatest(perf, -3), 3) >= 2 THEN 'UP' WHEN direct + least(greatest(guidance, -3), 3) + least(greatest(perf, -3), 3) <= -2 THEN 'DOWN' ELSE 'NEUTRAL' END AS class FROM s"""


query("d28_x2_earnings_score", lambda t: earnings_score(_features(t)).select("l_orderkey", "l_partkey", "score", score_class(c("score")).alias("class")), _score_sql())
query("d56_x3_late_filing", lambda t: late_filing_score(t.lineitem.select("l_orderkey", "l_partkey", (c("l_quantity") / 40).alias("pbr"), (c("l_discount") * 7).alias("cash_share"), (c("l_tax") * 8).alias("parent_share"), (c("l_partkey") % 50).alias("late_days"), (c("l_suppkey") % 2 == 0).alias("repeated"))).select("l_orderkey", "l_partkey", "score", F.array_join("reasons", "+").alias("reasons")), "WITH x AS (SELECT l_orderkey, l_partkey, CASE WHEN l_quantity / 40 < 0.7 THEN 2 WHEN l_quantity / 40 < 1 THEN 1 END AS a, CASE WHEN l_discount * 7 > 0.5 THEN 2 WHEN l_discount * 7 > 0.3 THEN 1 END AS b, CASE WHEN l_tax * 8 > 0.5 THEN 3 WHEN l_tax * 8 > 0.3 THEN 1 END AS p, CASE WHEN l_partkey % 50 >= 30 THEN 2 WHEN l_partkey % 50 >= 7 THEN 1 END AS l, CASE WHEN l_suppkey % 2 = 0 THEN 1 END AS r FROM lineitem) SELECT l_orderkey, l_partkey, coalesce(a, 0) + coalesce(b, 0) + coalesce(p, 0) + coalesce(l, 0) + coalesce(r, 0) AS score, concat_ws('+', CASE WHEN a IS NOT NULL THEN 'cheap' END, CASE WHEN b IS NOT NULL THEN 'cash' END, CASE WHEN p IS NOT NULL THEN 'parent' END, CASE WHEN l IS NOT NULL THEN 'late' END, CASE WHEN r IS NOT NULL THEN 'again' END) AS reasons FROM x")
query("d78_outcomes", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", outcome(score_class(c("l_quantity") % 7 - 3), return_class(F.when(c("l_tax") > 0.01, c("l_discount") - 0.05))).alias("outcome")), "WITH x AS (SELECT *, CASE WHEN l_quantity % 7 - 3 >= 2 THEN 'UP' WHEN l_quantity % 7 - 3 <= -2 THEN 'DOWN' ELSE 'NEUTRAL' END AS p, CASE WHEN l_tax > 0.01 THEN CASE WHEN l_discount - 0.05 > 0.02 THEN 'UP' WHEN l_discount - 0.05 < -0.02 THEN 'DOWN' ELSE 'NEUTRAL' END END AS a FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a IS NULL THEN 'check' WHEN p = 'NEUTRAL' THEN 'neutral' WHEN p = a THEN 'hit' ELSE 'miss' END AS outcome FROM x")


# Files: written, read again
def _round_trip(t, kind: str) -> DataFrame:
    path, x = scratch(t, kind), t.customer.select("c_custkey", "c_name", F.when(c("c_acctbal") > 0, c("c_acctbal")).alias("c_acctbal"))
    if kind == "csv":
        x.select("c_custkey", "c_name", F.coalesce(c("c_acctbal").cast("string"), F.lit("*****")).alias("bal")).write.option("header", "true").csv(path)
        return tables.read_csv(t.spark, path, {"c_custkey": ("c_custkey", "long"), "c_name": ("c_name", "string"), "bal": ("c_acctbal", "double")})
    if kind == "json":
        x.write.json(path)
        return tables.read_json(t.spark, path, "c_custkey long, c_name string, c_acctbal double")
    x.write.parquet(path)
    return t.spark.read.parquet(path)


for _kind in ("csv", "json", "parquet"):
    query(f"k12_{_kind}_round_trip", lambda t, k=_kind: rounded(_round_trip(t, k), 2), "SELECT c_custkey, c_name, round(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 2) AS c_acctbal FROM customer")


def _days(t):
    path, x = scratch(t, "days"), t.orders.select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    tables.write_days(x, path, "y", ["o_orderkey"])
    again = x.where("y = 1997").withColumn("o_orderstatus", F.lit("R"))
    tables.write_days(again, path, "y", ["o_orderkey"])
    tables.write_days(again, path, "y", ["o_orderkey"])  # once more: nothing doubles
    return t.spark.read.parquet(path).select("o_orderkey", "o_orderstatus", c("y").cast("int").alias("y"))


query("k3_replaced_days", _days, "SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1997 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, year(o_orderdate)::INTEGER AS y FROM orders")


# Streams, worked off and read again; the same functions run as batches
def _events(t):
    """A folder of event files, some events twice."""
    path = scratch(t, "events")
    e = t.events.select("event_id", c("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    e.unionByName(e.where("event_id % 10 = 0")).repartition(4, "event_id").write.parquet(path)
    return monitor.source(t.spark, path)


def _streamed(t, job, mode="append"):
    out, state = scratch(t, "streamed"), scratch(t, "state")
    monitor.run_available(job(_events(t)), out, state, mode)
    return t.spark.read.parquet(out)


query("st3_dedup_stream", lambda t: _streamed(t, lambda e: monitor.deduplicated(e, "60 days")).groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
query("st5_enriched_stream", lambda t: _streamed(t, lambda e: monitor.enriched(monitor.deduplicated(e, "60 days"), t.customer.select(c("c_custkey").alias("user_id"), "c_mktsegment"))).groupBy("c_mktsegment").agg(F.count("*").alias("n")), "SELECT c_mktsegment, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1")


def _latest(t, job, keys, mode="complete"):
    """The result of a stream whose output is replaced (complete) or changed by key (update)."""
    path, state = scratch(t, "latest"), scratch(t, "state")
    if mode == "complete":
        monitor.run_batches(job(_events(t)), lambda b, _: b.write.mode("overwrite").parquet(path), state, "complete")
        return t.spark.read.parquet(path)
    monitor.run_batches(job(_events(t)), monitor.keyed_sink(path), state, mode)
    x = t.spark.read.parquet(path)
    return x.groupBy(*keys).agg(*(F.max_by(k, "batch").alias(k) for k in x.columns if k not in (*keys, "batch")))


_TWICE = "WITH e AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0) "
query("st_tumbling_stream", lambda t: rounded(_latest(t, lambda e: monitor.tumbling(e), []), 4), _TWICE + "SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1, 2")
query("st_sliding_stream", lambda t: _latest(t, monitor.sliding, []), _TWICE + "SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP - to_days(k) AS start, event_type, count(*) AS n FROM e, (VALUES (0), (1)) v(k) GROUP BY 1, 2")
query("st_session_bursts", lambda t: rounded(_latest(t, monitor.bursts, []), 4), _TWICE + ", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM e), h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM h GROUP BY user_id, k")
query("st4_running_totals", lambda t: rounded(_latest(t, monitor.running_totals, ["user_id"], "update"), 4), _TWICE + "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1")
query("st7_ranked_complete", lambda t: _latest(t, lambda e: e.groupBy("user_id").agg(F.count("*").alias("n")), []).where("n >= 5"), _TWICE + "SELECT user_id, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 5")


def _matched(t):
    out, state, path = scratch(t, "matched"), scratch(t, "state"), scratch(t, "events")
    e = t.events.select("event_id", c("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    e.repartition(2, "event_id").write.parquet(path)
    source = lambda kind: monitor.source(t.spark, path, 100).where(c("event_type") == kind)
    monitor.run_available(monitor.matched_within(source("click"), source("purchase"), 600), out, state)
    return t.spark.read.parquet(out).select("user_id", "first_id", "second_id")


query("st_stream_stream_join", _matched, "SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 600 MINUTE")
query("w_batch_sessions", lambda t: rounded(monitor.bursts(t.events), 4), "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM h GROUP BY user_id, k")
