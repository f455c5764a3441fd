"""Market-like tables from the driver's tables, for Spark and as common table expressions for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.calendar import trading_calendar
from ..operators.windows import over
from ..sources.tables import read_table

#: The order of lineitem's rows; shorter keys repeat.
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
#: Rows of lineitem for a task that sorts a panel.
TASK_ROWS = 250_000


class Tables:
    """The driver's tables as attributes, and what is derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.folder, name)

    def _bars(self, ticker, tasks: int = 0) -> DataFrame:
        x = self.lineitem.select(ticker.alias("ticker"), F.to_date("l_shipdate").alias("d"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.struct(*ROW).alias("row"), "l_quantity", "l_extendedprice")
        if tasks:
            x = x.repartition(tasks, "ticker")
        return x.groupBy("ticker", "d").agg(F.min_by("px", "row").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "row").alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"))

    @cached_property
    def tasks(self) -> int:
        """So many that a task has TASK_ROWS of lineitem or so, whatever the table's size."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.lineitem.count() // TASK_ROWS))

    @cached_property
    def bars(self) -> DataFrame:
        """A panel of all names, dealt out by them."""
        return self._bars(F.col("l_suppkey"), self.tasks)

    @cached_property
    def bars10(self) -> DataFrame:
        return self._bars(F.col("l_suppkey") % 10)

    @cached_property
    def market(self) -> DataFrame:
        x = self.lineitem.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum("l_extendedprice").alias("turnover"), F.sum("l_quantity").alias("volume"))
        return x.select("d", (F.col("turnover") / F.col("volume")).alias("close"))

    @cached_property
    def calendar(self) -> DataFrame:
        return trading_calendar(self.market, "d")

    @cached_property
    def consensus(self) -> DataFrame:
        return self.lineitem.select(F.col("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("fy"), F.quarter("l_shipdate").alias("q"), F.to_date("l_shipdate").alias("dated"), F.when(F.col("l_orderkey") % 2 == 0, "A").otherwise("B").alias("source"), F.col("l_extendedprice").alias("sales"), F.when(F.col("l_orderkey") % 3 > 0, F.col("l_extendedprice") / 10).alias("profit"), *ROW)

    @cached_property
    def fin_quarters(self) -> DataFrame:
        x = self.lineitem.groupBy(F.col("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("fy"), F.quarter("l_shipdate").alias("n")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("own"), F.max(F.to_date("l_shipdate")).alias("disclosed"))
        return x

    @cached_property
    def fin_cum(self) -> DataFrame:
        x = self.fin_quarters.withColumn("sales", F.sum("own").over(over(["ticker", "fy"], ["n"])).cast("double"))
        x = x.select("ticker", "fy", F.when(F.col("n") == 4, "FY").otherwise(F.concat(F.col("n").cast("string"), F.lit("Q"))).alias("q"), "n", "disclosed", "sales")
        again = x.where("(ticker + n) % 7 = 0").select("ticker", "fy", "q", "n", F.date_add("disclosed", 5).alias("disclosed"), (F.col("sales") * 1.01).alias("sales"))
        return x.unionByName(again)

    @cached_property
    def corp_events(self) -> DataFrame:
        return self.lineitem.where("l_linenumber = 1 and l_quantity >= 48").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("event_d")).distinct()

    @cached_property
    def master(self) -> DataFrame:
        x = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return x.select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.col("n_name").alias("sector"), F.col("r_name").alias("area"), F.when(F.col("s_acctbal") > 5000, "L").when(F.col("s_acctbal") > 0, "M").otherwise("S").alias("size"), F.col("s_acctbal").alias("balance"))

    @cached_property
    def holders(self) -> DataFrame:
        return self._holders("l_suppkey", "Supplier#")

    @cached_property
    def order_holders(self) -> DataFrame:
        """Orders hold parts: most of them few, and some one alone."""
        return self._holders("l_orderkey", "Order#")

    def _holders(self, holder: str, prefix: str) -> DataFrame:
        x = self.lineitem.groupBy("l_partkey", holder).agg(F.sum("l_quantity").cast("long").alias("q"))
        x = x.withColumn("rn", F.row_number().over(over(["l_partkey"], [F.col("q").desc(), F.col(holder)]))).where("rn <= 10")
        x = x.withColumn("total", F.sum("q").over(over(["l_partkey"])))
        item = F.struct("rn", F.col(holder).alias("s"), (F.col("q") / F.col("total")).alias("ratio"))
        x = x.groupBy(F.col("l_partkey").alias("company")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        return x.select("company", F.to_json(F.transform("items", lambda i: F.struct(F.concat(F.lit(prefix), i["s"].cast("string")).alias("name"), F.round(i["ratio"] + nudge(6), 6).alias("ratio")))).alias("json"))


_ROW_SQL = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
_DAY = "CAST(l_shipdate AS DATE)"


def _bars_sql(ticker: str) -> str:
    px = "l_extendedprice / l_quantity"
    return f"SELECT {ticker} AS ticker, {_DAY} AS d, first({px} ORDER BY {_ROW_SQL}) AS open, max({px}) AS high, min({px}) AS low, last({px} ORDER BY {_ROW_SQL}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover FROM lineitem GROUP BY 1, 2"


#: Expressions by name, each after those that it needs.
CTES = {
    "bars": _bars_sql("l_suppkey"),
    "bars10": _bars_sql("l_suppkey % 10"),
    "market": f"SELECT {_DAY} AS d, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY 1",
    "calendar": f"SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT {_DAY} AS d FROM lineitem)",
    "consensus": f"SELECT l_suppkey AS ticker, year(l_shipdate) AS fy, quarter(l_shipdate) AS q, {_DAY} AS dated, CASE WHEN l_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS source, l_extendedprice AS sales, CASE WHEN l_orderkey % 3 > 0 THEN l_extendedprice / 10 END AS profit, {_ROW_SQL} FROM lineitem",
    "fin_quarters": f"SELECT l_suppkey AS ticker, year(l_shipdate) AS fy, quarter(l_shipdate) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS own, max({_DAY}) AS disclosed FROM lineitem GROUP BY 1, 2, 3",
    "fin_first": "SELECT ticker, fy, CASE WHEN n = 4 THEN 'FY' ELSE n || 'Q' END AS q, n, disclosed, CAST(sum(own) OVER (PARTITION BY ticker, fy ORDER BY n) AS DOUBLE) AS sales FROM fin_quarters",
    "fin_cum": "SELECT * FROM fin_first UNION ALL SELECT ticker, fy, q, n, disclosed + 5, sales * 1.01 FROM fin_first WHERE (ticker + n) % 7 = 0",
    "corp_events": f"SELECT DISTINCT l_suppkey AS ticker, {_DAY} AS event_d FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 48",
    "master": "SELECT s_suppkey AS ticker, s_name AS name, n_name AS sector, r_name AS area, CASE WHEN s_acctbal > 5000 THEN 'L' WHEN s_acctbal > 0 THEN 'M' ELSE 'S' END AS size, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "holder_rows": "SELECT l_partkey AS company, l_suppkey AS s, q, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) AS rn FROM (SELECT l_partkey, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)",
    "order_rows": "SELECT l_partkey AS company, l_orderkey AS s, q, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_orderkey) AS rn FROM (SELECT l_partkey, l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)",
    "order_list": "SELECT company, 'Order#' || s AS name, s, rn, round(q / sum(q) OVER (PARTITION BY company), 6) AS ratio FROM order_rows WHERE rn <= 10",
    "holder_list": "SELECT company, 'Supplier#' || s AS name, s, rn, round(q / sum(q) OVER (PARTITION BY company), 6) AS ratio FROM holder_rows WHERE rn <= 10",
}


def oracle(sql: str) -> str:
    """``sql`` after the expressions that it, and they, name."""
    import re

    used: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.append(name)
                need(CTES[name])

    need(sql)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in CTES if n in used)
    body = sql.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Register a query; ``sql`` is its DuckDB twin, with the expressions above at hand."""
    if name in QUERIES:
        raise ValueError(name)
    QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
    if sql:
        SQL[name] = _nudged(oracle(sql))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show. Quotients of cents often lie halfway between two rounded
    values, so a little is added first, here and by oracle()."""
    return df.select(*(F.round(F.col(c) + nudge(digits), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def nudge(digits: int) -> float:
    return float(f"1e-{digits + 2}")


def _nudged(sql: str) -> str:
    """``sql`` with every round(x, n) as round(x + a little, n)."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, i, comma = 1, start + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        digits = int(sql[comma + 1 : i - 1])
        out.append(f"{sql[at:start]}round(({_nudged(sql[start + 6 : comma])}) + 1e-{digits + 2}, {digits})")
        at = i
    return "".join(out) + sql[at:]
