"""Structures inside pages, panels and histories: lists and tables, trees of clusters, pairs, intervals, lists of an index, workbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markup
from ..sources import workbooks
from .fixtures import ROW, query

c = F.col


# S13 and V14: pages that hold the given tables' rows
def _order_pages(t):
    """A page for each order: a table with labels over two columns, a cell over all lines, and a table in each line."""
    x = t.lineitem.repartition(t.tasks, "l_orderkey").groupBy(c("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag"))).alias("lines"))  # a few lines an order
    cell = lambda x: F.concat(F.lit("<td align=right>"), x, F.lit("</td>"))
    line = lambda l, i: F.concat(
        F.lit("<TR>"), F.when(i == 0, F.concat(F.lit("<td rowspan='"), F.size("lines").cast("string"), F.lit("'><b>"), c("page_id").cast("string"), F.lit("</b>"))).otherwise(""),
        cell(l["l_linenumber"].cast("string")), cell(F.format_number(l["l_extendedprice"], 2)), cell(F.concat(l["l_quantity"].cast("int").cast("string"), F.lit(" &#x70;cs"))), F.lit('<td><table class="by > mode"><tr><td>'), l["l_returnflag"], F.lit("<td>1</table></td></tr>\n"),
    )
    head = "<html><body><!-- <table> --><table id=lines class='wide lines'><thead><tr><th rowspan=2>Order<th rowspan=2>Line</th><th colspan=\"3\">Amounts<br>in all</th></tr><tr><th>Price</th><th>Quantity<th>By</th></tr></thead><tbody>\n"
    return x.select("page_id", F.concat(F.lit(head), F.array_join(F.transform("lines", line), ""), F.lit("</tbody></table></body></html>")).alias("html"))


def _table_rows(t):
    x = markup.adapted_tables(_order_pages(t), "page_id", "html", {"order_no": "^Order$", "line": "^Line$", "price": "in all Price$", "quantity": "Quantity$"})
    return x.select("page_id", "table", "row", *(markup.figure(n).alias(n) for n in ("order_no", "line", "price", "quantity")))


query("v14_page_tables", _table_rows, f"""
    SELECT l_orderkey AS page_id, 0 AS "table", (1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {", ".join(ROW[2:])}))::INTEGER AS row, l_orderkey::DOUBLE AS order_no, l_linenumber::DOUBLE AS line, round(l_extendedprice, 2)::DOUBLE AS price, floor(l_quantity)::DOUBLE AS quantity FROM lineitem""")


def _customer_pages(t):
    """A page for each customer: a list of orders, in each of which there is a list of lines."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("lines"))
    item = lambda l: F.concat(F.lit('<li class="line">'), l["l_linenumber"].cast("string"), F.lit(":\n <i>"), l["l_quantity"].cast("int").cast("string"), F.lit("</i>"))
    x = t.orders.join(lines, c("o_orderkey") == c("l_orderkey")).select(c("o_custkey").alias("page_id"), "o_orderkey", F.concat(F.lit("<LI>Order "), c("o_orderkey").cast("string"), F.lit("<ol start='1'>"), F.array_join(F.transform("lines", item), ""), F.lit("</ol></LI>")).alias("item"))
    x = x.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "item"))), lambda s: s["item"]), "\n").alias("items"))
    return x.select("page_id", F.concat(F.lit("<p>Orders<ul id='orders'>"), "items", F.lit("</ul>")).alias("html"))


query("s13_nested_lists", lambda t: markup.page_lists(_customer_pages(t), "page_id", "html").drop("element_id", "element_class"), """
    WITH o AS (SELECT o_custkey AS page_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
    SELECT page_id, 0 AS list, NULL::INTEGER AS parent, 0 AS depth, (i - 1)::INTEGER AS item, 'Order ' || o_orderkey AS text FROM o
    UNION ALL SELECT page_id, i::INTEGER, 0, 1, (row_number() OVER (PARTITION BY page_id, i ORDER BY l_linenumber, l_quantity) - 1)::INTEGER, l_linenumber || ': ' || floor(l_quantity)::INTEGER FROM o JOIN lineitem ON l_orderkey = o_orderkey""")


# S7: customers as workbooks, two rows over the titles, read by title and by place
def _workbook_rows(t):
    x = t.customer.select(c("c_name").alias("Name"), c("c_custkey").alias("Key"), F.when(c("c_custkey") % 3 > 0, c("c_acctbal")).alias("Balance & more"), F.date_add(F.lit("1900-01-01").cast("date"), (c("c_custkey") % 50_000).cast("int")).alias("Since"), (c("c_nationkey") > 12).alias("Far"))
    books = workbooks.workbooks(x, ["Customers <all>", ""])
    return workbooks.read_workbook(books, {"Key": ("c_custkey", "long"), 0: ("name", "string"), "Balance & more": ("balance", "double"), "Since": ("since", "date"), 4: ("far", "boolean")}, "LIST", skip=2).drop("file", "row")


query("s7_workbook", _workbook_rows, """
    SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS balance, DATE '1900-01-01' + (c_custkey % 50000)::INTEGER AS since, c_nationkey > 12 AS far FROM customer""")
