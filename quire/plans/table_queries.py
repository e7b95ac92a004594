"""Queries over tables of packages: each order is a table whose rows are its line items.

A row has a first cell that is merged over three rows unless it shows something, two columns in the middle that one of five
sorts of cells fills, and a last pair of columns that is merged over four rows, continued by one cell, by two, or not.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import containment, grids
from .queries import _ORD, _table, query

#: The same for DuckDB: row, sort (k), whether the first cell breaks its merge, how the last pair goes on (s), free columns.
_ROWS = f"""WITH base AS (SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORD}) - 1)::INTEGER AS row, l_partkey % 5 AS k, l_suppkey % 10 = 0 AS broken, l_suppkey % 3 AS s, l_linenumber % 3 AS after FROM lineitem),
low AS (SELECT *, CASE WHEN k = 3 THEN 4 ELSE 3 END AS place FROM base),
a AS (SELECT *, min(CASE WHEN row % 3 = 0 OR NOT broken THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, row // 3 ORDER BY row) AS fit FROM low),
l AS (SELECT *, min(CASE WHEN row % 4 = 0 OR (s < 2 AND place = head) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, row // 4 ORDER BY row) AS held FROM (SELECT *, first(place) OVER (PARTITION BY doc_id, row // 4 ORDER BY row) AS head FROM low) x)
"""


def _cells(spark, sf_dir):
    """The cells of every order's table."""
    t = _table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")  # renamed first: what is dealt by it stays so
    row = (F.row_number().over(Window.partitionBy("doc_id").orderBy(F.expr(_ORD))) - 1).cast("int")
    t = t.select("doc_id", row.alias("row"), (F.col("l_partkey") % 5).alias("k"), (F.col("l_suppkey") % 10 == 0).alias("broken"), (F.col("l_suppkey") % 3).alias("s"), (F.col("l_linenumber") % 3).cast("int").alias("after"))
    cell = lambda span, across, down, text: F.struct(F.lit(span).alias("span"), F.lit(across).alias("across"), (down if not isinstance(down, str) else F.lit(down)).alias("down"), (text if not isinstance(text, str) else F.lit(text)).alias("text"))
    first = F.when(F.col("row") % 3 == 0, F.array(cell(1, "", "restart", "a"))).otherwise(F.array(cell(1, "", "continue", F.when(F.col("broken"), "b").otherwise(""))))
    sorts = ([cell(2, "", "", "c")], [cell(1, "restart", "", "c"), cell(1, "continue", "", "")], [cell(2, "restart", "", "c"), cell(1, "continue", "", "")], [cell(2, "restart", "", "c"), cell(1, "continue", "", "d")])
    middle = F.array(cell(1, "", "", "c"), cell(1, "", "", "d"))
    for k, own in enumerate(sorts):
        middle = F.when(F.col("k") == k, F.array(*own)).otherwise(middle)
    last = F.when(F.col("row") % 4 == 0, F.array(cell(2, "", "restart", "e"))).when(F.col("s") == 0, F.array(cell(2, "", "continue", "")))
    last = last.when(F.col("s") == 1, F.array(cell(1, "", "continue", ""), cell(1, "", "continue", ""))).otherwise(F.array(cell(2, "", "", "f")))
    t = t.select("doc_id", F.lit(0).alias("table_id"), "row", "after", F.lit(0).alias("before"), F.posexplode(F.concat(first, middle, last)).alias("cell", "x"))
    return t.select("doc_id", "table_id", "row", "cell", "x.*", (F.col("x.text") != "").alias("filled"), "before", "after")


@query(
    _ROWS
    + """SELECT doc_id, row - row % 3 AS row, 0 AS col, count(*) AS rowspan, 1::BIGINT AS colspan FROM a WHERE fit = 1 GROUP BY doc_id, row - row % 3 HAVING count(*) > 1
UNION ALL SELECT doc_id, row, 1, 1, 2 FROM low WHERE k < 4
UNION ALL SELECT doc_id, row - row % 4, head, count(*), 2 FROM l WHERE held = 1 GROUP BY doc_id, row - row % 4, head
UNION ALL SELECT doc_id, row, place, 1, 2 FROM l WHERE held = 0 AND row % 4 <> 0 AND s <> 1"""
)
def f19_f20_merged_rectangles(spark, sf_dir):
    """Merged rectangles of tables from the marks of their cells."""
    return grids.rectangles(_cells(spark, sf_dir)).select("doc_id", "row", "col", "rowspan", "colspan")


@query(
    _ROWS
    + """SELECT doc_id, row, col, span, text FROM (
SELECT doc_id, row, 0 AS col, 1 AS span, CASE WHEN row % 3 = 0 THEN 'a' WHEN fit = 0 AND broken THEN 'b' ELSE '' END AS text FROM a
UNION ALL SELECT doc_id, row, 1, CASE WHEN k IN (0, 2, 3) THEN 2 ELSE 1 END, 'c' FROM low
UNION ALL SELECT doc_id, row, 2, 1, CASE WHEN k = 4 THEN 'd' ELSE '' END FROM low WHERE k IN (1, 4)
UNION ALL SELECT doc_id, row, 3, 1, 'd' FROM low WHERE k = 3
UNION ALL SELECT doc_id, row, place, CASE WHEN s = 1 AND row % 4 <> 0 THEN 1 ELSE 2 END, CASE WHEN row % 4 = 0 THEN 'e' WHEN s = 2 THEN 'f' ELSE '' END FROM low
UNION ALL SELECT doc_id, row, place + 1, 1, '' FROM low WHERE s = 1 AND row % 4 <> 0) x"""
)
def f19_table_grid(spark, sf_dir):
    """Cells of tables on their grid."""
    return grids.grid(_cells(spark, sf_dir)).select("doc_id", "row", "col", "span", "text")


@query(
    _ROWS
    + """, r AS (SELECT *, row % 4 = 0 OR lag(s = 2 AND row % 4 <> 0) OVER (PARTITION BY doc_id ORDER BY row) AS root FROM low),
w AS (SELECT *, last_value(CASE WHEN root THEN CASE WHEN row % 4 = 0 OR s = 0 THEN 2 ELSE 1 END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row) AS wide FROM r),
n AS (SELECT doc_id, sum(CASE WHEN k IN (2, 3) THEN 1 ELSE 0 END) AS across, CASE WHEN doc_id % 2 = 1 THEN count(*) ELSE 0 END AS spans, sum(CASE WHEN k = 3 THEN 1 ELSE 0 END) AS seen_across, sum(CASE WHEN row % 3 <> 0 AND broken THEN 1 ELSE 0 END) AS seen_down,
  sum(CASE WHEN row % 4 = 0 OR s = 2 THEN 0 WHEN root THEN 1 + s WHEN s = 0 AND wide <> 2 THEN 1 WHEN s = 1 AND wide <> 1 THEN 2 ELSE 0 END) AS down FROM w GROUP BY doc_id)
SELECT doc_id, CASE WHEN across + spans + down + seen_across + seen_down > 0 THEN 1 ELSE 0 END::BIGINT AS irregular_tables, across::BIGINT AS irregular_across, spans::BIGINT AS irregular_spans, down::BIGINT AS irregular_down, seen_across::BIGINT AS visible_across, seen_down::BIGINT AS visible_down FROM n"""
)
def g10_h31_irregular_merges(spark, sf_dir):
    """Irregular merges of each document's tables; every second table declares a column too few."""
    columns = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("table_id"), (F.lit(5) - (F.col("o_orderkey") % 2)).cast("int").alias("grid_columns"))
    return grids.irregularities(_cells(spark, sf_dir), columns)


@query("SELECT o_custkey AS doc_id, sum(CASE WHEN o_orderkey % 3 > 0 THEN 1 ELSE 0 END)::BIGINT AS nested_tables, max(o_orderkey % 3)::INTEGER AS most_depth FROM orders GROUP BY 1")
def g11_nested_tables(spark, sf_dir):
    """Tables inside others."""
    return grids.depths(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_id"), (F.col("o_orderkey") % 3).cast("int").alias("depth")))


@query(
    """WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus = 'F' END AS mark FROM orders),
s AS (SELECT *, (SELECT min(u.ord) FROM t u WHERE u.doc_id = t.doc_id AND u.ord >= t.ord AND u.mark IS NOT NULL) AS closes FROM t),
wide AS (SELECT l_orderkey AS ord FROM lineitem GROUP BY 1 HAVING max(5 + l_linenumber % 3) > 6)
SELECT s.doc_id, count(CASE WHEN c.mark AND w.ord IS NOT NULL THEN 1 END) AS wide_in_landscape FROM s LEFT JOIN t c ON c.doc_id = s.doc_id AND c.ord = s.closes LEFT JOIN wide w ON w.ord = s.ord GROUP BY 1"""
)
def g14_wide_in_landscape(spark, sf_dir):
    """Wide tables in landscape sections; a section ends with the element that carries its mark."""
    orders = _table(spark, sf_dir, "orders")
    mark = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus") == "F")
    flow = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("table_id"), mark.alias("landscape"))
    wide = grids.widest(_cells(spark, sf_dir)).where("n_columns > 6").select(F.col("doc_id").alias("table_id"))
    wide = wide.join(orders.select(F.col("o_orderkey").alias("table_id"), F.col("o_custkey").alias("doc_id")), "table_id")
    return grids.wide_in_landscape(flow, wide)


@query(
    f"""WITH e AS (SELECT doc_id, table_id, list(DISTINCT key) AS keys FROM (SELECT l_orderkey AS doc_id, l_linenumber AS table_id, l_partkey || 'x' || l_linenumber % 3 AS key FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORD}) <= 3) x GROUP BY 1, 2),
r AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, string_agg('part' || l_partkey || 'x' || l_suppkey % 3 || 'kg', '') AS text FROM lineitem GROUP BY 1, 2)
SELECT e.doc_id, e.table_id, min(r.ord) AS found FROM e LEFT JOIN r ON r.doc_id = e.doc_id AND len(list_filter(e.keys, lambda k: NOT contains(r.text, k))) = 0 GROUP BY 1, 2"""
)
def e03_tables_with_samples(spark, sf_dir):
    """The first rendered table that holds what a table says."""
    t = _table(spark, sf_dir, "lineitem")
    cell = F.concat(F.col("l_partkey").cast("string"), F.lit(" x "), (F.col("l_linenumber") % 3).cast("string"))
    col = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.expr(_ORD))) - 1
    expected = t.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("table_id"), F.lit(0).alias("row"), col.alias("col"), cell.alias("text"))
    text = F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit("x"), (F.col("l_suppkey") % 3).cast("string"), F.lit(" kg"))
    rendered = t.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).agg(F.array_join(F.collect_list(text), "").alias("text"))
    return containment.tables_with_samples(expected, rendered)
