"""Further queries: typesetting instructions, plain-text formulas, matching, spans and table geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formula, latex, structure, style
from ..operators import checks, matching
from ..sources import corpora
from ..sources.corpora import corpus
from .queries import ORACLE_SQL, QUERIES, _table, query


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN 15 WHEN 2 THEN 12 END::DOUBLE AS size, CASE p_partkey % 4 WHEN 0 THEN 'Times New Roman' WHEN 1 THEN '黑体' WHEN 2 THEN '宋体' END AS font,
CASE p_partkey % 4 WHEN 0 THEN 'CENTER' WHEN 1 THEN 'LEFT' WHEN 2 THEN 'JUSTIFY' END AS align, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 1.5 WHEN 2 THEN 1 END::DOUBLE AS line, CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'auto' WHEN 2 THEN 'auto' END AS rule,
CASE p_partkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 28 WHEN 2 THEN 14 END::DOUBLE AS space, CASE p_partkey % 4 WHEN 2 THEN 0.85 END::DOUBLE AS indent, p_partkey % 4 <> 3 AS instruction FROM part"""
)
def c97_c102_style_text(spark, sf_dir):
    """Fonts, sizes, spacing and indents read from instructions."""
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    words = F.when(k == 0, F.concat(F.lit("标题 Times New  Roman "), size, F.lit(".5 pt 居中，固定值 "), size, F.lit(" 磅，段前段后各6磅")))
    words = words.when(k == 1, "黑体小三号，靠左，1.5 倍行距，段前段后1行").when(k == 2, "宋体，小四，两端对齐，单倍行距，段前段后0.5行，缩进2个字符").otherwise("An order of parts")
    t = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), words.alias("x"))
    line = style.line_spacing("x")
    return t.select("id", style.size("x").alias("size"), style.font("x").alias("font"), style.alignment("x").alias("align"), line["value"].alias("line"), line["rule"].alias("rule"), style.spacing("x").alias("space"), style.indent_cm("x").alias("indent"), style.is_instruction("x").alias("instruction"))


@query("""SELECT p_partkey AS id, p_size + 0.5 AS width, 29.7 AS height, 2.5::DOUBLE AS top, (p_size / 10)::DOUBLE AS bottom, 3::DOUBLE AS left_cm, CASE WHEN p_partkey % 2 = 0 THEN 3.2 END::DOUBLE AS right_cm FROM part""")
def c103_page_geometry(spark, sf_dir):
    """Page sizes and margins read from instructions."""
    words = F.concat(F.lit("A4 "), "p_size", F.lit(".5 × 29.7 cm，上2.5cm，下 "), F.format_string("%.1f", F.col("p_size") / 10), F.lit(" cm，左3cm，"), F.when(F.col("p_partkey") % 2 == 0, "右 3.2cm").otherwise("右侧"))
    g = style.page_geometry(words)
    t = _table(spark, sf_dir, "part")
    return t.select(F.col("p_partkey").alias("id"), g["width"].alias("width"), g["height"].alias("height"), g["top"].alias("top"), g["bottom"].alias("bottom"), g["left"].alias("left_cm"), g["right"].alias("right_cm"))


@query(
    """SELECT l_orderkey AS id, l_linenumber AS sub, 'E' || l_suppkey || ' = ' || l_quantity::BIGINT || ' × ' || l_partkey || ' + 3' AS body, l_linenumber || '-' || l_suppkey AS label, '\\mathrm{E}' || l_suppkey || '=' || l_quantity::BIGINT || '\\times' || l_partkey || '+3' AS latex
FROM lineitem WHERE (l_partkey + l_linenumber) % 7 = 0 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity::BIGINT || ' kg', '', l_quantity::BIGINT || '\\mathrm{kg}' FROM lineitem WHERE (l_partkey + l_linenumber) % 7 = 1"""
)
def c55_c59_text_to_latex(spark, sf_dir):
    """Plain formulas with their numbers apart, as LaTeX."""
    t = corpus(spark, sf_dir, "FORMULA_TEXT").where("kind IN ('equation', 'quantity')")
    t = t.select("id", "sub", latex.numbered("text").alias("n"))
    return t.select("id", "sub", "n.body", "n.label", latex.expression("n.body").alias("latex"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 24 = 0 THEN o_custkey % 9 + 1 WHEN o_orderkey % 24 = 15 THEN 2 WHEN o_orderkey % 24 IN (1, 2, 14) THEN o_custkey % 9 + 1 WHEN o_orderkey % 24 = 19 THEN o_custkey % 40 WHEN o_orderkey % 24 = 21 THEN 12 END::INT AS chapter,
CASE WHEN o_orderkey % 24 = 22 THEN 'A. Writer. On orders.' ELSE '' END AS reference FROM orders WHERE o_orderkey % 24 IN (0, 1, 2, 14, 15, 19, 21, 22, 23)"""
)
def c54_c60_chapters_and_references(spark, sf_dir):
    """Numbers of chapters, references without theirs."""
    t = corpus(spark, sf_dir, "OUTLINE").where("kind IN (0, 1, 2, 14, 15, 19, 21, 22, 23)")
    return t.select("id", latex.chapter("text").alias("chapter"), F.when(F.col("kind") == 22, latex.reference("text")).otherwise("").alias("reference"))


@query(
    """SELECT l_orderkey AS id, l_linenumber AS sub, l_partkey AS part, 4 AS n_runs, 2 AS n_citations, '图' || l_partkey || ' see |[' || l_suppkey || ']| and |[1, 2-' || l_linenumber || ']' AS pieces, 2 AS n_scripts FROM lineitem"""
)
def f32_f39_runs(spark, sf_dir):
    """Citation marks and scripts as runs."""
    x = F.concat(F.lit("图"), "l_partkey", F.lit(" see ["), "l_suppkey", F.lit("] and [1, 2-"), "l_linenumber", F.lit("]"))
    c = latex.citation_runs(x)
    t = _table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("sub"), F.col("l_partkey").alias("part"), F.size(c).alias("n_runs"), F.size(F.filter(c, lambda p: p["citation"])).alias("n_citations"), F.array_join(F.transform(c, lambda p: p["text"]), "|").alias("pieces"), F.size(latex.runs(x)).alias("n_scripts"))


@query(
    """SELECT l_orderkey AS id, l_linenumber AS sub, l_partkey AS part, 'x_' || l_linenumber AS span, 'dollar' AS kind FROM lineitem WHERE l_partkey % 3 = 0
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'f(n) = ' || l_suppkey || ' + n', 'equation' FROM lineitem WHERE l_partkey % 3 <> 2"""
)
def f01_math_spans(spark, sf_dir):
    """Inline math found in prose."""
    k = F.col("l_partkey") % 3
    prose = F.when(k == 0, F.concat(F.lit("Let $x_"), "l_linenumber", F.lit("$ be given; f(n) = "), "l_suppkey", F.lit(" + n, as said")))
    prose = prose.when(k == 1, F.concat(F.lit("then, f(n) = "), "l_suppkey", F.lit(" + n; costs $5"))).otherwise(F.lit("no math here, only $ and text"))
    t = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("sub"), F.col("l_partkey").alias("part"), prose.alias("text"))
    return matching.explode_spans(t).select("id", "sub", "part", "span", "kind")


_PLACED = "CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey * 1000 + l_suppkey % 1000"


@query(
    f"""SELECT DISTINCT l_orderkey AS doc_id, {_PLACED} AS ord, CASE WHEN l_partkey % 2 = 0 THEN {_PLACED} END AS match FROM lineitem"""
)
def e01_match_in_order(spark, sf_dir):
    """Expected texts matched one to one with rendered ones; of equal texts the first takes the first."""
    plain = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr(_PLACED).alias("ord"), "l_partkey").distinct()
    expected = plain.select("doc_id", "ord", F.concat(F.lit("Part No. <"), "l_partkey", F.lit(">")).alias("text"))
    rendered = plain.where("l_partkey % 2 = 0").select("doc_id", "ord", F.concat(F.when(F.col("l_partkey") % 4 == 0, "see ").otherwise(""), F.lit("part no.<"), "l_partkey", F.lit("> ")).alias("text"))
    return matching.match_in_order(expected, rendered)


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey AS doc_id, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS page, l_returnflag AS f FROM lineitem), a AS (SELECT doc_id, min(page) FILTER (f = 'A') AS a FROM p GROUP BY 1),
n AS (SELECT a.doc_id, a, (SELECT min(page) FROM p WHERE p.doc_id = a.doc_id AND f = 'N' AND page >= a) AS n FROM a), r AS (SELECT n.*, (SELECT min(page) FROM p WHERE p.doc_id = n.doc_id AND f = 'R' AND page >= coalesce(n, a)) AS r FROM n)
SELECT doc_id, 1 AS ord, a - a + 1 AS page FROM r UNION ALL SELECT doc_id, 2, n - a + 1 FROM r UNION ALL SELECT doc_id, 3, r - a + 1 FROM r"""
)
def e21_forward_pages(spark, sf_dir):
    """Contents entries on pages behind the contents, each not before the one ahead of it; the last by its letters only."""
    t = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page"), F.concat(F.lit("flag "), "l_returnflag", F.lit("; ")).alias("text"))
    pages = t.groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_set("text")), "").alias("text"))
    contents = t.select("doc_id").distinct().select("doc_id", F.lit(-1).cast("long").alias("page"), F.lit("目 录 Flag A; Flag N; Flag R").alias("text"))
    entries = t.select("doc_id").distinct().select("doc_id", F.inline(F.expr("array(struct(1 AS ord, 'Flag A' AS text), struct(2 AS ord, 'FLAG N' AS text), struct(3 AS ord, 'Flag: R!' AS text))")))
    return matching.forward_pages(entries, pages.unionByName(contents))


_CELLS = """SELECT l_orderkey AS doc_id, l_suppkey % 3 AS table_id, l_linenumber AS row, l_partkey * 1000 + l_suppkey % 1000 AS cell, CASE WHEN l_partkey % 4 = 0 THEN 3 ELSE 1 END AS span, CASE l_partkey % 3 WHEN 0 THEN 'restart' WHEN 1 THEN 'continue' ELSE '' END AS merge FROM lineitem"""


@query(
    f"""WITH c AS ({_CELLS}), r AS (SELECT doc_id, table_id, row, sum(span) AS w, sum((span > 1)::INT) AS s FROM c GROUP BY ALL) SELECT doc_id, table_id, count(*) AS n_rows, max(w)::BIGINT AS n_columns, sum(s)::BIGINT AS n_spans, max(w) <> min(w) AS ragged, max(w) > 8 AS wide FROM r GROUP BY ALL"""
)
def g09_g14_table_shapes(spark, sf_dir):
    """Rows, columns and spans of tables."""
    return matching.table_shapes(spark.sql(_CELLS.replace("FROM lineitem", "FROM {t}"), t=_table(spark, sf_dir, "lineitem")))


@query(
    f"""WITH c AS ({_CELLS.replace("l_linenumber AS row", "0 AS row")}), i AS (SELECT *, sum((merge <> 'continue')::INT) OVER (PARTITION BY doc_id, table_id, row ORDER BY cell) AS g FROM c)
SELECT doc_id, table_id, row, min(cell) AS cell, count(*) AS width FROM i GROUP BY doc_id, table_id, row, g HAVING count(*) > 1 AND bool_or(merge = 'restart')"""
)
def f22_horizontal_merges(spark, sf_dir):
    """Runs of merged cells."""
    cells = spark.sql(_CELLS.replace("l_linenumber AS row", "0 AS row").replace("FROM lineitem", "FROM {t}"), t=_table(spark, sf_dir, "lineitem"))
    return matching.horizontal_merges(cells)


@query("""SELECT conv_id AS doc_id, min(turn) AS page FROM conversations WHERE regexp_matches(text, '(?i)th') OR regexp_matches(regexp_replace(text, '\\s+', '', 'g'), '(?i)th') GROUP BY 1""")
def e11_first_pages(spark, sf_dir):
    """The first page that matches."""
    return matching.first_pages(_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"), "(?i)th")


@query(
    """WITH r AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderstatus AS status, o_totalprice AS price FROM orders), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE status WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, ord) AS n FROM r)
SELECT doc_id, n AS step, ord FROM s WHERE n <= 5"""
)
def i10_repair_actions(spark, sf_dir):
    """The first five of each group, errors first, then warnings, then the rest."""
    t = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return t.withColumn("step", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "ord"))).where("step <= 5").select("doc_id", "step", "ord")


@query(
    """SELECT s_suppkey AS doc_id, s_suppkey * 3 % 80 + 1 AS n_pages, array_to_string(list_sort(list_distinct(list_filter([1, 2, 4, 3, (s_suppkey * 3 % 80 + 2) // 2, s_suppkey * 3 % 80 + 1], lambda p: p >= 1 AND p <= s_suppkey * 3 % 80 + 1))), ',') AS pages FROM supplier"""
)
def i09_sample_pages(spark, sf_dir):
    """A sample of pages by priority: the first, contents, body, third, middle and last, ascending, eight at most."""
    n = F.col("s_suppkey") * 3 % 80 + 1
    wanted = F.array(F.lit(1), F.lit(2), F.lit(4), F.lit(3), F.floor((n + 1) / 2), n)
    pages = F.slice(F.array_distinct(F.filter(wanted, lambda p: (p >= 1) & (p <= n))), 1, 8)
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), n.alias("n_pages"), F.array_join(F.array_sort(pages).cast("array<string>"), ",").alias("pages"))


@query(
    """SELECT l_orderkey AS doc_id, l_linenumber AS word, l_partkey AS part, greatest(0.5, least(6, round_even(l_quantity / 10, 2))) AS margin, abs(l_quantity - l_linenumber * 7) > 4 AS off, l_quantity > l_linenumber AND l_linenumber > 0 AS landscape FROM lineitem"""
)
def g32_k15_page_checks(spark, sf_dir):
    """Margins held within bounds, sizes off by more than the tolerance, landscape pages."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    margin = F.greatest(F.lit(0.5), F.least(F.lit(6.0), F.bround(q / 10, 2)))
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("word"), F.col("l_partkey").alias("part"), margin.alias("margin"), (F.abs(q - n * 7) > 4).alias("off"), ((q > n) & (n > 0)).alias("landscape"))


@query(
    """WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS run, floor(o_totalprice / 1000)::BIGINT AS chars, o_orderkey % 5 AS images FROM orders) SELECT doc_id, arg_max(run, chars * 1000000000000 + images * 100000000000 - run) AS run, max(chars) AS chars FROM s GROUP BY 1"""
)
def g36_best_result(spark, sf_dir):
    """The best of several extractions by a lexicographic score, the first of equals."""
    t = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("run"), F.floor(F.col("o_totalprice") / 1000).alias("chars"), (F.col("o_orderkey") % 5).alias("images"))
    return t.groupBy("doc_id").agg(F.max_by("run", F.struct("chars", "images", -F.col("run"))).alias("run"), F.max("chars").alias("chars"))


@query(
    """WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN 'Abstract' WHEN o_orderkey % 4 = 1 THEN 'Keywords' ELSE 'x' END AS label FROM orders), w AS (SELECT doc_id, ord, string_agg(label, ' ') OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM t)
SELECT doc_id, min(ord) AS split_at FROM w WHERE contains(s, 'Abstract') AND contains(s, 'Keywords') GROUP BY 1"""
)
def h29_late_front_matter(spark, sf_dir):
    """Where front matter begins among references: the first row whose four rows hold both labels."""
    k = F.col("o_orderkey") % 4
    t = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.when(k == 0, "Abstract").when(k == 1, "Keywords").otherwise("x").alias("label"))
    ahead = F.array_join(F.collect_list("label").over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(0, 3)), " ")
    return t.withColumn("s", ahead).where(F.col("s").contains("Abstract") & F.col("s").contains("Keywords")).groupBy("doc_id").agg(F.min("ord").alias("split_at"))


@query(
    """WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 9 + 1 END AS chapter, o_orderkey % 6 <> 0 AS formula, o_orderkey % 5 = 0 AS own FROM orders), c AS (SELECT *, coalesce(last_value(chapter IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord), 0) AS ch FROM t)
SELECT doc_id, ord, CASE WHEN own THEN 'own' ELSE CASE WHEN ch = 0 THEN '' ELSE ch || '-' END || sum((NOT own)::INT) OVER (PARTITION BY doc_id, ch ORDER BY ord) END AS label FROM c WHERE formula"""
)
def h28_h33_formula_labels(spark, sf_dir):
    """Formula numbers by chapter; formulas with a number of their own don't count, chapter 0 has no prefix."""
    o = F.col("o_orderkey")
    t = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), o.alias("ord"), F.when(o % 6 == 0, o % 9 + 1).alias("chapter"), (o % 5 == 0).alias("own"))
    order = Window.partitionBy("doc_id").orderBy("ord")
    t = t.withColumn("ch", F.coalesce(F.last("chapter", ignorenulls=True).over(order), F.lit(0))).where("ord % 6 <> 0")
    number = F.sum((~F.col("own")).cast("int")).over(Window.partitionBy("doc_id", "ch").orderBy("ord"))
    prefix = F.when(F.col("ch") == 0, "").otherwise(F.concat(F.col("ch").cast("string"), F.lit("-")))
    return t.select("doc_id", "ord", F.when(F.col("own"), "own").otherwise(F.concat(prefix, number.cast("string"))).alias("label"))


@query("""SELECT p_partkey AS id, p_size > 0 AND (p_size * 4 > 160) AS wide, (p_size * 4 < 160 AND p_size < 45 AND 4.0 >= 2.4) OR (p_size < 80) AS fragment FROM part WHERE p_size > 0""")
def d46_d67_image_fragments(spark, sf_dir):
    """Pictures as small and flat as scraps of text."""
    from ..functions import structure

    t = _table(spark, sf_dir, "part").where("p_size > 0")
    return t.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 4 > 160).alias("wide"), structure.is_image_fragment(F.col("p_size") * 4, F.col("p_size"), F.lit("")).alias("fragment"))


@query(
    """WITH f AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderstatus AS role FROM orders), g AS (SELECT doc_id, role, list(ord ORDER BY ord)[1:6] AS l, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1) SELECT doc_id, role, n, array_to_string(l, ',') AS places FROM g"""
)
def h04_duplicate_roles(spark, sf_dir):
    """Roles that occur more than once, with their first six places."""
    t = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("role"))
    nth = t.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "role").orderBy("ord")))
    g = nth.groupBy("doc_id", "role").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("nth") <= 6, F.col("ord")))).alias("l")).where("n > 1")
    return g.select("doc_id", "role", "n", F.array_join(F.col("l").cast("array<string>"), ",").alias("places"))


@query(
    """SELECT o_orderkey AS doc_id, code, severity, detail FROM (SELECT o_orderkey, 'TEXT_LOSS' AS code, 'error' AS severity, floor(o_totalprice)::BIGINT::VARCHAR AS detail FROM orders WHERE o_totalprice > 200 AND o_custkey * 1000 < 0.6 * o_totalprice
UNION ALL SELECT o_orderkey, 'PLACEHOLDER_REMAINS', 'error', o_orderpriority FROM orders WHERE contains(o_orderpriority, 'NOT') UNION ALL SELECT o_orderkey, 'NO_STATUS', 'warning', o_orderstatus FROM orders WHERE o_orderstatus = 'P')"""
)
def k11_content_rules(spark, sf_dir):
    """Rules held against rows in one pass."""
    rules = [
        ("TEXT_LOSS", "error", (F.col("o_totalprice") > 200) & (F.col("o_custkey") * 1000 < 0.6 * F.col("o_totalprice")), F.floor("o_totalprice")),
        ("PLACEHOLDER_REMAINS", "error", F.col("o_orderpriority").contains("NOT"), F.col("o_orderpriority")),
        ("NO_STATUS", "warning", F.col("o_orderstatus") == "P", F.col("o_orderstatus")),
    ]
    return checks.apply_rules(_table(spark, sf_dir, "orders").withColumn("doc_id", F.col("o_orderkey")), ["doc_id"], rules)


@query(
    """SELECT c_custkey AS id, 'nation' AS field, c_nationkey::VARCHAR AS expected, CASE WHEN c_custkey % 7 <> 0 THEN (c_nationkey + 1)::VARCHAR END AS actual FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 'segment', c_mktsegment, NULL FROM customer WHERE c_custkey % 7 = 0"""
)
def e10_golden_compare(spark, sf_dir):
    """Differences from a baseline."""
    t = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    now = t.where("id % 7 <> 0").withColumn("nation", F.when(F.col("id") % 5 == 0, F.col("nation") + 1).otherwise(F.col("nation")))
    return checks.compare(t, now, "id", ["nation", "segment"])


@query(
    """WITH s AS (SELECT o_custkey AS doc_id, o_orderkey % 3 AS chapter, o_orderkey AS ord, CASE WHEN o_custkey % 4 > 0 OR o_orderkey % 5 > 0 THEN o_orderkey % 7 END AS number FROM orders), l AS (SELECT *, lag(number) OVER (PARTITION BY doc_id, chapter ORDER BY ord) AS p FROM s),
g AS (SELECT *, min((number IS NOT NULL)::INT) OVER w AS a, max((coalesce(number < p, false))::INT) OVER w AS b FROM l WINDOW w AS (PARTITION BY doc_id, chapter)) SELECT doc_id, chapter, ord, row_number() OVER (PARTITION BY doc_id, chapter ORDER BY CASE WHEN a * b = 1 THEN number ELSE 0 END, ord) AS place FROM g"""
)
def i02_section_order(spark, sf_dir):
    """Sections put in the order of their numbers where that is safe."""
    o = F.col("o_orderkey")
    number = F.when((F.col("o_custkey") % 4 > 0) | (o % 5 > 0), o % 7)
    return checks.sorted_where_numbered(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (o % 3).alias("chapter"), o.alias("ord"), number.alias("number")))


@query(
    r"""WITH w AS (SELECT conv_id AS doc_id, turn, turn // 8 + 1 AS page, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM conversations),
x AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY turn) - 1 AS line, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS n, trim(regexp_replace(array_to_string(l, ' '), '\s+', ' ', 'g')) AS t, len(l) AS k FROM w WHERE len(l) > 0)
SELECT doc_id, page, line, regexp_replace(regexp_replace(t, '\s+([,.;:!?，。；：！？）\]\}])', '\1', 'g'), '([（\[\{])\s+', '\1', 'g') AS text, 10.0 AS x_min, (k - 1) * 40.0 + 45 AS x_max, 10.0 AS size FROM x WHERE n <= 320 AND t <> ''"""
)
def f26_word_lines(spark, sf_dir):
    """All word boxes of the turns put together as lines, eight turns a page; the words of a turn stand a little apart in height."""
    t = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("i", "text"))
    y, x = F.col("turn") * 30.0 + F.col("i") % 2, F.col("i") * 40.0
    page = (F.floor(F.col("turn") / 8) + 1).cast("long")
    out = checks.word_lines(t.select("doc_id", page.alias("page"), (x + 10).alias("x_min"), (x + 45).alias("x_max"), y.alias("y_min"), (y + 10).alias("y_max"), "text"))
    return out.select("doc_id", "page", "line", "text", "x_min", "x_max", "size")


@query(
    """WITH f AS (SELECT l_orderkey AS doc_id, min(l_linenumber) AS ord, l_suppkey AS s FROM lineitem GROUP BY l_orderkey, l_suppkey) SELECT doc_id, ord, 'Box of supplier number ' || s AS text FROM f
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = doc_id AND contains('see the boxofsuppliernumber' || l_suppkey || '!', 'boxofsuppliernumber' || s) AND l_suppkey % 2 = 0)"""
)
def e04_recovered_texts(spark, sf_dir):
    """Texts of boxes that the body doesn't have."""
    t = _table(spark, sf_dir, "lineitem")
    found = t.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("Box of supplier number "), "l_suppkey").alias("text"))
    known = t.where("l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("see the box  of supplier number "), "l_suppkey", F.lit("!")).alias("text"))
    out = checks.recovered(found, known)
    return out.select("doc_id", "ord", "text")


@query(
    """SELECT a.s_suppkey AS id, list_filter([CASE WHEN a.s_nationkey <> b.s_nationkey THEN 'nation' END, CASE WHEN floor(a.s_acctbal / 5000) <> floor(b.s_acctbal / 5000) THEN 'balance' END], lambda x: x IS NOT NULL)[1] AS first_difference FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1"""
)
def j05_signature_diff(spark, sf_dir):
    """In what two signatures differ first."""
    t = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_nationkey").cast("long"), F.floor(F.col("s_acctbal") / 5000)).alias("signature"))
    after = t.select((F.col("id") - 1).alias("id"), F.col("signature").alias("other"))
    names = F.array(F.lit("nation"), F.lit("balance"))
    labels = F.filter(F.zip_with(names, F.arrays_zip("signature", "other"), lambda n, z: F.when(z["signature"] != z["other"], n)), lambda x: x.isNotNull())
    return t.join(after, "id").select("id", F.get(labels, 0).alias("first_difference"))


def _for_all_kinds(name: str, columns: str, kinds: str) -> str:
    """The SQL of a query over some kinds of lines, and these columns for the lines of all others."""
    source = f"({corpora.FORMULA_TEXT}) t" if name in ("c42_c44_formula_labels", "c55_c59_text_to_latex") else f"({corpora.OUTLINE}) t JOIN orders ON o_orderkey = id"
    return f"SELECT * FROM ({ORACLE_SQL[name]}) UNION ALL SELECT {columns} FROM {source} WHERE kind NOT IN ({kinds})"


@query(_for_all_kinds("c42_c44_formula_labels", "id, sub, text, '', text", "'equation', 'label'"))
def c42_c44_formula_labels_all(spark, sf_dir):
    """Equation numbers parted from their equations, and nothing from other lines."""
    t = formula.trailing_labels("text")
    return corpus(spark, sf_dir, "FORMULA_TEXT").select("id", "sub", t["body"].alias("body"), F.array_join(t["labels"], "|").alias("labels"), formula.without_labels("text").alias("stripped"))


@query(_for_all_kinds("c32_c33_heading_numbers", "id, CASE kind WHEN 19 THEN (o_custkey % 40)::VARCHAR WHEN 21 THEN '12.5' ELSE '' END, CASE kind WHEN 19 THEN '种方案' WHEN 21 THEN 'MWh per day' ELSE trim(text) END", "0, 1, 2, 14, 15"))
def c32_c33_heading_numbers_all(spark, sf_dir):
    """Numbers parted from the rest of all lines, where they begin with one."""
    p = structure.heading_parts("text")
    return corpus(spark, sf_dir, "OUTLINE").select("id", p["number"].alias("number"), p["title"].alias("title"))


@query(_for_all_kinds("d22_c34_captions", "id, 'none', trim(text)", "3, 4, 5, 6, 7"))
def d22_c34_captions_all(spark, sf_dir):
    """Captions told from all other lines, and their usual spacing."""
    return corpus(spark, sf_dir, "OUTLINE").select("id", F.coalesce(structure.caption_kind("text"), F.lit("none")).alias("caption"), structure.spaced_caption("text").alias("spaced"))


@query(
    _for_all_kinds(
        "c36_c38_contents_keys",
        "id, CASE kind WHEN 17 THEN 'TODO:ORDER' ELSE upper(regexp_replace(text, '\\s+', '', 'g')) END, CASE kind WHEN 2 THEN o_custkey % 9 + 1 WHEN 19 THEN o_custkey % 40 WHEN 21 THEN 12 END::INT",
        "0, 1, 14, 15, 20",
    )
)
def c36_c38_contents_keys_all(spark, sf_dir):
    """Keys and ordinals of all lines as contents lines."""
    return corpus(spark, sf_dir, "OUTLINE").select("id", structure.toc_key("text").alias("key"), structure.toc_order("text")["ordinal"].alias("ordinal"))


_LATEX = """CASE kind WHEN 'citation' THEN text WHEN 'label' THEN text WHEN 'dollar' THEN replace(replace(replace(text, ' ', ''), 'x', '\\mathrm{x}'), 'y', '\\mathrm{y}')
WHEN 'prose' THEN '\\mathrm{Item}' || split_part(text, ' ', 2) || '\\mathrm{was}\\mathrm{sent}\\mathrm{by}\\mathrm{rail}'
ELSE '\\text{分析结果表明},\\text{当}\\mathrm{f}(\\mathrm{x})=' || split_part(text, ' ', 4) || '\\text{时系统的收入明显高于成本};\\text{因此选择该模式进行约束优化}.' END"""


@query(_for_all_kinds("c55_c59_text_to_latex", f"id, sub, text, '', {_LATEX}", "'equation', 'quantity'"))
def c55_c59_text_to_latex_all(spark, sf_dir):
    """All lines with the numbers of formulas apart, as LaTeX."""
    t = corpus(spark, sf_dir, "FORMULA_TEXT").select("id", "sub", latex.numbered("text").alias("n"))
    return t.select("id", "sub", "n.body", "n.label", latex.expression("n.body").alias("latex"))


@query(
    f"""SELECT id, CASE WHEN kind = 15 THEN 2 WHEN kind IN (0, 1, 2, 14) THEN o_custkey % 9 + 1 WHEN kind = 19 THEN o_custkey % 40 WHEN kind = 21 THEN 12 END::INT AS chapter,
CASE kind WHEN 22 THEN 'A. Writer. On orders.' WHEN 19 THEN '种方案' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS reference FROM ({corpora.OUTLINE}) t JOIN orders ON o_orderkey = id"""
)
def c54_c60_chapters_and_references_all(spark, sf_dir):
    """Numbers of chapters, and all lines as references without theirs."""
    return corpus(spark, sf_dir, "OUTLINE").select("id", latex.chapter("text").alias("chapter"), latex.reference("text").alias("reference"))


# The queries over all kinds of lines take the places of those over some.
for _name in [n for n in QUERIES if n.endswith("_all")]:
    QUERIES[_name.removesuffix("_all")], ORACLE_SQL[_name.removesuffix("_all")] = QUERIES.pop(_name), ORACLE_SQL.pop(_name)
