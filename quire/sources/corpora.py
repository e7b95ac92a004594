"""Documents derived from the base tables, one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_INT = "CAST({} AS BIGINT)"
_TEXT = "CAST(CAST({} AS BIGINT) AS STRING)"


def _s(x: str) -> str:
    return _TEXT.format(x)


#: id, sub, kind (the answer) and text: one of seven sorts of text for each line item.
FORMULA_TEXT = f"""
SELECT l_orderkey AS id, l_linenumber AS sub,
 CASE (l_partkey + l_linenumber) % 7 WHEN 0 THEN 'equation' WHEN 1 THEN 'quantity' WHEN 2 THEN 'citation' WHEN 3 THEN 'label' WHEN 4 THEN 'dollar' WHEN 5 THEN 'contaminated' ELSE 'prose' END AS kind,
 CASE (l_partkey + l_linenumber) % 7
  WHEN 0 THEN 'E' || {_s('l_suppkey')} || ' = ' || {_s('l_quantity')} || ' × ' || {_s('l_partkey')} || ' + 3 (' || {_s('l_linenumber')} || '-' || {_s('l_suppkey')} || ')'
  WHEN 1 THEN {_s('l_quantity')} || ' kg'
  WHEN 2 THEN '[' || {_s('l_suppkey')} || ',' || {_s('l_linenumber')} || ']'
  WHEN 3 THEN '(' || {_s('l_linenumber')} || '-' || {_s('l_suppkey')} || ')'
  WHEN 4 THEN '$x_' || {_s('l_linenumber')} || ' + y = ' || {_s('l_quantity')} || '$'
  WHEN 5 THEN '分析结果表明，当 f(x) = ' || {_s('l_quantity')} || ' 时系统的收入明显高于成本; 因此选择该模式进行约束优化。'
  ELSE 'Item ' || {_s('l_partkey')} || ' was sent by rail' END AS text
FROM lineitem
"""

#: Lines of a thesis: headings of all sorts, captions, sentences about them, contents lines, placeholders.
OUTLINE = f"""
SELECT o_orderkey AS id, o_orderkey % 24 AS kind,
 CASE o_orderkey % 24
  WHEN 0 THEN '第' || {_s('o_custkey % 9 + 1')} || '章 绪论' WHEN 1 THEN {_s('o_custkey % 9 + 1')} || '.' || {_s('o_orderkey % 7')} || ' Method ' || {_s('o_custkey')}
  WHEN 2 THEN {_s('o_custkey % 9 + 1')} || '.2.' || {_s('o_orderkey % 5')} || '  数据来源' WHEN 3 THEN 'Figure ' || {_s('o_custkey')} || '. Load curve'
  WHEN 4 THEN '图 ' || {_s('o_custkey % 90')} || ' 系统结构' WHEN 5 THEN '图' || {_s('o_custkey % 90')} || '展示了系统结构' WHEN 6 THEN 'Table' || {_s('o_custkey')} || '-2  Cost of parts'
  WHEN 7 THEN '表 ' || {_s('o_custkey % 50')} || ' 成本汇总' WHEN 8 THEN '  Abstract  ' WHEN 9 THEN 'Key words: order, part' WHEN 10 THEN '参考文献' WHEN 11 THEN 'Acknowledgements'
  WHEN 12 THEN '附 录 A' WHEN 13 THEN 'Table of Contents' WHEN 14 THEN {_s('o_custkey % 9 + 1')} || '.1 Scope ........ ' || {_s('o_orderkey % 80')}
  WHEN 15 THEN '第二章 方法 ' || {_s('o_orderkey % 80')} WHEN 16 THEN '题目：{{{{title}}}}' WHEN 17 THEN 'TODO: order ' || {_s('o_orderkey')} WHEN 18 THEN '（一级标题，黑体三号，居中）'
  WHEN 19 THEN {_s('o_custkey % 40')} || ' 种方案' WHEN 20 THEN '三、研究方法' WHEN 21 THEN '12.5 MWh per day' WHEN 22 THEN '[' || {_s('o_orderkey % 30')} || '] A. Writer. On orders.'
  ELSE 'Order ' || {_s('o_orderkey')} || ' was shipped late because of rain; the customer ' || {_s('o_custkey')} || ' complained about it twice.' END AS text
FROM orders
"""

#: One Markdown document for each order as lines: heading, table of its items, code, references.
MD_LINES = f"""
SELECT o_orderkey AS doc_id, CAST(0 AS BIGINT) AS line_no, '# Order ' || {_s('o_orderkey')} || ' #' AS line FROM orders
UNION ALL SELECT o_orderkey, 1, '' FROM orders
UNION ALL SELECT o_orderkey, 2, '## Summary of **customer** ' || {_s('o_custkey')} FROM orders
UNION ALL SELECT o_orderkey, 3, '| part | `quantity` | note |' FROM orders
UNION ALL SELECT o_orderkey, 4, '|---|:---:|---|' FROM orders
UNION ALL SELECT l_orderkey, 4 + l_linenumber, '| ' || {_s('l_partkey')} || ' | **' || {_s('l_quantity')} || '** |' || CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN ' a | b |' ELSE ' _' || l_returnflag || '_ |' END FROM lineitem
UNION ALL SELECT o_orderkey, 100, '' FROM orders
UNION ALL SELECT o_orderkey, 101, '```text' FROM orders
UNION ALL SELECT o_orderkey, 102, '# not a heading ' || o_orderstatus FROM orders
UNION ALL SELECT o_orderkey, 103, '[code]: not/a/definition' FROM orders
UNION ALL SELECT o_orderkey, 104, '```' FROM orders
UNION ALL SELECT o_orderkey, 105, '![chart][fig' || {_s('o_custkey % 3')} || '] and ![remote](https://a.example/x.png "t")' FROM orders
UNION ALL SELECT o_orderkey, 106, '[Fig0]: <img/a' || {_s('o_custkey')} || '.png>' FROM orders
UNION ALL SELECT o_orderkey, 107, '[fig1]: img/b.png?v=' || {_s('o_custkey')} || ' "Title"' FROM orders
UNION ALL SELECT o_orderkey, 108, '[fig0]: img/last' || {_s('o_custkey')} || '.png' FROM orders
UNION ALL SELECT o_orderkey, 109, '## References' FROM orders
UNION ALL SELECT o_orderkey, 110, '[1] ' || o_orderpriority FROM orders
UNION ALL SELECT o_orderkey, 111, '## Appendix' FROM orders
UNION ALL SELECT o_orderkey, 112, 'tables' FROM orders
"""

#: Items of a document in order: pictures, captions and text.
ITEM_STREAM = f"""
SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord,
 CASE l_partkey % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'figure_caption' WHEN 2 THEN 'table_caption' WHEN 3 THEN 'table' ELSE 'text' END AS role,
 CASE l_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'Figure ' || {_s('l_linenumber')} || ' Part ' || {_s('l_partkey')} WHEN 2 THEN 'Table ' || {_s('l_linenumber')} || ' Part ' || {_s('l_partkey')}
  WHEN 3 THEN 'cells of ' || {_s('l_partkey')} ELSE CASE WHEN l_suppkey % 4 < 3 THEN '  E' ELSE 'sentence ' || {_s('l_suppkey')} || ' . ' END END AS text,
 CASE WHEN l_partkey % 8 = 0 THEN 'img' || {_s('l_partkey % 40')} || '.png' ELSE '' END AS image
FROM lineitem
"""

#: Findings of checks: a run has phases, a phase has findings in order.
ISSUES = """
SELECT user_id AS run_id, CASE event_id % 3 WHEN 0 THEN 'structural' WHEN 1 THEN 'strict' ELSE 'visual' END AS phase, event_id AS ord,
 CASE event_id % 11 WHEN 0 THEN 'TOC_POLLUTION' WHEN 1 THEN 'TEXT_LOSS' WHEN 2 THEN 'TABLE_COUNT_MISMATCH' WHEN 3 THEN 'PLACEHOLDER_REMAINS' WHEN 4 THEN 'FORMULA_COUNT_MISMATCH' WHEN 5 THEN 'IMAGE_COUNT_MISMATCH' ELSE 'BLANK_PAGE' END AS code,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity, CAST(event_id % 13 AS BIGINT) - 2 AS page
FROM events
"""

#: Files of a directory tree with their digests: one for each document, in scan order.
FILES = """
SELECT doc_id AS scan_ord, source || '/' || lang || '/' || CAST(doc_id AS STRING) || ext AS path, ext, text,
 n_chars AS text_chars, doc_id % 150 AS paragraphs, doc_id % 4 AS tables, doc_id % 3 AS headers, doc_id % 2 AS fields, CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS toc_fields, doc_id % 12 AS pages,
 CASE WHEN doc_id % 13 = 0 THEN 'COMPLEX_TABLE_UNSUPPORTED' WHEN doc_id % 19 = 0 THEN 'SOURCE_TEXTBOX_UNSUPPORTED' ELSE '' END AS risk
FROM (SELECT *, CASE doc_id % 8 WHEN 0 THEN '.docx' WHEN 1 THEN '.pdf' WHEN 2 THEN '.doc' WHEN 3 THEN '.png' WHEN 4 THEN '.docx' WHEN 5 THEN '.md' WHEN 6 THEN '.xlsx' ELSE '' END AS ext FROM documents) d
"""

_TABLES = {"FORMULA_TEXT": ["lineitem"], "OUTLINE": ["orders"], "MD_LINES": ["orders", "lineitem"], "ITEM_STREAM": ["lineitem"], "ISSUES": ["events"], "FILES": ["documents"]}


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpora above over the tables in sf_dir."""
    sql = globals()[name]
    for table in _TABLES[name]:
        sql = sql.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"FROM {{{table}}})", f"FROM {{{table}}})")
    sql = sql.replace("{{title}}", "{{{{title}}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]})
