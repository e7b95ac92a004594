"""Queries over elements in order: contents blocks, body dispatch. A customer's orders are the lines of a document."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import structure
from ..operators import body, splits
from ..sources import corpora
from ..sources.corpora import corpus
from .queries import _ORD, _table, query


def _lines(spark, sf_dir):
    """doc_id, n (from 0), kind and text of the outline's lines by customer; every ninth order ends a page."""
    t = corpus(spark, sf_dir, "OUTLINE").withColumnRenamed("id", "order_id").join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("doc_id")), "order_id")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("order_id")) - 1
    return t.select("doc_id", n.cast("long").alias("n"), "text", F.lit(False).alias("heading_style"), (F.col("order_id") % 9 == 0).alias("boundary"))


#: The lines and what they are, by their sort.
_KNOWN = f"""WITH RECURSIVE line AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY id) - 1 AS n, kind, id % 9 = 0 AS edge, text, o_custkey AS c, id AS o FROM ({corpora.OUTLINE}) t JOIN orders ON o_orderkey = id),
known AS (SELECT *, kind IN (1, 14, 15) AS paged, kind IN (0, 1, 2, 8, 10, 11, 13, 14, 15, 19, 20) AS entry,
  CASE kind WHEN 14 THEN (c % 9 + 1) || '.1SCOPE' WHEN 1 THEN (c % 9 + 1) || '.' || (o % 7) || 'METHOD' WHEN 15 THEN '第二章方法' ELSE upper(regexp_replace(text, '\\s+', '', 'g')) END AS key,
  CASE WHEN kind IN (0, 15) THEN 'chapter' WHEN kind = 20 THEN 'cn' WHEN kind IN (1, 2, 14, 19, 21) THEN 'num' END AS scheme,
  CASE WHEN kind IN (0, 1, 2, 14) THEN c % 9 + 1 WHEN kind = 15 THEN 2 WHEN kind = 20 THEN 3 WHEN kind = 19 THEN c % 40 WHEN kind = 21 THEN 12 END AS ordinal FROM line),
title AS (SELECT t.doc_id, t.n AS head, min(CASE WHEN l.edge THEN l.n END) AS edge, min(l.n) AS opener FROM known t LEFT JOIN known l ON l.doc_id = t.doc_id AND l.n > t.n AND l.n <= t.n + 160 WHERE t.kind = 13 GROUP BY t.doc_id, t.n),
-- Line by line behind a title without a break: keys, whether a page was seen, the last number.
walk AS (SELECT doc_id, head, head AS n, ['']::VARCHAR[] AS keys, false AS had, ''::VARCHAR AS s, 0::BIGINT AS k, 0 AS lines FROM title WHERE edge IS NULL
  UNION ALL SELECT w.doc_id, w.head, l.n, list_append(w.keys, l.key), w.had OR l.paged, coalesce(l.scheme, w.s), CASE WHEN l.scheme IS NULL THEN w.k ELSE l.ordinal END, w.lines + 1 FROM walk w JOIN known l ON l.doc_id = w.doc_id AND l.n = w.n + 1
  WHERE l.entry AND l.n <= w.head + 160 AND (w.lines = 0 OR NOT (list_contains(w.keys, l.key) OR (w.had AND NOT l.paged) OR (coalesce(l.scheme, '') = w.s AND w.s <> '' AND l.ordinal <= w.k)))),
closed AS (SELECT doc_id, head, max(n) - head AS skip FROM walk GROUP BY doc_id, head HAVING max(lines) >= 2 OR bool_or(had)),
block AS (SELECT t.doc_id, t.head AS n, CASE WHEN t.edge IS NULL THEN coalesce(c.skip, 0) WHEN f.entry AND (f.paged OR t.edge - t.head >= 2) THEN t.edge - t.head ELSE 0 END AS skip
  FROM title t LEFT JOIN closed c USING (doc_id, head) LEFT JOIN known f ON f.doc_id = t.doc_id AND f.n = t.opener)"""


@query(_KNOWN + " SELECT doc_id, n, skip::BIGINT AS skip FROM block")
def h05_contents_blocks(spark, sf_dir):
    """How many lines behind each contents title are part of a list."""
    return body.contents_blocks(_lines(spark, sf_dir))


_FATES = (
    _KNOWN.replace("WITH RECURSIVE", "WITH RECURSIVE")
    + """,
numbered AS (SELECT *, count(CASE WHEN kind NOT IN (16, 17, 18) THEN 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS q FROM known),
asked AS (SELECT d.doc_id, d.q AS s, d.q + b.skip AS e FROM block b JOIN numbered d USING (doc_id, n) WHERE b.skip > 0),
took AS (SELECT doc_id, min(s) AS s FROM asked GROUP BY doc_id UNION ALL SELECT t.doc_id, (SELECT min(x.s) FROM asked x WHERE x.doc_id = t.doc_id AND x.s > a.e) FROM took t JOIN asked a ON a.doc_id = t.doc_id AND a.s = t.s WHERE t.s IS NOT NULL),
kept AS (SELECT a.* FROM asked a JOIN took t ON t.doc_id = a.doc_id AND t.s = a.s),
f AS (SELECT d.*, kind IN (16, 17, 18) AS gone, EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = d.doc_id AND d.q BETWEEN k.s AND k.e) AND kind NOT IN (16, 17, 18) AS skipped FROM numbered d),
ev AS (SELECT *, CASE WHEN NOT gone AND NOT skipped AND kind = 10 THEN 'opens' WHEN NOT gone AND NOT skipped AND kind IN (11, 12) THEN 'closes' END AS event FROM f),
st AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'opens' AS listing FROM ev),
fa AS (SELECT *, CASE WHEN gone THEN 'placeholder' WHEN skipped THEN 'contents' WHEN event = 'opens' THEN 'references' WHEN listing AND event = 'closes' THEN 'section' WHEN listing THEN 'entry' WHEN kind IN (0, 1, 2, 8, 9, 14, 15, 20) THEN 'section' ELSE 'item' END AS fate FROM st),
counted AS (SELECT *, count(CASE WHEN fate = 'section' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS num,
  last_value(CASE WHEN event = 'opens' THEN 'opens' WHEN event = 'closes' AND listing THEN 'closes' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS behind FROM fa)"""
)


@query(
    _FATES
    + """ SELECT doc_id, n AS ord, CASE WHEN fate = 'entry' AND behind = 'opens' THEN 'lost' ELSE fate END AS fate, CASE WHEN fate IN ('section', 'item') THEN num END::BIGINT AS section,
CASE WHEN fate = 'section' THEN CASE kind WHEN 8 THEN 'en_abstract' WHEN 9 THEN 'en_keywords' WHEN 11 THEN 'acknowledgement' WHEN 12 THEN 'appendix' ELSE 'heading' END END AS role,
CASE WHEN fate = 'section' THEN CASE kind WHEN 9 THEN 'order, part' ELSE '' END END AS rest FROM counted"""
)
def h06_body_dispatch(spark, sf_dir):
    """Lines of documents as sections, items, references, contents lists and placeholders."""
    t = _lines(spark, sf_dir).withColumn("level", structure.heading_level("text")).withColumn("kind", F.lit("paragraph")).withColumn("wrapped", F.lit(False)).withColumnRenamed("n", "ord")
    return body.dispatch(t).select("doc_id", "ord", "fate", "section", "role", "rest")


#: Formulas as a layout splits them, by sort: the items, then what they are together. Q: terms, S: a start.
_SPLIT = (
    (("max", "x", "Q", "R(t)·3", "t=1"), (("formula", "max x ∑_{t=1}^{Q} R(t)·3", r"\max_{x} \sum_{t=1}^{Q}R(t)\cdot 3", False),)),
    (("E =", "a1", "b2", "Q", "t=1", "P(t)-Q0]", "(3-S)"), (("formula", "E=a1/b2 ∑_{t=1}^{Q} [P(t)-Q0]", r"E=\frac{a_{\mathrm{1}}}{b_{\mathrm{2}}}\sum_{t=1}^{Q}[P(t)-Q_{\mathrm{0}}]", True),)),
    (("Q", "A = ∑ P(t) (2-S)", "t = S"), (("formula", "A = ∑ P(t)", r"A = \sum_{t=S}^{Q} P(t)", True),)),
    (("Q", "E(t)+2P", "i = S"), (("formula", "∑_{i=S}^{Q} E(t)+2P", r"\sum_{i=S}^{Q}E(t)+2P", False),)),
    (("∑Q", "P(t)+λab 其中"), (("formula", "∑_{t=1}^{Q} P(t)+λab", r"\sum_{t=1}^{Q}P(t)+\lambda_{\mathrm{ab}}", False), ("text", "其中", None, False))),
    (("i = S", "rself", "=m/n×100%", "Etotal", "rgreen", "=kS×100%", "Ebuy"), (("formula", "rself=(m/n)/(Etotal)×100%", r"r_{\mathrm{self}}=\frac{m/n}{E_{\mathrm{total}}}\times100\%", False), ("formula", "rgreen=(kS)/(Ebuy)×100%", r"r_{\mathrm{green}}=\frac{k_{\mathrm{S}}}{E_{\mathrm{buy}}}\times100\%", False))),
    (("成本 C = ∑ Q", "P(t)+Q0"), (("text", "成本", None, False), ("formula", "C=∑_{t=1}^{Q} P(t)+Q0", r"C=\sum_{t=1}^{Q}P(t)+Q_{\mathrm{0}}", False))),
    (("D=∑S", "P+Q0"), (("formula_problem", "D=∑S P+Q0", None, False),)),
    (("H=∑Q P(t) 其中",), (("formula", "H=∑_{t=1}^{Q} P(t)", r"H=\sum_{t=1}^{Q}P(t)", False), ("text", "其中", None, False))),
)
_TERM, _START = "(40 + l_partkey % 50)", "(2 + l_suppkey % 7)"


def _worded(text: str | None) -> str:
    """SQL of a text with its terms and starts."""
    if text is None:
        return "NULL"
    own = {"Q": _TERM, "S": _START}
    parts = re.split("(Q(?![0_])|S)", text.replace("'", "''"))
    return " || ".join(f"CAST({own[x]} AS STRING)" if x in own else f"'{x}'" for x in parts if x)


def _split_sql() -> str:
    parts = ["SELECT l_orderkey AS doc_id, line, 0 AS place, 'item' AS role, 'Part ' || l_partkey || ' was sent by rail' AS text, NULL AS latex, false AS numbered FROM placed"]
    for k, (_, made) in enumerate(_SPLIT):
        for place, (role, text, latex, numbered) in enumerate(made):
            parts.append(f"SELECT l_orderkey, line, {place + 1}, '{role}', {_worded(text)}, {_worded(latex)}, {str(numbered).lower()} FROM placed WHERE l_partkey % {len(_SPLIT)} = {k}")
    placed = f"WITH placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORD}) AS line FROM lineitem)"
    return f"{placed} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line, place))::BIGINT AS n, role, text, latex, numbered FROM ({' UNION ALL '.join(parts)}) x"


@query(_split_sql())
def h09_h18_split_formulas(spark, sf_dir):
    """Formulas split over items, put together."""
    t = _table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")  # renamed first: what is dealt by it stays so
    items = F.array(F.concat(F.lit("Part "), F.col("l_partkey"), F.lit(" was sent by rail")))
    for k, (own, _) in enumerate(_SPLIT):
        items = F.when(F.col("l_partkey") % len(_SPLIT) == k, F.concat(F.array(F.concat(F.lit("Part "), F.col("l_partkey"), F.lit(" was sent by rail"))), F.array(*[F.expr(_worded(x)) for x in own]))).otherwise(items)
    t = t.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.expr(_ORD))).alias("line"), F.posexplode(items).alias("k", "text"))
    t = t.select("doc_id", (F.col("line") * 16 + F.col("k")).alias("ord"), "text", (F.col("text").startswith("=")).alias("formula"), F.lit(False).alias("numbered"))
    out = splits.repaired(t)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "place")).cast("long")
    return out.select("doc_id", n.alias("n"), "role", "text", "latex", "numbered")
