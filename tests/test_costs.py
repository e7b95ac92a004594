"""What steps that large tables run through must not do again: read off plans, with the results beside."""

import re
import unicodedata

from pyspark.sql import functions as F

from quire.functions import formula, latex, repair, text
from quire.operators import grids, matching, splits
from quire.plans import more_queries  # noqa: F401  (it registers its queries)
from quire.plans.queries import QUERIES

PLAN = lambda df: df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_without_patterns(spark):
    space = {*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    signs = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    t = spark.createDataFrame([(i, c + "a" + c + c, c + "\n" + c + "b") for i, c in enumerate(signs)], "i int, x string, y string")
    got = t.select("i", text.strip("x").alias("x"), text.squeeze("y").alias("y")).orderBy("i").collect()
    assert [r.x for r in got] == ["a" if ord(c) in space else c + "a" + c + c for c in signs]
    assert [r.y for r in got] == ["b" if ord(c) in space else f"{c} {c}b" for c in signs]
    assert "regexp" not in PLAN(t.select(text.strip("x")))
    assert len(re.findall(r"\\u|-", text.SPACE)) < 12


def _cells(spark, n=3):
    rows = [(d, 0, r, c, 1, "", "restart" if r == 0 else "continue", False, 0, 0, "") for d in range(n) for r in range(4) for c in range(2)]
    return spark.createDataFrame(rows, "doc_id long, table_id int, row int, cell int, span int, across string, down string, filled boolean, before int, after int, text string")


def _written(*_):
    raise AssertionError("a table was written")


def test_irregular_merges_shuffle_cells_once(spark, monkeypatch):
    monkeypatch.setattr(grids, "settled", _written)
    columns = spark.createDataFrame([(d, 0, 1) for d in range(3)], "doc_id long, table_id int, grid_columns int")
    out = grids.irregularities(_cells(spark), columns)
    assert sorted((r.doc_id, r.irregular_tables, r.irregular_spans, r.irregular_down) for r in out.collect()) == [(d, 1, 4, 0) for d in range(3)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Join" not in below


def test_texts_are_made_plain_once(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("d01_formula_class", "d02_d11_formula_predicates"):
        assert PLAN(QUERIES[name](spark, folder)).count("translate(") == 1
    t = spark.createDataFrame([("E1 = 2 × 3 (1-2)",), ("[3]",), ("(2020)",), ("12 kW",), ("$x_1 + y$",), ("f(x)",), ("x = 3，y",), ("分析结果表明，当 f(x) = 7 时系统的收入明显高于成本; 因此选择该模式进行约束优化。",), ("",), (None,)], "x string")
    one = t.select(formula.is_quantity("x"), formula.is_contaminated("x"), formula.looks_like_formula("x"), formula.valid_equation_span("x"), formula.valid_dollar_span("x")).collect()
    assert [tuple(r) for r in t.select(formula.tests("x").alias("t")).select("t.*").collect()] == [tuple(r) for r in one]
    apart = PLAN(t.select(latex.numbered("x").alias("n"))).count("regexp_extract(")
    assert PLAN(QUERIES["c55_c59_text_to_latex"](spark, folder)).count("regexp_extract(") == apart


def test_merges_without_groups(spark):
    marks = ["continue", "restart", "continue", "continue", "", "continue", "restart", None, "restart", "continue"]
    rows = [(1, 0, 0, i, m) for i, m in enumerate(marks)] + [(1, 0, 1, 5, "restart"), (1, 0, 1, 5, "continue"), (1, 0, 1, 7, "continue"), (2, 0, 0, 0, "continue")]
    t = spark.createDataFrame(rows, "doc_id int, table_id int, row int, cell int, merge string")
    out = matching.horizontal_merges(t)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 0, 1, 3), (1, 0, 0, 8, 2), (1, 0, 1, 5, 3)]
    assert "Aggregate" not in PLAN(out)


def test_spans_of_math_are_sought_where_signs_stand(spark):
    texts = ["a $x$ and f(n) = 3", None, "", "no math, only $ and words", "a ≠ b1", "a $x$ and f(n) = 3", "E（2） ≥ 4)", "$$a = b$$", "words " * 300 + "$x$", "cost\n$y_1$", "[1] ＝ 2"]
    t = spark.createDataFrame([(i, [x or "", "k"], x) for i, x in enumerate(texts)], "id long, own array<string>, text string").coalesce(1)
    out = matching.explode_spans(t)
    expected = [(i, [x or "", "k"], x, *s) for i, x in enumerate(texts) for s in matching.math_spans(unicodedata.normalize("NFC", x or ""))]
    assert sorted(tuple(r) for r in out.collect()) == sorted(expected) and {i for i, *_ in expected} == {0, 4, 5, 9}
    assert out.schema.simpleString() == "struct<id:bigint,own:array<string>,text:string,start:int,end:int,span:string,kind:string>"
    assert "RLIKE" in PLAN(out) and "EvalPython" not in PLAN(out)
    left = t.where(t.text.rlike("|".join(matching.NEEDED.values())))
    assert sorted(r.id for r in left.collect()) == [0, 4, 5, 6, 7, 8, 9]


def test_forward_pages_pass_in_order(spark):
    pages = [(1, None, "Gamma"), (1, 3, "beta\n and ALPHA"), (1, 1, "目 录 alpha"), (1, 2, None), (1, 4, "g a m m a"), (2, 1, "x"), (2, 2, "y"), (3, 1, "目录"), (5, 1, "b"), (5, 2, "a b\nc"), (5, 3, "c d"), (None, 1, "z"), (None, 2, "p"), (None, 3, "q")]
    entries = [(1, 2, "Beta"), (1, 1, "al pha"), (1, 3, None), (1, 4, "(gamma)!"), (1, 5, "alpha"), (2, 1, "z"), (2, 2, "y"), (3, 1, "y"), (4, 1, "a"), (5, 1, "a"), (5, 2, "bcc"), (5, 3, "cd"), (5, None, "ab"), (None, 1, "p"), (None, 2, "q")]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "2")
    try:
        out = matching.forward_pages(spark.createDataFrame(entries, "doc_id long, ord int, text string"), spark.createDataFrame(pages, "doc_id long, page long, text string"))
        got = {(r.doc_id, r.ord): r.page for r in out.collect()}
    finally:
        spark.conf.set(batch, before)
    assert out.schema.simpleString() == "struct<doc_id:bigint,ord:bigint,page:bigint>"
    want = {(1, 1): 1, (1, 2): 1, (1, 3): None, (1, 4): 2, (1, 5): None, (2, 1): None, (2, 2): None, (3, 1): None, (4, 1): None, (5, 1): 1, (5, 2): None, (5, 3): 2, (5, None): None, (None, 1): 1, (None, 2): 2}
    assert got == want
    # A document isn't a group of its own in Python.
    for df in (out, QUERIES["e21_forward_pages"](spark, "/root/testdata/sf0.001")):
        assert "CoGroup" not in df._jdf.queryExecution().sparkPlan().toString()


def test_sums_are_sought_in_texts_with_a_sum_only(spark, monkeypatch):
    texts = ["Part 1 was sent by rail", "24", "E(t)+2P", "t=1", "x", "= m / n × 100%", "P", "q", "(3-1)", None, "E =", "成本 C="]
    items = spark.createDataFrame([(1, i, t, False, False) for i, t in enumerate(texts)], "doc_id long, ord int, text string, formula boolean, numbered boolean")
    own = [("item", t) for t in texts]
    assert [(r.role, r.text) for r in splits.repaired(items).orderBy("ord", "place").collect()] == [*own[:1], ("formula", "∑_{t=1}^{24} E(t)+2P"), *own[4:]]
    # Past this, asking for a sum's index or summand fails.
    asked = lambda *_: F.raise_error(F.concat(F.lit("asked"), F.col("t"))).cast("string")
    monkeypatch.setattr(repair, "sum_start", asked)
    monkeypatch.setattr(repair, "prose_tail", lambda x: F.struct(asked().alias("formula"), asked().alias("tail")))
    assert len(splits._matches(splits._facts(items)).select("m.kind").collect()) == len(texts)


def test_rectangles_pass_in_order(spark, monkeypatch):
    monkeypatch.setattr(grids, "settled", _written)
    wide = [(9, 1, 0, 0, 2, "restart", "restart", True, 0, 0, "w"), (9, 1, 0, 1, 1, "continue", "", False, 0, 0, ""), (9, 1, 0, 2, 1, "", "", True, 1, 0, "x"), (9, 1, 1, 0, 2, "restart", "continue", False, 0, 0, ""), (9, 1, 1, 1, 1, "continue", "", False, 0, 0, ""), (9, 1, 3, 0, 2, "restart", "continue", False, 0, 0, "")]
    cells = _cells(spark).unionByName(spark.createDataFrame(wide, _cells(spark).schema))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    got = []
    try:
        for size in ("3", "10000"):  # tables that go over batches, and many tables in one
            spark.conf.set(batch, size)
            out = grids.rectangles(cells)
            got.append(sorted((r.doc_id, r.table_id, r.row, r.col, r.rowspan, r.colspan, *r.ord) for r in out.collect()))
    finally:
        spark.conf.set(batch, before)
    want = [(d, 0, 0, c, 4, 1, 0, c, 0) for d in range(3) for c in range(2)] + [(9, 1, 0, 0, 2, 2, 0, 0, 0), (9, 1, 3, 0, 1, 2, 3, 0, 1)]
    assert got == [want, want]
    assert grids.rectangles(cells.where("false")).collect() == []
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()
