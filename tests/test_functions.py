"""Column functions against cases with known answers, and their treatment of nulls."""

import pytest
from pyspark.sql import functions as F

from quire.functions import formula, markdown, structure, text


def evaluate(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f("x").alias("y")).orderBy("i").collect()]


CASES = [
    (text.strip, [("\u3000 a b\u00a0\n", "a b"), (None, "")]),
    (text.squeeze, [(" a \t\n b ", "a b"), ("", "")]),
    (text.unlink, [("see [x](y) and [ ](z)", "see x and z")]),
    (text.clean, [(" Copy ", ""), ("[a](b)  c", "a c"), (None, "")]),
    (text.clean_lines, [("a  b\r\nCopy\r c ", "a b\nc")]),
    (text.word_count, [("两个 words it's", 4), ("", 0)]),
    (text.half_point, []),
    (formula.is_citation, [("[1]", True), ("[1-3]", True), ("(2020a)", True), ("[a]", False), (None, False)]),
    (formula.is_label, [("(1)", True), ("（2 - 3）", True), ("(a)", False)]),
    (formula.is_quantity, [("12 kW", True), ("50%", False), ("10-20%", True), ("x = 3 m", False), ("12", False)]),
    (lambda x: formula.classify(x)["category"], [("", "TEXT"), ("(2020)", "CITATION"), ("(3-1)", "FORMULA_LABEL"), ("$$a$$", "DISPLAY_MATH"), ("E=mc^2+1", "DISPLAY_MATH"), ("= 3", "DISPLAY_MATH"), ("hello", "TEXT")]),
    (formula.without_labels, [("f(1)", "f(1)"), ("a = b + 2 (3)", "a = b + 2"), ("x (1) (2)", "x"), ("plain", "plain")]),
    (structure.heading_level, [("第一章 绪论", 1), ("1.2.3 X", 3), ("1.2 X", 2), ("2.5 MW of power", 0), ("3 个方案", 0), ("Chapter 3 Results", 1), ("图 1 结构", 0), ("", 0), (None, 0)]),
    (structure.is_figure_caption, [("Figure 1. Load", True), ("图 2 结构", True), ("图2展示了", False), ("Fig. 3 4", False)]),
    (structure.is_table_caption, [("Table 1-2 Costs", True), ("表3给出了", False)]),
    (structure.cn_number, [("十", 10), ("二十三", 23), ("十五", 15), ("九", 9), ("12", 12), ("一百", None), ("", None)]),
    (structure.is_placeholder, [("{{x}}", True), ("[请输入姓名]", True), ("todo", True), ("[1]", False)]),
    (structure.is_toc_entry, [("1.2 Scope .... 7", True), ("第二章 方法 12", True), ("", True), ("A sentence.", False)]),
    (structure.spaced_caption, [("fig.3Load", "Fig. 3 Load"), ("表2成本", "表 2 成本")]),
    (structure.is_reference_entry, [("[12] A. B.", True), ("3. C.", True), ("3.4 Method", False)]),
    (markdown.plain, [("> - **a** `b` [c](d) ![e](f)", "a b c"), ("1. _x_", "x"), (None, "")]),
    (markdown.heading_text, [("## A ##", "A"), ("#### B", ""), ("text", "")]),
    (markdown.is_separator, [("|---|:---:|", True), ("|--|", False), ("---", False), (None, False)]),
    (markdown.cells, [("| a | b |", ["a", "b"]), ("a|", ["a"]), ("no", [])]),
    (markdown.file_source, [("a%20b+c.png?x#y", "a b+c.png"), ("a\\b", "a/b"), ("50%", "50%")]),
    (markdown.image_destination, [('<a b.png> "t"', "a b.png"), ('a.png "t"', "a.png"), ("a b", "a b")]),
    (markdown.image_source, [('<img src="data:image/png;base64,x" data-src="b.png">', "b.png"), ("<img srcset='a.png 1x, b.png 2x'>", "a.png"), ("<img alt=x>", "")]),
    (markdown.is_format_rule, [("正文字体：宋体", True), ("Font: Arial 12pt", True), ("Hello world", False), ("---", False)]),
]


@pytest.mark.parametrize("f,cases", [c for c in CASES if c[1]])
def test_function(spark, f, cases):
    assert evaluate(spark, f, [x for x, _ in cases]) == [y for _, y in cases]


def test_definition(spark):
    got = evaluate(spark, markdown.reference_definition, ["[ A  b ]: <x y> 'T'", "[a]: b \"t\"", "    [a]: b", "x"])
    assert [tuple(g) if g else None for g in got] == [("a b", "x y"), ("a", "b"), None, None]


def test_fitted(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b", "c", "d"],), (["a", "b", "c"],)], "r array<string>")
    assert [r[0] for r in df.select(markdown.fitted(F.col("r"), F.lit(3))).collect()] == [["a", "", ""], ["a", "b", "c | d"], ["a", "b", "c"]]


def test_hamming(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0000000000000000"), ("f0", "0f"), ("8000000000000001", "0000000000000001"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(text.hamming_hex("a", "b")).collect()] == [64, 999, 1, 999]


def test_rounding_half_even(spark):
    df = spark.createDataFrame([(10.25,), (10.75,), (10.24,)], "x double")
    assert [r[0] for r in df.select(text.half_point("x")).collect()] == [10.0, 11.0, 10.0]


def test_path_label(spark):
    got = evaluate(spark, lambda x: text.path_label(x, {"C:/me/proj": "PROJECT"}), ["C:\\me\\proj\\a.docx", "D:\\x\\y\\z\\b.docx", "rel/c"])
    assert got == ["<PROJECT>/a.docx", "<ABS_PATH>/z/b.docx", "rel/c"]
