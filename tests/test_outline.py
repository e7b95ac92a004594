"""Outline operators, page choice and title rules on small documents."""

import random

from pyspark.sql import functions as F

from quire.functions import front, style
from quire.operators import matching, outline


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_sections_and_breaks(spark):
    t = spark.createDataFrame([(1, 1, "正文", 3, 0), (1, 2, "1 Scope", 0, 0), (1, 3, "", 0, 0), (1, 4, None, 0, 2), (2, 1, "正文", 2, 0), (3, 1, "正文", 0, 0)], "doc_id int, ord int, heading string, n_items int, n_images int")
    assert [(r[0], r[1]) for r in rows(outline.content_sections(t), "doc_id", "ord")] == [(1, 2), (1, 4), (2, 1)]
    t = spark.createDataFrame([(1, 1, "cn_abstract", None), (1, 2, "heading", True), (1, 3, "heading", None), (1, 4, "body", None), (2, 1, None, False)], "doc_id int, ord int, role string, page_break boolean")
    assert [r[3] for r in rows(outline.body_breaks(t), "doc_id", "ord")] == [False, True, True, False, True]


def test_titles_and_leading_blocks(spark):
    docs = {1: ["---", "a: b", "---", "", "# Title #", "text"], 2: ["Lined", "===", "# Other"], 3: ["no title"], 4: ["## 格式要求", "宋体 12 pt：正文", "# Body", "x"], 5: ["## Intro", "宋体 12 pt：正文", "---", "rest"], 6: ["## Intro", "prose", "---", "rest"]}
    t = spark.createDataFrame([(d, i, x) for d, lines in docs.items() for i, x in enumerate(lines)], "doc_id int, line_no int, line string")
    assert [r[:2] for r in rows(outline.titles(t), "doc_id")] == [(1, "Title"), (2, "Lined"), (4, "Body")]
    left = {}
    for r in rows(outline.without_leading_block(t), "doc_id", "line_no"):
        left.setdefault(r[0], []).append(r[2])
    assert left == {1: ["# Title #", "text"], 2: docs[2], 3: docs[3], 4: ["# Body", "x"], 5: ["rest"], 6: docs[6]}


def test_contents_and_captions(spark):
    t = spark.createDataFrame([(1, 1, "摘要", 1, "cn_abstract"), (1, 2, "1Scope", 1, "heading"), (1, 3, "1.1 Aims", 5, "heading"), (1, 4, "图 1 系统", 2, "heading"), (1, 5, "正文", 1, "body"), (1, 6, "致谢", 1, "acknowledgement")], "doc_id int, ord int, heading string, level int, role string")
    assert [r[1:] for r in rows(outline.contents_entries(t, F.lit(True)), "ord")] == [(2, 1, "1 Scope"), (3, 3, "1.1 Aims"), (7, 1, "参考文献"), (8, 1, "致  谢")]
    items = [(1, 1, 1, "figure_caption", "图1 系统", "H", False), (1, 1, 2, "text", "t", "H", True), (1, 2, 3, "text", "t", "图2 结构", True), (1, 3, 4, "table_caption", "表1 成本", "H", False)]
    items = spark.createDataFrame(items, "doc_id int, section int, ord int, role string, text string, heading string, has_media boolean")
    assert [r[1:] for r in rows(outline.caption_entries(items, "figure"), "ord")] == [(1, "图 1 系统"), (3, "图 2 结构")]
    assert [r[1:] for r in rows(outline.caption_entries(items, "table"), "ord")] == [(4, "表 1 成本")]


def test_blocks_sorted_by_chunks(spark):
    rng = random.Random(8)
    blocks = {b: [None if i and rng.random() < 0.3 else rng.randint(1, 6) for i in range(rng.randint(1, 8))] for b in range(200)}
    t = spark.createDataFrame([(1, b, i, n) for b, ns in blocks.items() for i, n in enumerate(ns)], "doc_id int, block int, ord int, number int")
    got = {}
    for _, b, o, _ in rows(outline.sorted_blocks(t), "block", "place"):
        got.setdefault(b, []).append(o)

    def walked(ns):
        chunks = []
        for i, n in list(enumerate(ns))[1:]:
            if n is not None or not chunks:
                chunks.append([])
            chunks[-1].append(i)
        heads = [ns[c[0]] for c in chunks]
        if len(chunks) > 1 and None not in heads and heads != sorted(heads):
            chunks.sort(key=lambda c: ns[c[0]])
        return [0] + [i for c in chunks for i in c]

    assert got == {b: walked(ns) for b, ns in blocks.items()}


def test_pages(spark):
    texts = ["Cover", "Contents\nChapter 1 ..... 3", "Chapter 1 Scope", "Figure 2 shows", "Table 1 Costs", "prose", "the equation", "prose", "end"]
    t = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(texts)] + [(2, 1, "one page")], "doc_id int, page long, text string")
    assert rows(matching.matching_pages(t, r"Table\s*\d"), "page") == [(1, 5)] and rows(matching.first_pages(t, "prose"), "doc_id") == [(1, 6)]
    assert rows(matching.sample_pages(t), "doc_id") == [(1, "1,2,3,4,5,6,7,9"), (2, "1")]


def test_titles_by_type_and_caption_spacing(spark):
    t = spark.createDataFrame([("面向订单数据的分析方法研究", 16.0, False), ("面向订单数据的分析方法研究", 12.0, False), ("面向订单数据的分析方法研究", None, True), ("1 面向订单数据的分析方法研究", 16.0, True), ("短", 16.0, True)], "x string, size double, heading boolean")
    assert [r[0] for r in t.select(front.is_title("x", F.col("size"), F.col("heading"))).collect()] == [True, False, True, False, False]
    spaced = lambda *texts: spark.range(1).select(style.caption_number_space(F.array(*map(F.lit, texts)))).first()[0]
    assert (spaced("prose", "图 1 系统", "表2 成本"), spaced("图1 系统"), spaced("prose")) == (True, False, None)
