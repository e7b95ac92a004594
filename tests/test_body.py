"""Contents blocks, body dispatch and scans against a walk through the elements."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import front, structure, text
from quire.operators import body, scans

LINES = [
    "目录", "CONTENTS", "1 Scope ...... 3", "1.1 Aims 4", "2 Method 7", "第一章 绪论 2", "第二章 方法", "第一章 绪论", "摘要", "ABSTRACT", "参考文献", "References", "Acknowledgements", "附录 A：tables", "TODO: fill in", "（一级标题，黑体三号，居中）", "",
    "An ordinary sentence about orders.", "A sentence with an end。", "[1] A. Writer. On orders.", "1 Introduction", "2.1 Data", "Abstract: we show it", "Key words (in English) order; part", "三、研究方法", "[题目]（说明）", "（说明）", "3 Results 9",
]


@pytest.fixture(scope="module")
def stream(spark):
    """Elements with what the functions say of each line, so that the walk only has to follow the order."""
    rng, rows = random.Random(7), []
    for d in range(160):
        lines = rng.sample(LINES, 14) + ["目录", "1 Scope ...... 3", "References"] * 2
        for i in range(rng.randint(1, 45)):
            kind = "table" if rng.random() < 0.08 else "paragraph"
            rows.append((d, i, kind, "" if kind == "table" else " " * rng.randint(0, 1) + rng.choice(lines), rng.random() < 0.12, rng.random() < 0.07 and kind == "paragraph", rng.random() < 0.1))
    t = spark.createDataFrame(rows, "doc_id long, ord long, kind string, text string, heading_style boolean, boundary boolean, wrapped boolean").repartition(5)
    return t.withColumn("level", structure.heading_level("text", F.when(F.col("heading_style"), 2)))


@pytest.fixture(scope="module")
def known(stream):
    s = structure
    t = stream.select(
        "*", s.is_toc_title("text").alias("title"), s.is_toc_entry("text").alias("paged"), s.is_bare_toc_entry("text").alias("bare"), s.toc_key("text").alias("key"), s.toc_order("text").alias("order"), front.is_reference_heading("text").alias("refs"),
        s.is_backmatter("text").alias("back"), (s.is_placeholder(text.strip("text")) | s.is_instruction("text")).alias("gone"), body.section_heading("text", F.col("level")).alias("named"), s.is_placeholder("text").alias("blank"), text.clean("text").alias("clean"),
    )
    docs = {}
    for r in t.orderBy("doc_id", "ord").collect():
        docs.setdefault(r.doc_id, []).append(r)
    return docs


def skip(lines, at, most):
    """Paragraphs behind the title at `at`, line by line."""
    ahead = lines[at + 1 : at + 1 + most]
    shown = [r for r in ahead if r.text.strip()]
    entry = lambda r: (r.paged and not r.title) or r.bare or (r.heading_style and len(r.text.strip()) <= 80 and not r.blank and not r.text.rstrip().endswith("。"))
    if not shown or not entry(shown[0]):
        return 0
    lenient = any(r.boundary for r in ahead) and not lines[at].heading_style
    taken, paged, keys, last, odd, end = 0, False, set(), None, False, 0
    for i, r in enumerate(ahead, 1):
        if r.text.strip():
            own = r.paged and not r.title
            bad = not entry(r) or (taken and (r.key in keys or (paged and not own) or (r.order and last and r.order[0] == last[0] and r.order[1] <= last[1])))
            if bad and not lenient:
                break
            if bad:
                odd = True
            else:
                taken, paged, last = taken + 1, paged or own, r.order or last
                keys |= {r.key} - {""}
        end = i
        if r.boundary:
            break
    return end if paged or taken >= 2 or (taken and odd) else 0


def plain(lines):
    return [r for r in lines if r.kind == "paragraph" and not r.wrapped]


@pytest.mark.parametrize("most", [160, 5, None])
def test_contents_blocks(spark, known, most):
    rows = [(d, i, r.text, r.heading_style, r.boundary) for d, lines in known.items() for i, r in enumerate(plain(lines))]
    t = spark.createDataFrame(rows, "doc_id long, n long, text string, heading_style boolean, boundary boolean").repartition(3)
    got = {(r.doc_id, r.n): r.skip for r in body.contents_blocks(t, most).collect()}
    expected = {(d, i): skip(plain(lines), i, most or 1000) for d, lines in known.items() for i, r in enumerate(plain(lines)) if r.title}
    assert got == expected and sum(v > 2 for v in got.values()) > 20


def walked(lines):
    own, left, listing, section, fates, entries = plain(lines), 0, None, 0, {}, []
    for r in lines:
        if r.kind == "table":
            fates[r.ord] = ("entry", None) if listing is not None else ("item", section)
            if listing is not None:
                listing.append(r.ord)
            continue
        if r.gone:
            fates[r.ord] = ("placeholder", None)
            continue
        if left:
            left -= 1
            fates[r.ord] = ("contents", None)
            continue
        if r.title and not r.wrapped and (left := skip(own, own.index(r), 160)):
            fates[r.ord] = ("contents", None)
        elif r.refs:
            for lost in listing or []:
                fates[lost] = ("lost", None)
            listing, fates[r.ord] = [], ("references", None)
        elif listing is not None and r.back:
            listing, section = None, section + 1
            fates[r.ord] = ("section", section)
        elif listing is not None:
            fates[r.ord] = ("entry", None) if r.clean else ("dropped", section)
            if r.clean:
                listing.append(r.ord)
        elif r.level and r.named:
            section += 1
            fates[r.ord] = ("section", section)
        else:
            fates[r.ord] = ("dropped" if r.level else "item", section)
    return fates


@pytest.mark.parametrize("size", [3, 10_000])
def test_dispatch(stream, known, monkeypatch, size):
    for f in (scans.last_before, scans.sum_upto):
        monkeypatch.setattr(f, "__defaults__", (size,))
    got = {}
    for r in body.dispatch(stream).collect():
        got.setdefault(r.doc_id, {})[r.ord] = (r.fate, r.section)
    expected = {d: walked(lines) for d, lines in known.items()}
    bad = [(d, o, got[d][o], e, [(r.ord, r.text, r.boundary) for r in known[d]]) for d, x in expected.items() for o, e in x.items() if got[d][o] != e]
    assert not bad, (len(bad), bad[0])
    fates = [f for x in expected.values() for f, _ in x.values()]
    assert all(fates.count(f) > 20 for f in ("placeholder", "contents", "references", "section", "entry", "lost", "item"))


def test_headings_and_rest(spark):
    t = spark.createDataFrame([("Abstract: we show it", 2), ("附录A（续）", 1), ("关键词：（三个）订单", 2), ("（说明）", 1), ("1 Scope", 1)], "text string, level int")
    got = [r.n and tuple(r.n) for r in t.select(body.section_heading("text", F.col("level")).alias("n")).collect()]
    assert got == [("Abstract:", "we show it", "en_abstract"), ("附录A", "", "appendix"), ("关键词：", "订单", "cn_keywords"), None, ("1 Scope", "", "heading")]


def test_taken_in_order(spark):
    rng = random.Random(3)
    rows = [(d, s, s + rng.randint(0, 6)) for d in range(30) for s in rng.sample(range(400), rng.randint(1, 150))]
    got = sorted(map(tuple, scans.taken_in_order(spark.createDataFrame(rows, "doc_id int, start int, end int").repartition(4), ["doc_id"]).collect()))
    expected, reach = [], {}
    for d, s, e in sorted(rows):
        if s > reach.get(d, -1):
            expected.append((d, s, e))
            reach[d] = e
    assert got == expected
