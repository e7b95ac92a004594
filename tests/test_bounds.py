"""Bounds that can be turned off, and guidance in brackets of any depth."""

import json
import random
import re

from pyspark.sql import functions as F

from quire.functions import front, rows, structure
from quire.operators import checks, contracts, documents, matching


def test_bounds_can_be_turned_off(spark):
    assert matching.math_spans("x " * 700 + "$a$") == [] and matching.math_spans("x " * 700 + "$a$", None) == [(1400, 1403, "a", "dollar")]
    text = json.dumps({"sections": [{"paragraphs": []}] * 55 + [1]})
    t = spark.createDataFrame([(1, text)], "id int, j string")
    of = lambda **more: [r.path for r in contracts.validate(t, ["id"], "j", contracts.CONTENT, **more).collect()]
    assert of() == [] and of(whole=True) == ["$.sections[55]"]
    report = spark.createDataFrame([(1, json.dumps({"passed": False, "issues": [{"code": "a", "severity": "error", "message": "m"}] * 105 + [1]}))], "id int, j string")
    found = lambda **more: {r.path for r in contracts.validate_report(report, ["id"], "j", **more).collect()}
    assert found(most=None) - found() == {"$.issues[105]"}
    words = spark.createDataFrame([(1, 1, float(0), float(20 * i), 5.0, float(20 * i + 9), f"w{i}") for i in range(330)], "doc_id int, page long, x_min double, y_min double, x_max double, y_max double, text string")
    assert checks.word_lines(words).count() == 320 and checks.word_lines(words, None).count() == 330


def test_guidance_in_brackets_of_any_depth(spark):
    rng = random.Random(9)
    notes, other = ["宋体小四居中", "黑体三号，加粗", "一级标题，黑体"], ["text", "见图 1", "a", "宋体", "x" * 130]

    def text(depth):
        parts = []
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.5 and depth:
                parts.append(rng.choice("(（") + text(depth - 1) + rng.choice([")", "）", ")", ""]))
            else:
                parts.append(rng.choice(notes if kind > 0.7 else other))
        return "".join(parts) + rng.choice(["", "", ")"])

    texts = [text(rng.choice([1, 2, 4, 8])) for _ in range(300)] + ["（" * 9 + "宋体小四居中" + "）" * 9, "", None]
    bracket = re.compile(r"[（(]([^（）()]{1,120})[）)]")
    # A walk from the inmost brackets until nothing changes, with one answer for each note.
    asked = set()
    todo = [t or "" for t in texts]
    while todo:
        inner = {m for t in todo for m in bracket.findall(t)}
        asked |= inner
        todo = sorted({t[: m.start()] + t[m.end() :] for t in todo for m in bracket.finditer(t)} - asked)[:20000] if len(asked) < 3000 else []
    rows = spark.createDataFrame([(a,) for a in sorted(asked)], "t string").select("t", structure.is_instruction("t").alias("is")).collect()
    known = {r.t: r["is"] for r in rows}

    def walked(t):
        while True:
            hit = next((m for m in bracket.finditer(t) if known.get(m[1], False)), None)
            if hit is None:
                return re.sub(r"\s{2,}", " ", t).strip()
            t = t[: hit.start()] + t[hit.end() :]

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", front.without_instructions("t").alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [walked(t or "") for t in texts]
    assert spark.range(1).select(front.without_instructions(F.lit("a（b（宋体小四居中））")).alias("x")).first().x == "a（b）"


def test_captions_however_far(spark):
    items = [(1, 0, "image", "", "a.png")] + [(1, i, "text", "x", "") for i in range(1, 12)] + [(1, 12, "figure_caption", " Figure 1 ", "")]
    t = spark.createDataFrame(items, "doc_id int, ord int, role string, text string, image string")
    assert [r.caption for r in documents.pair_figures(t).collect()] == [None]
    assert [r.caption for r in documents.pair_figures(t, near=False).collect()] == ["Figure 1"]


def test_one_least_width_for_many_columns(spark):
    t = spark.createDataFrame([([800] + [100] * 17,)], "w array<int>")
    of = lambda *more: t.select(rows.fitted_widths(F.col("w"), F.size("w"), F.lit(2000), *more).alias("x")).first().x
    assert sum(of()) == 2000 and min(of()[1:]) == 111
    # Each column has 120 before what is over comes off the widest.
    wide = [max(120, 800 * 2000 // 2500)] + [120] * 17
    over = sum(wide) - 2000
    first = wide[0] - min(over, wide[0] - 1)
    assert of(rows.LEAST_WIDTH)[0] == first and of(rows.LEAST_WIDTH)[1:] == [120 - max(0, over - wide[0] + 1)] + [120] * 16


def test_only_lines_that_count_are_shuffled(spark):
    text = "![a][x]\n~~~\n[x]: no.png\n![b](c.png)\n ```\n [X]: y.png\nplain\n![d](e.png)"
    t = spark.createDataFrame([(1, i, line) for i, line in enumerate(text.split("\n"))] + [(2, 0, None)], "doc_id int, line_no int, line string")
    assert [tuple(r) for r in documents.definitions(t).collect()] == [(1, "x", "y.png")]
    assert sorted((r.line_no, r.source) for r in documents.images(t).collect()) == [(0, "y.png"), (7, "e.png")]
    for out in (documents.definitions(t), documents.images(t)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Contains(line" in plan
