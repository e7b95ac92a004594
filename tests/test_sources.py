"""Word packages made here with the standard library, read back as rows."""

import random
import zipfile

import pytest

from quire.operators import matching
from quire.sources import ooxml

_HEAD = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"><w:body>'
_BODY = (
    '<w:p><w:pPr><w:pStyle w:val="Heading1"/><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="32"/></w:rPr><w:t>Title</w:t></w:r></w:p>'
    "<w:p><w:r><w:t>kept </w:t></w:r><w:del><w:r><w:delText>gone</w:delText><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins><m:oMath><m:r><m:t>x=1</m:t></m:r></m:oMath></w:p>"
    '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl>"
    "<w:sdt><w:sdtContent><w:p><w:r><w:t>control</w:t></w:r></w:p></w:sdtContent></w:sdt><w:sectPr/></w:body></w:document>"
)


@pytest.fixture
def folder(tmp_path):
    for name, body in (("one", _BODY), ("sub/two", _BODY.replace("Title", "Other"))):
        path = tmp_path / f"{name}.docx"
        path.parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("word/document.xml", _HEAD + body)
            z.writestr("word/media/image1.png", b"png")
            z.writestr("word/header1.xml", "<x/>")
            z.writestr("word/footnotes.xml", '<w:footnotes xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:footnote w:type="separator" w:id="0"/><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>')
    (tmp_path / "bad.docx").write_bytes(b"no package")
    (tmp_path / "other.txt").write_text("x")
    return str(tmp_path)


def test_packages(spark, folder):
    rows = ooxml.read_packages(spark, folder).cache()
    assert rows.select("path").distinct().count() == 3
    one = rows.where("path LIKE '%one.docx'")
    assert [r.text for r in one.where("kind = 'paragraph' AND depth = 0").orderBy("ord").collect()] == ["Title", "kept newx=1", "control"]
    title = one.where("text = 'Title'").first()
    assert title.style == "Heading1" and title.props == {"align": "center", "size": "16.0", "bold": "1"}
    cells = {(r.table_id, r.row, r.cell): (r.text, r.span, r.depth, r.props) for r in one.where("kind = 'cell'").collect()}
    assert cells[0, 0, 0] == ("a", 2, 0, {}) and cells[1, 0, 0][0] == "inner" and cells[1, 0, 0][2] == 1 and cells[0, 1, 1][3] == {"vmerge": "continue"}
    assert [(r.style, r.text) for r in one.where("kind = 'footnote'").collect()] == [("2", "note")]
    bad = rows.where("NOT ok").collect()
    assert len(bad) == 1 and bad[0].text == "bad_docx:BadZipFile"
    f = ooxml.features(rows).where("path LIKE '%two.docx'").first()
    assert (f.tables, f.images, f.headers, f.formulas, f.sections, f.merged_cells, f.controls, f.tracked_changes) == (2, 1, 1, 1, 1, 2, 1, 2)


def test_math_spans():
    assert matching.math_spans("a $x$ and $5 only") == [(2, 5, "x", "dollar")]

    assert matching.math_spans("$$a = b$$") == [] and matching.math_spans(None) == [] and matching.math_spans("x" * 1300) == []


def test_match_uses_each_row_once(spark):
    e = spark.createDataFrame([(1, 1, "A b"), (1, 2, "ab"), (1, 3, "c")], "doc_id long, ord long, text string")
    r = spark.createDataFrame([(1, 10, "xab y"), (1, 11, "AB"), (1, 12, "c\t4"), (2, 1, "c")], "doc_id long, ord long, text string")
    got = {x.ord: x.match for x in matching.match_in_order(e, r).where("doc_id = 1").collect()}
    assert got == {1: 11, 2: 10, 3: None}


def test_match_against_a_walk_over_all_pairs(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abA ") for _ in range(n))
    docs = [1, 2, 3, 4, 5, None]
    right = {d: [(i, None if i == 7 else word(rng.randint(0, 6)) + ("\t" if i % 9 == 0 else "")) for i in range(rng.randint(0, 40))] for d in docs}
    left = {d: [(i, None if i == 5 else word(rng.randint(0, 3))) for i in range(rng.randint(10, 40))] for d in docs}
    expected = []
    for d in docs:
        places, used = [(i, "".join((t or "").split()).lower()) for i, t in right[d] if "\t" not in (t or "")], set()
        for i, t in left[d]:
            key = "".join((t or "").split()).lower()
            free = [(p, x) for p, x in places if key and p not in used]
            found = next((p for p, x in free if x == key), next((p for p, x in free if key in x), None))
            used.add(found)
            expected.append((d, i, found))
    table = lambda of: spark.createDataFrame([(d, i, t) for d in docs for i, t in of[d]], "doc_id long, ord long, text string").repartition(3)
    got = matching.match_in_order(table(left), table(right))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str) and sum(m is not None for _, _, m in expected) > 50
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().toString()
