"""Packages written and read as a data source."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quire.sources import packages

HEAD = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>'
BODY = (
    "<w:p><w:r><w:t>a </w:t><w:tab/></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>b</w:t><w:drawing><a><blip r:embed='i1'/><blip r:embed='i1'/></a></w:drawing><w:t>c</w:t></w:r></w:ins>"
    "<m:oMath><m:r><m:t>x=1</m:t></m:r></m:oMath><w:r><w:t>  </w:t><w:footnoteReference w:id='2'/></w:r><m:oMathPara><m:oMath><m:r><m:t>y</m:t></m:r></m:oMath></m:oMathPara></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t><w:pict><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:pict></w:r></w:p></w:tc></w:tr></w:tbl>"
    "<w:sdt><w:sdtPr/><w:sdtContent><w:p><w:r><w:t>control</w:t></w:r></w:p></w:sdtContent></w:sdt></w:body></w:document>"
)
RELATIONS = '<Relationships><Relationship Id="i1" Target="media/p.png"/></Relationships>'
NOTES = '<w:footnotes xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:footnote w:type="separator" w:id="0"/><w:footnote w:id="2"><w:p><w:r><w:t>a note</w:t></w:r></w:p></w:footnote></w:footnotes>'


@pytest.fixture(scope="module")
def source(spark):
    return packages.registered(spark)


def test_written_and_read(source, tmp_path):
    folder = str(tmp_path / "out")
    rows = source.range(150, numPartitions=3).select(F.concat(F.lit("d"), "id").alias("name"), F.lit(HEAD + BODY).alias("document"), F.lit(RELATIONS).alias("relations"), F.create_map(F.lit("word/footnotes.xml"), F.lit(NOTES).cast("binary"), F.lit("word/media/p.png"), F.lit("png").cast("binary")).alias("media"))
    rows.write.format("packages").mode("append").save(folder)
    names = sorted(os.listdir(folder))
    assert len(names) == 151 and not any(n.startswith(".") for n in names)
    assert len(json.load(open(f"{folder}/{next(n for n in names if n.startswith('manifest'))}"))["files"]) == 150
    open(f"{folder}/bad.docx", "w").write("no package")
    read = source.read.format("packages").load(folder)
    assert read.groupBy("ok").count().orderBy("ok").collect()[0]["count"] == 1 and read.where("ok").select("path").distinct().count() == 150
    one = read.where(F.col("path") == f"{folder}/d7.docx")
    got = [tuple(r)[2:] for r in one.collect()]
    assert got == [
        (0, 0, "text", "a \tb", "", "", False), (0, 1, "picture", "", "word/media/p.png", "", False), (0, 2, "text", "c", "", "", False), (0, 3, "math", "x=1", "", "", False), (0, 4, "footnote", "a note", "2", "", False), (0, 5, "formula", "y", "", "", False),
        (1, 0, "text", "cell", "", "", True), (None, -1, "text", "box", "", "textbox", True), (None, -1, "text", "control", "", "control", False), (2, 0, "text", "control", "", "", False),
    ]
    assert read.where("kind = 'math'").count() == 150


def test_pushed_filters_choose_files():
    reader = packages.PackageReader("/nowhere")
    left = list(reader.pushFilters([packages.EqualTo(("path",), "a"), packages.In(("kind",), ("math", "text")), packages.EqualTo(("text",), "x")]))
    assert [f.attribute for f in left] == [("text",)] and reader.paths == {"a"} and reader.kinds == {"math", "text"}


def test_a_failed_job_leaves_nothing_to_read(source, tmp_path):
    folder = str(tmp_path / "failed")
    rows = source.range(40, numPartitions=4).select(F.concat(F.lit("d"), "id").alias("name"), F.when(F.col("id") == 39, F.raise_error(F.lit("stop"))).otherwise(F.lit(HEAD)).alias("document"), F.lit("").alias("relations"), F.lit(None).cast("map<string,binary>").alias("media"))
    with pytest.raises(Exception, match="stop"):
        rows.write.format("packages").mode("append").save(folder)
    assert source.read.format("packages").load(folder).count() == 0
    twice = rows.withColumn("document", F.lit(HEAD)).withColumn("name", F.lit("same"))
    with pytest.raises(Exception, match="two rows"):
        twice.write.format("packages").mode("append").save(folder + "2")
    assert os.listdir(folder + "2") == []


def test_folders_keep_files_from_the_driver(source, tmp_path, monkeypatch):
    rows = source.range(150, numPartitions=3).select(F.concat(F.lit("d"), "id").alias("name"), F.lit(HEAD + BODY).alias("document"), F.lit(RELATIONS).alias("relations"), F.lit(None).cast("map<string,binary>").alias("media"))
    flat, dealt = str(tmp_path / "flat"), str(tmp_path / "dealt")
    rows.write.format("packages").mode("append").save(flat)
    rows.write.format("packages").mode("append").option("folders", "true").save(dealt)
    top = sorted(os.listdir(dealt))
    assert len(top) == 4
    folders = json.load(open(next(f"{dealt}/{n}" for n in top if n.endswith(".json"))))["folders"]
    assert sorted(len(os.listdir(f"{dealt}/{n}")) for n in folders) == [50, 50, 50]
    # What a job that hasn't committed holds, and files put beside, in folders of their own too.
    os.mkdir(f"{dealt}/.{'0' * 32}-{'1' * 32}")
    open(f"{dealt}/.{'0' * 32}-{'1' * 32}/d9.docx", "w").write("x")
    os.makedirs(f"{dealt}/other/deep")
    open(f"{dealt}/other/deep/bad.docx", "w").write("no package")
    reader = packages.PackageReader(dealt)
    assert sorted((len(p.paths), p.folder != "") for p in reader.partitions()) == [(0, True)] * 3 + [(1, False)]
    read = lambda folder: source.read.format("packages").load(folder)
    short = lambda t: sorted((os.path.basename(r.path), *map(str, r[1:])) for r in t.where("ok").collect())
    assert short(read(dealt)) == short(read(flat)) and read(dealt).where("NOT ok").count() == 1
    one = next(f"{dealt}/{n}/d7.docx" for n in folders if os.path.exists(f"{dealt}/{n}/d7.docx"))
    list(reader.pushFilters([packages.EqualTo(("path",), one)]))
    assert len(reader.partitions()) == 1 and read(dealt).where(F.col("path") == one).count() == read(flat).where(F.col("path") == f"{flat}/d7.docx").count() > 0
    monkeypatch.setattr(packages.PackageWriter, "IN_FOLDER", 20)
    writer = packages.PackageWriter(str(tmp_path / "small"), False, True)
    writer.commit([writer.write(iter(rows.collect()[:50]))])
    assert len(os.listdir(tmp_path / "small")) == 4
    with pytest.raises(ValueError, match="two rows"):
        writer.write(iter(rows.collect()[:1] * 2))
    assert len(os.listdir(tmp_path / "small")) == 4
    bad = rows.withColumn("document", F.when(F.col("name") == "d149", F.raise_error(F.lit("stop"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("packages").mode("append").option("folders", "true").save(str(tmp_path / "failed"))
    assert read(str(tmp_path / "failed")).count() == 0
