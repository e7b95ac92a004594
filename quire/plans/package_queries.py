"""Queries over Word packages, which are written from `documents` by the sink and read by the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.state import new_path
from ..sources import packages
from .queries import _table, query

_HEAD = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>'


def _escaped(x):
    """Text for XML; characters that XML can't hold are blanks."""
    x = F.regexp_replace(x, r"[\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}]", " ")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def written(spark, sf_dir):
    """The folder with a package for each document: a paragraph for each line, its number as inline math behind it, the
    fifth line of each in a control, a deleted word, a picture behind the first, and a note on the second."""
    line = lambda x, i: F.concat(
        F.lit('<w:p><w:r><w:t xml:space="preserve">'), x, F.lit("</w:t></w:r><w:del><w:r><w:t>deleted</w:t></w:r></w:del>"),
        F.when(i == 0, '<w:r><w:drawing><a:blip xmlns:a="a" r:embed="i1"/></w:drawing></w:r>').when(i == 1, '<w:r><w:footnoteReference w:id="2"/></w:r>').otherwise(""),
        F.lit("<m:oMath><m:r><m:t>n="), i.cast("string"), F.lit("</m:t></m:r></m:oMath></w:p>"),
    )
    boxed = lambda x, i: F.when(i % 5 == 4, F.concat(F.lit("<w:sdt><w:sdtContent>"), line(x, i), F.lit("</w:sdtContent></w:sdt>"))).otherwise(line(x, i))
    body = F.array_join(F.transform(F.split(_escaped(F.coalesce("text", F.lit(""))), "\n", -1), boxed), "")
    notes = F.concat(F.lit('<w:footnotes xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:footnote w:id="2"><w:p><w:r><w:t>Note '), F.col("doc_id").cast("string"), F.lit("</w:t></w:r></w:p></w:footnote></w:footnotes>"))
    # Dealt out by key: a file of one row group would be one task's, and rows of one name meet.
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id").select(
        F.concat(F.lit("d"), "doc_id").alias("name"), F.concat(F.lit(_HEAD), body, F.lit("</w:body></w:document>")).alias("document"), F.lit('<Relationships><Relationship Id="i1" Target="media/p.png"/></Relationships>').alias("relations"),
        F.create_map(F.lit("word/footnotes.xml"), notes.cast("binary")).alias("media"),
    )
    path = new_path(packages.registered(spark), "packages")
    rows.write.format("packages").mode("append").option("folders", "true").save(path)
    return path


@query(
    """WITH t AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b-\\x1f]', ' ', 'g'), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
s AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(160) || chr(8195) || chr(12288)) <> '' AS shown, line FROM t)
SELECT doc_id, i AS paragraph, 'text' AS kind, sha256(line) AS digest FROM s WHERE shown
UNION ALL SELECT doc_id, i, 'math', sha256('n=' || i) FROM s UNION ALL SELECT doc_id, 0, 'picture', sha256('word/media/p.png') FROM s WHERE i = 0
UNION ALL SELECT doc_id, 1, 'footnote', sha256('Note ' || doc_id) FROM s WHERE i = 1
UNION ALL SELECT doc_id, -1, 'control', sha256(line || 'n=' || i) FROM s WHERE i % 5 = 4"""
)
def a16_f12_package_items(spark, sf_dir):
    """The items of packages in order: text, pictures, math, notes, and what controls hold."""
    t = spark.read.format("packages").load(written(spark, sf_dir)).where("ok")
    kind = F.when(F.col("boxed") != "", F.col("boxed")).otherwise(F.col("kind"))
    value = F.when(F.col("kind") == "picture", F.col("ref")).otherwise(F.col("text"))
    return t.select(F.regexp_extract("path", r"d(\d+)\.docx$", 1).cast("long").alias("doc_id"), F.coalesce("paragraph", F.lit(-1)).cast("long").alias("paragraph"), kind.alias("kind"), F.sha2(value, 256).alias("digest"))
