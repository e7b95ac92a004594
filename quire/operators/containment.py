"""Which texts of a document contain which keys: by an inverted index of grams where a document has many texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact
from .state import settled

#: Characters of a gram; a shorter key is its own gram.
GRAM = 4
#: Texts of a document that are compared without an index.
FEW = 64


def _grams(x: Column, size: Column) -> Column:
    """The distinct grams of a text, at least as long as one."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: F.substring(x, i, size)))


def _parted(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The texts of documents with FEW at most, and those of all others; None where there is no such document."""
    crowded = settled(texts.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("doc_id"), "crowded")
    if not crowded.limit(1).count():
        return texts, None
    return texts.join(crowded, "doc_id", "left_anti"), texts.join(crowded, "doc_id", "left_semi")


def _by_grams(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, key and text_id by the index: a key asks only the texts that have its rarest gram, and these are compared with
    it; a key with a gram that no text of its document has asks none. The empty key is contained in every text."""
    k = keys.where("key IS NOT NULL").select("doc_id", "key").distinct().join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    k = k.withColumn("size", F.least(F.length("key"), F.lit(GRAM)))
    some, texts = k.where("size > 0"), texts.distinct()
    posts = texts.join(some.select("doc_id", "size").distinct(), "doc_id").where("length(text) >= size")
    posts = posts.select("doc_id", "text_id", F.explode(_grams(F.col("text"), F.col("size"))).alias("gram"))
    counts = posts.groupBy("doc_id", "gram").agg(F.count("*").alias("n"))
    rarest = some.select("doc_id", "key", F.explode(_grams(F.col("key"), F.col("size"))).alias("gram")).join(counts, ["doc_id", "gram"], "left")
    rarest = rarest.groupBy("doc_id", "key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).where("m.n > 0").select("doc_id", "key", F.col("m.gram").alias("gram"))
    met = rarest.join(posts, ["doc_id", "gram"]).select("doc_id", "key", "text_id").join(texts, ["doc_id", "text_id"]).where(F.col("text").contains(F.col("key")))
    empty = k.where("size = 0").select("doc_id", "key").join(texts.select("doc_id", "text_id"), "doc_id")
    return met.select("doc_id", "key", "text_id").unionByName(empty)


def holders(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct keys(doc_id, key, ...) with text_id: a row for each text of texts(doc_id, text_id, text) that contains one.

    Keys of a document with few texts are compared with each of them, so this takes at most FEW comparisons a key; in the
    others texts are found by an index of grams. Null keys and texts count for nothing.
    """
    few, many = _parted(texts.where("text IS NOT NULL").select("doc_id", "text_id", "text"))
    keys = keys.where("key IS NOT NULL").distinct()
    met = keys.join(few.distinct(), "doc_id").where(F.col("text").contains(F.col("key"))).select(*keys.columns, "text_id")
    if many is not None:
        met = met.unionByName(keys.join(_by_grams(keys, many), ["doc_id", "key"]).select(*keys.columns, "text_id"))
    return met


def unheld(rows: DataFrame, texts: DataFrame, least: int = 0) -> DataFrame:
    """The rows(doc_id, key, ...) whose key no text of texts(doc_id, text) contains; a key of fewer than `least` characters
    must equal a text to be held. Null keys are in no text.

    As in holders, but a row asks only until one text holds its key.
    """
    few, many = _parted(texts.where("text IS NOT NULL").select("doc_id", "text"))
    f = few.toDF("__d", "__t")
    held = F.col("__t").contains(F.col("key"))
    if least:
        held = (F.col("__t") == F.col("key")) | ((F.length("key") >= least) & held)
    out = rows.join(f, (rows["doc_id"] == F.col("__d")) & held, "left_anti")
    if many is not None:
        asked = out.where(F.length("key") >= least)
        found = _by_grams(asked, many.withColumn("text_id", F.md5("text"))).select("doc_id", "key").distinct()
        if least:
            found = found.unionByName(many.select("doc_id", F.col("text").alias("key")).distinct()).distinct()
        out = out.join(found, ["doc_id", "key"], "left_anti").select(*rows.columns)
    return out


def tables_with_samples(expected: DataFrame, rendered: DataFrame) -> DataFrame:
    """doc_id, table_id and found: the first table of rendered(doc_id, ord, text) that holds the samples of each table of
    expected(doc_id, table_id, row, col, text); null if none does, or if it has no sample.

    Samples are the first three texts among the first four cells of the first two rows; white space doesn't count.
    """
    cells = expected.select("doc_id", "table_id", "row", "col", compact("text").alias("key"))
    sample = cells.where("row < 2 AND col < 4 AND key <> ''").withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "table_id").orderBy("row", "col"))).where("k <= 3").select("doc_id", "table_id", "key").distinct()
    needed = sample.groupBy("doc_id", "table_id").agg(F.count("*").alias("needed"))
    held = holders(sample, rendered.select("doc_id", F.col("ord").alias("text_id"), compact("text").alias("text")))
    held = held.groupBy("doc_id", "table_id", "text_id").agg(F.count("*").alias("n")).join(needed, ["doc_id", "table_id"]).where("n = needed")
    first = held.groupBy("doc_id", "table_id").agg(F.min("text_id").alias("found"))
    return expected.select("doc_id", "table_id").distinct().join(first, ["doc_id", "table_id"], "left")
