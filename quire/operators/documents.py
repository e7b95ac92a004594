"""Operators on line and item tables of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import structure as S
from ..functions.text import col, strip
from .containment import unheld


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no and line of documents(doc_id, text)."""
    return docs.select("doc_id", F.posexplode(F.split(col(text), "\n", -1)).alias("line_no", "line"))


def fenced(table: DataFrame) -> DataFrame:
    """A line table with in_fence: the fence lines and what stands between."""
    upto = Window.partitionBy("doc_id").orderBy("line_no")
    bare = strip("line")
    mark = (bare.startswith("```") | bare.startswith("~~~")).cast("int")
    return table.withColumn("in_fence", ((F.sum(mark).over(upto) % 2) == 1) | (mark == 1))


def _asked(table: DataFrame, mark: str) -> DataFrame:
    """The lines of a table that can be fences or contain `mark`: what stands in fences is told by these as well."""
    return table.where(F.col("line").contains("```") | F.col("line").contains("~~~") | F.col("line").contains(mark))


def sections(table: DataFrame) -> DataFrame:
    """doc_id, sec_no, heading, level, role and n_lines of a line table; headings in fences count for nothing and lines
    before the first heading belong to no section."""
    table = fenced(table).withColumn("level", F.when(F.col("in_fence"), 0).otherwise(M.heading_depth("line")))
    upto = Window.partitionBy("doc_id").orderBy("line_no")
    table = table.withColumn("sec_no", F.sum((F.col("level") > 0).cast("int")).over(upto)).where("sec_no > 0")
    head = F.max(F.when(F.col("level") > 0, F.struct(M.plain(M.heading_text("line")).alias("heading"), "level")))
    out = table.groupBy("doc_id", "sec_no").agg(head.alias("h"), F.sum(((F.col("level") == 0) & (strip("line") != "")).cast("int")).alias("n_lines"))
    return out.select("doc_id", "sec_no", "h.heading", "h.level", M.role("h.heading").alias("role"), "n_lines")


def tables(table: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no (0: header) and cells of the tables in a line table, each row as wide as its header.

    A table is a row with bars over a separator, then rows until a blank line, a heading or a line without bars; one
    without body rows is none.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    t = fenced(table).where("NOT in_fence").withColumn("sep", M.is_separator("line") & col(F.lag("line").over(order)).contains("|"))
    t = t.withColumn("stops", (strip("line") == "") | strip("line").startswith("#") | ~strip("line").contains("|"))
    t = t.withColumn("run", F.sum(F.col("stops").cast("int")).over(order)).where(~F.col("stops"))
    inside = Window.partitionBy("doc_id", "run").orderBy("line_no")
    t = t.withColumn("sep_at", F.min(F.when(F.col("sep"), F.col("line_no"))).over(Window.partitionBy("doc_id", "run")))
    t = t.where("line_no >= sep_at - 1 AND line_no <> sep_at").withColumn("row_no", F.row_number().over(inside) - 1)
    t = t.withColumn("cells", F.transform(M.cells("line"), M.plain))
    whole = Window.partitionBy("doc_id", "run")
    t = t.withColumn("width", F.max(F.when(F.col("row_no") == 0, F.size("cells"))).over(whole)).withColumn("rows", F.count("*").over(whole)).where("rows > 1")
    return t.withColumn("table_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("run"))).select("doc_id", "table_no", "row_no", M.fitted(F.col("cells"), F.col("width")).alias("cells"))


def definitions(table: DataFrame) -> DataFrame:
    """doc_id, label and target of reference definitions outside fences; the last of a label counts."""
    found = fenced(_asked(table, "]:")).where("NOT in_fence").select("doc_id", "line_no", M.reference_definition("line").alias("d")).where("d IS NOT NULL")
    return found.groupBy("doc_id", F.col("d.label").alias("label")).agg(F.max_by("d.target", "line_no").alias("target"))


def images(table: DataFrame) -> DataFrame:
    """doc_id, line_no, ord, alt, source and reason of the pictures in a line table: `![alt](path)` and `![alt][label]`
    with the label's target; reason tells why there is no file to read."""
    whole = r"!\[([^\]]*)\](?:\(((?:[^()]|\([^()]*\))*)\)|\[([^\]]*)\])"
    tokens = fenced(_asked(table, "![")).where("NOT in_fence").select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(whole), F.lit(0))).alias("ord", "token"))
    alt, inline = F.regexp_extract("token", whole, 1), F.regexp_extract("token", whole, 2)
    label = F.when(~F.col("token").rlike(r"\)$"), M.reference_label(F.when(F.regexp_extract("token", whole, 3) != "", F.regexp_extract("token", whole, 3)).otherwise(alt)))
    tokens = tokens.select("doc_id", "line_no", "ord", alt.alias("alt"), M.image_destination(inline).alias("inline"), label.alias("label"))
    joined = tokens.join(definitions(table), ["doc_id", "label"], "left")
    source = F.when(F.col("label").isNotNull(), F.coalesce("target", F.lit(""))).otherwise(F.col("inline"))
    reason = F.when(F.col("label").isNotNull() & F.col("target").isNull(), "reference_not_found").when(M.is_remote(source), "remote").when(source == "", "empty_filename").otherwise("")
    return joined.select("doc_id", "line_no", "ord", "alt", F.when(reason == "", M.file_source(source)).otherwise(source).alias("source"), reason.alias("reason"))


def modes(table: DataFrame, order: str, marker: Column, start: str) -> DataFrame:
    """table(doc_id, ...) with mode: the last marker up to each row, `start` before the first."""
    upto = Window.partitionBy("doc_id").orderBy(order)
    return table.withColumn("mode", F.coalesce(F.last(marker, ignorenulls=True).over(upto), F.lit(start)))


def pair_figures(items: DataFrame, near: bool = True) -> DataFrame:
    """doc_id, ord, image and caption of every picture of items(doc_id, ord, role, text, image).

    The k-th picture of an unbroken run of n gets the k-th figure caption after it, before another picture or a table
    caption; near: among the next max(8, 3n + 3) items only.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    t = items.withColumn("at", F.row_number().over(order)).withColumn("picture", F.col("role") == "image")
    t = t.withColumn("starts", (F.col("picture") & ~F.coalesce(F.lag("picture").over(order), F.lit(False))).cast("int")).withColumn("run", F.sum("starts").over(order))
    if near:
        whole = Window.partitionBy("doc_id", "run")
        t = t.withColumn("n", F.sum(F.col("picture").cast("int")).over(whole)).withColumn("head", F.min("at").over(whole))
    past = t.where("run > 0 AND NOT picture").withColumn("stopped", F.sum((F.col("role") == "table_caption").cast("int")).over(Window.partitionBy("doc_id", "run").orderBy("ord")))
    captions = past.where((F.col("stopped") == 0) & (F.col("role") == "figure_caption"))
    if near:
        captions = captions.where(F.col("at") < F.col("head") + F.col("n") + F.greatest(F.lit(8), 3 * F.col("n") + 3))
    rank = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("ord"))
    captions = captions.select("doc_id", "run", strip("text").alias("caption"), rank.alias("k"))
    pictures = t.where("picture").select("doc_id", "ord", "image", "run", rank.alias("k"))
    return pictures.join(captions, ["doc_id", "run", "k"], "left").select("doc_id", "ord", "image", "caption")


FRAGMENT = r"^(?:E|RE|total|rself|rgreen|rup|max|t=\d+|\d+\s+\d+|\d+(?:\.\d+)?|[A-Za-z]{1,8})$"


def fragment_streaks(items: DataFrame) -> DataFrame:
    """doc_id, ord and sample: from the third on, every token of a streak of formula fragments, with the five before."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    t = items.withColumn("token", strip("text")).withColumn("is_fragment", F.col("token").rlike(FRAGMENT))
    t = t.withColumn("streak", F.sum((~F.col("is_fragment")).cast("int")).over(order)).where("is_fragment")
    inside = Window.partitionBy("doc_id", "streak").orderBy("ord")
    t = t.withColumn("nth", F.row_number().over(inside)).withColumn("sample", F.array_join(F.collect_list("token").over(inside.rowsBetween(-5, 0)), " / "))
    return t.where("nth >= 3").select("doc_id", "ord", "sample")


def first_images(items: DataFrame) -> DataFrame:
    """doc_id, image and ord of the first place of every picture's name."""
    return items.where("image <> ''").groupBy("doc_id", "image").agg(F.min("ord").alias("ord"))


def numbered(items: DataFrame, role: str) -> DataFrame:
    """doc_id, ord and number: captions of a kind counted in each document."""
    return items.where(F.col("role") == role).select("doc_id", "ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("number"))


def item_counts(items: DataFrame) -> DataFrame:
    """Pictures, tables, captions and characters of each document."""
    n = lambda r: F.sum((F.col("role") == r).cast("long"))
    return items.groupBy("doc_id").agg(n("image").alias("n_images"), n("table").alias("n_tables"), n("figure_caption").alias("n_figure_captions"), n("table_caption").alias("n_table_captions"), F.sum(F.length(strip("text"))).alias("n_chars"))


def missing(expected: DataFrame, rendered: DataFrame, limit: int = 6) -> DataFrame:
    """The first `limit` rows of expected(doc_id, ord, text) of each document that no text of rendered(doc_id, text)
    contains, white space and case apart."""
    key = lambda x: F.lower(F.regexp_replace(col(x), r"\s+", ""))
    e = expected.select(F.struct(*expected.columns).alias("__row"), "doc_id", key("text").alias("key"))
    left = unheld(e, rendered.select("doc_id", key("text").alias("text"))).select("__row.*")
    return left.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("__n") <= limit).drop("__n")


def toc_pollution(headings: DataFrame) -> DataFrame:
    """doc_id, ord, and why a heading pollutes a contents list: it reads as body text, or repeats an earlier heading that
    had nothing below. headings(doc_id, ord, heading, n_lines)."""
    key = F.regexp_replace(col("heading"), r"\s+", "")
    before = Window.partitionBy("doc_id", "__k").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    t = headings.withColumn("__k", key).withColumn("__e", F.max(F.when(F.col("n_lines") == 0, 1)).over(before))
    why = F.when(S.heading_is_polluted("heading"), "body_or_formula").when((F.col("n_lines") > 0) & (F.col("__e") == 1), "empty_duplicate")
    return t.select("doc_id", "ord", why.alias("why")).where("why IS NOT NULL")
