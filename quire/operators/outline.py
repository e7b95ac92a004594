"""Sections and lines of documents in order: titles, leading blocks, contents entries, numbered order, body start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import front, markdown, structure
from ..functions.text import compact, strip
from .containment import holders

FRONT_ROLES = ("cn_abstract", "cn_keywords", "en_abstract", "en_keywords")


def content_sections(sections: DataFrame) -> DataFrame:
    """sections(doc_id, ord, heading, n_items, n_images) without the stand-in for a body that has other sections, and without
    empty ones that have no heading of their own."""
    t = sections.withColumn("__n", F.count("*").over(Window.partitionBy("doc_id")))
    stand_in = F.coalesce(F.col("heading") == front.BODY_NAME, F.lit(False))
    own = (F.coalesce(F.col("heading"), F.lit("")) != "") & ~stand_in
    return t.where(~(stand_in & (F.col("__n") > 1)) & ((F.col("n_items") > 0) | (F.col("n_images") > 0) | own)).drop("__n")


def body_breaks(sections: DataFrame) -> DataFrame:
    """sections(doc_id, ord, role, page_break) with a page break at the first that is no front matter and has none yet."""
    open_ = ~F.coalesce(F.col("role"), F.lit("")).isin(*FRONT_ROLES) & ~F.coalesce(F.col("page_break"), F.lit(False))
    first = F.min(F.when(open_, F.col("ord"))).over(Window.partitionBy("doc_id"))
    return sections.withColumn("page_break", F.coalesce(F.col("page_break"), F.lit(False)) | F.coalesce(F.col("ord") == first, F.lit(False)))


def titles(lines: DataFrame) -> DataFrame:
    """doc_id, title and line_no where it ends, of lines(doc_id, line_no, line): the first heading of the first level, or a
    line underlined by equals signs."""
    t = strip(markdown.without_bom(F.col("line")))
    marked = F.regexp_extract(t, r"^#\s+(.+?)\s*#*\s*$", 1)
    under = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    found = lines.select("doc_id", "line_no", t.alias("t"), marked.alias("marked"), under.alias("under"))
    lined = (F.col("t") != "") & F.coalesce(strip("under").rlike("^=+$"), F.lit(False))
    found = found.where((F.col("marked") != "") | lined)
    end = F.col("line_no") + F.when(F.col("marked") != "", 0).otherwise(1)
    first = found.groupBy("doc_id").agg(F.min_by(F.struct(F.when(F.col("marked") != "", strip("marked")).otherwise(F.col("t")).alias("title"), end.alias("line_no")), "line_no").alias("m"))
    return first.select("doc_id", "m.title", "m.line_no")


def without_leading_block(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, line; numbers from 0 without gaps) behind a leading block between dashes, blank lines, and a
    leading section of format rules.

    Such a section begins with a heading. Under a heading that names it, it ends at the next heading or behind dashes;
    under any other, only if all its lines are rules, behind dashes or with the document.
    """
    w = Window.partitionBy("doc_id")
    t = lines.withColumn("__t", strip(markdown.without_bom(F.col("line"))))
    first = lambda test: F.min(F.when(test, F.col("line_no"))).over(w)
    opens = F.max(F.when((F.col("line_no") == 0) & (F.col("__t") == "---"), 1).otherwise(0)).over(w) == 1
    t = t.withColumn("__o", opens).withColumn("__a", F.when(F.col("__o"), F.coalesce(first((F.col("line_no") > 0) & (F.col("__t") == "---")) + 1, F.lit(0))).otherwise(0))
    t = t.withColumn("__b", first((F.col("line_no") >= F.col("__a")) & (F.col("__t") != "")))
    t = t.where(F.col("line_no") >= F.col("__b"))

    heading = F.col("__t").rlike(r"^#{1,3}\s+")
    head = F.col("line_no") == F.col("__b")
    t = t.withColumn("__h", F.max(F.when(head & heading, 1).otherwise(0)).over(w) == 1).withColumn("__e", F.max(F.when(head & markdown.is_format_heading("line"), 1).otherwise(0)).over(w) == 1)
    later, rule = F.col("line_no") > F.col("__b"), markdown.is_format_rule(F.col("__t"))
    text = later & (F.col("__t") != "") & (F.col("__t") != "---") & ~heading
    stop = F.when(F.col("__e"), later & ((F.col("__t") == "---") | heading)).otherwise(later & ((F.col("__t") == "---") | heading | (text & ~rule)))
    t = t.withColumn("__s", F.min(F.when(stop, F.struct("line_no", F.col("__t").alias("t")))).over(w))
    ruled = F.max(F.when(text & rule & (F.col("__s").isNull() | (F.col("line_no") < F.col("__s.line_no"))), 1).otherwise(0)).over(w) == 1
    end = (
        F.when(~F.col("__h"), F.col("__b"))
        .when(F.col("__s").isNull(), F.when(F.col("__e") | F.col("__r"), F.lit(1 << 60)).otherwise(F.col("__b")))
        .when(F.col("__s.t") == "---", F.when(F.col("__e") | F.col("__r"), F.col("__s.line_no") + 1).otherwise(F.col("__b")))
        .when(F.col("__e"), F.col("__s.line_no")).otherwise(F.col("__b"))
    )
    t = t.withColumn("__r", ruled).withColumn("__end", end)
    return t.where(F.col("line_no") >= F.col("__end")).select(*lines.columns)


def contents_entries(sections: DataFrame, has_references: Column) -> DataFrame:
    """doc_id, ord, level and text of a contents list: sections(doc_id, ord, heading, level, role) that are no front or back
    matter, captions or stand-ins, then references, acknowledgements and appendices where there are any."""
    h = strip("heading")
    role = F.coalesce(F.col("role"), F.lit(""))
    back = role.isin("references", "acknowledgement", "appendix")
    own = (h != "") & (h != front.BODY_NAME) & ~role.isin(*FRONT_ROLES) & ~back & ~front.is_reference_heading(h) & ~structure.is_backmatter(h) & ~structure.is_figure_caption(h) & ~structure.is_table_caption(h)
    level = F.greatest(F.lit(1), F.least(F.coalesce(F.col("level"), F.lit(1)), F.lit(3))).cast("int")
    rows = sections.where(own).select("doc_id", "ord", level.alias("level"), structure.spaced_heading(h).alias("text"))
    named = front.back_role("heading", "role")
    end = sections.groupBy("doc_id").agg(F.max(has_references.cast("int")).alias("r"), F.max((named == "acknowledgement").cast("int")).alias("a"), F.max((named == "appendix").cast("int")).alias("x"), F.max("ord").alias("m"))
    last = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.struct((F.col("m") + i).alias("ord"), F.lit(1).alias("level"), F.lit(text).alias("text"))) for i, (c, text) in enumerate((("r", "参考文献"), ("a", "致  谢"), ("x", "附  录")), 1)]))
    return rows.unionByName(end.select("doc_id", F.inline(last)))


def caption_entries(items: DataFrame, kind: str) -> DataFrame:
    """doc_id, ord and text of a list of figures or tables (kind: 'figure' or 'table'): captions of items(doc_id, section, ord,
    role, text, heading, has_media), and the heading of a section with such media and no item of that kind, if it is a caption."""
    is_caption = structure.is_figure_caption if kind == "figure" else structure.is_table_caption
    roles = ("figure", "figure_caption") if kind == "figure" else ("table_caption",)
    inline = F.col("role").isin("figure", "image") if kind == "figure" else F.col("role") == "table_caption"
    own = items.where(F.col("role").isin(*roles) & (strip("text") != "")).select("doc_id", "ord", structure.spaced_caption("text").alias("text"))
    by_section = items.groupBy("doc_id", "section").agg(F.max(F.coalesce(inline, F.lit(False)).cast("int")).alias("inline"), F.max(F.col("has_media").cast("int")).alias("media"), F.min("ord").alias("ord"), F.first("heading").alias("heading"))
    legacy = by_section.where("inline = 0 AND media = 1").where(is_caption("heading")).select("doc_id", "ord", structure.spaced_caption("heading").alias("text"))
    return own.unionByName(legacy)


def sorted_blocks(sections: DataFrame) -> DataFrame:
    """doc_id, block, ord and place: the order of a block's sections(doc_id, block, ord, number) behind its head (the first).
    Each numbered one opens a chunk with those without a number after it. Chunks are sorted by number only if all begin
    with one, there are two or more, and some stand out of order."""
    w = Window.partitionBy("doc_id", "block").orderBy("ord")
    whole = Window.partitionBy("doc_id", "block")
    t = sections.withColumn("__i", F.row_number().over(w)).withColumn("__k", F.sum(F.when((F.col("__i") > 1) & F.col("number").isNotNull(), 1).otherwise(0)).over(w))
    # Sections behind the head and before the first number are chunks without one.
    plain = F.max(F.when((F.col("__i") > 1) & (F.col("__k") == 0), 1).otherwise(0)).over(whole)
    late = F.when(F.col("number") < F.max(F.when(F.col("__i") > 1, F.col("number"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    t = t.withColumn("__late", late)
    t = t.withColumn("__sort", (F.max("__late").over(whole) == 1) & (plain == 0) & (F.max("__k").over(whole) >= 2))
    lead = F.first("number", ignorenulls=True).over(Window.partitionBy("doc_id", "block", "__k").orderBy("ord"))
    t = t.withColumn("__key", F.when(F.col("__sort") & (F.col("__i") > 1), lead).when(F.col("__i") == 1, -1).otherwise(0))
    return t.select("doc_id", "block", "ord", F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("__key", "__k", "ord")).alias("place"))


def body_start(paragraphs: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id and the place from 0 where the body of paragraphs(doc_id, ord, text) begins, by expected(doc_id, ord, role, text).

    The first paragraph that has an expected text from before the first heading, by the first such text; else the last
    that is one of the first five headings, by the first heading found; else behind the contents title; else 0.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    p = paragraphs.select("doc_id", (F.row_number().over(order) - 1).alias("at"), F.lower(compact("text")).alias("p"))
    e = expected.select("doc_id", "ord", F.coalesce(F.col("role"), F.lit("")).startswith("h").alias("head"), F.lower(compact("text")).alias("e"))
    e = e.withColumn("before", F.coalesce(F.max(F.col("head").cast("int")).over(order), F.lit(0)) == 0).where("e <> ''")
    heads = e.where("head").withColumn("k", F.row_number().over(order)).where("k <= 5")
    met = holders(e.where("before").select("doc_id", "ord", F.col("e").alias("key")), p.select("doc_id", F.col("at").alias("text_id"), F.col("p").alias("text")))
    early = met.groupBy("doc_id").agg(F.min(F.struct("ord", F.col("text_id").alias("at"))).alias("m")).select("doc_id", F.col("m.at").alias("early"))
    late = p.join(heads, (p.doc_id == heads.doc_id) & (p.p == heads.e)).groupBy(p.doc_id, "k").agg(F.max("at").alias("at")).groupBy("doc_id").agg(F.min_by("at", "k").alias("late"))
    toc = p.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("p").isin("目录", "contents"), F.col("at"))).alias("toc"))
    t = toc.join(early, "doc_id", "left").join(late, "doc_id", "left")
    return t.select("doc_id", F.coalesce("early", "late", F.least(F.col("toc") + 1, F.col("n")), F.lit(0)).cast("long").alias("start"))


def heading_style_level(style_id, style_name) -> Column:
    """The level that a style's id and name state: its number, 1 for any other heading, title or chapter, else 0."""
    key = F.upper(compact(F.concat(F.coalesce(F.col(style_id), F.lit("")), F.coalesce(F.col(style_name), F.lit("")))))
    number = F.coalesce(F.nullif(F.regexp_extract(key, "HEADING([1-6])", 1), F.lit("")), F.nullif(F.regexp_extract(key, "标题([1-6])", 1), F.lit("")))
    return F.coalesce(number.cast("int"), F.when(key.rlike("HEADING|TITLE|CHAPTER|标题|章"), 1).otherwise(0))
