"""From a document's elements in order to sections, references and what is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import front, structure, text
from ..functions.text import let, strip
from . import scans
from .state import settled


def contents_blocks(paragraphs: DataFrame, most: int | None = 160) -> DataFrame:
    """doc_id, n and skip: how many paragraphs behind each contents title belong to a contents list that the source has.

    paragraphs(doc_id, n, text, heading_style, boundary): n counts from 0 without gaps, boundary marks a page or section
    break. The list's first visible line must be an entry. Under a title without heading style it reaches to the first
    break within `most` paragraphs (None: the document), if it has a paged entry or two visible lines. Else it ends
    before the first line that is no entry, repeats one, lacks a page where one before had one, or goes back in its
    numbering, or with the first break; it must have a paged entry or two of any sort.
    """
    p = paragraphs.withColumn("t", strip("text")).withColumn("style", F.coalesce("heading_style", F.lit(False))).withColumn("stop", F.coalesce("boundary", F.lit(False)))
    title = structure.is_toc_title("t")
    p = p.withColumn("title", title).withColumn("shown", F.col("t") != "").withColumn("paged", F.col("shown") & structure.is_toc_entry("t") & ~title)
    p = p.withColumn("entry", F.col("shown") & (F.col("paged") | structure.is_bare_toc_entry("t") | (F.col("style") & (F.length("t") <= 80) & ~structure.is_placeholder("t") & ~F.col("t").rlike(r"[。！？!?；;]\s*$"))))
    p = settled(p.withColumn("key", structure.toc_key("t")).withColumn("order", structure.toc_order("t")))
    titles = p.where("title").select("doc_id", F.col("n").alias("at"), F.col("style").alias("styled"))
    if most is None:
        ends = p.groupBy("doc_id").agg(F.max("n").alias("end"))
        titles = titles.join(ends, "doc_id")
    else:
        titles = titles.withColumn("end", F.col("at") + most)
    ahead = titles.where("end > at").select("doc_id", "at", "styled", F.explode(F.sequence(F.col("at") + 1, F.col("end"))).alias("n"))
    t = ahead.join(p.select("doc_id", "n", "shown", "paged", "entry", "key", "order", "stop"), ["doc_id", "n"])
    before = Window.partitionBy("doc_id", "at").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("doc_id", "at", "key").orderBy("n")
    # What the lines before a line say, if all of them are part of the list.
    t = t.withColumn("again", (F.col("key") != "") & (F.sum(F.col("shown").cast("int")).over(same) > 1)).withColumn("had", F.coalesce(F.max(F.col("paged").cast("int")).over(before), F.lit(0)) == 1)
    t = t.withColumn("last", F.last(F.when(F.col("shown"), F.col("order")), ignorenulls=True).over(before)).withColumn("later", F.coalesce(F.max(F.col("shown").cast("int")).over(before), F.lit(0)) == 1)
    back = F.coalesce((F.col("order.scheme") == F.col("last.scheme")) & (F.col("order.ordinal") <= F.col("last.ordinal")), F.lit(False))
    breaks = F.col("shown") & (~F.col("entry") | (F.col("later") & (F.col("again") | (F.col("had") & ~F.col("paged")) | back)))
    t = t.withColumn("breaks", breaks)
    least = lambda test: F.min(F.when(test, F.col("n"))).over(Window.partitionBy("doc_id", "at"))
    t = t.withColumn("edge", least(F.col("stop"))).withColumn("wrong", least(F.col("breaks"))).withColumn("first", least(F.col("shown")))
    n = lambda test: F.sum(F.when(test, 1).otherwise(0))
    some = lambda test: F.max(F.when(test, 1).otherwise(0)) == 1
    open_ = F.col("edge").isNotNull() & ~F.col("styled")
    inside = F.when(open_, F.col("n") <= F.col("edge")).otherwise((F.col("wrong").isNull() | (F.col("n") < F.col("wrong"))) & (F.col("edge").isNull() | (F.col("n") <= F.col("edge"))))
    g = t.groupBy("doc_id", "at").agg(
        F.max(F.when(inside, F.col("n"))).alias("end"), n(inside & F.col("shown")).alias("lines"), some(inside & F.col("paged") & (~open_ | (F.col("n") == F.col("first")))).alias("paged"),
        some((F.col("n") == F.col("first")) & F.col("entry")).alias("begins"),
    )
    found = F.col("begins") & F.col("end").isNotNull() & (F.col("paged") | (F.col("lines") >= 2))
    g = g.select("doc_id", F.col("at").alias("n"), F.when(found, F.col("end") - F.col("at")).otherwise(0).alias("skip"))
    return titles.select("doc_id", F.col("at").alias("n")).join(g, ["doc_id", "n"], "left").fillna(0, ["skip"])


#: Names that a heading's line may go on behind (fixed values).
OPENINGS = r"(?i)^(Abstract\s*:?|Key\s*words?\s*:?|摘要\s*[：:]|关键词\s*[：:])\s*"


def section_heading(x, level: Column) -> Column:
    """struct(heading, rest, role) of a heading's line; null if it is a placeholder, guidance or empty."""
    t = strip(x)
    clean = strip(F.split(t, "（")[0])
    opens = t.rlike(OPENINGS)
    rest = F.regexp_replace(strip(F.regexp_replace(t, OPENINGS, "")), r"^[（(][^）)]*[）)]\s*", "")
    heading = structure.spaced_heading(F.when(opens, strip(F.regexp_extract(t, OPENINGS, 1))).otherwise(clean))
    none = structure.is_placeholder(clean) | structure.is_instruction(t) | (clean == "")
    return let(heading, lambda h: F.when(~none, F.struct(h.alias("heading"), F.when(opens, rest).otherwise("").alias("rest"), structure.section_role(h, level).alias("role"))))


def dispatch(elements: DataFrame, most: int | None = 160) -> DataFrame:
    """elements(doc_id, ord, kind, text, level, heading_style, boundary, wrapped) with fate, section, heading, rest and role.

    ord counts from 0 without gaps; kind is paragraph or table, level a paragraph's heading level, wrapped whether it
    stands in a control or revision, where contents titles open no list. fate is:
    placeholder (or guidance), contents (a list that the source has), references (their heading), entry (of references),
    lost (an entry whose list is opened again before it was closed), section (a heading that opens one), dropped (a
    heading without a name) or item. section counts the sections of a document, 0 being what stands before the first;
    entries have none.

    Whether references are being collected is told by the last heading of references or of back matter before an element,
    which scans.last_before finds over blocks of elements; the lists of contents are taken in order by pointers.
    """
    t = strip("text")
    e = elements.withColumn("t", t).withColumn("paragraph", F.col("kind") == "paragraph")
    e = e.withColumn("placeholder", F.col("paragraph") & (structure.is_placeholder("t") | structure.is_instruction("t")))
    # What the lines say is found once; the scans below read these tables more than once.
    level, back = F.coalesce("level", F.lit(0)), strip(F.split("t", "[:：]", 2)[0])
    closing = let(structure.spaced_heading(back), lambda h: F.struct(h.alias("heading"), F.lit("").alias("rest"), structure.section_role(h, F.greatest(level, F.lit(1))).alias("role")))
    refs = front.is_reference_heading("t")
    e = settled(e.select("*", refs.alias("refs"), (~refs & structure.is_backmatter("t")).alias("back"), F.when(structure.is_backmatter("t"), closing).alias("closing"), F.when(level > 0, section_heading("t", level)).alias("opening"), (text.clean("t") == "").alias("blank")))
    # Paragraphs are counted for the contents' lists: all of them to find a list, those that aren't placeholders to skip it.
    e = scans.sum_upto(e, ["doc_id"], "ord", F.col("paragraph") & ~F.coalesce("wrapped", F.lit(False)), "plain")
    e = settled(scans.sum_upto(settled(e), ["doc_id"], "ord", F.col("paragraph") & ~F.col("placeholder"), "counted"))
    source = e.where("paragraph AND NOT coalesce(wrapped, false)").select("doc_id", (F.col("plain") - 1).alias("n"), "text", "heading_style", "boundary")
    blocks = settled(contents_blocks(source, most).where("skip > 0"))
    spans = e.where("paragraph AND NOT placeholder AND NOT coalesce(wrapped, false)").select("doc_id", (F.col("plain") - 1).alias("n"), F.col("counted").alias("start")).join(blocks, ["doc_id", "n"])
    spans = scans.taken_in_order(settled(spans.select("doc_id", "start", (F.col("start") + F.col("skip")).alias("end"))), ["doc_id"])
    skipped = spans.select("doc_id", F.explode(F.sequence("start", "end")).alias("counted")).withColumn("skipped", F.lit(True))
    e = e.join(skipped, ["doc_id", "counted"], "left").withColumn("skipped", F.when(F.col("paragraph"), F.col("skipped")))
    free = F.col("paragraph") & ~F.col("placeholder") & F.col("skipped").isNull()
    e = settled(e.withColumn("free", free).withColumn("event", F.when(free & F.col("refs"), "opens").when(free & F.col("back"), "closes")))
    e = scans.last_before(e, ["doc_id"], "ord", F.col("event"), "state")
    listing = F.coalesce(F.col("state") == "opens", F.lit(False))
    named = F.coalesce(F.when(listing & (F.col("event") == "closes"), F.col("closing")), F.when(~listing, F.col("opening")))
    e = e.withColumn("listing", listing).withColumn("named", F.when(F.col("free") & ~F.coalesce(F.col("event") == "opens", F.lit(False)), named))
    fate = (
        F.when(F.col("placeholder"), "placeholder").when(F.col("skipped"), "contents").when(F.col("event") == "opens", "references").when(F.col("named").isNotNull(), "section")
        .when(F.col("listing"), F.when(F.col("paragraph") & F.col("blank"), "dropped").otherwise("entry")).when(F.col("paragraph") & (level > 0), "dropped").otherwise("item")
    )
    e = settled(e.withColumn("fate", fate))
    e = scans.sum_upto(e, ["doc_id"], "ord", F.col("fate") == "section", "section")
    # The event behind an entry tells whether its list is closed: the last before it in the reverse order.
    e = scans.last_before(settled(e).withColumn("reverse", -F.col("ord")), ["doc_id"], "reverse", F.when(F.col("event") == "opens", "opens").when((F.col("event") == "closes") & F.col("listing"), "closes"), "behind")
    fate = F.when((F.col("fate") == "entry") & (F.col("behind") == "opens"), "lost").otherwise(F.col("fate"))
    return e.select(*elements.columns, fate.alias("fate"), F.when(F.col("fate").isin("section", "item", "dropped"), F.col("section")).alias("section"), "named.heading", "named.rest", "named.role")
