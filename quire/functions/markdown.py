"""Markdown lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .structure import ACKNOWLEDGEMENT, APPENDIX
from .text import SPACE, col, compact, squeeze, strip

IMG_TAG = r"""(?i)<\s*img\b(?:"[^"]*"|'[^']*'|[^'">])*>"""
FORMAT_NAMES = ("格式", "排版", "格式说明", "格式要求", "排版说明", "排版要求", "格式排版", "要求说明")
FONTS = ("times new roman", "arial", "calibri", "宋体", "黑体", "楷体", "仿宋", "微软雅黑")
RULE_WORDS = r"(?i)正文|标题|摘要|关键词|字体|字号|行距|页边距|缩进|居中|对齐|加粗|\bbody\b|\bheading\b|\bfont\b|\babstract\b|\bkeywords?\b|\bmargin\b|\bspacing\b|\bindent\b|\bjustif(?:y|ied)\b|\bcenter\b|\bbold\b"
LAZY_SOURCES = ("data-src", "data-original", "data-lazy-src", "data-url")


def without_bom(x) -> Column:
    return F.regexp_replace(col(x), "^\ufeff+", "")


def heading_text(x) -> Column:
    return strip(F.regexp_extract(strip(without_bom(x)), r"^#{1,3}\s+(.+?)\s*#*\s*$", 1))


def heading_depth(x) -> Column:
    """1 to 3 for a heading line, else 0."""
    return F.length(F.regexp_extract(without_bom(x), r"^(#{1,3})\s+\S", 1))


def plain(x) -> Column:
    """Without Markdown signs: pictures, links, emphasis, code, quotes, list marks; in this order."""
    t = F.regexp_replace(col(x), IMG_TAG, "")
    for pattern, to in (
        (r"!\[.*?\]\(.+?\)", ""), (r"\[([^\]]*)\]\(.+?\)", "$1"), (r"\*\*(.+?)\*\*", "$1"), (r"__(.+?)__", "$1"), (r"\*(.+?)\*", "$1"), (r"_(.+?)_", "$1"),
        (r"`([^`]+)`", "$1"), (r"(?m)^>\s?", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+[.)]\s+", ""),
    ):
        t = F.regexp_replace(t, pattern, to)
    return squeeze(t)


def role(x) -> Column:
    t = strip(x)
    key = F.lower(compact(t))
    return (
        F.when(key.isin("摘要", "中文摘要"), "cn_abstract").when(key.isin("关键词", "关键字"), "cn_keywords").when(key.isin("abstract", "englishabstract"), "en_abstract")
        .when(key.isin("keywords", "keyword", "keywords:", "keywords："), "en_keywords").when(t.rlike(APPENDIX) | t.rlike(r"附\s*录"), "appendix")
        .when(t.rlike(ACKNOWLEDGEMENT) | t.rlike(r"致\s*谢"), "acknowledgement").otherwise("")
    )


def reference_label(x) -> Column:
    return F.lower(squeeze(x))


def reference_definition(x) -> Column:
    """struct(label, target) of `[label]: target "title"`; null for another line."""
    pattern = r"^\s{0,3}\[([^\]]+)\]:\s*(.+?)\s*$"
    label, rest = reference_label(F.regexp_extract(col(x), pattern, 1)), strip(F.regexp_extract(col(x), pattern, 2))
    target = F.when(rest.startswith("<"), strip(F.regexp_extract(rest, "^<([^>]*)", 1))).otherwise(F.regexp_extract(rest, r"^(\S*)", 1))
    return F.when((label != "") & (target != ""), F.struct(label.alias("label"), target.alias("target")))


def image_destination(x) -> Column:
    """A picture's path without its title."""
    raw = strip(x)
    title = r"""(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^)\\])*\))"""
    angled, titled = rf"^<([^>]*)>\s*{title}?\s*$", rf"^(\S+)\s+{title}\s*$"
    return F.when(raw.rlike(angled), strip(F.regexp_extract(raw, angled, 1))).when(raw.rlike(titled), F.regexp_extract(raw, titled, 1)).otherwise(raw)


def file_source(x) -> Column:
    """A local path: cut at ? or #, unescaped, slashes forward."""
    cut = F.regexp_extract(strip(x), "^([^?#]*)", 1)
    return F.translate(F.coalesce(F.try_url_decode(F.replace(cut, F.lit("+"), F.lit("%2B"))), cut), "\\", "/")


def is_remote(x) -> Column:
    return strip(x).rlike("(?i)^[a-z][a-z0-9+.-]*://")


def is_data_uri(x) -> Column:
    return F.lower(strip(x)).startswith("data:image/")


def attribute(tag, name: str) -> Column:
    return F.coalesce(F.nullif(strip(F.regexp_extract(col(tag), rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'[^']*'|[^\s"'>]+)""", 1)), F.lit("")), strip(F.regexp_extract(col(tag), rf"""(?i)\s{name}\s*=\s*'?([^\s"'>]+)""", 1)))


def image_source(tag) -> Column:
    """The source of an <img>: src, else a lazy attribute, else the first of srcset; a data URI yields to a lazy one."""
    empty = F.lit("")
    src = F.nullif(attribute(tag, "src"), empty)
    lazy = F.coalesce(*[F.nullif(attribute(tag, a), empty) for a in LAZY_SOURCES])
    first = F.nullif(F.regexp_extract(attribute(tag, "srcset"), r"^\s*([^\s,]+)", 1), empty)
    return F.coalesce(F.when(~is_data_uri(src), src), lazy, first, src, empty)


def is_separator(x) -> Column:
    inner = strip(F.regexp_replace(strip(x), r"^\|+|\|+$", ""))
    return strip(x).contains("|") & (inner != "") & F.forall(F.split(inner, r"\|", -1), lambda c: strip(c).rlike("^:?-{3,}:?$"))


def cells(x) -> Column:
    """The cells of a table row; none without a bar."""
    t = F.regexp_replace(F.regexp_replace(strip(x), r"^\|", ""), r"\|$", "")
    return F.when(col(x).contains("|"), F.transform(F.split(t, r"\|", -1), strip)).otherwise(F.array().cast("array<string>"))


def fitted(row: Column, width: Column) -> Column:
    """A row of `width` cells: short ones filled, what is over folded into the last."""
    short = F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0))))
    over = F.concat(F.slice(row, 1, width - 1), F.array(F.array_join(F.slice(row, width, F.greatest(F.size(row), F.lit(1))), " | ")))
    return F.when(F.size(row) > width, over).otherwise(short)


def is_format_heading(x) -> Column:
    t = compact(heading_text(x))
    return t.isin(*FORMAT_NAMES) | t.rlike("格式说明|格式要求|排版说明|排版要求")


def is_format_rule(x) -> Column:
    """Two signs of a typesetting rule or more: a font, a subject, a measure, a colon."""
    t = strip(x)
    low = F.lower(t)
    font, word = low.rlike("|".join(FONTS)), t.rlike(RULE_WORDS)
    measure = t.rlike(r"(?i)\d+(?:\.\d+)?\s*(?:pt|cm|mm|号|字符|倍)") | (t.rlike(r"\d") & low.rlike("times new roman|font"))
    score = font.cast("int") + word.cast("int") + measure.cast("int")
    colon = (t.rlike("[:：]") & (score > 0)).cast("int")
    return (t != "") & (t != "---") & ~t.rlike(r"^#{1,3}\s+") & (score + colon >= 2)


def looks_like_formula(x) -> Column:
    """The stricter test for Markdown: a relation with a digit, two operators or more, no sentence end."""
    t = strip(x)
    return (F.length(t) <= 180) & t.rlike(r"[=<>≤≥≈]") & t.rlike(r"\d") & (F.regexp_count(t, F.lit(r"[=+\-*/^_<>≤≥≈]")) >= 2) & ~t.rlike("[。；！？]")
