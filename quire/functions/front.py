"""Front and back matter: titles, cover fields, headings by role, list lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .structure import ACKNOWLEDGEMENT, APPENDIX, PROSE, is_instruction, section_role
from .text import SPACE, clean, col, compact, let, strip

#: Numerals, patterns, labels and synonyms (fixed values).
CN = "一二三四五六七八九十百千万"
NUMBERINGS = (rf"^\d+(?:\.\d+)*{SPACE}+", rf"^\d+(?:\.\d+)+{SPACE}*\S+", rf"^\d+[、．.]{SPACE}*\S+", rf"^第[{CN}\d]+[章节篇部分]", rf"^[{CN}]+[、．.]{SPACE}*\S+", rf"^[（(][{CN}\d]+[）)]{SPACE}*\S+")
LIST_MARKS = (
    r"^(?:[-*+•·◦‣])\s+\S", r"^(?:\(?\d{1,3}\)?[.)、]|[A-Za-z][.)])\s+\S", r"^(?:\([ivxlcdmIVXLCDM]{1,8}\)|[IVXLCDM]{2,8}[.)、]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+[、.)）])\s*\S",
    r"^(?:\[\d{1,3}\]|［\d{1,3}］|【\d{1,3}】|〔\d{1,3}〕)[、.]?\s*\S", r"^[（(]?\d{1,3}[）)][、.]?\s*\S", r"^[一二三四五六七八九十]+[、.)）]\s*\S", r"^[①②③④⑤⑥⑦⑧⑨⑩]\s*\S",
)
COVER_LABELS = {
    "学校编码": "school_code", "学位编码": "degree_code", "论文题目": "paper_title", "学生姓名": "student_name", "姓名": "student_name", "学号": "student_id", "所属学院": "college", "学院": "college",
    "专业班级": "class_name", "年级专业": "class_name", "专业": "class_name", "指导老师": "advisor", "指导教师": "advisor", "日期": "completion_date", "完成时间": "completion_date", "答辩时间": "completion_date",
}
EN_PROSE = ("shows", "show", "illustrates", "illustrate", "presents", "present", "describes", "describe", "summarizes", "summary", "lists", "reports", "indicates", "demonstrates")
FRONT_NAMES = {"cn_abstract": ("摘要", "中文摘要"), "en_abstract": ("ABSTRACT",), "cn_keywords": ("关键词", "关键字"), "en_keywords": ("KEYWORDS", "KEYWORD")}
SYNONYMS = {
    "references": ("参考文献", "References", "Reference"),
    "acknowledgement": ("致谢", "Acknowledgements", "Acknowledgments", "Acknowledgement", "Acknowledgment"),
    "appendix": ("附录", "Appendix", "Appendices"),
}
NOT_TITLES = ("cn_abstract", "cn_keywords", "en_abstract", "en_keywords", "references", "acknowledgement", "appendix")
BODY_NAME = "正文"


def is_reference_heading(x) -> Column:
    t = strip(x)
    return t.rlike(r"(?i)^references?(?![\p{L}\p{N}_])") | t.startswith("参考文献")


def is_numbered(x) -> Column:
    """A line that a heading's numbering opens."""
    return strip(x).rlike("|".join(NUMBERINGS))


def is_list_line(x) -> Column:
    return strip(clean(x)).rlike("|".join(LIST_MARKS))


def title_candidate(x) -> Column:
    """What may be a title: up to a wide bracket, on one line."""
    return F.regexp_replace(F.regexp_replace(strip(F.regexp_replace(col(x), "(?s)（.*$", "")), "\n", " "), "\r", "")


def _titles(t: Column) -> Column:
    return (F.length(t) >= 10) & (F.length(t) <= 120) & ~t.startswith("年") & ~t.startswith("本科") & ~is_numbered(t) & ~section_role(t, F.lit(1)).isin(*NOT_TITLES)


def is_title(x, size: Column, heading: Column) -> Column:
    """A title by its text and by type: 14 points or more, or a heading's style."""
    return let(title_candidate(x), _titles) & ((F.coalesce(size, F.lit(0.0)) >= 14) | F.coalesce(heading, F.lit(False)))


def is_plain_title(x) -> Column:
    """A title by its text alone; short names of institutions and lists are none."""
    return let(title_candidate(x), lambda t: _titles(t) & ~(t.rlike("学校|学院|大学|委员会|声明|授权|目录|参考文献") & (F.length(t) < 24)))


def is_date(x) -> Column:
    return compact(x).rlike(r"^\d{4}年\d{1,2}月\d{1,2}日$")


def cover_label(x) -> Column:
    return F.regexp_replace(col(x), rf"(?:{SPACE}|[：:])+", "")


def cover_key(x) -> Column:
    """The field that a label names: the first known label that contains it or is contained in it."""

    def found(t: Column) -> Column:
        rule = F.when(t == "", "")
        for label, key in COVER_LABELS.items():
            rule = rule.when(t.contains(label) | F.lit(label).contains(t), key)
        return rule.otherwise("")

    return let(cover_label(x), found)


def cover_field(x, refused: Column) -> Column:
    """struct(key, value) of a line `label: value`, both empty without a known label or a value; refused: values that
    don't count, from the value."""
    pattern = rf"(?s)^{SPACE}*(.{{1,16}}?){SPACE}*[：:]{SPACE}*(.+?){SPACE}*$"
    key, value = cover_key(F.regexp_extract(strip(x), pattern, 1)), clean(F.regexp_extract(strip(x), pattern, 2))
    good = (key != "") & (value != "") & ~refused(value)
    return F.struct(F.when(good, key).otherwise("").alias("key"), F.when(good, value).otherwise("").alias("value"))


#: Characters of a note in brackets at most (fixed value).
LONGEST_NOTE = 120


def without_instructions(x) -> Column:
    """Text without bracketed guidance of a template, however deep: a bracket goes if what it holds, once the guidance in
    it is gone, has no brackets left and is guidance.

    One pass over brackets and what stands between them keeps the open ones on a stack; each knows whether a bracket
    inside it stays. What is never closed stays, as does a bracket that closes nothing.
    """
    parts = F.regexp_extract_all(col(x), F.lit(r"([（(]|[）)]|[^（）()]+)"), F.lit(1))
    level = lambda text, kept: F.struct(text.alias("text"), kept.alias("kept"))
    base = F.array(level(F.lit(""), F.lit(False)))

    def step(stack: Column, part: Column) -> Column:
        top, rest = F.element_at(stack, -1), F.slice(stack, 1, F.size(stack) - 1)
        under = F.element_at(rest, -1)
        onto = lambda text, kept: F.concat(rest, F.array(level(F.concat(top["text"], text), kept)))
        content = F.substring(top["text"], 2, LONGEST_NOTE + 1)
        note = ~top["kept"] & F.length(content).between(1, LONGEST_NOTE) & is_instruction(content)
        joined = F.concat(F.slice(rest, 1, F.size(rest) - 1), F.array(level(F.concat(under["text"], top["text"], part), F.lit(True))))
        closed = F.when(note, rest).otherwise(joined)
        return F.when(part.rlike("^[（(]$"), F.concat(stack, F.array(level(part, F.lit(False))))).when(part.rlike("^[）)]$") & (F.size(stack) > 1), closed).otherwise(onto(part, top["kept"]))

    left = F.aggregate(parts, base, step, lambda stack: F.array_join(F.transform(stack, lambda s: s["text"]), ""))
    return strip(F.regexp_replace(left, rf"{SPACE}{{2,}}", " "))


def _caption(t: Column, label: str) -> Column:
    tail = F.regexp_replace(F.regexp_replace(t, label, ""), r"^[ \t:：.．、\-—]+|[ \t:：.．、\-—]+$", "")
    return t.rlike(label) & (tail != "") & ~F.lower(strip(tail)).rlike(f"^(?:{'|'.join((*PROSE, *EN_PROSE))})")


def checked_caption(x) -> Column:
    """figure_caption, table_caption or nothing; English and Chinese verbs after the number make it a sentence."""
    t = strip(x)
    number = r"\s*\d+(?:[.-]\d+)?"
    return F.when(_caption(t, rf"(?i)^(?:Fig\.|Figure|图){number}"), "figure_caption").when(_caption(t, rf"(?i)^(?:Table|表){number}"), "table_caption").otherwise("")


def front_role(x) -> Column:
    """The front matter that a heading names as a whole."""
    key = F.upper(cover_label(x))
    rule = F.when(F.lit(False), "")
    for role, names in FRONT_NAMES.items():
        rule = rule.when(key.isin(*names), role)
    return rule.otherwise("")


def back_role(heading, role=None) -> Column:
    """references, acknowledgement, appendix or nothing: the role given, else by the heading."""
    t, given = strip(heading), F.lower(strip(role)) if role is not None else F.lit("")
    return (
        F.when(given.isin(*SYNONYMS), given)
        .when(t.rlike("(?i)^references?$") | compact(t).startswith("参考文献"), "references")
        .when(t.rlike(ACKNOWLEDGEMENT) | t.rlike(rf"致{SPACE}*谢"), "acknowledgement")
        .when(t.rlike(APPENDIX) | t.rlike(rf"附{SPACE}*录"), "appendix")
        .otherwise("")
    )


def heading_names(heading, role=None) -> Column:
    """The heading and the other names of its back matter."""
    t = strip(heading)
    known = F.create_map(*[v for k, names in SYNONYMS.items() for v in (F.lit(k), F.array(*map(F.lit, names)))])
    none = F.expr("array()").cast("array<string>")
    return F.concat(F.when(t != "", F.array(t)).otherwise(none), F.coalesce(F.try_element_at(known, back_role(heading, role)), none))
