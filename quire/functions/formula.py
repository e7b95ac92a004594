"""Formulas in text: classes, labels and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cjk_count, col, let, squeeze, strip

#: Wide and typographic signs, and what they are read as (fixed values).
WIDE = "＝＋－−＊×·／÷＜＞％（），。：；"
PLAIN = "=+--***//<>%(),.:;"

#: Fixed patterns of the classes.
CITATION = r"^\s*(?:\[\d+(?:[-,\s–—]\d+)*\]|\(\d{4}[a-z]?\))\s*$"
LABEL = r"^\s*[\(（]\s*\d+(?:\s*[-.]\s*\d+)?\s*[\)）]\s*$"
RELATION = r"[=<>≤≥≠≈∼∝∈∉]"
OPERATOR = r"[+\-*/%∑∏∫√^_]"
SENTENCE = r"[.;!?；！？]"
NARRATIVE = "对应|约束|当.+时|无法|低于|约为|角度|模式|收入|成本|产量|开机|结果|表明|分析|选择"
UNIT = (
    r"(?i)\b(?:kw|mw|gw|kwh|mwh|gwh|v|kv|a|ma|hz|khz|mhz|w|j|kj|mj|n|pa|kpa|mpa|kg|g|mg|t|ton|h|min|s|ms|m|cm|mm|km|m2|m3|m\^2|m\^3|yuan|rmb|usd|cny)\b"
    r"|[%℃元万元吨日年月周小时]"
)
DELIMITED = r"(?s)^\s*\${1,2}.+\${1,2}\s*$"
LETTER = "A-Za-zͰ-Ͽ"
_BODY = r"(?:\d+(?:\s*[-.]\s*\d+)?|[A-Za-z]\s*(?:[-.]\s*)?\d+(?:\s*[-.]\s*\d+)?)"
TRAILING = rf"((?:\s*[\(（]\s*{_BODY}\s*[\)）])+\s*)$"
ONE_LABEL = rf"[\(（]\s*({_BODY})\s*[\)）]"


def normalize(x) -> Column:
    """Wide signs as plain ones, white space squeezed; text in ASCII has none of the former."""
    return squeeze(F.when(col(x).rlike(r"[^\x00-\x7f]"), F.translate(col(x), WIDE, PLAIN)).otherwise(col(x)))


def is_citation(x) -> Column:
    return strip(x).rlike(CITATION)


def is_label(x) -> Column:
    return strip(x).rlike(LABEL)


def has_relation(x) -> Column:
    return normalize(x).rlike(RELATION)


def has_operator(x) -> Column:
    return normalize(x).rlike(OPERATOR)


# The rules below take normalized text, and are wrapped for any text further down.


def _quantity(t: Column) -> Column:
    return t.rlike(r"\d") & ~t.rlike(RELATION) & (~t.rlike(OPERATOR) | t.rlike(r"\d\s*-\s*\d")) & t.rlike(UNIT)


def _contaminated(t: Column) -> Column:
    # Lengths are asked first: each way asks for more than 30 characters.
    n, cjk, mark = F.length(t), cjk_count(t), t.rlike(SENTENCE)
    signal = t.rlike(RELATION) | t.rlike(rf"[{LETTER}][A-Za-z0-9_Ͱ-Ͽ]*\s*\(")
    return (n > 30) & (cjk >= 4) & signal & t.rlike(r"\d") & ((mark & t.rlike(NARRATIVE)) | ((n > 70) & (cjk > 12) & mark) | ((n > 90) & (cjk > 18)))


def _apart(t: Column) -> Column:
    return t.rlike(CITATION) | t.rlike(LABEL) | _quantity(t)


def _counted(t: Column) -> Column:
    return t.rlike(r"\d") & t.rlike(RELATION) & t.rlike(OPERATOR)


def _numbered(t: Column) -> Column:
    return _counted(t) & ~_contaminated(t)


def _equation(t: Column) -> Column:
    """What is left to ask of a text that is no other class, is not delimited and not contaminated."""
    equation = (t.rlike(r"^[=<>]") & t.rlike(r"\d")) | (t.rlike(RELATION) & (t.rlike(OPERATOR) | t.rlike(r"\d")))
    return (F.length(t) <= 180) & equation & ~(((cjk_count(t) > 3) & t.rlike(SENTENCE)) | (cjk_count(t) > 8))


def _formula(t: Column, raw: Column) -> Column:
    return (t != "") & (F.length(t) <= 180) & ~_apart(t) & (raw.rlike(DELIMITED) | (_equation(t) & ~_contaminated(t)))


def is_quantity(x) -> Column:
    return let(normalize(x), _quantity)


def is_contaminated(x) -> Column:
    """Narrative text with signs of a formula in it."""
    return let(normalize(x), _contaminated)


def should_number(x) -> Column:
    return let(normalize(x), _numbered)


def looks_like_formula(x) -> Column:
    return let(normalize(x), lambda t: _formula(t, strip(x)))


def classify(x) -> Column:
    """struct(category, confidence, reason, should_number); the first class that fits counts."""
    none = F.lit(False)

    def made(category: str, confidence: float, reason: str, number=none):
        return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"), number.alias("should_number"))

    def rules(t: Column) -> Column:
        return (
            F.when(t == "", made("TEXT", 1.0, "empty"))
            .when(t.rlike(CITATION), made("CITATION", 0.98, "citation"))
            .when(t.rlike(LABEL), made("FORMULA_LABEL", 0.98, "label"))
            .when(_contaminated(t), made("CONTAMINATED", 0.92, "prose with signs"))
            .when(_quantity(t), made("QUANTITY_TEXT", 0.86, "number and unit"))
            .when(strip(x).rlike(DELIMITED), made("DISPLAY_MATH", 0.96, "dollars", _counted(t)))
            .when(_equation(t), made("DISPLAY_MATH", 0.88, "equation", _counted(t)))
            .otherwise(made("TEXT", 0.74, "text"))
        )

    return let(normalize(x), rules)


def _balanced(t: Column) -> Column:
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return (count("(") == count(")")) & (count("{") == count("}")) & (count("[") == count("]"))


def valid_equation_span(x) -> Column:
    """Whether a piece of prose can be inline math without delimiters."""

    def rules(t: Column) -> Column:
        return _equation_span(t, x, ~_apart(t) & ~_contaminated(t))

    return let(normalize(x), rules)


def _equation_span(t: Column, x, free: Column) -> Column:
    sides = F.split(t, r"<=|>=|=|<|>|≤|≥|≈|≠", 2)
    lettered = (F.size(sides) == 2) & F.forall(sides, lambda s: s.rlike(f"[{LETTER}]"))
    whole = (t != "") & (F.length(t) <= 140) & free & (cjk_count(t) == 0) & _balanced(t)
    return whole & ~col(x).rlike(r"[。，；：,;]|\s[一-鿿]") & t.rlike(RELATION) & (t.rlike(OPERATOR) | t.rlike(r"\d") | lettered)


def valid_dollar_span(x) -> Column:
    """Whether text between dollars is math."""

    return let(normalize(x), lambda t: _dollar_span(t, ~_apart(t)))


def _dollar_span(t: Column, free: Column) -> Column:
    mark = t.rlike(r"\\[A-Za-z]+|[_^=<>≤≥≈≠+\-*/%∑∫√]")
    name = t.rlike(rf"^[{LETTER}][A-Za-z0-9Ͱ-Ͽ]*(?:\([A-Za-z0-9]+\))?$")
    return (t != "") & (F.length(t) <= 120) & free & (cjk_count(t) == 0) & _balanced(t) & (mark | name)


def tests(x) -> Column:
    """struct(quantity, contaminated, looks_like, equation_span, dollar_span): the tests of these names, for which a text is
    made plain, and held against the other classes, once."""

    def rules(t: Column) -> Column:
        known = F.struct(_quantity(t).alias("quantity"), _contaminated(t).alias("contaminated"), (t.rlike(CITATION) | t.rlike(LABEL)).alias("mark"))
        return let(known, lambda k: held(t, k))

    def held(t: Column, k: Column) -> Column:
        free, bare = ~(k["mark"] | k["quantity"]), ~k["contaminated"]
        like = (t != "") & (F.length(t) <= 180) & free & (strip(x).rlike(DELIMITED) | (bare & _equation(t)))
        return F.struct(k["quantity"].alias("quantity"), k["contaminated"].alias("contaminated"), like.alias("looks_like"), _equation_span(t, x, free & bare).alias("equation_span"), _dollar_span(t, free).alias("dollar_span"))

    return let(normalize(x), rules)


def trailing_labels(x) -> Column:
    """struct(body, labels): the numbers in brackets at the end, apart from the rest."""
    t = strip(x)
    tail = F.when(t.endswith(")") | t.endswith("）"), F.regexp_extract(t, TRAILING, 1)).otherwise("")
    body = F.when(tail != "", strip(F.regexp_replace(t, TRAILING, ""))).otherwise(t)
    return F.struct(body.alias("body"), F.regexp_extract_all(tail, F.lit(ONE_LABEL), F.lit(1)).alias("labels"))


def without_labels(x) -> Column:
    """The body, where the brackets at the end number an equation; f(1) stays."""
    parts = trailing_labels(x)
    body, labels = parts["body"], parts["labels"]
    relation = body.rlike(r"[=＝≈≤≥<>]") & body.rlike(r"\d|[+*/×÷%·]")
    numbers = (body != "") & (F.size(labels) > 0) & ((F.size(labels) >= 2) | (~body.rlike(f"[{LETTER}]$") & relation))
    return F.when(numbers, body).otherwise(strip(x))
