"""Plain-text formulas to LaTeX, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formula import LETTER, trailing_labels
from .text import col, let, squeeze, strip

#: Signs with a LaTeX form of their own (fixed values).
SIGNS = {"×": r"\times", "÷": r"\div", "≤": r"\leq", "≥": r"\geq", "≈": r"\approx", "≒": r"\approx", "％": r"\%", "%": r"\%", "²": "^{2}", "³": "^{3}", "（": "(", "）": ")", "，": ",", "。": ".", "：": "=", "＝": "=", "＋": "+", "－": "-"}


def escape(x) -> Column:
    t = F.replace(col(x), F.lit("\\"), F.lit("\\backslash "))
    return F.replace(F.replace(t, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))


def token(x: Column) -> Column:
    signs = F.create_map(*[F.lit(v) for pair in SIGNS.items() for v in pair])
    return (
        F.when(x.rlike("^[一-鿿]+$"), F.concat(F.lit("\\text{"), escape(x), F.lit("}"))).when(x.rlike("^[A-Za-z]+$"), F.concat(F.lit("\\mathrm{"), x, F.lit("}")))
        .otherwise(F.coalesce(F.try_element_at(signs, x), x))
    )


def expression(x) -> Column:
    """CJK runs as text, Latin runs upright, signs by their commands, blanks out."""
    tokens = F.regexp_extract_all(strip(x), F.lit(r"[一-鿿]+|[A-Za-z]+|\d+(?:,\d{3})*(?:\.\d+)?|[²³]|."), F.lit(0))
    return F.array_join(F.transform(F.filter(tokens, lambda t: ~t.rlike(r"^\s$")), token), "")


def numbered(x) -> Column:
    """struct(body, label): an equation and its last number, dots as hyphens; an empty label where nothing numbers it."""

    def rules(p: Column) -> Column:
        body, labels = p["body"], p["labels"]
        one = (F.size(labels) == 1) & (body.rlike(f"[{LETTER}]$") | ~(body.rlike("[=＝≈≤≥<>]") & body.rlike(r"\d|[+*/×÷%·]")))
        label = F.translate(F.regexp_replace(F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("")), r"\s+", ""), ".", "-")
        made = lambda a, b: F.struct(a.alias("body"), b.alias("label"))
        return F.when((body == "") | (F.size(labels) == 0) | one, made(strip(x), F.lit(""))).otherwise(made(body, label))

    return let(trailing_labels(x), rules)


def colon_split(x) -> Column:
    """struct(left, right) of a name, a colon and something like math; an empty left else."""
    t = strip(x)
    left, right = (strip(F.regexp_extract(t, r"(?s)^([^：:]*)[：:](.*)$", i)) for i in (1, 2))
    good = (left != "") & (right != "") & right.rlike(r"\d|[=＝+\-*/×÷]")
    return F.when(good, F.struct(left.alias("left"), right.alias("right"))).otherwise(F.struct(F.lit("").alias("left"), t.alias("right")))


def linear(x) -> Column:
    """Without the marks of exponents and indices."""
    t = F.regexp_replace(F.regexp_replace(col(x), r"[\^_]\s*\{([^{}]+)\}", "$1"), r"[\^_]\s*([A-Za-z0-9+\-=]+)", "$1")
    return F.regexp_replace(t, "[{}]", "")


def chapter(x) -> Column:
    """The number of a chapter's heading, 1 to 10 in Chinese numerals."""
    t = strip(x)
    numerals = F.create_map(*[F.lit(v) for i, c in enumerate("一二三四五六七八九十") for v in (c, i + 1)])
    first = F.nullif(F.regexp_extract(t, r"^第(\d+)章", 1), F.lit("")).cast("int")
    return F.coalesce(first, F.try_element_at(numerals, F.regexp_extract(t, "^第([一二三四五六七八九十])章", 1)), F.nullif(F.regexp_extract(t, r"^(\d+)(?:\.|\s)", 1), F.lit("")).cast("int"))


def reference(x) -> Column:
    """A reference without its number."""
    t = squeeze(x)
    bracket, point = r"^\[\d+\]\s*(.*)$", r"^[.、\[\]]*\d+[.、\[\]]*\s+(\S.*)$"
    return F.when(t.rlike(bracket), F.regexp_extract(t, bracket, 1)).when(t.rlike(point), F.regexp_extract(t, point, 1)).otherwise(t)


def runs(x) -> Column:
    """Pieces of CJK and of other characters, in order."""
    return F.regexp_extract_all(col(x), F.lit("[一-鿿]+|[^一-鿿]+"), F.lit(0))


def citation_runs(x) -> Column:
    """struct(text, citation) pieces of a text: `[n, n-m]` marks and what stands between."""
    mark = r"\[\d+(?:\s*[-,–]\s*\d+)*\]"
    pieces = F.regexp_extract_all(col(x), F.lit(rf"{mark}|(?:(?!{mark})[\s\S])+"), F.lit(0))
    return F.transform(pieces, lambda p: F.struct(p.alias("text"), p.rlike(f"^{mark}$").alias("citation")))
