"""Formulas that were split or mixed with prose: pieces and their LaTeX, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formula import _contaminated, normalize, trailing_labels
from .text import SPACE, cjk_count, clean, col, compact, let, squeeze, strip

#: Characters and names (fixed values).
PIECE = r"^[A-Za-z0-9_\s∆ΔλΛµμ%+\-*/·×÷=<>≤≥≈∈∑().,α-ωΑ-Ω]+$"
GREEK = {"∆": r"\Delta", "Δ": r"\Delta", "λ": r"\lambda", "Λ": r"\Lambda", "μ": r"\mu", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma"}
RELATIONS = "[=<>≤≥≠≈∈∉]"


def tidied(x) -> Column:
    """A formula's text without clipboard labels, and without bars if there are three or more."""
    t = clean(x)
    return squeeze(F.when(F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))) >= 3, F.replace(t, F.lit("|"), F.lit(""))).otherwise(t))


def delimited(x) -> Column:
    """What stands between dollars, an equation number behind them apart; empty without dollars."""
    inner = lambda t: F.when(t.rlike(r"(?s)^\$\$.*\$\$$") & (F.length(t) >= 4), strip(F.substring(t, F.lit(3), F.length(t) - 4))).when(t.rlike(r"(?s)^\$.*\$$") & (F.length(t) >= 2), strip(F.substring(t, F.lit(2), F.length(t) - 2)))
    p = trailing_labels(x)
    return F.coalesce(F.when(F.size(p["labels"]) > 0, inner(p["body"])), inner(strip(x)), F.lit(""))


def percentage(x) -> Column:
    """struct(body, percent): a right side without its factor of 100%."""
    t = strip(x)
    tail = r"(?:[×x*]\s*100\s*%|\\times\s*100\s*%)$"
    return F.struct(F.when(t.rlike(tail), strip(F.regexp_replace(t, tail, ""))).otherwise(t).alias("body"), t.rlike(tail).alias("percent"))


def prose_tail(x) -> Column:
    """struct(formula, tail): a text cut before its first CJK character, with the bracket that opens there."""
    pattern = r"(?s)^(.*?)((?:[（(])?[一-鿿].*)$"
    return let(strip(x), lambda t: F.struct(
        F.when(t.rlike(pattern), F.regexp_replace(strip(F.regexp_extract(t, pattern, 1)), "[，,。;；]+$", "")).otherwise(t).alias("formula"), F.when(t.rlike(pattern), strip(F.regexp_extract(t, pattern, 2))).otherwise("").alias("tail")))


def sum_start(x) -> Column:
    """`i=1` if one letter only is an index in the text, f(i) or x_i; else null."""
    letters = F.array_distinct(F.concat(*[F.regexp_extract_all(col(x), F.lit(p), F.lit(1)) for p in (r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]*\s*\(\s*([A-Za-z])\s*\)", r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]*\s*_\s*([A-Za-z])(?![A-Za-z0-9_])")]))
    return F.when(F.size(letters) == 1, F.concat(letters[0], F.lit("=1")))


def identifier(x) -> Column:
    """A name as LaTeX: Greek letters by name, further characters as an upright index; a delta stands before its name."""
    names = F.create_map(*[F.lit(v) for pair in GREEK.items() for v in pair])

    def one(t: Column) -> Column:
        return F.when((F.length(t) > 1) & t.rlike("^[A-Za-z][A-Za-z0-9]*$"), F.concat(F.substring(t, 1, 1), F.lit(r"_{\mathrm{"), F.substring(t, 2, 1 << 20), F.lit("}}"))).otherwise(t)

    def rules(t: Column) -> Column:
        head, rest = F.substring(t, 1, 1), F.substring(t, 2, 1 << 20)
        return (
            F.when(F.try_element_at(names, t).isNotNull(), F.try_element_at(names, t))
            .when(t.rlike("^[∆Δ][A-Za-z0-9]+$"), F.concat(F.lit("\\Delta "), one(rest)))
            .when(t.rlike("^[λΛμ][A-Za-z0-9]+$"), F.concat(F.try_element_at(names, head), F.lit(r"_{\mathrm{"), rest, F.lit("}}")))
            .otherwise(one(t))
        )

    return let(compact(x), rules)


def is_piece(x) -> Column:
    """A scrap of a formula: 18 characters at most, of formulas' characters only."""
    t = strip(x)
    return (t != "") & (F.length(t) <= 18) & t.rlike(PIECE)


def is_variable(x) -> Column:
    return compact(x).rlike("^[a-zα-ω][A-Za-z0-9_α-ωΑ-Ω]*$")


def is_body(x) -> Column:
    """A formula's text that is a paragraph: by length, CJK characters, and words or marks of prose."""
    t, cjk, n = strip(x), cjk_count(strip(x)), F.length(strip(x))
    return (n > 220) | ((n > 35) & (cjk > 18) & t.rlike("表明|显示|说明|分析|结果|选择|问题|模型|成本|指标")) | ((n > 90) & (cjk > 20) & t.rlike(r"[。；;，,.]"))


def is_problem(x, has_spans: Column) -> Column:
    """Short, dense, formula-like text mixed with prose. has_spans: whether it holds inline math."""

    def rules(t: Column) -> Column:
        ends = col(x).rlike(rf"[。；;.]{SPACE}*$") & ~t.rlike(rf"{RELATIONS}\s*$")
        open_end = F.substring(t, -3, 3).rlike(RELATIONS)
        dense = (F.regexp_count(t, F.lit(r"[=<>+\-*/%≤≥≠≈∈∉]")) >= 3) & (cjk_count(t) <= 20) & (F.length(t) <= 150)
        return _contaminated(t) & (F.length(t) <= 180) & ~ends & ~has_spans & (open_end | dense)

    return let(normalize(x), rules)
