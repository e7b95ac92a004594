"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and as a class of Java patterns. Single signs below 256 are one table there, and ranges few:
#: a class of many parts asks each part at each character.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Labels that clipboards leave behind (fixed values).
NOISE = ("复制", "Copy", "Plain Text", "纯文本")


def col(x) -> Column:
    """A column of text; null is the empty text."""
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it: as the variable of a lambda it is no repeated
    subexpression, which keeps long rule chains within the limits of generated code."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(x) -> Column:
    return F.btrim(col(x), F.lit(SPACES))


def squeeze(x, by: str = " ") -> Column:
    """White space runs to one blank, ends stripped."""
    return strip(F.regexp_replace(col(x), rf"{SPACE}+", by))


def compact(x) -> Column:
    """Without white space."""
    return F.regexp_replace(col(x), rf"{SPACE}+", "")


def compact_upper(x) -> Column:
    return F.upper(compact(x))


def unlink(x) -> Column:
    """[label](target) to its label, or to the target where the label is blank."""
    blank = F.regexp_replace(col(x), rf"\[{SPACE}+\]\({SPACE}*([^)]+?){SPACE}*\)", "$1")
    return F.regexp_replace(blank, rf"\[{SPACE}*([^\]]+?){SPACE}*\]\(([^)]+)\)", "$1")


def clean(x) -> Column:
    """Links to labels, white space squeezed; a clipboard label is empty."""
    value = squeeze(unlink(x))
    return F.when(value.isin(*NOISE), "").otherwise(value)


def clean_lines(x) -> Column:
    """The same line by line: clipboard labels go, line ends stay (also for code)."""
    value = F.regexp_replace(F.translate(unlink(x), "\u00a0", " "), "\r\n?", "\n")
    lines = F.transform(F.split(value, "\n", -1), lambda s: strip(F.regexp_replace(s, r"[ \t]+", " ")))
    return strip(F.array_join(F.filter(lines, lambda s: ~s.isin(*NOISE)), "\n"))


def ascii_letter_ratio(x) -> Column:
    return F.when(F.length(col(x)) == 0, 0.0).otherwise(F.regexp_count(col(x), F.lit("[A-Za-z]")) / F.length(col(x)))


def word_count(x) -> Column:
    """CJK characters and Latin words."""
    return F.regexp_count(col(x), F.lit(r"[一-鿿]")) + F.regexp_count(col(x), F.lit(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"))


def cjk_count(x) -> Column:
    return F.regexp_count(col(x), F.lit(r"[一-鿿]"))


def path_label(x, roots: dict[str, str]) -> Column:
    """Slashes forward, the given roots to <LABEL>, other Windows drives to <ABS_PATH>/ and the last two parts."""
    value = F.translate(col(x), "\\", "/")
    for root, label in roots.items():
        value = F.replace(value, F.lit(root), F.lit(f"<{label}>"))
    return F.regexp_replace(value, r"(?i)\b[a-z]:/(?:[^/\s]+/)*?([^/\s]+/[^/\s]+|[^/\s]+)(?=\s|$)", "<ABS_PATH>/$1")


def digest(x, chars: int = 16) -> Column:
    """The first hex digits of SHA-256."""
    return F.substring(F.sha2(col(x).cast("binary"), 256), 1, chars)


def hamming_hex(a, b) -> Column:
    """Differing bits of two 16-digit hex strings; 999 if either isn't one. Halves keep clear of the sign."""
    a, b = col(a), col(b)
    half = lambda s, i: F.conv(F.substring(s, i, 8), 16, 10).cast("long")
    good = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    return F.when(good, F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))).otherwise(999).cast("int")


def half_point(x) -> Column:
    """Rounded to halves, ties to even."""
    return F.bround(F.col(x) * 2) / 2


def twips(x, per_unit: float) -> Column:
    """Lengths to twips, ties to even: 1440 / 2.54 for cm, 20 for points."""
    return F.bround(F.col(x) * F.lit(per_unit)).cast("int")
