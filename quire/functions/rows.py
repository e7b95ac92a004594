"""Tables as columns: rows of cells (array<array<string>>) and widths (array<int>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .structure import CHAPTER
from .text import SPACE, clean, let, strip

#: First words of a line of device configuration (fixed values).
COMMANDS = (
    "interface", "vlan", "ip route", "ip address", "router", "switchport", "acl", "rule", "nat", "dhcp", "dns", "ospf", "bgp", "display", "show", "ping", "tracert", "undo", "quit", "return", "sysname", "description",
    "gateway", "firewall", "security-policy",
)
#: Characters of a line of a cell, and bounds on rows that stay together (fixed values).
LINE_CHARS, LEAST_WIDTH = 14, 120
_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_CODE = "|".join((r"^[A-Za-z0-9_.-]+[>#]", rf"(?i:^(?:{'|'.join(COMMANDS)})(?![\p{{L}}\p{{N}}_]))", rf"(?s:^(?=.*[/._-])[a-z][a-z0-9_-]+{SPACE}+[-A-Za-z0-9_/.:]+)"))


def is_code_line(x, most: int = 220) -> Column:
    """A prompt, a command of a device, or a name with a path-like argument."""
    return let(strip(x), lambda t: (t != "") & (F.length(t) <= most) & t.rlike(_CODE))


def cell_lines(rows: Column) -> Column:
    """All lines of all cells that aren't blank, stripped."""
    parts = F.flatten(F.transform(F.flatten(rows), lambda c: F.split(F.coalesce(c, F.lit("")), _BREAK, -1)))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def shape(rows: Column) -> Column:
    """struct(rows, columns): how many rows there are and the cells of the longest."""
    return F.struct(F.size(rows).alias("rows"), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)).alias("columns"))


def _code(rows: Column, most: int, rules) -> Column:
    """rules(rows, columns, lines, hits) over the shape of rows and their lines of code."""
    at = lambda s: rules(s["rows"], s["columns"], s["lines"], s["hits"])
    made = lambda lines: F.struct(shape(rows)["rows"].alias("rows"), shape(rows)["columns"].alias("columns"), F.size(lines).alias("lines"), F.size(F.filter(lines, lambda s: is_code_line(s, most))).alias("hits"))
    return let(let(cell_lines(rows), made), at)


def _third(n: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(n / 3))


def are_code(rows: Column) -> Column:
    """Rows of one column with two lines of code, or of two at most with a third of at least four lines."""
    return _code(rows, 220, lambda r, c, n, hits: ((c <= 1) & (n >= 2) & (hits >= 2)) | ((c <= 2) & (n >= 4) & (hits >= _third(n))))


def render_as_code(rows: Column) -> Column:
    """The renderer's rule: four rows or more decide by a third of the lines, one column by two lines."""
    return _code(rows, 240, lambda r, c, n, hits: F.when(n == 0, False).when((r >= 4) & (c <= 2), hits >= _third(n)).otherwise((c == 1) & (n >= 2) & (hits >= 2)))


def code_text(rows: Column) -> Column:
    """Rows as lines, cells parted by four blanks."""
    end = rf"{SPACE}+$"
    line = lambda row: F.regexp_replace(F.array_join(F.transform(row, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), end, "")), "    "), end, "")
    return strip(F.array_join(F.transform(rows, line), "\n"))


def without_number(x) -> Column:
    """A title without its chapter or dotted number."""
    t = F.regexp_replace(strip(x), rf"^{CHAPTER}{SPACE}*", "")
    return strip(F.regexp_replace(t, rf"^\d+(?:\.\d+)*{SPACE}*", ""))


def is_title(x) -> Column:
    """A short line that can be a table's title: no numbered heading, caption or sentence."""
    raw = strip(clean(x))
    t = without_number(raw)
    no = (r"^(?:图|表)\s*\d+|^代码\s*\d+", r"[。！？；;=<>]|[.!?]$|如下|所示")
    return (t != "") & (F.length(t) <= 50) & ~raw.rlike(rf"^\d+(?:\.\d+)+(?:[.)、．。]{SPACE}*|{SPACE}+)\S") & ~t.rlike("|".join(no))


def row_lines(row: Column) -> Column:
    """How many lines the tallest cell of a row takes."""
    cell = lambda c: F.aggregate(F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), lambda p: F.greatest(F.lit(1), F.ceil(F.length(p) / LINE_CHARS)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.coalesce(F.greatest(F.lit(1).cast("long"), F.array_max(F.transform(row, cell))), F.lit(1).cast("long"))


def keeps_row_whole(row: Column, header=None) -> Column:
    """A header, or a row of twelve lines at most without a cell over 420 characters."""
    short = ~F.exists(row, lambda c: F.length(F.coalesce(c, F.lit(""))) > 420) & (row_lines(row) <= 12)
    return short if header is None else header | short


def keeps_together(rows: Column) -> Column:
    """A table of ten rows at most, 18 lines, and no cell over 90 characters."""
    lines = F.aggregate(F.transform(rows, row_lines), F.lit(0).cast("long"), lambda a, b: a + b)
    return (F.size(rows) > 0) & (F.size(rows) <= 10) & ~F.exists(F.flatten(rows), lambda c: F.length(F.coalesce(c, F.lit(""))) > 90) & (lines <= 18)


def repeats_first_row(rows: Column, columns: Column, nested=None, rich=None) -> Column:
    """A table of its own with over twelve rows and several columns, whose first row is plain and three lines at most."""
    no = lambda x: F.lit(False) if x is None else F.coalesce(x, F.lit(False))
    return ~no(nested) & ~no(rich) & (F.size(rows) > 12) & (columns > 1) & (row_lines(F.get(rows, 0)) <= 3)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def _sized(widths: Column, n: Column) -> Column:
    return F.slice(F.concat(F.transform(widths, lambda w: F.coalesce(w, F.lit(0)).cast("long")), F.array_repeat(F.lit(0).cast("long"), F.greatest(n, F.lit(0)))), 1, F.greatest(n, F.lit(0)))


def fitted_widths(widths: Column, n: Column, most: Column, least: int | None = None) -> Column:
    """`n` column widths within `most` together: missing ones get the mean (120 at least), a sum over `most` is scaled with a
    least width, and what is still over comes off the widest, the first of equals; none if no width is positive.

    least: that width, whatever the number of columns; None: 120, or an equal share where 120 is too much for so many."""
    none = F.expr("array()").cast("array<long>")

    def shaved(w: Column) -> Column:
        over = F.greatest(_sum(w) - most, F.lit(0).cast("long"))
        # The widest gives all but 1, then the next: each is reduced by what those before it in this order leave over.
        before = lambda x, i: _sum(F.transform(F.filter(F.transform(w, lambda y, j: F.struct(y.alias("y"), j.alias("j"))), lambda o: (o["y"] > x) | ((o["y"] == x) & (o["j"] < i))), lambda o: o["y"] - 1))
        return F.transform(w, lambda x, i: x - F.least(F.greatest(over - before(x, i), F.lit(0).cast("long")), F.greatest(x - 1, F.lit(0).cast("long"))))

    def scaled(w: Column) -> Column:
        usual = F.when(n * LEAST_WIDTH > most, F.greatest(F.lit(1).cast("long"), F.floor(most / n))).otherwise(F.lit(LEAST_WIDTH).cast("long"))
        floor = usual if least is None else F.lit(least).cast("long")
        share = most / _sum(w)
        return F.when((most <= 0) | (_sum(w) <= most), w).otherwise(let(F.transform(w, lambda x: F.greatest(floor, F.floor(x * share))), shaved))

    def filled(w: Column) -> Column:
        given = F.filter(w, lambda x: x > 0)
        usual = F.greatest(F.lit(LEAST_WIDTH).cast("long"), F.floor(_sum(given) / F.size(given)))
        return F.when(F.size(given) == 0, none).otherwise(let(F.transform(w, lambda x: F.when(x > 0, x).otherwise(usual)), scaled))

    return let(F.transform(_sized(widths, n), lambda x: F.greatest(x, F.lit(0).cast("long"))), filled)


def given_widths(widths: Column, n: Column) -> Column:
    """Widths padded or cut to `n`; none if none is positive."""
    return let(_sized(widths, n), lambda w: F.when(F.exists(w, lambda x: x > 0), w).otherwise(F.expr("array()").cast("array<long>")))


def repaired_widths(grid: Column, fallback: Column, n: Column) -> Column:
    """The grid's widths with zeros taken from the fallback row, or else the mean of all that are positive."""

    def made(g: Column) -> Column:
        f = given_widths(fallback, n)
        positive = F.filter(F.concat(f, g), lambda x: x > 0)
        usual = F.greatest(F.lit(1).cast("long"), F.floor(_sum(positive) / F.size(positive)))
        return F.when(F.size(g) == 0, f).otherwise(F.transform(g, lambda x, i: F.when(x > 0, x).when(F.coalesce(F.get(f, i), F.lit(0)) > 0, F.get(f, i)).otherwise(usual)))

    return let(given_widths(grid, n), made)


def widest_row(rows: Column, n: Column) -> Column:
    """The widths of the row with the most positive ones, `n` of them being enough; the first of equals."""
    count = lambda r: F.least(F.size(F.filter(r, lambda w: w > 0)), n)
    best = F.array_max(F.transform(rows, count))
    row = F.get(F.filter(rows, lambda r: count(r) == best), 0)
    return F.when(F.coalesce(best, F.lit(0)) > 0, F.slice(row, 1, F.greatest(n, F.lit(0)))).otherwise(F.slice(row, 1, 0))
