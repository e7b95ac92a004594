"""Matching of expected and rendered texts, spans of inline math, and the geometry of tables."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import deque
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import formula as R
from ..functions import template


def _compact(text: str | None) -> str:
    return re.sub(r"\s+", "", text or "").lower()


def _apart(df: DataFrame, place: str) -> DataFrame:
    """doc_id, place and text as columns of their own, so that both sides may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in ("doc_id", place, "text")]).toDF("doc_id", place, "text")


class _Places:
    """The rendered texts of one document in order, and which of them are used."""

    def __init__(self):
        self.ords, self.texts, self.equal = [], [], {}
        self.used, self.whole, self.starts = [], None, []

    def add(self, ord, text: str | None) -> None:
        if "\t" not in (text or ""):
            own = _compact(text)
            self.equal.setdefault(own, deque()).append(len(self.ords))
            self.ords.append(ord)
            self.texts.append(own)
            self.used.append(False)

    def take(self, text: str | None):
        """The ord of the first unused row with this text, else of one that contains it; None without one."""
        target = _compact(text)
        at = self._equal(target) if target else None
        at = self._holder(target) if target and at is None else at
        if at is None:
            return None
        self.used[at] = True
        return self.ords[at]

    def _equal(self, target: str) -> int | None:
        rows = self.equal.get(target, ())
        while rows:
            at = rows.popleft()
            if not self.used[at]:
                return at
        return None

    def _holder(self, target: str) -> int | None:
        # Texts without white space stand in one string, each on a line, so that no match crosses two of them.
        if self.whole is None:
            self.whole = "\n".join(self.texts)
            self.starts = list(accumulate((len(t) + 1 for t in self.texts[:-1]), initial=0))
        found = self.whole.find(target)
        while found >= 0:
            at = bisect_right(self.starts, found) - 1
            if not self.used[at]:
                return at
            found = self.whole.find(target, self.starts[at] + len(self.texts[at]))
        return None


def match_in_order(expected: DataFrame, rendered: DataFrame) -> DataFrame:
    """doc_id, ord and match: for each row of expected(doc_id, ord, text) in order, the ord of the first unused row of
    rendered(doc_id, ord, text) with the same text, else of one that contains it; none is used twice; null without one.

    White space and case don't count; rendered rows with a tab are listings and never match. The choice depends on the
    rows before, so a document's rows come to one task in order, the rendered ones first; a task holds the rendered rows of
    one document (its own rows only; documents are bounded by their files).
    """
    kind = expected.schema["doc_id"].dataType.simpleString()

    def run(batches):
        doc, places = None, _Places()
        for b in batches:
            out = []
            for d, asks, o, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "asks", "ord", "text")), strict=True):
                if d != doc:
                    doc, places = d, _Places()
                if asks:
                    out.append((d, o, places.take(t)))
                else:
                    places.add(o, t)
            if out:
                own, ords, found = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(own, b.schema.field("doc_id").type), pa.array(ords, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "ord", "match"])

    both = _apart(rendered, "ord").withColumn("asks", F.lit(False)).unionByName(_apart(expected, "ord").withColumn("asks", F.lit(True)))
    both = both.repartition("doc_id").sortWithinPartitions("doc_id", "asks", F.col("ord").asc_nulls_last())
    return both.mapInArrow(run, f"doc_id {kind}, ord long, match long")


class _Pages:
    """The pages of one document in order, and the first on which its next entry may stand."""

    def __init__(self, contents: str, loose: int):
        self.contents, self.loose = contents, loose
        self.texts, self.whole, self.starts = [], None, []
        self.body, self.low = None, 0

    def add(self, text: str | None) -> None:
        self.texts.append(_compact(text))

    def take(self, text: str | None) -> int | None:
        """The page of the document's next entry, counted from the body's first; None without one."""
        key = _compact(text)
        if self.whole is None:  # the first entry: all pages are there
            # Pages without white space stand in one string, each on a line, so that no match crosses two of them.
            self.whole = "\n".join(self.texts)
            self.starts = list(accumulate((len(t) + 1 for t in self.texts[:-1]), initial=0))
            behind = max((i for i, t in enumerate(self.texts) if self.contents in t), default=0) + 1
            self.body = self.low = self._first(key, behind)
        if self.body is None or not key:
            return None
        found = self._first(key, self.low)
        if found is None:
            found = self._first(re.sub("[^0-9a-zA-Z一-鿿]+", "", key)[: self.loose], self.low)
        if found is None:
            return None
        self.low = found
        return found - self.body + 1

    def _first(self, key: str, low: int) -> int | None:
        at = self.whole.find(key, self.starts[low]) if key and low < len(self.texts) else -1
        return bisect_right(self.starts, at) - 1 if at >= 0 else None


def forward_pages(entries: DataFrame, pages: DataFrame, contents: str = "目录", loose: int = 16) -> DataFrame:
    """doc_id, ord and page: each entry(doc_id, ord, text) in order on the first page(doc_id, page, text), not before its
    predecessor's, that contains it, counted from the page where the body starts.

    The body starts behind the last page that contains `contents` (behind the first page if none does), on the first page
    with the first entry; without one there are no pages. An entry that isn't found is sought once more by its letters and
    digits, the first `loose` of them. White space and case don't count. The lower bound runs along, so a document's rows
    come to one task in order, its pages first; a task holds the pages of one document.
    """
    kind = entries.schema["doc_id"].dataType.simpleString()

    def run(batches):
        doc, held = None, _Pages(contents, loose)
        for b in batches:
            out = []
            for d, asks, p, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "asks", "place", "text")), strict=True):
                if d != doc:
                    doc, held = d, _Pages(contents, loose)
                if asks:
                    out.append((d, p, held.take(t)))
                else:
                    held.add(t)
            if out:
                own, ords, found = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(own, b.schema.field("doc_id").type), pa.array(ords, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "ord", "page"])

    both = _apart(pages, "page").withColumnRenamed("page", "place").withColumn("asks", F.lit(False))
    both = both.unionByName(_apart(entries, "ord").withColumnRenamed("ord", "place").withColumn("asks", F.lit(True)))
    both = both.repartition("doc_id").sortWithinPartitions("doc_id", "asks", F.col("place").asc_nulls_last())
    return both.mapInArrow(run, f"doc_id {kind}, ord long, page long")


class Grammar(NamedTuple):
    """One sort of inline math: where it may stand, and what its text, made plain, must match and must not match."""

    kind: str
    pattern: re.Pattern
    longest: int
    wants: tuple[re.Pattern, ...]
    not_raw: re.Pattern | None = None
    mixed: bool = False  # narrative text is refused
    brackets: bool = False  # closing brackets too many at the end are no part of it


_SIGN = "<=|>=|[=<>≤≥≈≠]"
#: In order of precedence (fixed values: patterns and bounds).
GRAMMARS = (
    Grammar(
        "dollar", re.compile(r"(?<!\$)\$(?!\$)(?P<math>[^$\n]{1,120})(?<!\$)\$(?!\$)"), 120,
        (re.compile(rf"\\[A-Za-z]+|[_^]|[=<>]|≤|≥|≈|≠|[+\-*/%]|∑|∫|√|^[{R.LETTER}][A-Za-z0-9Ͱ-Ͽ]*(?:\([A-Za-z0-9]+\))?$"),),
    ),
    Grammar(
        "equation", re.compile(rf"(?<![A-Za-z0-9_])(?P<math>[{R.LETTER}][A-Za-z0-9_Ͱ-Ͽ]*+(?:\s*+\([^,;\n。，；：]{{0,40}}\))?\s*+(?:{_SIGN})\s*[^,;\n。，；：]{{1,100}})"), 140,
        (re.compile(R.RELATION), re.compile(rf"{R.OPERATOR}|\d|^[^=<>≤≥≈≠]*[{R.LETTER}][^=<>≤≥≈≠]*(?:{_SIGN}).*[{R.LETTER}]")),
        re.compile(r"[。，；：,;]"), True, True,
    ),
)
_WIDE = str.maketrans(R.WIDE, R.PLAIN)
_MARK, _CJK = re.compile(f"{R.CITATION}|{R.LABEL}"), re.compile("[一-鿿]")
_QUANTITY = re.compile(rf"(?=.*\d)(?!.*(?:{R.RELATION}))(?:(?!.*(?:{R.OPERATOR}))|(?=.*\d\s*-\s*\d))(?=.*(?:{R.UNIT.replace('(?i)', '')}))", re.I | re.S)
_RELATION = re.compile(R.RELATION)
_DISPLAYED = re.compile(r"(?s)\s*\$\$.+\$\$\s*$")
#: What a text must hold for each sort of span; no normal form makes these signs out of others.
NEEDED = {"dollar": r"\$[^$]*\$", "equation": "[<=>≤≥≈≠]"}
_NEEDED = {kind: re.compile(pattern) for kind, pattern in NEEDED.items()}


def _plain(text: str) -> str:
    return text if text.isascii() else text.translate(_WIDE)


def _surplus(plain: str, pair: str) -> int:
    """How many more closing than opening brackets of this sort there are in a text that was made plain."""
    return plain.count(pair[1]) - plain.count(pair[0])


def _ends_beyond(text: str) -> bool:
    """Does it end with a bracket, and has it more closing than opening ones of a sort?"""
    plain = _plain(text)
    return plain[-1:] in (")", "]", "］") and (_surplus(plain, "()") > 0 or _surplus(plain, "[]") > 0)


def _is_math(text: str, g: Grammar) -> bool:
    """The columns' rules (valid_dollar_span, valid_equation_span) on one text. Narrative text has CJK characters, which no
    sort may have, so `mixed` asks for nothing more."""
    plain = " ".join(_plain(text).split())
    refused = not plain or len(plain) > g.longest or _surplus(plain, "()") or _surplus(plain, "[]") or _surplus(plain, "{}")
    refused = refused or _MARK.match(plain) or (not plain.isascii() and _CJK.search(plain)) or (not _RELATION.search(plain) and _QUANTITY.match(plain)) or (g.not_raw and g.not_raw.search(text))
    return not refused and all(w.search(plain) for w in g.wants)


def math_spans(text: str | None, longest: int | None = 1200) -> list[tuple[int, int, str, str]]:
    """(start, end, text, kind) of inline math in prose of at most `longest` characters (None: any; a whole displayed formula is none):
    each grammar in turn takes what those before it left free."""
    raw, taken = text or "", []
    if (longest is not None and len(raw) > longest) or ("$$" in raw and _DISPLAYED.match(raw)):
        return taken
    for g in GRAMMARS:
        if not _NEEDED[g.kind].search(raw):
            continue
        for m in g.pattern.finditer(raw):
            inner = m["math"].rstrip()
            while g.brackets and inner and _ends_beyond(inner):
                inner = inner[:-1].rstrip()
            start, end = m.span() if not g.brackets else (m.start("math"), m.start("math") + len(inner))
            start += 0 if not g.brackets else len(inner) - len(inner.lstrip())
            inner = inner.strip()
            if not any(start < b and a < end for a, b, _, _ in taken) and _is_math(inner, g):
                taken.append((start, end, inner, g.kind))
    return sorted(taken)


def explode_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a row for each span of math in its text: start, end, span and kind. The greedy choice among overlapping
    spans has no built-in form, so it is a function of Arrow batches; texts without the signs of math stay on Spark's side,
    and equal texts of a batch are searched once."""
    types = {"start": pa.int32(), "end": pa.int32(), "span": pa.string(), "kind": pa.string()}
    names = [*df.columns, *types]

    def found(batches):
        for b in batches:
            texts = b.column(text).dictionary_encode()
            spans = [math_spans(unicodedata.normalize("NFC", t)) for t in texts.dictionary.to_pylist()]
            rows = [(i, *s) for i, k in enumerate(texts.indices.to_pylist()) if k is not None for s in spans[k]]
            if rows:
                at, *columns = zip(*rows)
                own = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, t) for c, t in zip(columns, types.values(), strict=True))], names=names)

    schema = StructType([*df.schema.fields, *(StructField(n, StringType() if pa.types.is_string(t) else IntegerType()) for n, t in types.items())])
    return df.where(F.col(text).rlike("|".join(NEEDED.values()))).mapInArrow(found, schema)


def table_shapes(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, n_rows, n_columns, n_spans and wide of cells(doc_id, table_id, row, cell, span)."""
    rows = cells.groupBy("doc_id", "table_id", "row").agg(F.sum("span").alias("width"), F.sum((F.col("span") > 1).cast("int")).alias("spans"))
    t = rows.groupBy("doc_id", "table_id").agg(F.count("*").alias("n_rows"), F.max("width").alias("n_columns"), F.sum("spans").alias("n_spans"), (F.max("width") != F.min("width")).alias("ragged"))
    return t.withColumn("wide", F.col("n_columns") > 8)


def horizontal_merges(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, row, first cell and width of runs of merged cells: a 'restart' and the 'continue' cells after it.
    cells(doc_id, table_id, row, cell, merge). All windows share one order, and no groups are held beside it: a run is its
    first cell, up to the place and the number of restarts at which the next one begins."""
    row = Window.partitionBy("doc_id", "table_id", "row")
    w = row.orderBy("cell")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    t = cells.select("doc_id", "table_id", "row", "cell", F.col("merge").eqNullSafe("restart").cast("int").alias("restart"), F.sum((~F.coalesce(F.col("merge") == "continue", F.lit(False))).cast("int")).over(w).alias("island"))
    t = t.withColumn("at", F.row_number().over(w) - 1).withColumn("before", F.sum("restart").over(so_far) - F.col("restart"))
    t = t.withColumn("n", F.count("*").over(row)).withColumn("all", F.sum("restart").over(row)).withColumn("last", F.lag("island").over(w)).where("last IS NULL OR last <> island")
    t = t.withColumn("width", F.coalesce(F.lead("at").over(w), F.col("n")) - F.col("at")).withColumn("starts", F.coalesce(F.lead("before").over(w), F.col("all")) - F.col("before"))
    return t.where("width > 1 AND starts > 0").select("doc_id", "table_id", "row", "cell", F.col("width").cast("long").alias("width"))


def distinct_merges(merges: DataFrame) -> DataFrame:
    """The first of equal merge rectangles. merges(doc_id, ord, row, col, rowspan, colspan)."""
    return merges.groupBy("doc_id", "row", "col", "rowspan", "colspan").agg(F.min("ord").alias("ord"))


def _on_page(patterns: tuple[str, ...]):
    """Whether a page's text, as it is or without white space, matches one of the patterns, whatever the case."""
    either = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    return F.col("text").rlike(either) | F.regexp_replace("text", r"\s+", "").rlike(either)


def first_pages(pages: DataFrame, *patterns: str) -> DataFrame:
    """doc_id and the first page of pages(doc_id, page, text) that matches a pattern."""
    return matching_pages(pages, *patterns).groupBy("doc_id").agg(F.min("page").alias("page"))


def matching_pages(pages: DataFrame, *patterns: str) -> DataFrame:
    """doc_id and page of all pages that match a pattern."""
    return pages.where(_on_page(patterns)).select("doc_id", "page")


#: Pages worth a look: contents, start of the body, figures, tables, formulas (fixed values).
CONTENTS_PAGE = ("目录", "contents")
BODY_PAGE = (r"第\d+章", r"chapter\s*1", r"1\.\s*[A-Za-z]")
RISK_PAGES = ((r"图\s*\d+", r"\bfig\.?\s*\d+", r"\bfigure\s*\d+", "插图"), (r"表\s*\d+", r"\btable\s*\d+", "三线表"), ("公式", "方程", r"\bequation\b", r"\beq\.?\s*\(?\d+"))


def sample_pages(pages: DataFrame, most: int = 8) -> DataFrame:
    """doc_id and pages (ascending) of a sample of at most `most` pages of pages(doc_id, page, text; page from 1).

    In order: the first, the contents, the body's start; of pages that are no lists, the first with a figure, the first
    with a table, the first with a formula not chosen yet; pages behind those with tables; the third, the middle one of
    eight or more, the last.
    """
    figure, table, formula = (F.when(_on_page(p) & ~template.is_list_page("text"), F.col("page")) for p in RISK_PAGES)
    on = lambda p: F.when(_on_page(p), F.col("page"))
    t = pages.groupBy("doc_id").agg(
        F.max("page").alias("n"), F.min(on(CONTENTS_PAGE)).alias("toc"), F.min(on(BODY_PAGE)).alias("body"), F.array_sort(F.collect_set(figure)).alias("figures"), F.array_sort(F.collect_set(table)).alias("tables"),
        F.array_sort(F.collect_set(formula)).alias("formulas"),
    )
    one = lambda c: F.array_compact(F.array(c))
    chosen = F.array_distinct(F.array_compact(F.array(F.lit(1).cast("long"), F.col("toc"), F.col("body"))))
    t = t.withColumn("c", chosen)
    fresh = lambda found: F.slice(F.array_except(found, F.col("c")), 1, 1)
    t = t.withColumn("c", F.concat("c", fresh(F.col("figures")))).withColumn("c", F.array_distinct(F.concat("c", F.slice("tables", 1, 1)))).withColumn("c", F.concat("c", fresh(F.col("formulas"))))
    rest = F.concat(F.transform("tables", lambda p: p + 1), one(F.when(F.col("n") >= 3, F.lit(3).cast("long"))), one(F.when(F.col("n") >= 8, F.floor(F.col("n") / 2))), one(F.col("n")))
    chosen = F.slice(F.filter(F.array_distinct(F.concat("c", rest)), lambda p: p <= F.col("n")), 1, most)
    return t.select("doc_id", F.array_join(F.array_sort(chosen).cast("array<string>"), ",").alias("pages"))
