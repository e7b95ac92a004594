"""Rules as data, comparison with baselines, conditional order, word boxes to lines."""

from __future__ import annotations

from bisect import insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import template
from .containment import unheld

#: code, severity, predicate, detail
Rule = tuple[str, str, Column, Column]


def apply_rules(df: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """keys, code, severity and detail: a row for every rule whose predicate holds. One pass over the rows, whatever the
    number of rules; a null predicate doesn't hold."""
    found = F.array_compact(F.array(*[F.when(p, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))) for code, severity, p, detail in rules]))
    return df.select(*keys, F.inline(found))


def compare(baseline: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, expected and actual where a current row differs from its baseline; a row on one side only differs in
    every field that it has. Null equals null."""
    b, c = (x.select(F.col(key).alias(f"{s}_key"), *[F.col(f).cast("string").alias(f"{s}_{f}") for f in fields]) for x, s in ((baseline, "b"), (current, "c")))
    t = b.join(c, F.col("b_key") == F.col("c_key"), "full")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("expected"), F.col(f"c_{f}").alias("actual")) for f in fields])
    return t.select(F.coalesce("b_key", "c_key").alias(key), F.inline(pairs)).where(~F.col("expected").eqNullSafe(F.col("actual")))


def sorted_where_numbered(sections: DataFrame) -> DataFrame:
    """doc_id, chapter, ord and place: the order of a chapter's sections(doc_id, chapter, ord, number). They are sorted by
    number only if all have one and some stand out of order; equal numbers keep their order."""
    order = Window.partitionBy("doc_id", "chapter").orderBy("ord")
    whole = Window.partitionBy("doc_id", "chapter")
    t = sections.withColumn("late", F.coalesce(F.col("number") < F.lag("number").over(order), F.lit(False)))
    sort = F.min(F.col("number").isNotNull().cast("int")).over(whole) * F.max(F.col("late").cast("int")).over(whole) == 1
    t = t.withColumn("key", F.when(sort, F.col("number")).otherwise(0))
    return t.select("doc_id", "chapter", "ord", F.row_number().over(Window.partitionBy("doc_id", "chapter").orderBy("key", "ord")).alias("place"))


def word_lines(words: DataFrame, most: int | None = 320) -> DataFrame:
    """doc_id, page, line, text, x_min, x_max, y_min, y_max and size of words(doc_id, page, x_min, x_max, y_min, y_max, text).

    Words of a page come by their centre, then from the left. Each joins the line before it if its centre is within
    max(3, 0.45 x the median height) of that line's median centre, else it opens a line: the medians move as words join, so a
    page is one group. The first `most` lines of a document count (None: all); those without text are left out.
    """
    kind = words.schema["doc_id"].dataType.simpleString()

    def run(key, page: pd.DataFrame) -> pd.DataFrame:
        page = page.assign(centre=(page.y_min + page.y_max) / 2, height=page.y_max - page.y_min).sort_values(["centre", "x_min"])
        number, line, centres, heights = [], -1, [], []
        middle = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
        for centre, height in zip(page.centre, page.height, strict=True):
            if line < 0 or abs(centre - middle(centres)) > max(3.0, 0.45 * middle(heights)):
                line, centres, heights = line + 1, [], []
            insort(centres, centre)
            insort(heights, height)
            number.append(line)
        return page.assign(line=number)[["doc_id", "page", "line", "x_min", "x_max", "y_min", "y_max", "text"]]

    laid = words.groupBy("doc_id", "page").applyInPandas(run, f"doc_id {kind}, page long, line long, x_min double, x_max double, y_min double, y_max double, text string")
    parts = F.array_sort(F.collect_list(F.struct("x_min", "text")))
    t = laid.groupBy("doc_id", "page", "line").agg(
        F.array_join(F.transform(parts, lambda w: w["text"]), " ").alias("text"), F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"),
        F.median(F.col("y_max") - F.col("y_min")).alias("size"),
    )
    if most is not None:
        t = t.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line"))).where(F.col("__n") <= most).drop("__n")
    return t.withColumn("text", template.line("text")).where("text <> ''")


def recovered(found: DataFrame, known: DataFrame) -> DataFrame:
    """The first of each text of found(doc_id, ord, text), white space and case apart, that isn't in known(doc_id, text):
    not equal to one, nor, from 16 characters on, contained in one."""
    key = lambda x: F.lower(F.regexp_replace(F.coalesce(F.col(x), F.lit("")), r"\s+", ""))
    f = found.withColumn("__k", key("text")).where("__k <> ''")
    first = f.groupBy("doc_id", "__k").agg(F.min_by(F.struct("ord", "text"), "ord").alias("m"))
    left = unheld(first.withColumnRenamed("__k", "key"), known.select("doc_id", key("text").alias("text")), 16)
    return left.select("doc_id", "m.ord", "m.text")
