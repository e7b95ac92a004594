"""Running values over long sequences: within blocks of bounded size first, then over the blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import settled

#: Rows of a block where a sequence's order counts them without large gaps.
BLOCK = 10_000


def _blocks(df: DataFrame, order: str, size: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(order) / size))


def last_before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, size: int = BLOCK) -> DataFrame:
    """df with name: the last value that isn't null strictly before each row of its sequence.

    A block's last value is all that the blocks behind it need, so what a task gathers is a block or the blocks' heads.
    """
    t = _blocks(df.withColumn("__v", value), order, size)
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    heads = t.where("__v IS NOT NULL").groupBy(*keys, "__block").agg(F.max_by("__v", order).alias("__last"))
    heads = t.select(*keys, "__block").distinct().join(heads, [*keys, "__block"], "left").withColumn("__last", F.last("__last", ignorenulls=True).over(over))
    t = t.withColumn("__in", F.last("__v", ignorenulls=True).over(inside)).join(heads, [*keys, "__block"], "left")
    return t.select(*df.columns, F.coalesce("__in", "__last").alias(name))


def sum_upto(df: DataFrame, keys: list[str], order: str, value: Column, name: str, size: int = BLOCK) -> DataFrame:
    """df with name: the sum of value up to each row of its sequence, the row included."""
    t = _blocks(df.withColumn("__v", value.cast("long")), order, size)
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    over = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    heads = t.groupBy(*keys, "__block").agg(F.sum("__v").alias("__n")).withColumn("__n", F.coalesce(F.sum("__n").over(over), F.lit(0)))
    t = t.withColumn("__in", F.sum("__v").over(inside)).join(heads, [*keys, "__block"])
    return t.select(*df.columns, (F.col("__in") + F.col("__n")).alias(name))


def taken_in_order(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The spans(keys, start, end) that a pass from the left takes: the first, then each time the next that starts behind
    the end of the last one taken. Of spans with one start there must be one.

    Each span points to the one that would follow it; from a sequence's first one the pointers are followed by doubling:
    after k rounds 2^k spans are found, so a chain of any length takes as many rounds as its length has bits.
    """
    marks = spans.select(*keys, F.col("start").alias("at"), F.col("start"), "end").unionByName(spans.select(*keys, (F.col("end") + 1).alias("at"), F.lit(None).cast(spans.schema["start"].dataType).alias("start"), "end"))
    # Of marks at one place those that ask come first, so that a span which starts there is still ahead.
    ahead = Window.partitionBy(*keys).orderBy("at", F.col("start").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    asked = marks.withColumn("next", F.first("start", ignorenulls=True).over(ahead)).where("start IS NULL").groupBy(*keys, "end").agg(F.first("next").alias("next"))
    jump = settled(spans.join(asked, [*keys, "end"], "left").select(*keys, "start", "next"))
    taken = settled(spans.groupBy(*keys).agg(F.min("start").alias("start")))
    while True:
        more = taken.join(jump, [*keys, "start"]).where("next IS NOT NULL").select(*keys, F.col("next").alias("start"))
        fresh = settled(more.join(taken, [*keys, "start"], "left_anti").distinct())
        if not fresh.limit(1).count():
            return spans.join(taken, [*keys, "start"], "left_semi")
        taken = settled(taken.unionByName(fresh))
        far = jump.select(*keys, F.col("start").alias("next"), F.col("next").alias("far"))
        jump = settled(jump.join(far, [*keys, "next"]).select(*keys, "start", F.col("far").alias("next")))
