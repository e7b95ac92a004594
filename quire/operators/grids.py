"""Tables of packages: the columns of cells, merged rectangles, irregular merges, depth, sections.

Cells are rows (doc_id, table_id, row, cell, span, across, down, filled, before): `cell` is the place in its row, `span` the
columns it takes, `across` and `down` its marks of horizontal and vertical merging (empty, restart or continue), `filled`
whether it shows anything, `before` the columns that its row leaves free. A row's cells are one window, a column's cells
another; only rectangles has the cells of a table in one task's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import settled  # noqa: F401  (tests see to it that nothing here calls it)

TABLE = ["doc_id", "table_id"]
ROW = [*TABLE, "row"]


def _runs(cells: DataFrame) -> DataFrame:
    """cells with `run` (each cell that doesn't continue its neighbour begins one), `headed` (the run began with a restart),
    `spare` (columns that the restart's own span takes and further cells of the run may repeat) and `used` (columns of the
    run's cells so far)."""
    line = Window.partitionBy(*ROW).orderBy("cell")
    t = cells.withColumn("run", F.sum((F.col("across") != "continue").cast("int")).over(line))
    run = Window.partitionBy(*ROW, "run").orderBy("cell")
    so_far = run.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("headed", F.first("across").over(run) == "restart").withColumn("spare", F.first("span").over(run) - 1)
    return t.withColumn("used", F.coalesce(F.sum(F.when(F.col("across") == "continue", F.col("span"))).over(so_far), F.lit(0)))


def repeats() -> Column:
    """Whether a cell only repeats columns that its run's restart spans; over _runs."""
    return (F.col("across") == "continue") & F.col("headed") & (F.col("used") < F.col("spare"))


def merge_widths(cells: DataFrame) -> DataFrame:
    """_runs with `plain_col`, the column of a cell if repeating cells take none, and `width`: for a restart, the columns of
    all its run."""
    t = _runs(cells)
    line = Window.partitionBy(*ROW).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*ROW, "run")
    t = t.withColumn("plain_col", F.col("before") + F.coalesce(F.sum(F.when(~repeats(), F.col("span"))).over(line), F.lit(0)))
    return t.withColumn("width", F.when(F.col("across") == "restart", F.sum(F.when(~repeats(), F.col("span"))).over(whole)))


def _width_at(col: str) -> Column:
    """The width of the row's run that begins at a column, else null; `widths` has the row's (plain_col, width)."""
    found = F.filter("widths", lambda w: w["plain_col"] == F.col(col))
    return F.get(found, 0)["width"]


def _with_widths(t: DataFrame) -> DataFrame:
    row = Window.partitionBy(*ROW)
    return t.withColumn("widths", F.collect_list(F.when(F.col("width").isNotNull(), F.struct("plain_col", "width"))).over(row))


def placed(cells: DataFrame) -> DataFrame:
    """cells with `col`, the grid column, `skipped` (an empty cell that repeats spanned columns: it has no place), `extends`
    (it widens the merge to its left) and what merge_widths adds.

    A repeating cell that shows something ends its run: it and what follows stand for themselves.
    """
    t = merge_widths(cells)
    so_far = Window.partitionBy(*ROW, "run").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shown = repeats() & F.col("filled")
    t = t.withColumn("ended", F.coalesce(F.max(shown.cast("int")).over(so_far), F.lit(0)) == 1)
    t = t.withColumn("skipped", repeats() & ~F.col("filled") & ~F.col("ended"))
    t = t.withColumn("extends", (F.col("across") == "continue") & F.col("headed") & (F.col("used") >= F.col("spare")) & ~F.col("ended"))
    line = Window.partitionBy(*ROW).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("col", F.col("before") + F.coalesce(F.sum(F.when(~F.col("skipped"), F.col("span"))).over(line), F.lit(0)))


def chained(cells: DataFrame) -> DataFrame:
    """placed cells with `down_span` (for a vertical restart: the rows of its merge), `joined` (the cell continues the
    merge above) and `swallowed` (it lies in a merge's continuation that several cells make up).

    A merge goes on in the next row if a continuing, empty cell of its column takes as many columns and belongs to a
    horizontal merge as wide, or if empty continuing cells from its column on take as many together. A cell with both
    marks is placed by the horizontal one first.
    """
    t = _with_widths(placed(cells))
    free = (F.col("down") == "continue") & ~F.col("filled") & ~F.col("skipped")
    line = Window.partitionBy(*ROW).orderBy("cell")
    t = t.withColumn("free", free).withColumn("island", F.sum((~free).cast("int")).over(line))
    t = t.withColumn("ends", F.collect_list(F.when(F.col("free"), F.col("col") + F.col("span"))).over(Window.partitionBy(*ROW, "island")))
    kept = t.where("NOT skipped")
    column = Window.partitionBy(*TABLE, "col").orderBy("row")
    kept = kept.withColumn("chain", F.sum((F.col("down") == "restart").cast("int")).over(column))
    chain = Window.partitionBy(*TABLE, "col", "chain").orderBy("row")
    width = F.coalesce(_width_at("col"), F.col("span"))
    head = lambda c: F.first(c).over(chain)
    kept = kept.withColumn("own", width).withColumn("need", head(F.when(F.col("own") > F.col("span"), F.col("own")).otherwise(1)))
    kept = kept.withColumn("begun", head(F.col("down") == "restart")).withColumn("wide", head("span")).withColumn("due", head("row") + F.row_number().over(chain) - 1)
    alone = (F.col("span") == F.col("wide")) & ((F.col("need") <= 1) | (F.col("own") == F.col("need")))
    together = (F.col("span") < F.col("wide")) & F.array_contains("ends", F.col("col") + F.col("wide"))
    fits = F.col("begun") & (F.col("row") == F.col("due")) & ((F.col("down") == "restart") | (F.col("free") & (alone | together)))
    kept = kept.withColumn("fits", F.min(fits.cast("int")).over(chain.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    kept = kept.withColumn("joined", F.col("fits") & (F.col("down") == "continue"))
    kept = kept.withColumn("down_span", F.when(F.col("down") == "restart", F.sum(F.col("fits").cast("int")).over(chain.rowsBetween(0, Window.unboundedFollowing))))
    edge = F.when(F.col("joined"), F.col("col") + F.col("wide"))
    before = Window.partitionBy(*ROW).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("swallowed", F.coalesce(F.last(edge, ignorenulls=True).over(before) > F.col("col"), F.lit(False)))


def _whole_tables(batches):
    """Batches in the order of their tables, cut anew so that none ends within a table."""
    held = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("starts").to_numpy(zero_copy_only=False))
        cut = int(starts[-1]) if len(starts) else 0
        if cut or (len(starts) and held):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _so_far(values, first):
    """Sums of what stands before each element of its group; first: the place of the group's first element."""
    total = np.cumsum(values) - values
    return total - total[first]


def _latest(flags):
    """The place of the last set flag up to each element, 0 before the first."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), 0))


def _marks(t: dict):
    """Marks of merged cells of whole tables, by arrays: place of the cell, kind (0: down, 1: across), row number over all tables (line),
    col, rowspan and colspan; behind them the lines of each one's rows, one after the other. It follows chained step by step."""
    across, down, span, row, filled = (t[c] for c in ("across", "down", "span", "row", "filled"))
    n = len(row)
    head = t["starts"] | (row != np.concatenate([row[:1], row[:-1]]))
    head[:1] = True
    line, first = np.cumsum(head) - 1, _latest(head)
    # Runs of horizontal merges.
    on = across == 2
    begins = head | ~on
    run, at = np.cumsum(begins) - 1, _latest(begins)
    runs = np.flatnonzero(begins)
    headed, used = across[at] == 1, _so_far(np.where(on, span, 0), at)
    repeat = on & headed & (used < span[at] - 1)
    plain = t["before"] + _so_far(np.where(repeat, 0, span), first)
    width = np.add.reduceat(np.where(repeat, 0, span), runs)[run]
    ended = _so_far(repeat & filled, at) > 0
    skipped = repeat & ~filled & ~ended
    extends = on & headed & ~repeat & ~ended
    col = t["before"] + _so_far(np.where(skipped, 0, span), first)
    extended = span + np.add.reduceat(np.where(extends, span, 0), runs)[run]
    # Widths by line and column, ends by islands of free cells.
    most = int(max(col.max(), plain.max()) + span.max() + 1)
    restarts = np.flatnonzero(across == 1)
    keys, which = np.unique(line[restarts] * most + plain[restarts], return_index=True)
    asked = line * most + col
    spot = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
    own = np.where(keys[spot] == asked, width[restarts[which]][spot], span) if len(keys) else span
    free = (down == 2) & ~filled & ~skipped
    island = np.cumsum(head | ~free)
    # Chains of a column.
    order = np.flatnonzero(~skipped)
    table = np.cumsum(t["starts"])
    order = order[np.argsort(table[order] * most + col[order], kind="stable")]
    o_table, o_col, o_row, o_down, o_span, o_own = table[order], col[order], row[order], down[order], span[order], own[order]
    new = (o_down == 1) | (o_table != np.concatenate([o_table[:1], o_table[:-1]])) | (o_col != np.concatenate([o_col[:1], o_col[:-1]]))
    new[:1] = True
    top, links = _latest(new), np.flatnonzero(new)
    need = np.where(o_own > o_span, o_own, 1)[top]
    wide = o_span[top]
    alone = (o_span == wide) & ((need <= 1) | (o_own == need))
    together = (o_span < wide) & np.isin(island[order] * most + o_col + wide, (island * most + col + span)[free])
    fits = (o_down[top] == 1) & (o_row == o_row[top] + np.arange(len(order)) - top) & ((o_down == 1) | (free[order] & (alone | together)))
    fits &= _so_far(~fits, top) == 0
    tall = np.flatnonzero(o_down == 1)
    down_span = np.add.reduceat(fits.astype(np.int64), links)[np.searchsorted(links, tall)]
    joined, spread = np.zeros(n, dtype=bool), span.copy()
    joined[order], spread[order] = fits & (o_down == 2), wide
    # Cells that lie in a continuation begun before them in their row.
    last = np.concatenate([[0], _latest(joined)[:-1]])
    swallowed = joined[last] & (last >= first) & (last < np.arange(n)) & (col[last] + spread[last] > col)
    spanned = (across == 0) & (span > 1) & (down != 1) & ~joined
    level = np.flatnonzero(((across == 1) | spanned) & ~skipped & ~swallowed & ~(joined & (span < spread)))
    place = np.concatenate([order[tall], level])
    kind = np.repeat([0, 1], [len(tall), len(level)])
    rowspan = np.concatenate([down_span, np.ones(len(level), dtype=np.int64)])
    colspan = np.concatenate([span[order[tall]], np.where(across == 1, extended, span)[level]])
    steps = np.arange(down_span.sum()) - np.repeat(np.cumsum(down_span) - down_span, down_span)
    lines = np.concatenate([line[order[np.repeat(tall, down_span) + steps]], line[level]])
    return place, kind, line[place], col[place], rowspan, colspan, lines, most


def _rectangles(t: dict):
    """Merged rectangles of whole tables: place of the cell that began each, kind, col, rowspan and colspan."""
    place, kind, line, col, rowspan, colspan, lines, most = _marks(t)
    # Of the flat marks at a line's column the first; a tall one is asked for at each of its lines.
    flat = np.flatnonzero((rowspan == 1) & (colspan > 1))
    flat = flat[np.lexsort((kind[flat], place[flat]))]
    keys, which = np.unique(line[flat] * most + col[flat], return_index=True)
    firsts = flat[which]
    starts = np.cumsum(rowspan) - rowspan
    tall = np.flatnonzero(rowspan > 1)
    long = rowspan[tall]
    offsets = np.cumsum(long) - long
    steps = np.repeat(starts[tall] - offsets, long) + np.arange(long.sum())
    asked = lines[steps] * most + np.repeat(col[tall], long)
    spot = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
    width = np.zeros(len(tall), dtype=np.int64)
    if len(tall) and len(keys):
        under = np.where(keys[spot] == asked, colspan[firsts][spot], 0)
        least, widest = np.minimum.reduceat(under, offsets), np.maximum.reduceat(under, offsets)
        width = np.where((least == widest) & (least > 0) & (widest >= colspan[tall]), widest, 0)
    # From left to right over the tall merges of the same rows: a wide one takes those that begin inside it.
    keep, end, group = np.ones(len(tall), dtype=bool), -1, None
    if width.any():
        by = np.lexsort((place[tall], col[tall], long, line[tall]))
        for i, of, at, w in zip(by.tolist(), zip(line[tall][by].tolist(), long[by].tolist()), col[tall][by].tolist(), width[by].tolist(), strict=True):
            if of != group:
                group, end = of, -1
            if at < end:
                keep[i] = False
            elif w:
                end = at + w
    gone = np.zeros(len(place), dtype=bool)
    if len(tall) and len(keys):
        gone[firsts[spot[np.repeat(keep & (width > 0), long)]]] = True
    rest = flat[~gone[flat]]
    tall, width = tall[keep], width[keep]
    colspan[tall] = np.maximum(colspan[tall], width)
    out = np.concatenate([tall, rest])
    # Equal rectangles are one: the first mark's.
    out = out[np.lexsort((kind[out], place[out], colspan[out], rowspan[out], col[out], line[out]))]
    same = [x[out][1:] == x[out][:-1] for x in (line, col, rowspan, colspan)]
    out = out[np.concatenate([np.ones(min(len(out), 1), dtype=bool), ~np.logical_and.reduce(same)])]
    return place[out], kind[out], col[out], rowspan[out], colspan[out]


def rectangles(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, row, col, rowspan, colspan and ord of the merged rectangles of each table.

    A vertical merge whose rows all have a horizontal merge as wide at its column is one rectangle of that width; the
    horizontal ones, and the vertical ones of the same rows that begin inside it, are part of it. Equal rectangles are
    one. ord is the place of the mark that began it. Cells are dealt by table and sorted once, and pass their task in order, by
    arrays over many tables at a time: nothing is written, and a task holds one batch and the cells of one table.
    """
    code = lambda c: F.when(F.col(c) == "restart", 1).when(F.col(c) == "continue", 2).when(F.coalesce(c, F.lit("")) == "", 0).otherwise(3).cast("byte").alias(c)
    start = F.lag("row").over(Window.partitionBy(*TABLE).orderBy("row", "cell")).isNull()
    t = cells.select(*ROW, "cell", F.col("span").cast("long"), code("across"), code("down"), F.coalesce("filled", F.lit(False)).alias("filled"), F.col("before").cast("long"))
    t = t.withColumn("starts", start).sortWithinPartitions(*ROW, "cell")

    def run(batches):
        for whole in _whole_tables(batches):
            if not whole.num_rows:
                continue
            own = {c: whole.column(c).to_numpy() for c in ("row", "span", "across", "down", "filled", "before", "starts")}
            place, kind, col, rowspan, colspan = _rectangles(own)
            part = whole.select([*ROW, "cell"]).take(pa.array(place)).combine_chunks()
            ids = {c: (part.column(c).chunk(0) if part.num_rows else pa.array([], part.schema.field(c).type)) for c in part.column_names}
            ord = pa.StructArray.from_arrays([ids["row"], ids["cell"], pa.array(kind.astype(np.int32))], names=["row", "cell", "kind"])
            yield pa.RecordBatch.from_arrays([*(ids[c] for c in ROW), *(pa.array(x.astype(np.int64)) for x in (col, rowspan, colspan)), ord], names=[*ROW, "col", "rowspan", "colspan", "ord"])

    kinds = {f.name: f.dataType.simpleString() for f in t.schema}
    return t.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ROW) + f", col long, rowspan long, colspan long, ord struct<row:{kinds['row']},cell:{kinds['cell']},kind:int>")


def grid(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, row, col, span and text of the cells that have a place; what continues a merge shows nothing.
    cells also has text."""
    t = chained(cells)
    return t.select(*ROW, "col", "span", F.when(F.col("joined") | F.col("extends") | F.col("swallowed"), "").otherwise(F.col("text")).alias("text"))




def _against_above(batches):
    """Cells in the order of their tables with `bad`: a vertical continuation that doesn't go on what stands above it. Of the
    row above, what each column expects is held: (width, need), which a continuation passes on and any other cell begins."""
    table, at, above, here, seen = 0, None, {}, {}, 0
    for batch in batches:
        bad = np.zeros(batch.num_rows, dtype=bool)
        tables = seen + np.cumsum(batch.column("starts").to_numpy(zero_copy_only=False))
        seen = int(tables[-1]) if len(tables) else seen
        asked = np.flatnonzero(batch.column("marked").to_numpy(zero_copy_only=False))
        part = batch.take(pa.array(asked)).select(["row", "col", "span", "own", "down"])
        for i, no, row, col, span, own, down in zip(asked, tables[asked].tolist(), *(c.to_pylist() for c in part.columns), strict=True):
            if no != table:
                table, at, above, here = no, row, {}, {}
            elif row != at:
                at, above, here = row, here if row == at + 1 else {}, {}
            on = above.get(col) if down == "continue" else None
            wide, need = on or (span, own if down == "restart" else span)
            bad[i] = down == "continue" and (on is None or wide != span or (need > wide and own != need))
            here.update(dict.fromkeys(range(col, col + span), (wide, need)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _COUNTED), pa.array(bad)], names=[*_COUNTED, "bad"])


#: What is counted of a cell once it was held against the row above.
_COUNTED = [*TABLE, "end", "flagged", "repeat", "filled", "goes_on"]


def irregularities(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """By doc_id: tables with irregular merges, and how many merges of each sort are irregular or continue visibly.

    columns(doc_id, table_id, grid_columns) is a table's declared grid, 0 for none. A horizontal merge is irregular if cells
    repeat what its restart spans; a span, if it leaves the grid; a vertical continuation, if nothing goes on above it, or
    something of another width. What a continuation expects comes down from the restart, row by row, whichever of the
    columns above it lies under: cells pass their task in order, which holds one row. Cells are shuffled once, by table;
    declared grids meet the counts of each table's right edges, not its cells.
    """
    # The window over whole tables comes first, so that those over rows find their tables in one task.
    start = F.lag("row").over(Window.partitionBy(*TABLE).orderBy("row", "cell")).isNull()
    t = _with_widths(merge_widths(cells.select(*ROW, "cell", "span", "across", "down", "filled", "before").withColumn("starts", start)))
    repeat = repeats()
    first = Window.partitionBy(*ROW, "run").orderBy("cell")
    t = t.withColumn("repeat", repeat).withColumn("flagged", repeat & (F.sum(repeat.cast("int")).over(first) == 1))
    t = t.select(
        *ROW, "cell", "starts", F.col("plain_col").cast("long").alias("col"), F.col("span").cast("long").alias("span"), F.coalesce(_width_at("plain_col"), F.col("span")).cast("long").alias("own"), "down", ((F.col("down") != "") & ~F.col("repeat")).alias("marked"),
        F.when(~F.col("repeat"), F.col("plain_col") + F.col("span")).cast("long").alias("end"), "flagged", "repeat", "filled", (F.col("down") == "continue").alias("goes_on"),
    ).sortWithinPartitions(*ROW, "cell")
    kinds = {f.name: f.dataType.simpleString() for f in t.schema}
    t = t.mapInArrow(_against_above, ", ".join(f"{c} {kinds[c]}" for c in _COUNTED) + ", bad boolean")
    n = lambda c: F.sum(c.cast("long"))
    t = t.groupBy(*TABLE, "end").agg(
        n(F.col("flagged")).alias("irregular_across"), F.count("*").alias("n"), n(F.col("bad")).alias("irregular_down"), n(F.col("repeat") & F.col("filled")).alias("visible_across"),
        n(F.col("goes_on") & ~F.col("repeat") & F.col("filled")).alias("visible_down"),
    )
    t = t.join(columns, TABLE, "left").withColumn("irregular_spans", F.when((F.coalesce("grid_columns", F.lit(0)) > 0) & (F.col("end") > F.col("grid_columns")), F.col("n")).otherwise(0))
    counts = ["irregular_across", "irregular_spans", "irregular_down", "visible_across", "visible_down"]
    by_table = t.groupBy(*TABLE).agg(*[F.sum(c).alias(c) for c in counts])
    some = sum((F.col(c) for c in counts[1:]), F.col(counts[0])) > 0
    return by_table.groupBy("doc_id").agg(n(some).alias("irregular_tables"), *[F.sum(c).alias(c) for c in counts])


def depths(tables: DataFrame) -> DataFrame:
    """doc_id, tables inside others and their greatest depth; tables(doc_id, table_id, depth): tables around a table."""
    inner = F.col("depth") >= 1
    return tables.groupBy("doc_id").agg(F.sum(inner.cast("long")).alias("nested_tables"), F.max(F.when(inner, F.col("depth")).otherwise(0)).alias("most_depth"))


def widest(cells: DataFrame) -> DataFrame:
    """doc_id, table_id and n_columns, the columns of the widest row; cells also has `after`, columns free at a row's end."""
    rows = merge_widths(cells).groupBy(*ROW).agg((F.max("before") + F.coalesce(F.sum(F.when(~repeats(), F.col("span"))), F.lit(0)) + F.max("after")).alias("n"))
    return rows.groupBy(*TABLE).agg(F.max("n").alias("n_columns"))


def wide_in_landscape(flow: DataFrame, wide: DataFrame) -> DataFrame:
    """doc_id and how many wide tables stand in landscape sections.

    flow(doc_id, ord, table_id, landscape) are a document's elements: landscape is null but where an element closes a
    section, itself included; table_id is null but for tables. What follows the last mark is in no section. wide(doc_id,
    table_id) has the tables that count.
    """
    rest = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(0, Window.unboundedFollowing)
    t = flow.withColumn("section", F.first("landscape", ignorenulls=True).over(rest)).where("table_id IS NOT NULL")
    t = t.join(wide.select(*TABLE, F.lit(1).alias("counts")), TABLE, "left")
    return t.groupBy("doc_id").agg(F.sum((F.col("section") & F.col("counts").isNotNull()).cast("long")).alias("wide_in_landscape")).fillna(0)
