"""Grids of tables against a walk through the cells, one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import grids

SCHEMA = "doc_id long, table_id int, row int, cell int, text string, span int, across string, down string, filled boolean, before int, after int"


def table(rng, both):
    """Rows of cells (span, across, down, text)."""
    out = []
    for _ in range(rng.randint(1, 7)):
        row = []
        if out and rng.random() < 0.4:  # a row that goes on below the last one, in full or with its spans cut
            row = [(span, across, "continue" if down else "", "" if down or across == "continue" else "y") for span, across, down, _ in out[-1][1]]
            if rng.random() < 0.4:
                row = [x for span, across, down, text in row for x in ([(1, across, down, text)] * span if down and not across else [(span, across, down, text)])]
            out.append((out[-1][0], row))
            continue
        for _ in range(rng.randint(1, 5)):
            across = rng.choice(["", "", "restart", "continue", "continue"])
            down = rng.choice(["", "restart", "continue", "continue"])
            if not both and rng.random() < 0.7:
                across = ""
            if not both and across:
                down = ""
            text = "" if rng.random() < 0.75 and (across == "continue" or down == "continue") else "x"
            row.append((1 if both else rng.choice([1, 1, 1, 2, 3]), across, down, text))
        out.append((rng.choice([0, 0, 1]), row))
    return out


def widths(before, row):
    """Column of each horizontal restart and the columns of its run; content doesn't matter."""
    found, col, start, spare = {}, before, None, 0
    for span, across, _, _ in row:
        if across == "continue" and start is not None and spare > 0:
            spare -= span
            continue
        if across == "restart":
            start, spare, found[col] = col, span - 1, span
        elif across == "continue" and start is not None:
            found[start] += span
            spare = 0
        else:
            start = None
        col += span
    return found


def walked(rows):
    """(grid of texts by (row, col), rectangles) by one pass with the merges open in each column."""
    texts, marks, live = {}, [], {}
    for r, (before, row) in enumerate(rows):
        have, col, kept, flat, spare, k = widths(before, row), before, set(), None, 0, 0
        used = set()
        while k < len(row):
            span, across, down, text = row[k]
            up = live.get(col) if down == "continue" else None
            whole = up and all(live.get(col + j) is up for j in range(up["colspan"])) and id(up) not in used
            if whole and up["colspan"] > span:
                n, end = k, col
                while n < len(row) and end < col + up["colspan"] and row[n][2] == "continue" and not row[n][3] and end + row[n][0] <= col + up["colspan"]:
                    end += row[n][0]
                    n += 1
                if end == col + up["colspan"]:
                    at = col
                    for m in range(k, n):
                        texts[r, at] = ""
                        at += row[m][0]
                    up["rowspan"] += 1
                    used.add(id(up))
                    kept |= set(range(col, end))
                    col, k, flat, spare = end, n, None, 0
                    continue
            repeat = across == "continue" and flat is not None and spare > 0
            if repeat and not text:
                spare -= span
                k += 1
                continue
            joined = bool(whole and up["colspan"] == span and not text and not repeat and (up["need"] <= 1 or have.get(col, span) == up["need"]))
            extends = across == "continue" and flat is not None and not repeat
            texts[r, col] = "" if joined or extends else text
            if down == "restart":
                record = {"row": r, "col": col, "rowspan": 1, "colspan": span, "need": have[col] if have.get(col, span) > span else 1}
                marks.append(record)
                live.update({col + j: record for j in range(span)})
                kept |= set(range(col, col + span))
            elif joined:
                up["rowspan"] += 1
                used.add(id(up))
                kept |= set(range(col, col + span))
            if across == "restart":
                flat = {"row": r, "col": col, "rowspan": 1, "colspan": span}
                marks.append(flat)
                spare = span - 1
            elif extends:
                flat["colspan"] += span
                spare = 0
            else:
                if not across and span > 1 and down != "restart" and not joined:
                    marks.append({"row": r, "col": col, "rowspan": 1, "colspan": span})
                flat, spare = None, 0
            col += span
            k += 1
        live = {c: m for c, m in live.items() if c in kept}
    flats = {}
    for m in marks:
        if m["rowspan"] == 1 and m["colspan"] > 1:
            flats.setdefault((m["row"], m["col"]), m)
    gone = []
    for m in [m for m in marks if m["rowspan"] > 1]:
        under = [flats.get((m["row"] + i, m["col"])) for i in range(m["rowspan"])]
        if any(m is g for g in gone) or not all(under) or len({u["colspan"] for u in under}) > 1 or under[0]["colspan"] < m["colspan"]:
            continue
        m["colspan"] = under[0]["colspan"]
        gone += under + [o for o in marks if o is not m and o["row"] == m["row"] and o["rowspan"] == m["rowspan"] > 1 and m["col"] < o["col"] < m["col"] + m["colspan"]]
    found = {(m["row"], m["col"], m["rowspan"], m["colspan"]) for m in marks if not any(m is g for g in gone)}
    return texts, {f for f in found if f[2] > 1 or f[3] > 1}


def irregular(rows, grid):
    """Counts of irregular merges by a pass with what the row above leaves open."""
    n = dict.fromkeys(["irregular_across", "irregular_spans", "irregular_down", "visible_across", "visible_down"], 0)
    live = {}
    for before, row in rows:
        have, col, on, spare, flagged, new = widths(before, row), before, False, 0, False, {}
        for span, across, down, text in row:
            if across == "continue" and on and spare > 0:
                n["irregular_across"] += not flagged
                n["visible_across"] += bool(text)
                flagged = True
                spare -= span
                continue
            n["irregular_spans"] += bool(grid and col + span > grid)
            own = have.get(col, span)
            if down == "restart":
                new.update({col + j: (span, own) for j in range(span)})
            elif down == "continue":
                n["visible_down"] += bool(text)
                wide, need = live.get(col, (None, None))
                n["irregular_down"] += wide != span or (need > wide and own != need)
                new.update({col + j: (wide or span, need or span) if wide else (span, span) for j in range(span)})
            if across == "restart":
                on, spare, flagged = True, span - 1, False
            elif across == "continue" and on:
                spare = 0
            else:
                on, spare, flagged = False, 0, False
            col += span
        live = new
    return n


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    return {(i % 20, i): table(rng, i % 2) for i in range(240)}


@pytest.fixture(scope="module")
def cells(spark, tables):
    data = [(d, t, r, c, text, span, across, down, bool(text), before, 0) for (d, t), rows in tables.items() for r, (before, row) in enumerate(rows) for c, (span, across, down, text) in enumerate(row)]
    return spark.createDataFrame(data, SCHEMA).repartition(4)


def test_rectangles(cells, tables):
    got = {}
    for x in grids.rectangles(cells).collect():
        got.setdefault((x.doc_id, x.table_id), set()).add((x.row, x.col, x.rowspan, x.colspan))
    expected = {k: walked(rows)[1] for k, rows in tables.items()}
    bad = [(k, tables[k], got.get(k, set()), e) for k, e in expected.items() if got.get(k, set()) != e]
    assert not bad, bad[:2]
    every = [m for e in expected.values() for m in e]
    assert sum(m[2] > 1 for m in every) > 60 and sum(m[2] > 1 and m[3] > 1 for m in every) > 5


def test_grid(cells, tables):
    got = {}
    for x in grids.grid(cells).collect():
        got.setdefault((x.doc_id, x.table_id), {})[x.row, x.col] = x.text
    assert got == {k: walked(rows)[0] for k, rows in tables.items()}


def test_irregularities(spark, cells, tables):
    columns = spark.createDataFrame([(d, t, t % 3 * 3) for d, t in tables], "doc_id long, table_id int, grid_columns int")
    expected = {}
    for (d, t), rows in tables.items():
        n = irregular(rows, t % 3 * 3)
        own = expected.setdefault(d, dict.fromkeys(["irregular_tables", *n], 0))
        for k, v in n.items():
            own[k] += v
        own["irregular_tables"] += any(n.values())
    got = {x.doc_id: {k: x[k] for k in expected[x.doc_id]} for x in grids.irregularities(cells, columns).collect()}
    assert got == expected


def test_depth_width_and_sections(spark, cells, tables):
    n = {(x.doc_id, x.table_id): x.n_columns for x in grids.widest(cells).collect()}

    def widest(rows):
        return max(before + sum(s for s, *_ in row) - repeated(row) for before, row in rows)

    def repeated(row):
        out, on, spare = 0, False, 0
        for span, across, _, _ in row:
            if across == "continue" and on and spare > 0:
                out, spare = out + span, spare - span
            elif across == "restart":
                on, spare = True, span - 1
            elif across != "continue":
                on, spare = False, 0
        return out

    assert n == {k: widest(rows) for k, rows in tables.items()}
    t = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 4, 0)], "doc_id int, table_id int, depth int")
    assert sorted(map(tuple, grids.depths(t).collect())) == [(1, 2, 2), (2, 0, 0)]
    flow = [(1, 1, 7, None), (1, 2, None, False), (1, 3, 8, None), (1, 4, 9, None), (1, 5, 10, True), (1, 6, 11, None), (2, 1, 7, None)]
    flow = spark.createDataFrame(flow, "doc_id int, ord int, table_id int, landscape boolean")
    wide = spark.createDataFrame([(1, i) for i in (7, 8, 10, 11)] + [(2, 7)], "doc_id int, table_id int")
    assert sorted(map(tuple, grids.wide_in_landscape(flow, wide).collect())) == [(1, 2), (2, 0)]


def test_no_cells(spark, cells):
    none = cells.limit(0)
    assert grids.rectangles(none).count() == grids.grid(none).count() == grids.widest(none).count() == 0
    assert grids.irregularities(none, none.select("doc_id", "table_id", F.lit(1).alias("grid_columns"))).count() == 0
