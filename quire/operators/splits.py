"""Repair of formulas that a layout has split over several items: row patterns that don't overlap.

Each item is asked whether a pattern begins there; what a pattern needs of the next items comes from windows. Then documents
pass their task in order (_walk): matches are taken from the left, clusters of ratios of any length put together from the run
that they lie in, and sums of 24 terms without an index look back at what was put out before them. Items are dealt by document
once and nothing is written.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formula, repair
from ..functions.text import col, let, strip

#: Shapes of items (fixed values).
NUMBER, BOUND, INDEXED = r"^\d+$", r"^[A-Za-z]\s*=\s*\d+$", r"[A-Za-z][A-Za-z0-9]*\s*\(\s*[A-Za-z]\s*\)"
FRACTION = r"^[A-Za-z][A-Za-z0-9_]*\s*=$"
OPEN_SUM, CLOSED_SUM = r"^(.*?)([A-Za-z][A-Za-z0-9_,]*\s*=\s*)∑\s*(\d+)\s*$", r"^([A-Za-z][A-Za-z0-9_,]*\s*=\s*)∑\s*(\d+)\s+(.+)$"
#: How far a sum looks back for its index, over how many terms, and which index it takes (fixed values).
LOOK_BACK, TERMS, INDEX = 12, "24", "t=1"
#: Items that a pattern of fixed length spans at most: a piece, its sum, and a bound for each number of the piece.
REACH = 11

PART = "struct<role:string,source:string,text:string,latex:string,numbered:boolean>"


def tex(x, lower: Column | None = None, upper: Column | None = None) -> Column:
    """A formula's text as LaTeX: signs by name, names with an upright index, sums with their bounds."""
    s = strip(x)
    for sign, name in {"−": "-", "－": "-", "＝": "=", "×": r"\times ", "·": r"\cdot ", "÷": r"\div ", "%": r"\%"}.items():
        s = F.replace(s, F.lit(sign), F.lit(name))
    total = F.lit(r"\sum") if lower is None else F.concat(F.lit(r"\sum_{"), lower, F.lit("}^{"), upper, F.lit("}"))
    s = F.replace(s, F.lit("∑"), total)
    greek = (
        (r"[∆Δ]([A-Za-z])([A-Za-z0-9]+)", r"\\Delta $1_{\\mathrm{$2}}"), (r"[∆Δ]([A-Za-z0-9]+)", r"\\Delta $1"), (r"[∆Δ]", r"\\Delta"),
        (r"λ([A-Za-z0-9]+)", r"\\lambda_{\\mathrm{$1}}"), (r"Λ([A-Za-z0-9]+)", r"\\Lambda_{\\mathrm{$1}}"), (r"μ([A-Za-z0-9]+)", r"\\mu_{\\mathrm{$1}}"), ("λ", r"\\lambda"), ("Λ", r"\\Lambda"), ("μ", r"\\mu"),
    )
    s = let(s, lambda x: F.when(x.rlike("[∆ΔλΛμ]"), _replaced(x, greek)).otherwise(x))
    steps = (
        (r"(?<![\\{\p{L}\p{N}_])([A-Za-z])([A-Za-z0-9]+)(?![\p{L}\p{N}_])", r"$1_{\\mathrm{$2}}"), (r"\s+", " "),
    )
    return F.trim(_replaced(s, steps))


def _replaced(s: Column, steps) -> Column:
    for pattern, by in steps:
        s = F.regexp_replace(s, pattern, by)
    return s


def _part(role: str, source: str, text: Column, latex: Column, numbered: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(source).alias("source"), text.alias("text"), latex.cast("string").alias("latex"), numbered.alias("numbered"))


def _sum(kind: str, lead: Column, lower: Column, upper: Column, expr: Column, numbered: Column) -> Column:
    text = F.concat(lead, F.lit("∑_{"), lower, F.lit("}^{"), upper, F.lit("} "), expr)
    return _part("formula", f"repaired_{kind}", text, tex(F.concat(lead, F.lit("∑"), expr), lower, upper), numbered)


def _problem(text: Column) -> Column:
    return _part("formula_problem", "split_sum_index_unknown", repair.tidied(text), F.lit(None), F.lit(False))


def _tail(text: Column) -> Column:
    """The prose behind a formula, if there is any, as an array."""
    return F.filter(F.array(_part("text", "", text, F.lit(None), F.lit(False))), lambda p: p["text"] != "")


def _facts(items: DataFrame) -> DataFrame:
    """What an item alone tells, found once."""
    t = items.withColumn("t", strip("text")).withColumn("like", F.coalesce("formula", F.lit(False))).withColumn("numbered", F.coalesce("numbered", F.lit(False)))
    labels, closed = formula.trailing_labels("t"), F.col("t").endswith(")") | F.col("t").endswith("）")
    labelled = closed & (F.size(labels["labels"]) > 0)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    ratio = F.col("like") & F.col("t").startswith("=") & F.col("t").contains("100")
    return t.select(
        "doc_id", "ord", n.cast("long").alias("n"), "t", "text", "like", "numbered", repair.is_piece("t").alias("piece"), F.when(repair.is_piece("t"), repair.is_variable("t")).otherwise(False).alias("variable"), ratio.alias("ratio"), labelled.alias("labelled"),
        F.when(closed, labels["body"]).otherwise(F.col("t")).alias("body"), F.when(labelled, labels["body"]).otherwise(F.col("t")).alias("parted"), F.col("t").rlike(NUMBER).alias("number"), F.col("t").rlike(BOUND).alias("bound"), (closed & formula.is_label("t")).alias("label"),
    )


#: A side of a cluster of ratios as _walk puts it together.
SIDE = "array<struct<name:string,body:string,percent:boolean,divisor:string,numbered:boolean>>"
#: Patterns that go before a cluster of ratios.
EARLY = ("max_sum_layout", "fraction_sum_layout", "sum_bounds", "missing_sum_symbol", "sum_prefix")


def _ratio(x: Column) -> Column:
    """A side of a cluster as a part."""
    hundred = lambda mark: F.when(x["percent"], mark).otherwise("")
    text = F.concat(x["name"], F.lit("=("), x["body"], F.lit(")/("), x["divisor"], F.lit(")"), hundred("×100%"))
    latex = F.concat(repair.identifier(x["name"]), F.lit(r"=\frac{"), tex(x["body"]), F.lit("}{"), repair.identifier(x["divisor"]), F.lit("}"), hundred(r"\times100\%"))
    return _part("formula", "repaired_ratio_cluster", text, latex, x["numbered"])


def _matches(t: DataFrame) -> DataFrame:
    """t with m: struct(kind, length, parts, and for sums that look back: lead, expr, tail and upper), the first pattern
    that begins at an item, clusters of ratios apart; null for none."""
    order = Window.partitionBy("doc_id").orderBy("n")
    ahead = lambda c, k: F.lead(c, k).over(order)
    kept = {c: [ahead(c, k) for k in range(REACH)] for c in ("t", "bound")}
    for c in ("piece", "number", "labelled", "body", "parted", "numbered", "label"):
        kept[c] = [ahead(c, k) for k in range(7)]
    for c, values in kept.items():
        for k, v in enumerate(values[1:], 1):
            t = t.withColumn(f"{c}{k}", v)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    bare = lambda c: F.regexp_replace(col(c), r"\s+", "")
    made = lambda kind, length, parts, **more: F.struct(
        F.lit(kind).alias("kind"), (F.lit(length) if isinstance(length, int) else length).cast("int").alias("length"), parts.cast(f"array<{PART}>").alias("parts"),
        *[(more.get(c, F.lit(None)).cast("string")).alias(c) for c in ("lead", "expr", "tail", "upper")],
    )
    none = F.lit(False)

    # max or min, a variable, the upper bound, the formula, the lower bound
    clean = F.when(col("body3") != "", F.col("body3")).otherwise(F.col("t3"))
    summand = F.concat(F.lit(r"(?s)^(.*?)([A-Za-zα-ωΑ-Ω][A-Za-z0-9_α-ωΑ-Ω]*\s*\(\s*"), F.substring(bare("t4"), 1, 1), F.lit(r"\s*\))(.*)$"))
    group = lambda k: F.call_function("regexp_extract", clean, summand, F.lit(k))
    total = F.concat(F.lit("∑_{"), bare("t4"), F.lit("}^{"), "t2", F.lit("} "))
    op = F.lower("t")
    text = F.concat(op, F.lit(" "), "t1", F.lit(" "), group(1), total, group(2), group(3))
    latex = F.concat(F.lit("\\"), op, F.lit("_{"), repair.identifier("t1"), F.lit("} "), tex(F.concat(group(1), F.lit("∑"), group(2), group(3)), bare("t4"), F.col("t2")))
    fits = (F.length("t") == 3) & op.isin("max", "min") & F.col("t4").isNotNull() & yes("piece1") & yes("number2") & yes("bound4") & ~col("t3").contains("∑") & (group(2) != "")
    most = F.when(fits, made("max_sum_layout", 5, F.array(_part("formula", "repaired_max_sum_layout", text, latex, yes("labelled3") | yes("numbered3")))))

    # a name with =, numerator, denominator, upper and lower bound, the summand, a number
    expr = F.when(col("t5").endswith("]") & ~col("t5").contains("["), F.concat(F.lit("["), "t5")).otherwise(F.col("t5"))
    lhs = F.replace(F.col("t"), F.lit(" "), F.lit(""))
    text = F.concat(lhs, "t1", F.lit("/"), "t2", F.lit(" ∑_{"), bare("t4"), F.lit("}^{"), "t3", F.lit("} "), expr)
    latex = F.concat(repair.identifier(F.regexp_replace(lhs, "=+$", "")), F.lit(r"=\frac{"), tex("t1"), F.lit("}{"), tex("t2"), F.lit("}"), tex(F.concat(F.lit("∑"), expr), bare("t4"), F.col("t3")))
    fits = F.col("t").endswith("=") & F.col("t").rlike(FRACTION) & (col("t1") != "") & (col("t2") != "") & yes("number3") & yes("bound4") & col("t5").rlike("[A-Za-z∆ΔλΛμ]")
    fraction = F.when(fits, made("fraction_sum_layout", F.when(yes("label6"), 7).otherwise(6), F.array(_part("formula", "repaired_fraction_sum_layout", text, latex, yes("label6")))))

    # numbers, a sum, a lower bound for each number
    numbers = F.regexp_extract_all("t", F.lit(r"(\d+)"), F.lit(1))
    follow = F.array(*[yes(f"bound{k}") for k in range(2, REACH)])
    first_other = F.array_position(F.concat(follow, F.array(none)), False) - 1
    bounds = F.least(first_other, F.size(numbers).cast("long"))
    body = _part("formula", "repaired_sum_bounds", F.col("parted1"), tex("parted1", bare("t2"), F.get(numbers, F.lit(0))), yes("labelled1") | yes("numbered1"))
    summed = F.when(col("t1").contains("∑") & yes("bound2") & (F.size(numbers) > 0) & (bounds > 0), made("sum_bounds", 2 + bounds, F.array(body)))

    # an upper bound, an indexed expression without its sum, a lower bound
    fits = F.col("number") & F.col("t2").isNotNull() & ~col("t1").contains("∑") & yes("bound2") & col("t1").rlike(INDEXED)
    missing = F.when(fits, made("missing_sum_symbol", 3, F.array(_sum("missing_sum_symbol", F.lit(""), bare("t2"), F.col("t"), F.col("t1"), yes("numbered1")))))

    # a sum with its upper bound, the summand
    upper, cut = F.regexp_extract("t", r"^∑\s*(\d+)$", 1), repair.prose_tail("t1")
    prefix = F.when(F.col("t").startswith("∑") & (upper != ""), let(F.struct(cut["formula"].alias("f"), cut["tail"].alias("tail"), repair.sum_start(cut["formula"]).alias("low")), lambda c: F.when(
        c["f"] != "", made("sum_prefix", 2, F.concat(F.array(F.when(c["low"].isNotNull(), _sum("sum_prefix", F.lit(""), c["low"], upper, c["f"], none)).otherwise(_problem(F.concat("t", F.lit(" "), c["f"])))), _tail(c["tail"]))))))

    # a name with = and an open sum, the summand; the index may come from before
    g = lambda k: F.regexp_extract("t", OPEN_SUM, k)
    before = F.filter(F.array(_part("text", "", strip(g(1)), F.lit(None), none)), lambda p: p["text"] != "")
    opened = F.when(F.col("t").rlike(OPEN_SUM), let(F.struct(cut["formula"].alias("f"), cut["tail"].alias("tail"), repair.sum_start(cut["formula"]).alias("low")), lambda c: F.when(
        c["f"] != "", made("labeled_sum_continuation", 2, F.concat(before, F.array(F.when(c["low"].isNotNull(), _sum("labeled_sum_continuation", bare(g(2)), c["low"], g(3), c["f"], none)).otherwise(_problem(F.concat(bare(g(2)), F.lit("∑"), g(3), F.lit(" "), c["f"])))), _tail(c["tail"])),
        lead=bare(g(2)), expr=c["f"], tail=c["tail"], upper=F.when(c["low"].isNull(), g(3))))))

    # the same within one item
    q = lambda k: F.regexp_extract("t", CLOSED_SUM, k)
    own = repair.prose_tail(q(3))
    inline = F.when(F.col("t").rlike(CLOSED_SUM), let(F.struct(own["formula"].alias("f"), own["tail"].alias("tail"), repair.sum_start(own["formula"]).alias("low")), lambda c: F.when(
        (c["f"] != "") & (c["low"].isNotNull() | (q(2) == TERMS)), made("inline_sum_missing_lower", 1, F.concat(F.array(F.when(c["low"].isNotNull(), _sum("inline_sum_missing_lower", bare(q(1)), c["low"], q(2), c["f"], F.col("numbered"))).otherwise(_part("item", "", F.col("text"), F.lit(None), F.col("numbered")))), _tail(c["tail"])),
        lead=bare(q(1)), expr=c["f"], tail=c["tail"], upper=F.when(c["low"].isNull(), q(2))))))
    return t.withColumn("m", F.coalesce(F.when(F.col("piece"), F.coalesce(most, fraction, summed, missing, prefix)), F.when(F.col("t").contains("∑"), F.coalesce(opened, inline))))


def _told(text: Column) -> Column:
    """The index that a text tells of a sum over TERMS, else null."""
    told = F.regexp_replace(F.regexp_extract(text, rf"∑_\{{\s*([A-Za-z]\s*=\s*1)\s*\}}\^\{{\s*{TERMS}\s*\}}", 1), r"\s+", "")
    return F.when(text.contains("∑") & text.contains(TERMS), F.when(told != "", told).otherwise(repair.sum_start(text)))


_BOUNDED = re.compile(rf"∑_\{{\s*([A-Za-z]\s*=\s*1)\s*\}}\^\{{\s*{TERMS}\s*\}}", re.A)
_INDEXES = [re.compile(p, re.A) for p in (r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]*\s*\(\s*([A-Za-z])\s*\)", r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]*\s*_\s*([A-Za-z])(?![A-Za-z0-9_])")]


def _told_by(side: dict) -> str | None:
    """_told of a side of a cluster."""
    text = f"{side['name']}=({side['body']})/({side['divisor']})" + "×100%" * side["percent"]
    if "∑" not in text or TERMS not in text:
        return None
    found = _BOUNDED.search(text)
    letters = {x for p in _INDEXES for x in p.findall(text)}
    return re.sub(r"\s+", "", found[1]) if found else letters.pop() + "=1" if len(letters) == 1 else None


def _clusters(buf, until: int) -> dict[int, tuple[int, list[dict]]]:
    """Length and sides of the clusters of ratios by the place of their first name, of runs that end before `until`: a name,
    a right side with 100, then pieces with a divisor and the next name, and so on; pieces behind the last right side are its
    divisor. A cluster reaches to the end of the unbroken run of right sides and pieces that it lies in."""
    flag = lambda c: buf.column(c).to_numpy(zero_copy_only=False)
    ratio, starts, found = flag("ratio"), flag("n") == 0, {}
    places = np.flatnonzero(ratio[:until])
    if not len(places):
        return found
    inside, named = ratio | flag("scrap"), flag("named")
    breaks = np.flatnonzero(~inside | starts)
    ends = np.append(breaks, until)[np.searchsorted(breaks, places, side="right")]
    text, k = buf.column("t"), len(places) - 1
    while k >= 0:  # run by run from the last, in a run from its last side on
        end = to = int(ends[k])
        sides: list[dict] = []
        fits = True
        while k >= 0 and ends[k] == end:
            at = int(places[k])
            pieces = [(i, text[i].as_py()) for i in range(at + 1, to)] if fits else []
            name = next((p for p in pieces if buf.column("variable")[p[0]].as_py()), None) if to < end else None
            fits = fits and (len(pieces) > 0 if to == end else name is not None and len(pieces) > 1)
            if fits:
                body = buf.column("side")[at].as_py()
                divisor = "".join(p[1] for p in pieces if p is not name)
                sides.append({"next": name and name[1], **{c: body[c] for c in ("body", "percent")}, "divisor": divisor, "numbered": buf.column("numbered")[at].as_py()})
                if len(sides) > 1 and at > 0 and not starts[at] and named[at - 1]:
                    found[at - 1] = (end - at + 1, len(sides), sides)
            to, k = at, k - 1
    return found


def _walk(batches):
    """Items in the order of their documents with `put` (0: gone, 1: as it is, 2: its match is taken, 3: a cluster of ratios
    is), `sides` of the cluster, and whether its sum has found its index (`resolved`). What is held back is the last run."""
    s = {}

    def reset():
        s.update(end=-1, n=0, at=0, last=-LOOK_BACK - 1, told="", shift=0)

    def happened(at, first, asks, told, spare):
        found = asks and first - s["shift"] - s["last"] <= LOOK_BACK and s["told"] == INDEX
        told = INDEX if found else told
        if told is not None:
            s.update(last=at - s["shift"], told=told)
        if asks and not found:
            s["shift"] += spare
        return found

    def walked(buf, stop, until):
        flag = lambda c: buf.column(c).to_numpy(zero_copy_only=False)
        n, heads = flag("n"), _clusters(buf, until)
        docs = np.cumsum(n == 0)
        put, resolved, sides = np.ones(stop, dtype=np.int32), np.zeros(stop, dtype=bool), [None] * stop
        if stop and docs[0] == 0 and s["end"] >= n[0]:
            put[: min(s["end"] - n[0] + 1, int(np.argmax(docs[:stop] > 0)) if docs[stop - 1] else stop)] = 0
        kinds, tolds, bounds = buf.column("kind"), buf.column("told"), flag("bounded")
        asked = np.asarray(kinds.is_valid()) | np.asarray(tolds.is_valid()) | bounds
        asked[list(heads)] = True
        doc = 0
        for i in np.flatnonzero(asked[:stop]).tolist():
            if docs[i] != doc:
                doc = docs[i]
                reset()
            here = int(n[i])
            if here <= s["end"]:
                continue
            kind, first = kinds[i].as_py(), s["at"] + here - s["n"] + 1
            if i in heads and kind not in EARLY:
                length, known, whole = heads[i]
                name, own = buf.column("t")[i].as_py(), []
                for side in reversed(whole[:known]):  # they were put together from the last one on
                    own.append({c: name if c == "name" else side[c] for c in ("name", "body", "percent", "divisor", "numbered")})
                    name = side["next"]
                events = [(False, _told_by(x)) for x in own]
                put[i], sides[i], spare = 3, own, 0
            elif kind is not None:
                length, spare = buf.column("length")[i].as_py(), buf.column("spare")[i].as_py()
                events = [(e["asks"], e["told"]) for e in buf.column("events")[i].as_py()]
                put[i] = 2
            elif bounds[i] and i + 1 in heads and docs[i + 1] == docs[i] and kinds[i + 1].as_py() not in EARLY:
                put[i] = 0
                s.update(at=first - 1, n=here + 1)
                continue
            else:
                happened(first, first, False, tolds[i].as_py(), 0)
                continue
            for k, (asks, told) in enumerate(events):
                resolved[i] |= happened(first + k, first, asks, told, spare)
            s.update(at=first + len(events) - 1, n=here + length, end=here + length - 1)
            put[i + 1 : i + length] = 0
        if stop and docs[stop - 1] != doc:
            reset()
        cut = buf.slice(0, stop)
        return pa.RecordBatch.from_arrays([*(cut.column(c) for c in _KEPT), pa.array(put), pa.array(sides, _SIDES), pa.array(resolved)], names=[*_KEPT, "put", "sides", "resolved"])

    reset()
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        buf = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        first = buf.column("n").to_numpy() == 0
        breaks = np.flatnonzero(first | ~(buf.column("ratio").to_numpy(zero_copy_only=False) | buf.column("scrap").to_numpy(zero_copy_only=False)))
        until = int(breaks[-1]) if len(breaks) else 0
        # The row before the run's first name may be a bound that goes with it.
        stop = until if first[until] else max(until - 1, 0)
        if stop:
            yield walked(buf, stop, until)
        held = buf.slice(stop)
    if held is not None and held.num_rows:
        yield walked(held, held.num_rows, held.num_rows)


_KEPT = ["doc_id", "ord", "text", "numbered", "m"]
_SIDES = pa.list_(pa.struct([("name", pa.string()), ("body", pa.string()), ("percent", pa.bool_()), ("divisor", pa.string()), ("numbered", pa.bool_())]))


def repaired(items: DataFrame) -> DataFrame:
    """doc_id, ord, place, role, source, text, latex and numbered of items(doc_id, ord, text, formula, numbered) with split
    formulas put together; formula: whether an item is one. role is item for those left as they are.

    Patterns are tried in the order of _matches, a cluster of ratios behind EARLY; a match takes its items, and the next
    begins behind it. A cluster of ratios takes a bound right before it (`i = 1`) along. A sum over 24 terms without an index
    takes t=1 if of the 12 rows put out before it the last that tells the index of such a sum tells that one.
    """
    t = _matches(_facts(items))
    late = F.coalesce(F.col("m.upper") == TERMS, F.lit(False))
    kinds = ("labeled_sum_continuation", "inline_sum_missing_lower")
    events = F.transform("m.parts", lambda p: F.struct((late & p["role"].isin("formula_problem", "item")).alias("asks"), _told(col(p["text"])).alias("told")))
    body = let(strip(F.regexp_replace(F.col("t"), "^=+", "")), lambda x: repair.percentage(formula.without_labels(x)))
    t = t.select(
        "doc_id", "ord", "n", F.when(F.col("piece") | F.col("ratio"), F.col("t")).alias("t"), "text", "numbered", "m", F.col("m.kind").alias("kind"), F.col("m.length").alias("length"), events.alias("events"), _told(col("text")).alias("told"), F.col("bound").alias("bounded"),
        F.when(F.col("m.kind") == kinds[1], F.least(F.length("m.tail"), F.lit(1))).otherwise(0).alias("spare"), "ratio", (F.col("piece") & ~F.col("like")).alias("scrap"), "variable", (F.col("piece") & F.col("variable")).alias("named"),
        F.when(F.col("ratio"), body).alias("side"),
    ).sortWithinPartitions("doc_id", "n")
    extra = T.StructType.fromDDL(f"put int, sides {SIDE}, resolved boolean")
    t = t.mapInArrow(_walk, T.StructType([t.schema[c] for c in _KEPT] + extra.fields)).where("put > 0")

    single = F.array(_part("item", "", F.col("text"), F.lit(None), F.col("numbered")).cast(PART))
    t = t.withColumn("m", F.when(F.col("put") == 2, F.col("m")))
    made = F.when(F.col("put") == 2, F.col("m.parts")).when(F.col("put") == 3, F.transform("sides", _ratio).cast(f"array<{PART}>")).otherwise(single)
    rows = t.select("doc_id", "ord", "m.kind", "m.lead", "m.expr", late.alias("late"), "resolved", F.posexplode(made).alias("place", "part"))
    sums = F.coalesce(*[F.when(F.col("kind") == k, _sum(k, F.col("lead"), F.lit(INDEX), F.lit(TERMS), F.col("expr"), F.col("part.numbered"))) for k in kinds]).cast(PART)
    part = F.when(F.col("late") & F.col("resolved") & F.col("part.role").isin("formula_problem", "item"), sums).otherwise(F.col("part"))
    whole = ~(F.col("late") & ~F.col("resolved") & F.coalesce(F.col("kind") == kinds[1], F.lit(False)) & (F.col("part.role") == "text"))
    return rows.where(whole).select("doc_id", "ord", "place", part.alias("p")).select("doc_id", "ord", "place", "p.*")
