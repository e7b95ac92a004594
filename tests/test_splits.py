"""Repair of split formulas against a pass from item to item."""

import random
import re

import pytest

from quire.operators import splits

ITEMS = [
    "max", "min", "x", "P", "24", "12", "1 24", "t=1", "i = 1", "t = 1", "E(t)+2P", "C = R(t)·3", "E =", "RE=", "a1", "b2/c", "[P(t)-Q]", "P(t)-Q]", "(3-1)", "A = ∑ P(t) (2-5)", "B=∑Q", "∑24", "∑ 12", "P(t)+Q(t)", "P+Q", "P(t) 表示功率",
    "= m / n × 100%", "=k×100%", "= (a+b) × 100", "rself", "rgreen", "Etotal", "Ebuy", "E = ∑24", "成本 C=∑ 24", "F=∑12", "G=∑ 24 P+Q", "H=∑24 P(t)+Q 其中", "K = ∑ 24 P+λab，其中功率", "L=∑12 P+Q", "prose about orders", "∑_{t=1}^{24} P(t)", "∑_{i=1}^{24} P(i)",
    "∆P", "这是正文", "",
]
GREEK = {"∆": r"\Delta", "Δ": r"\Delta", "λ": r"\lambda", "Λ": r"\Lambda", "μ": r"\mu", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma"}


def name(x):
    x = "".join(x.split())
    if x in GREEK:
        return GREEK[x]
    if re.fullmatch("[∆Δ][A-Za-z0-9]+", x):
        return GREEK[x[0]] + " " + name(x[1:])
    if re.fullmatch("[λΛμ][A-Za-z0-9]+", x):
        return GREEK[x[0]] + r"_{\mathrm{" + x[1:] + "}}"
    return x[0] + r"_{\mathrm{" + x[1:] + "}}" if re.fullmatch("[A-Za-z][A-Za-z0-9]+", x) else x


def tex(x, bounds=None):
    for a, b in {"×": r"\times ", "·": r"\cdot ", "÷": r"\div ", "%": r"\%"}.items():
        x = x.replace(a, b)
    x = x.replace("∑", r"\sum" + ("_{%s}^{%s}" % bounds if bounds else ""))
    x = re.sub("[∆ΔλΛμ][A-Za-z0-9]*", lambda m: name(m[0]), x)
    return " ".join(re.sub(r"(?<![\\{])\b[A-Za-z][A-Za-z0-9]*\b", lambda m: name(m[0]), x).split())


def cut(x):
    m = re.search("[一-鿿]", x)
    return (x, "") if not m else (x[: m.start()].strip().rstrip("，,。;；"), x[m.start() :].strip())


def index(x):
    found = set(re.findall(r"\b[A-Za-z][A-Za-z0-9]*\s*\(\s*([A-Za-z])\s*\)|\b[A-Za-z][A-Za-z0-9]*\s*_\s*([A-Za-z])\b", x))
    found = {a or b for a, b in found}
    return found.pop() + "=1" if len(found) == 1 else None


def total(kind, lead, low, up, expr, numbered=False):
    return ("formula", "repaired_" + kind, f"{lead}∑_{{{low}}}^{{{up}}} {expr}", tex(f"{lead}∑{expr}", (low, up)), numbered)


def before(out, up):
    for row in reversed(out[-12:]):
        m = re.search(r"∑_\{\s*([A-Za-z]\s*=\s*1)\s*\}\^\{\s*" + up + r"\s*\}", row[2])
        low = "".join(m[1].split()) if m else index(row[2]) if "∑" in row[2] and up in row[2] else None
        if low:
            return low if (up, low) == ("24", "t=1") else None
    return None


def walked(items):
    out, i = [], 0
    at = lambda k: items[k][0].strip() if k < len(items) else None
    squeezed = lambda x: "".join(x.split())
    piece = lambda k: k < len(items) and bool(re.fullmatch(r"[A-Za-z0-9_\s∆ΔλΛµμ%+\-*/·×÷=<>≤≥≈∈∑().,α-ωΑ-Ω]{1,18}", at(k)))
    bound = lambda k: k < len(items) and bool(re.fullmatch(r"[A-Za-z]\s*=\s*\d+", at(k)))
    digits = lambda k: k < len(items) and at(k).isdigit()
    label = lambda x: re.fullmatch(r"\(\d+-\d+\)", x or "")
    tail = lambda x: [("text", "", x, None, False)] if x else []
    bad = lambda x: ("formula_problem", "split_sum_index_unknown", x, None, False)
    bare = lambda x: re.sub(r"\s*\(\d+-\d+\)$", "", x)
    while i < len(items):
        t, new, n = at(i), None, 1
        if piece(i):
            if t in ("max", "min") and i + 4 < len(items) and piece(i + 1) and digits(i + 2) and bound(i + 4) and "∑" not in at(i + 3):
                f = bare(at(i + 3)) or at(i + 3)
                low = squeezed(at(i + 4))
                if m := re.search(r"[A-Za-zα-ωΑ-Ω][A-Za-z0-9_α-ωΑ-Ω]*\s*\(\s*" + low[0] + r"\s*\)", f):
                    a, b = f[: m.start()], f[m.end() :]
                    text = f"{t} {at(i + 1)} {a}∑_{{{low}}}^{{{at(i + 2)}}} {m[0]}{b}"
                    new, n = [("formula", "repaired_max_sum_layout", text, f"\\{t}_{{{name(at(i + 1))}}} " + tex(f"{a}∑{m[0]}{b}", (low, at(i + 2))), bare(at(i + 3)) != at(i + 3) or items[i + 3][2])], 5
            if not new and re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*\s*=", t) and i + 5 < len(items) and at(i + 1) and at(i + 2) and digits(i + 3) and bound(i + 4) and re.search("[A-Za-z∆ΔλΛμ]", at(i + 5)):
                x = "[" * (at(i + 5).endswith("]") and "[" not in at(i + 5)) + at(i + 5)
                low, lhs, more = squeezed(at(i + 4)), t.replace(" ", ""), bool(label(at(i + 6)))
                latex = name(lhs[:-1]) + r"=\frac{" + tex(at(i + 1)) + "}{" + tex(at(i + 2)) + "}" + tex("∑" + x, (low, at(i + 3)))
                new, n = [("formula", "repaired_fraction_sum_layout", f"{lhs}{at(i + 1)}/{at(i + 2)} ∑_{{{low}}}^{{{at(i + 3)}}} {x}", latex, more)], 6 + more
            ups = re.findall(r"\d+", t)
            if not new and ups and "∑" in (at(i + 1) or ""):
                k = 0
                while k < len(ups) and bound(i + 2 + k):
                    k += 1
                if k:
                    f = bare(at(i + 1))
                    new, n = [("formula", "repaired_sum_bounds", f, tex(f, (squeezed(at(i + 2)), ups[0])), f != at(i + 1) or items[i + 1][2])], 2 + k
            if not new and digits(i) and bound(i + 2) and "∑" not in at(i + 1) and re.search(r"[A-Za-z][A-Za-z0-9]*\s*\(\s*[A-Za-z]\s*\)", at(i + 1)):
                new, n = [total("missing_sum_symbol", "", squeezed(at(i + 2)), t, at(i + 1), items[i + 1][2])], 3
            m = re.fullmatch(r"∑\s*(\d+)", t)
            if not new and m and (at(i + 1) or "") and cut(at(i + 1))[0]:
                x, rest = cut(at(i + 1))
                new, n = [total("sum_prefix", "", index(x), m[1], x) if index(x) else bad(f"{t} {x}"), *tail(rest)], 2
            side = lambda k: k < len(items) and items[k][1] and at(k).startswith("=") and "100" in at(k)
            if not new and re.fullmatch("[a-zα-ω][A-Za-z0-9_α-ωΑ-Ω]*", squeezed(t)) and side(i + 1):
                names, sides, under, k = [t], [i + 1], [], i + 2
                while names:
                    run = []
                    while piece(k) and not items[k][1]:
                        run.append(at(k))
                        k += 1
                    if side(k):
                        own = next((r for r in run if re.fullmatch("[a-zα-ω][A-Za-z0-9_α-ωΑ-Ω]*", squeezed(r))), None)
                        if own is None or len(run) < 2:
                            names = []
                            break
                        run.remove(own)
                        names.append(own)
                        sides.append(k)
                        k += 1
                    under += ["".join(run)] if run else []
                    if not side(k - 1) or not run:
                        break
                if len(names) > 1 and len(under) == len(names):
                    new = []
                    for v, s, u in zip(names, sides, under):
                        rhs = at(s).lstrip("=").strip()
                        p = re.fullmatch(r"(.*?)(?:[×x*]\s*100\s*%)", rhs)
                        top, hundred = (p[1].strip(), "×100%") if p else (rhs, "")
                        new.append(("formula", "repaired_ratio_cluster", f"{v}=({top})/({u}){hundred}", name(v) + r"=\frac{" + tex(top) + "}{" + name(u) + "}" + (r"\times100\%" if hundred else ""), items[s][2]))
                    n = k - i
                    if out and re.fullmatch(r"[A-Za-z]\s*=\s*\d+", out[-1][2].strip()):
                        out.pop()
        if not new and (m := re.fullmatch(r"(.*?)([A-Za-z][A-Za-z0-9_,]*\s*=\s*)∑\s*(\d+)\s*", t)) and at(i + 1) and cut(at(i + 1))[0]:
            (x, rest), lead = cut(at(i + 1)), squeezed(m[2])
            low = index(x) or before(out, m[3])
            new, n = [*tail(m[1].strip()), total("labeled_sum_continuation", lead, low, m[3], x) if low else bad(f"{lead}∑{m[3]} {x}"), *tail(rest)], 2
        if not new and (m := re.fullmatch(r"([A-Za-z][A-Za-z0-9_,]*\s*=\s*)∑\s*(\d+)\s+(.+)", t)) and cut(m[3])[0]:
            x, rest = cut(m[3])
            if low := index(x) or before(out, m[2]):
                new, n = [total("inline_sum_missing_lower", squeezed(m[1]), low, m[2], x, items[i][2]), *tail(rest)], 1
        out += new or [("item", "", items[i][0], None, items[i][2])]
        i += n
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    forms = [["max", "x", "24", "C = R(t)·3", "t=1"], ["E =", "a1", "b2/c", "24", "t=1", "P(t)-Q]", "(3-1)"], ["1 24", "A = ∑ P(t) (2-5)", "t=1", "i = 1"], ["24", "E(t)+2P", "t = 1"], ["∑24", "P(t)+Q(t)"], ["∑ 12", "P+Q"], ["i = 1", "rself", "= m / n × 100%", "Etotal", "rgreen", "=k×100%", "Ebuy"], ["成本 C=∑ 24", "P+Q"], ["G=∑ 24 P+Q", "K = ∑ 24 P+λab，其中功率"], ["H=∑24 P(t)+Q 其中"], ["rself", "= m / n × 100%", "P", "x", "=k×100%", "a1", "rup", "= (a+b) × 100", "24"]]
    out = []
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 12)):
            form = list(rng.choice(forms)) if rng.random() < 0.75 else [rng.choice(ITEMS)]
            if rng.random() < 0.2:
                form[rng.randrange(len(form))] = rng.choice(ITEMS)
            texts += form
        out.append([(x, x.startswith("=") or "∑" in x and rng.random() < 0.5, rng.random() < 0.2) for x in texts])
    return out


def test_repairs(spark, docs):
    rows = [(d, i * 3, *item) for d, items in enumerate(docs) for i, item in enumerate(items)]
    table = spark.createDataFrame(rows, "doc_id long, ord long, text string, formula boolean, numbered boolean").repartition(5)
    got = {}
    for r in splits.repaired(table).orderBy("doc_id", "ord", "place").collect():
        got.setdefault(r.doc_id, []).append((r.role, r.source, r.text, r.latex, r.numbered))
    expected = {d: walked(items) for d, items in enumerate(docs)}
    bad = [(d, [x for x in zip(got[d], e) if x[0] != x[1]][:2], len(got[d]), len(e), [x[0] for x in docs[d]]) for d, e in expected.items() if got[d] != e]
    assert not bad, (len(bad), bad[0])
    sources = [r[1] for e in expected.values() for r in e]
    assert all(sources.count("repaired_" + k) > 8 for k in ("max_sum_layout", "fraction_sum_layout", "sum_bounds", "missing_sum_symbol", "sum_prefix", "ratio_cluster", "labeled_sum_continuation", "inline_sum_missing_lower"))
    assert splits.repaired(table.limit(0)).count() == 0


def test_documents_pass_in_small_batches_and_nothing_is_written(spark, monkeypatch):
    """Clusters of several ratios, bounds before them and sums that look back, cut by batches at every place."""
    from quire.operators import state

    def written(*_):
        raise AssertionError("a table was written")

    monkeypatch.setattr(state, "new_path", written)
    cluster = ["i = 1", "ra", "=m/n×100%", "Ea", "rb", "=k/l×100%", "Eb", "rc", "=o×100%", "Ec"]
    texts = ["text", *cluster, "plain words", "E = ∑24", "P(t)+Q", "G=∑24 P+Q 其中", *cluster, "这是正文", *cluster[1:], "x"]
    rows = [(d, i, x, x.startswith("="), False) for d in range(4) for i, x in enumerate(texts[d:])]
    t = spark.createDataFrame(rows, "doc_id long, ord long, text string, formula boolean, numbered boolean")
    run = lambda: sorted(map(tuple, splits.repaired(t).select("doc_id", "ord", "place", "role", "source", "text", "numbered").collect()))
    whole = run()
    names = [r[5].split("=")[0] for r in whole if r[0] == 0 and r[4] == "repaired_ratio_cluster"]
    assert names == ["ra", "rb", "rc"] * 3 and not any(r[5] == "i = 1" for r in whole if r[0] == 0)
    try:
        for n in (1, 2, 3, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
            assert run() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
