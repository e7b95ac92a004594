"""Hard negatives, repeated byte strings and Merkle manifests against brute force."""

import hashlib
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import bwt, merkle, negatives, wrappers

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


# 11 Hard negatives


def mined(data, every=4, k=3, most=4, low=30, high=90):
    """Anchor, positive, rank, negative and scores by a full scan; rows count by their place."""
    rows = [(i, d, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, (d, v, y) in enumerate(data) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, d, v, y in rows:
        if d is None or d % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w)), math.inf if e is None else e, b, e, z) for b, e, w, z in rows if b != a), key=lambda x: x[:3])
        for p in [s for s in scored if s[4] == y][:k]:
            hard = [s for s in scored if s[4] != y and low * -p[0] <= 100 * -s[0] <= high * -p[0]][:most]
            out += [(d, p[3], r + 1, s[3], -p[0], -s[0]) for r, s in enumerate(hard)]
    return out


def vectors(n=220, width=6, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        center = [1.0 if j == i % 3 else 0.4 for j in range(width)]
        v = [round(c + rng.gauss(0, 0.2), 2) for c in center]
        data.append((i, v, 0 if i % 3 == 0 else rng.randrange(4)))
    data += [(i, data[0][1], 0 if i % 2 else 1) for i in range(300, 340)]  # a group of copies
    data += [(340, None, 1), (344, [1.0, None, 0.0], 1), (348, [1.0, float("nan")], 1), (352, [float("inf")], 2), (356, [1.0, 1.0], None), (360, [], 1), (364, [1.0], 1), (None, data[4][1], 1)]
    return [*data, data[4], data[4], data[5]]


@pytest.mark.parametrize("parts", [1, 5])
def test_hard_negatives(spark, parts, monkeypatch):
    monkeypatch.setattr(negatives, "FIRST", 1)
    monkeypatch.setattr(negatives, "FACTOR", 2)
    data = vectors()
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("q", F.lit("x")).withColumn("row", F.lit(1)).repartition(parts)
    got = negatives.mine(table, F.col("vec_id") % 4 == 0, positives=3, negatives=4)
    # Repeated rows have results of their own, and equal ids among results are equal rows.
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, mined(data)))


def test_hard_negatives_beyond_exact_doubles(spark):
    rng = random.Random(2)
    data = [(i, [rng.randrange(1, 1 << 22) * 1.0, rng.randrange(1, 1 << 22) * 1.0], i % 2) for i in range(40)]
    got = negatives.mine(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 4 == 0, positives=3, negatives=4)
    assert sorted(map(tuple, got.collect())) == sorted(mined(data)) and len(mined(data)) > 40


def test_centers_are_fitted_in_bounded_steps():
    """The driver holds a step of the distances, not those of all sampled rows to all centers (here 131 MB)."""
    x = np.floor(np.random.default_rng(4).normal(size=(4000, 4)) * 256)
    whole = lambda c: np.argmin((c**2).sum(axis=1) - 2 * (x @ c.T), axis=1)
    tracemalloc.start()
    centers = negatives.kmeans(x, 4096, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(centers) > 3000 and peak < 40 << 20
    assert (negatives.nearest(x, centers) == whole(centers)).all() and len(negatives.nearest(x[:0], centers)) == 0


def test_chunks_of_queries_are_not_broadcast(spark, monkeypatch):
    plans = []
    stored = negatives.stored
    monkeypatch.setattr(negatives, "stored", lambda df, name, **more: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), stored(df, name, **more))[1])
    negatives.mine(spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 4 == 0)
    found = [plan for name, plan in plans if name == "found"]
    assert found and all("SortMergeJoin [list" in plan and "BroadcastHashJoin [list" not in plan for plan in found)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(none, F.lit(True)).count() == 0


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(3000, 8)) * 256)
    centers = negatives.kmeans(x, 40)
    own = negatives.nearest(x, centers)
    radii = np.array([np.sqrt(((x[own == i] - centers[i]) ** 2).sum(axis=1)).max() if (own == i).any() else -1 for i in range(len(centers))])
    low, high = negatives.bounds(x[:50], centers, radii)
    scores = x[:50] @ x.T
    assert (scores <= high[:, own]).all() and (scores >= low[:, own]).all()
    went, done = negatives.next_lists(low[0], high[0], [{"lo": -(10**9), "hi": 10**9, "kth": int(np.sort(scores[0])[-3])}], 0, 100)
    assert len(went) < len(centers) and set(own[np.argsort(scores[0])[-3:]]) <= set(went) and done <= len(centers)


# 12 Repeated strings


def without_repeats(rows, length):
    """kept and spans by (doc_id, text), place by place."""
    docs = sorted({(d is None, d or 0, hashlib.md5(f"{'-' if d is None else d}:{t or ''}".encode()).digest(), (t or "").encode()) for d, t in rows})
    seen, out = set(), {}
    for none, d, _, text in docs:
        cut = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            if window in seen:
                cut[i : i + length] = True
            seen.add(window)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(int), [0]])))
        out[(None if none else d, text)] = (bytes(b for b, c in zip(text, cut) if not c), [tuple(map(int, e)) for e in edges.reshape(-1, 2)])
    return out


def passages(seed=4, n=50):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(shared) if rng.random() < 0.3 else word() for _ in range(rng.randint(1, 30)))
        rows.append((i * 3 % n, text))
    rows += [(100, None), (101, ""), (102, "x" * 900), (103, "y" + "x" * 400), (104, "ab" * 200), (105, "0123456789" * 30), (106, rows[0][1]), (106, rows[1][1]), (106, rows[1][1]), (None, rows[2][1]), (None, "zz " + rows[3][1]), (107, "x" * 29), (108, "x" * 30), (109, shared[0][-40:] + "é" + shared[1])]
    return rows


@pytest.mark.parametrize("bucket, most, parts", [(1 << 20, 1 << 26, 1), (300, 1 << 26, 6), (1 << 20, 0, 6), (3000, 0, 3)])
def test_repeats_go(spark, monkeypatch, bucket, most, parts):
    monkeypatch.setattr(bwt, "BUCKET", bucket)
    monkeypatch.setattr(bwt, "NAME", bucket)
    monkeypatch.setattr(bwt, "BROADCAST_BYTES", most)
    rows = passages()
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("name", F.lit(2)).withColumn("__key", F.lit(3)).withColumn("__spans", F.lit(4)).repartition(parts)
    got = bwt.remove_repeats(table, 30).collect()
    expected = without_repeats(rows, 30)
    assert len(got) == len(rows)
    for r in got:
        kept, spans = expected[(r.doc_id, (r.text or "").encode())]
        assert (bytes(r.kept), [tuple(s) for s in r.spans]) == (kept, spans) and (r.key, r.name, r["__key"], r["__spans"]) == (1, 2, 3, 4)
    assert sum(len(s) for _, s in expected.values()) > 60


def test_one_passage_in_many_contexts(spark, monkeypatch):
    """Its first gram names a piece in every document, more than a bucket holds."""
    monkeypatch.setattr(bwt, "BUCKET", 2000)
    monkeypatch.setattr(bwt, "NAME", 2000)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = text(34)
    rows = [(i, text(60) + passage + text(60)) for i in range(150)]
    got = {r.doc_id: bytes(r.kept) for r in bwt.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 30).collect()}
    expected = without_repeats(rows, 30)
    assert got == {d: kept for (d, _), (kept, _) in expected.items()} and len(got[149]) < 130


def test_no_texts(spark):
    assert bwt.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in bwt.remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, None, [], b"")]


def test_merged_transforms_are_those_of_all_strings():
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(30)]
    strings += [strings[3], strings[0] * 3, b"a" * 300, b"a" * 200]
    parts = [strings[:7], strings[7:8], strings[8:]]
    shards = [bwt.transform(p) for p in parts]
    for p, (s, n) in zip(parts, shards):
        order = sorted([(x[at:], j) for j, x in enumerate(p) for at in range(len(x) + 1)])
        assert [(p[j][at:], j) for j, at in zip(*bwt.places(s, n, bwt.backwards(s)))] == order
    suffixes = [p[j][at:] for p, (s, n) in zip(parts, shards) for j, at in zip(*bwt.places(s, n, bwt.backwards(s)))]
    common, rows, interval = bwt.merge([s for s, _ in shards], 12)
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert common.tolist() == [min(12, max(shared(a, b) for j, b in enumerate(suffixes) if i != j)) for i, a in enumerate(suffixes)]
    by_two = bwt.merge([s for s, _ in shards], 12, step=2)
    assert by_two[0].tolist() == [c // 2 * 2 for c in common] and sorted(by_two[1].tolist()) == sorted(rows.tolist())
    assert bwt.merge([s for s, _ in shards], 11, step=2)[0].tolist() == [min(c // 2 * 2 + (c >= 11) if c >= 10 else c // 2 * 2, 11) for c in common]
    blocks = {}
    for row, i in zip(rows.tolist(), interval.tolist()):
        blocks.setdefault(i, []).append(row)
    groups = {}
    for row, x in enumerate(suffixes):
        if len(x) >= 12:
            groups.setdefault(x[:12], []).append(row)
    assert sorted(map(sorted, blocks.values())) == sorted(g for g in groups.values() if len(g) > 1) and len(blocks) > 3
    assert [suffixes[b[0]][:12] for _, b in sorted(blocks.items())] == sorted(k for k, g in groups.items() if len(g) > 1)


# 13 Merkle manifests


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def folded(nodes, fanout):
    """The top of a tree, and the siblings (left, right) of each leaf by level."""
    sides = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, held = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for k in range(len(run)):
                for leaf in under[at + k]:
                    sides[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(h(*run))
            held.append([x for u in under[at : at + fanout] for x in u])
        nodes, under = parents, held
    return nodes[0], sides


def manifest(rows, fanout):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(field, r))
    trees = {}
    for r in rows:
        trees.setdefault(("" if r[2] is None else "+" + r[2]).encode(), []).append(r)
    own = {}
    for k, t in sorted(trees.items()):
        t.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        own[k] = (t, *folded([leaf(r) for r in t], fanout))
    root, upper = folded([top for _, top, _ in own.values()], fanout)
    out = []
    for (t, top, sides), above in zip(own.values(), upper):
        for r, s in zip(t, sides):
            out.append((r[0], leaf(r), top, root, h(*[a + b for a, b in s + above])))
    return out


@pytest.mark.parametrize("fanout", [2, 3, 7])
def test_merkle_manifest(spark, fanout):
    rng = random.Random(fanout)
    rows = [(rng.randrange(60), rng.choice(["a", None]), rng.choice(["en", "en", "é", "", None, "z"]), rng.choice([None, 5, -7]), rng.choice(["", None, "1:x", "é" * 3000])) for _ in range(90)]
    rows += [(None, None, "lone", None, None), (None, "s", "en", 1, "t"), rows[0], rows[0]]
    table = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit(1)).withColumn("idx", F.lit(2)).repartition(5)
    out = merkle.verified(merkle.manifest(table, fanout), F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)))
    hexed = [merkle.as_text(F.col(c)) for c in ("leaf", "subroot", "root")]
    got = out.select("doc_id", *hexed, "proof_sha256", "verified", "n_chars").collect() if "n_chars" in out.columns else out.select("doc_id", *hexed, "proof_sha256", "verified").collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, manifest(rows, fanout)))
    changed = {h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r]) for r in rows if r[0] is not None and r[0] % 2 == 0 and r[3] is not None}
    assert all(r.verified == (r[1] not in changed) for r in got) and 10 < sum(r.verified for r in got) < len(got)


def test_small_manifests(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    one = merkle.verified(merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], DOCS)), F.lit(True)).select("leaf", "root", "verified", "proof_sha256").first()
    assert one.leaf == one.root and one.verified and one.proof_sha256 == h("")
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], DOCS), 1)


# 7 Main text: elements that hold none, left open or closed by themselves


def main_texts(*pages):
    streams = [wrappers.tokens(p) for p in pages]
    whole = None
    for s in streams:
        made = wrappers.Wrapper.of_page(s)
        whole = made if whole is None else whole.merge(made)
    roles = whole.roles()
    return [wrappers.main_text(s, roles) for s in streams]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>a</p><svg/><p>b</p></article>", "a b"),
        ("<article><p>a</p><svg><title>t</title><g>q</g></svg><p>b</p></article>", "a b"),
        ("<article><p>Let <math><mi>x</mi></math> be</p></article>", "Let x be"),
        ("<article><p>a <button>go</p><p>b</p></article>", "a b"),
        ("<article><p>a</p><select><option>1<option>2</select><p>b</p><object data=x>instead</object></article>", "a b instead"),
        ("<article>a<script>x<y</script>b<iframe src='x'/>c<iframe>d</iframe>e</article>", "a b c e"),
        ("<article><p>a</p><noscript><p>n</p></noscript><template><p>t</p></template><p>b</p></article>", "a b"),
    ],
)
def test_elements_without_text(page, text):
    assert main_texts(page) == [text]


def test_equal_pages_behave_alike_whatever_their_number():
    page = "<body><div class=a><p>Welcome to the site</p></div><div class=b><p>the same words</p></div></body>"
    for n in (1, 2, 3, 10):
        assert main_texts(*[page] * n) == ["Welcome to the site the same words"] * n
    for n in (2, 3, 10):  # pages that differ: what stays the same is the frame
        pages = [page.replace("the same words", f"words of page {i}") for i in range(n)]
        assert main_texts(*pages) == [f"words of page {i}" for i in range(n)]
