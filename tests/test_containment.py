"""Containment by grams against all pairs."""

import random

import pytest

from quire.operators import checks, containment, documents, outline


def test_holders(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    texts = [(d, i, word(rng.randint(0, 30))) for d in range(15) for i in range(20)] + [(3, 99, None)]
    keys = [(d, word(rng.choice([0, 1, 2, 3, 4, 5, 7]))) for d in range(16) for _ in range(15)] + [(d, t[3:12]) for d, _, t in texts if t and len(t) > 14] + [(2, None)]
    got = containment.holders(spark.createDataFrame(keys, "doc_id int, key string"), spark.createDataFrame(texts, "doc_id int, text_id int, text string").repartition(3))
    expected = {(d, k, i) for d, k in keys if k is not None for e, i, t in texts if e == d and t is not None and k in t}
    assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 500
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_missing_and_body_start(spark):
    e = spark.createDataFrame([(1, 1, "A b"), (1, 2, "zz"), (2, 1, "q"), (1, 3, "  ")], "doc_id int, ord int, text string")
    r = spark.createDataFrame([(1, "xAB"), (1, "xAB"), (1, None)], "doc_id int, text string")
    assert sorted((x.doc_id, x.ord) for x in documents.missing(e, r).collect()) == [(1, 2), (2, 1)]
    p = spark.createDataFrame([(1, 1, "Cover"), (1, 2, "Contents"), (1, 3, "My Title here"), (2, 1, "contents"), (2, 2, "x"), (3, 1, "Scope"), (3, 2, "Scope")], "doc_id int, ord int, text string")
    x = spark.createDataFrame([(1, 1, "title", "mytitle"), (3, 1, "h1", "scope")], "doc_id int, ord int, role string, text string")
    assert sorted(map(tuple, outline.body_start(p, x).collect())) == [(1, 2), (2, 1), (3, 1)]


def test_samples(spark):
    e = [(1, 1, 0, 0, "a b"), (1, 1, 0, 1, " "), (1, 1, 1, 0, "c"), (1, 1, 2, 0, "not asked"), (1, 2, 0, 0, ""), (2, 1, 0, 0, "x")]
    r = [(1, 5, "a"), (1, 6, "c ab"), (1, 7, "abc")]
    got = containment.tables_with_samples(spark.createDataFrame(e, "doc_id int, table_id int, row int, col int, text string"), spark.createDataFrame(r, "doc_id int, ord int, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 1, 6), (1, 2, None), (2, 1, None)]


@pytest.mark.parametrize("few", [4, 64])
def test_held_and_unheld(spark, monkeypatch, few):
    """Both ways: documents with few texts by comparison, those with more by grams."""
    monkeypatch.setattr(containment, "FEW", few)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [(d, i, word(rng.randint(0, 25))) for d in range(12) for i in range(d)] + [(11, 0, None), (11, 30, "abcab")]
    keys = [(d, i, word(rng.choice([0, 1, 3, 4, 6]))) for d in range(13) for i in range(12)] + [(9, 50, "a"), (9, 51, "a"), (9, 52, None), (None, 53, "a")]
    k, t = spark.createDataFrame(keys, "doc_id int, n int, key string"), spark.createDataFrame(texts, "doc_id int, text_id int, text string").repartition(3)
    of = lambda d, x: {i for e, i, s in texts if e == d and None not in (s, x) and x in s}
    assert sorted(map(tuple, containment.holders(k, t).collect())) == sorted((d, n, x, i) for d, n, x in keys for i in of(d, x))
    assert sorted(r.n + 100 * (r.doc_id or 0) for r in containment.unheld(k, t).collect()) == sorted(n + 100 * (d or 0) for d, n, x in keys if not of(d, x))
    whole = {(d, s) for d, _, s in texts}
    left = [n + 100 * (d or 0) for d, n, x in keys if x is None or (d, x) not in whole and (len(x) < 4 or not of(d, x))]
    assert sorted(r.n + 100 * (r.doc_id or 0) for r in containment.unheld(k, t, 4).collect()) == sorted(left)


def test_few_texts_make_no_grams(spark):
    """Documents of a few texts shuffle neither grams nor anything else that grows with the texts' characters."""
    e = spark.createDataFrame([(1, 1, "A part of supplier 12"), (2, 1, "zz")], "doc_id int, ord int, text string")
    r = spark.createDataFrame([(1, "see a part of supplier 123!"), (2, "q")], "doc_id int, text string")
    for out in (documents.missing(e, r), checks.recovered(e, r)):
        assert [(x.doc_id, x.ord) for x in out.collect()] == [(2, 1)]
        assert "explode" not in out._jdf.queryExecution().toString().lower()
