"""The stages of the pipeline on small tables."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from quire.llm import linededup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def documents(seed=0):
    """Copies with words changed and lines broken anew, beside texts of their own."""
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(50, 150))]
        for _ in range(4):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(3000)}"
            texts.append("".join(w + rng.choice("    \n") for w in own))
    texts += ["a b", "A\nb", "a b c d e f", None, "", "\n"]
    rng.shuffle(texts)
    return texts


def staged(spark, data):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], SCHEMA).repartition(3)
    return [(r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, "").collect()]


def test_near_stage_finds_every_near_copy(spark):
    texts = documents()
    sets = [shingles(t) for t in texts]
    kept = [i for i in range(len(texts)) if not any(near(sets[i], sets[j]) for j in range(i))]
    assert sorted(i for i, _ in staged(spark, list(enumerate(texts)))) == kept and 20 < len(kept) < 90


def test_near_stage_with_many_candidates(spark, monkeypatch):
    monkeypatch.setattr(linededup, "FIRST", 1)
    monkeypatch.setattr(linededup, "BLOCK", 20)
    test_near_stage_finds_every_near_copy(spark)


def test_near_stage_goes_by_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = staged(spark, [(1, a), (1, b), (1, b), (2, a), (None, a), (None, "x y z"), (None, "x y z"), (None, "p q r")])
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, "x y z"), (None, "p q r")], key=str)


@pytest.mark.parametrize("n", [0, 1])
def test_near_stage_of_little(spark, n):
    assert len(staged(spark, [(1, "one")][:n])) == n


def test_benchmark_stage_goes_by_rows(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    data = [(None, f"so {item}"), (None, "clean"), (1, item), (1, "also clean"), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(None, "clean"), (1, "also clean"), (2, None)], key=str)


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    """Columns with the names that operators use, nulls, empty texts, repeated rows, an empty table."""
    text = " ".join(f"word{i} of a line" for i in range(30))
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some words that nobody else has written down here so far at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, text, "k1", 7, 5), (2, None, "k2", 7, 5), (3, "", "k3", 7, 5), (None, text + "\nmore " + text[::-1], "k4", 7, 5), (5, "a\nb", "k5", 7, 5)]
    docs = spark.createDataFrame([(*r[:2], "en", "s", 0, *r[2:]) for r in rows], SCHEMA + ", __key string, n_lines int, __id int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {r["__key"] for r in got} <= {"k1", "k2", "k3", "k4", "k5"} and all((r.n_lines, r["__id"]) == (7, 5) for r in got), name
        # The line that two rows share stays in one of them.
        assert name == "quality rules" or {"k1", "k4"} & {r["__key"] for r in got}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert len(corpus_pipeline.token_stage(spark, docs, str(tmp_path)).collect()) == 5


def test_stages_take_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], SCHEMA)
    for before, after in (("67108864b", "1048576b"), ("8388608b", "1048576b"), ("123456b", "123456b")):
        spark.conf.set(key, before)
        try:
            corpus_pipeline.token_stage(spark, docs, "")
            assert spark.conf.get(key) == after
        finally:
            spark.conf.unset(key)


def test_workers_keep_no_codec(spark):
    """A worker that has encoded gives its caches back when its task ends."""
    docs = spark.createDataFrame([(i, f"w{i} x{i}", "en", "s", 3) for i in range(40)], SCHEMA).repartition(4)
    assert corpus_pipeline.token_stage(spark, docs, "").count() == 40

    def held(batches):
        import gc

        for b in batches:
            n = sum(type(x).__name__ == "Codec" for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows, pa.int64())], names=["n"])

    assert spark.range(8).repartition(4).mapInArrow(held, "n long").agg({"n": "max"}).first()[0] == 0
