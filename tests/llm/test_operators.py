"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bitplanes, decontamination, lexicon, licenses, linededup, ppm, quality, queries, sharding, simhash, wrappers
from quire.llm.shared import span_hashes, text_buffer, word_spans

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


def rows(seed=0, n=60):
    rng = random.Random(seed)
    texts = ["\n".join(sentence(rng, rng.randint(1, 25)) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    for i in range(0, n, 5):  # near and exact copies
        parts = texts[i].split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        texts[(i + 2) % n] = " ".join(parts)
        texts[(i + 3) % n] = texts[i].upper() if i % 2 else texts[i]
    texts += [None, "", " \n\t ", "one", "two words", "\n\n", sentence(rng, 3000), "é ñ 中文 😀 the end", "<|endoftext|> a <|endoftext|>"]
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, "w1 w2 w3 w4", None, None, None)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Shared


def test_span_hashes_tell_spans_apart():
    data = np.frombuffer(b"ab ba ab abc a " + b"x" * 5000 + b" " + b"x" * 5001, np.uint8)
    h = span_hashes(data, *word_spans(data))
    assert h[0] == h[2] and len(set(h.tolist())) == len(h) - 1


# 1 License scans


def test_license_places_and_labels(spark):
    texts = ["Released under the MIT License.\nMIT License mit license", "nothing", None, "Licensed under CC BY-NC 4.0.", "GNU  General\nPublic\tLicense apache license,", "the apache", "Unter der MIT-License"]
    got = licenses.license_scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").withColumn("labels", F.lit(1)).withColumn("hits", F.lit(1)))
    got = {r.doc_id: r for r in got.collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].score) == (9, 3, 3, 7, "mit", 1.0)
    assert (got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, None, "", 0.0) and got[2].n_words == 0
    assert got[3].base_labels == "cc-by" and got[3].labels == "cc-by,cc-by-nc-4.0"
    assert got[4].base_labels == "apache,gpl" and got[4].n_base == 2 and got[5].n_base == 0 and got[6].n_base == 1


def test_license_notices_over_lines_and_words_far_apart(spark):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 500)
    words = mit.split()
    texts = [
        "some code\n\n" + "\n// ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\nmore code",
        "Permission is hereby granted, free of charge, to any person\n obtaining a copy of this software and associated\n documentation files",
        "The work released last year was sold under a name; the firm at MIT never held a license.",
        "Licensed under CC BY 4.0. " + "x " * 30 + "Licensed under CC BY-NC 4.0.",
        "x " * 300_000 + "released under the MIT license",
    ]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert [got[i].labels for i in range(5)] == ["mit", "mit", "", "cc-by,cc-by-4.0,cc-by-nc-4.0", "mit"]
    assert [got[i].score for i in (0, 1, 2)] == [1.0, 1.0, 0.0] and got[4].n_words == 300_005


def test_license_join_equals_all_pairs(spark):
    rng = random.Random(3)
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    texts = []
    for i in range(150):
        own = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join([*rng.sample(words, rng.randint(0, 9)), *own[rng.randint(0, 2) :], *rng.sample(words, rng.randint(0, 40))]))
    docs = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "__key long, words array<string>")
    ranks = licenses.token_ranks(docs, licenses.TEMPLATES)
    hits = docs.select("__key", licenses.known_places(F.col("words"), ranks, licenses.TEMPLATES, licenses.CONTAINMENT).alias("hits"))
    got = {(r["__key"], r.template, r.s): r.found for r in licenses.template_matches(hits, ranks).collect()}
    expected = {}
    for i, t in enumerate(texts):
        own = t.split()
        for j, (_, x) in enumerate(licenses.TEMPLATES):
            tokens, wide = set(x.split()), licenses.block_words(x)
            for s in range(len(own)):
                shared = len(tokens & set(own[s : s + wide]))
                if own[s] in tokens and shared >= licenses.CONTAINMENT * len(tokens) - 1e-9:
                    expected[i, j, s] = shared
    assert got == expected and len(expected) > 100


def test_license_empty(empty):
    assert licenses.license_scan(empty).count() == 0


# 2 Token-ID output


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_chunks_round_trip(kind):
    rng = np.random.default_rng(1)
    for ids in ([], [0], [0, 0], rng.integers(0, 49408, 1000), rng.integers(0, 2**32, 77)):
        ids = np.array(ids, "<u4")
        block = bitplanes.pack_chunk(ids, kind)
        assert (bitplanes.unpack_chunk(block) == ids).all()
    with pytest.raises(Exception):
        bitplanes.unpack_chunk(block[:-1] + bytes([block[-1] ^ 1]))


def test_joined_crc():
    parts = [b"abc", b"", b"x" * 300_000, b"yz"]
    assert bitplanes.joined_crc([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files(spark, table, kind):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bitplanes.write_ids(table, path, end_id=2, chunk_ids=256, kind=kind, partitions=4)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in bitplanes.read_documents(spark, out).collect()), key=lambda r: r[2])
    tokenizer = Tokenizer.from_file(path)
    expected, start = [], 0
    for i, t in sorted(((r[0], r[1]) for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i is not None, i or 0, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    chunks = bitplanes.read_ids(spark, out).orderBy("part", "chunk").collect()
    assert sum(len(c.ids) for c in chunks) == start and all(len(c.ids) <= 256 for c in chunks)


def test_token_files_empty(spark, empty):
    path = bitplanes.write_ids(empty, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    assert bitplanes.read_documents(spark, path).count() == 0


# 3 Line dedup


def lines_to_remove(data, threshold=0.8):
    """All pairs."""
    order = lambda d: (d[0] is not None, d[0] or 0)
    place = [(order(r), n, frozenset(WORDS.findall(x.translate(LOW)))) for r in data if r[1] is not None for n, x in enumerate(r[1].split("\n"))]
    first = {}
    for where, n, w in place:
        if w:
            first[w] = min(first.get(w, (where, n)), (where, n))
    late = {w for w in first for v in first if first[v] < first[w] and len(v & w) >= threshold * len(v | w) - 1e-9}
    return {(where, n) for where, n, w in place if w and (first[w] != (where, n) or w in late)}


@pytest.mark.parametrize("seed", [0, 1])
def test_line_dedup(spark, seed):
    data = rows(seed, 80)
    got = linededup.line_dedup(spark.createDataFrame(data, SCHEMA).withColumn("removed", F.lit("x")).repartition(3)).collect()
    gone = lines_to_remove(data)
    assert len(got) == len(data)
    for r in got:
        text = next(d[1] for d in data if d[0] == r.doc_id)
        own = [n for (where, n) in gone if where == (r.doc_id is not None, r.doc_id or 0)]
        assert sorted(r.removed) == sorted(own) and r.n_removed == len(own)
        assert r.text == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in set(own)) if own else text)
    assert any(r.n_removed for r in got)


def test_line_dedup_near_copies_past_the_first_candidates(spark, monkeypatch):
    """A large group of near copies: each line must find its match though most candidates fail."""
    monkeypatch.setattr(linededup, "FIRST", 1)
    monkeypatch.setattr(linededup, "BLOCK", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # lists go on over batches
    rng = random.Random(5)
    base = [f"b{i}" for i in range(20)]
    data = []
    for i in range(150):
        own = list(base)
        for j in rng.sample(range(20), rng.choice([1, 2, 3, 5])):
            own[j] = f"v{rng.randrange(40)}"
        data.append((i, " ".join(own)))
    got = {r.doc_id for r in linededup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect() if r.n_removed}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {where[1] for where, _ in lines_to_remove(data)}


def test_line_dedup_without_broadcast(spark, table, monkeypatch):
    expected = sorted((str(r.doc_id), str(r.text), r.n_removed, r.n_lines) for r in linededup.line_dedup(table).collect())
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", -1)
    assert sorted((str(r.doc_id), str(r.text), r.n_removed, r.n_lines) for r in linededup.line_dedup(table).collect()) == expected


def test_line_dedup_when_words_share_a_hash(spark, monkeypatch):
    """With 6 bits of a token most lists and sets in them collide; the words themselves decide."""
    monkeypatch.setattr(linededup, "_ID", np.uint64(63))
    data = [(i, " ".join(f"t{i}x{j}" for j in range(4)), "en", "s", 0) for i in range(60)]
    data += [(60, data[3][1].upper(), "en", "s", 0), (61, data[4][1], "en", "s", 0)]
    got = {r.doc_id for r in linededup.line_dedup(spark.createDataFrame(data, SCHEMA).repartition(3)).collect() if r.n_removed}
    assert got == {60, 61}


def test_line_dedup_with_clashing_columns_and_string_ids(spark):
    data = [(f"d{i}", "a b c d e\n" + f"own{i} line{i}", 7, 8, 9, "z") for i in range(4)]
    docs = spark.createDataFrame(data, "doc_id string, text string, kept int, __key int, __kept int, N_removed string")
    got = linededup.line_dedup(docs).collect()
    assert len(got) == 4 and sum(r.n_removed for r in got) == 3 and all((r["kept"], r["__key"], r["__kept"]) == (7, 8, 9) for r in got)
    assert all(r.text.endswith(f"own{r.doc_id[1:]} line{r.doc_id[1:]}") for r in got)


def test_line_dedup_of_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    got = {r.doc_id: r for r in linededup.line_dedup(spark.createDataFrame([(0, long), (1, "x\n" + long + " more"), (2, None), (3, "")], "doc_id long, text string")).collect()}
    assert got[1].text == "x" and got[0].text == long and got[2].text is None and got[3].text == ""


def test_line_dedup_empty(empty):
    assert linededup.line_dedup(empty).count() == 0


# 4 SimHash


def brute_simhash(text):
    from xxhash import xxh64_intdigest

    words = WORDS.findall((text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, table):
    got = simhash.near_duplicates(table).collect()
    data = rows()
    prints = {(r[0], r[1]): brute_simhash(r[1]) for r in data}
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in got) == sorted((str(r[0]), prints[r[0], r[1]]) for r in data)
    label = {f: f for f in set(prints.values())}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least = {}
    for (i, _), f in prints.items():
        if i is not None:
            least[label[f]] = min(least.get(label[f], i), i)
    assert all(r.component_id == least.get(label[r.fp % 2**64]) for r in got)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_close_edges_link_all_close_values(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(8)]
    values = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(12)}
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    edges = simhash.close_edges(spark.createDataFrame([(signed(v),) for v in values], "fp long"), radius)
    found = {r.node: r.label for r in simhash.components(edges).collect()}
    for a in values:
        for b in values:
            if 0 < (a ^ b).bit_count() <= radius:
                assert found[signed(a)] == found[signed(b)]
    assert all((a.a ^ a.b) != 0 and bin((a.a ^ a.b) % 2**64).count("1") <= radius for a in edges.collect())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1001] == 1000


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


# 5 LM scoring


def brute_trie(train, text):
    """Escapes and exclusion by the book."""
    order = ppm.ORDER
    counts = {}
    for t in train:
        line = b"\0" * order + t + bytes([ppm.END])
        for i in range(order, len(line)):
            for k in range(order + 1):
                counts.setdefault(line[i - k : i], Counter())[line[i]] += 1
    line, total = b"\0" * order + text + bytes([ppm.END]), 0.0
    for i in range(order, len(line)):
        barred = set()
        for k in range(order, -1, -1):
            seen = {s: c for s, c in counts.get(line[i - k : i], {}).items() if s not in barred}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if line[i] in seen:
                total += math.log10(seen[line[i]] / whole)
                break
            total += math.log10(len(seen) / whole)
            barred |= set(seen)
        else:
            total -= math.log10(256 - len(barred))
    return total


@pytest.mark.parametrize("entries", [10**6, 300])
def test_ppm_scores(spark, monkeypatch, entries):
    monkeypatch.setattr(ppm, "PASS_ENTRIES", entries)
    monkeypatch.setattr(ppm, "HOT_WORDS", 20)
    data = [r for r in rows(2, 25) if len(r[1] or "") < 5000]
    held = lambda i: (i or 0) % 4 == 1
    got = ppm.score_texts(spark.createDataFrame(data, SCHEMA), F.coalesce(F.col("doc_id"), F.lit(0)) % 4 == 1).collect()
    lowered = lambda t: (t or "").encode().lower()
    train = [lowered(r[1]) for r in data if not held(r[0])]
    words = lambda t: [*lowered(t).split(), None]
    count = Counter(w for r in data if not held(r[0]) for w in words(r[1]))
    n, v = sum(count.values()), len(count)
    assert len(got) == len(data)
    for r in got:
        text = next(d[1] for d in data if d[0] == r.doc_id)
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(words(text)) and r.n_known == sum(count[w] > 0 for w in words(text)) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(text)))
        assert r.score == pytest.approx(brute_trie(train, lowered(text)), rel=1e-4)


def test_ppm_probabilities_sum_to_one():
    data, offsets = text_buffer(pa.array(["abracadabra", "abc", "cab"]))
    keys, counts = np.unique(ppm.grams(data, offsets), return_counts=True)
    short = (keys >> (8 * ppm.ORDER)) << 8 | (keys & 255)
    unique = np.unique(short)
    trie = ppm.Trie(keys, counts, (unique, np.array([counts[short == s].sum() for s in unique])))
    for context in (b"\0\0\0\0\0", b"abrac", b"zzzzz", b"zzzab", b"zzzza"):
        key = sum(b << (8 * (i + 1)) for i, b in enumerate(context))
        assert (10 ** trie.score(np.array([key | s for s in range(256)], np.int64))).sum() == pytest.approx(1, abs=1e-5)


def test_ppm_without_training_and_empty(spark, empty):
    got = ppm.score_texts(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(True)).first()
    assert got.score == pytest.approx(-3 * math.log10(256)) and got.n_known == 0 and got.train_tokens == 0
    assert ppm.score_texts(empty, F.lit(False)).count() == 0


# 6 Sharding


def test_matrix_sums():
    counts, sizes = [5, 0, 17, 3, 100], [32, 31, 31, 31]
    m = sharding.communication_matrix(counts, sizes, 1)
    assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m)] == sizes


@pytest.mark.parametrize("limit", [10**9, 10])
def test_hypergeometric_mean_and_spread(monkeypatch, limit):
    monkeypatch.setattr(sharding, "_NUMPY_LIMIT", limit)
    rng = np.random.Generator(np.random.Philox(7))
    x = np.array([sharding.hypergeometric(rng, 300, 700, 200) for _ in range(4000)])
    assert abs(x.mean() - 60) < 0.5 and abs(x.var() - 200 * 0.3 * 0.7 * 800 / 999) < 2.5


def test_shards_are_exact_and_uniform(spark):
    n = 4003
    df = spark.range(n).selectExpr("id AS doc_id", "id % 7 AS shard").repartition(5)
    got = sharding.uniform_shards(df, shards=8, bucket_rows=100).collect()
    sizes = Counter(r.shard for r in got)
    assert sorted(r.doc_id for r in got) == list(range(n)) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    low = Counter(r.shard for r in got if r.doc_id < n // 2)  # the first half spreads like the whole
    assert all(abs(low[s] - n / 16) < 5 * math.sqrt(n / 32) for s in range(8))
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(np.arange(n), order)[0, 1]) < 0.08


def test_shards_of_equal_rows_and_of_none(spark, table, empty):
    same = spark.createDataFrame([(1, None)] * 50, "doc_id long, text string")
    assert sorted(Counter(r.shard for r in sharding.uniform_shards(same, 8).collect()).values()) == [6] * 6 + [7] * 2
    assert sharding.uniform_shards(table, 8).count() == len(rows()) and sharding.uniform_shards(empty).count() == 0


def test_sharding_query_shards_the_texts(spark, monkeypatch):
    """Its digests are those of the rows that the operator gives."""
    from quire.llm.queries import op6_sharding

    whole = sharding.uniform_shards
    monkeypatch.setattr(sharding, "uniform_shards", lambda df, **k: whole(df, **k).withColumn("text", F.lit("é")))
    assert {(r.size, r.text_crc32) for r in op6_sharding(spark, "/root/testdata/sf0.001").collect()} == {(3, zlib.crc32("é".encode()))}


# 7 HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body><header><a href=/>Site</a></header>
<nav><ul><li>Home<li>About</ul></nav><!-- ad <p>x</p> --><div class="ad-box">Buy</div><div id="cookieNotice">Cookies</div><article><h1>{0}</h1><p>One &amp; <b>bo</b>ld<br>line<p>Two   &eacute;\n {1}</p>
<form><p>Mail</p></form><aside>More</aside><div class="comments"><p>First!</p></div></article><footer>&copy; S</footer></body></html>"""


def test_article_text(spark):
    pages = [(i, f"http://a.example/{i}", PAGE.format(f"Title {i}", f"text {i}")) for i in range(5)]
    pages += [(10, None, None), (11, "x", ""), (12, "http://b.example", "plain text &lt;b&gt;"), (13, "http://b.example", "<p>a<p>b <i>c</i>d <script>x")]
    got = {r.page_id: r.text for r in wrappers.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    for i in range(5):
        assert got[i] == f"Title {i} One & bold line Two é text {i}"
    assert got[10] == got[11] == "" and got[12] == "plain text <b>" and got[13] == "a b cd"


def test_frame_of_pages_without_article(spark):
    pages = [(i, "http://c.example/", f"<div class=top>Same frame</div><div class=body><p>Own text {i}</p></div><div class=bottom>All rights</div>") for i in range(4)]
    got = [r.text for r in wrappers.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [f"Own text {i}" for i in range(4)]


def test_texts_that_begin_alike_or_are_copies_stay(spark):
    lead, bottom = "The same lead of every text. " * 20, "<div class=bottom>All rights</div>"
    pages = [(i, "http://d.example/", f"<div class=top>Same frame</div><p>{lead}Own end {i}</p>{bottom}") for i in range(4)]
    pages += [(10 + i, "http://e.example/", f"<div class=top>Frame</div><p>One text</p>{bottom}") for i in range(4)]  # one page, four times
    pages += [(20 + i, "http://f.example/", f"<nav>{i}</nav><p>Same text</p>{bottom}") for i in range(4)]  # nothing of their own
    got = {r.page_id: r.text for r in wrappers.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"{lead}Own end {i}" for i in range(4))
    assert all(got[10 + i] == "Frame One text All rights" and got[20 + i] == "Same text All rights" for i in range(4))


def test_names_that_only_contain_a_word_of_a_region(spark):
    frame = "<nav>Home</nav><div class='share-buttons'>Share it now</div>"
    pages = [(i, "http://g.example/", f"{frame}<div class='share-price'><p>The price of share {i} rose by {i} points on this long day of trading.</p></div><footer>x</footer>") for i in range(4)]
    pages += [(10 + i, "http://h.example/", f"<article><div class='ad-week-report'><p>Report {i} of the week, with all its many words.</p></div><div class='ad-box'>Buy</div></article>") for i in range(2)]
    got = {r.page_id: r.text for r in wrappers.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()}
    assert all(got[i] == f"The price of share {i} rose by {i} points on this long day of trading." for i in range(4))
    assert all(got[10 + i] == f"Report {i} of the week, with all its many words." for i in range(2))


def test_deep_markup_and_clashing_columns(spark):
    deep = "<div>" * 5000 + "<p>deep text</p>" + "</div>" * 5000
    pages = spark.createDataFrame([(1, "http://a.example/", deep, 1, 2, 3), (2, "http://a.example/", "<p>a " + "word " * 200_000 + "</p>", 1, 2, 3)], "page_id long, url string, html string, host int, roles int, text int")
    got = {r.page_id: r.text for r in wrappers.extract_main_text(pages).collect()}
    assert got[1] == "deep text" and len(got[2]) == 1_000_001


def test_wrapper_is_a_union_free_expression():
    make = lambda x: wrappers.Wrapper.of_page(wrappers.tokens(x))
    w = make("<ul><li>a</li><li>b</li></ul><p>x</p>").merge(make("<ul><li>a</li></ul><h2>y</h2><p>z</p>"))
    assert str(w) == "<ul>(<li>#text</li>)+</ul>(<h2>#text</h2>)?<p>#text</p>"
    assert str(wrappers.Wrapper.load(w.dump())) == str(w)
    assert str(make("<p>a</p><h2>b</h2><p>c</p>")) == "((<p>#text</p>)?(<h2>#text</h2>)?)+"


def test_wrapper_roles_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    pages = spark.createDataFrame([(1, "http://a.example/", PAGE.format("T", "x"))], "page_id long, url string, html string")
    assert wrappers.extract_main_text(pages).first().text.startswith("T One & bold")
    assert wrappers.extract_main_text(pages.limit(0)).count() == 0


# 8 BPE


def test_bpe_round_trip(spark, table, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = lexicon.bpe_round_trip(table, path, most_words=50).collect()
    assert sorted((str(r.doc_id), r.ids.hex(), r.decoded) for r in got) == sorted(
        (str(r[0]), np.array(ids := tokenizer.encode(r[1] or "", add_special_tokens=False).ids, "<u4").tobytes().hex(), tokenizer.decode(ids, skip_special_tokens=False)) for r in rows()
    )
    assert lexicon.bpe_round_trip(empty, path).count() == 0


def test_both_encoders_on_odd_texts():
    rng = random.Random(1)
    alphabet = [*"abcXYZ019 '  \n\t.,!?-", *map(chr, (0xE9, 0x4E2D, 0xDF, 0x130, 0x301, 0x2003, 0x3000, 0x1C, 0x85, 0xA0, 0x0D, 0x0B, 0x1F600, 0x1680, 0x2028, 0x202F, 0x3A3)), "<|endoftext|>", "'s", " the", "J" + chr(0x30C), "hello", "'ll", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["", "a" * 2000, " " * 40]
    byte, word = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    vocabulary = lexicon.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    words = {x: [i for p in lexicon.split_pieces(x) for i in vocabulary.merge(p)] for x in (b" the", b"hello", b"\n", b"abc")}
    data, offsets = text_buffer(pa.array(texts))
    codec = lexicon.Codec(vocabulary, lexicon.Transducer.build(words))
    assert [x.tolist() for x in codec.encode(data, offsets)] == [byte.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in bitplanes.word_encoder(word)(data, offsets)] == [word.encode(t, add_special_tokens=False).ids for t in texts]


def test_units_of_one_piece_are_kept_once():
    vocabulary = lexicon.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    codec = lexicon.Codec(vocabulary, lexicon.Transducer.build({}))
    codec.encode(*text_buffer(pa.array(["zqx vvk zqx ab12"])))
    assert set(codec.unseen.young) == {b"zqx", b" vvk", b" zqx", b" ab12"} and set(codec.merged.young) == {b" ab", b"12"}


def test_transducer_shares_suffixes():
    words = {w.encode(): [i] for i, w in enumerate("tap taps top tops trap traps".split())}
    t = lexicon.Transducer(lexicon.Transducer.build(words))
    found = t.ranks(pa.array([*words, b"ta", b"tapss", b"", b"x"], pa.binary()))
    assert [t.ids[t.offsets[r]] for r in found[:6]] == list(range(6)) and (found[6:] == -1).all()
    assert len(t.edges) == 7  # t, a, o, r, a and one p, one s for all
    none = lexicon.Transducer(lexicon.Transducer.build({}))
    assert (none.ranks(pa.array([b"a"], pa.binary())) == -1).all()


# 9 Quality


def test_quality_counts(spark, table, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(table, labels).collect()
    by_id = {r[0]: r[1] or "" for r in rows()}
    assert len(got) == len(rows())
    for r in got:
        t = by_id[r.doc_id]
        w = WORDS.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many, covered, seen, repeated = Counter(grams), set(), set(), 0
        for i, g in enumerate(grams):
            covered |= {i, i + 1, i + 2} if many[g] > 1 else set()
        for x in t.split("\n"):
            if WORDS.search(x):
                repeated += x in seen
                seen.add(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality(empty, labels).count() == 0 and quality.quality(table, labels.limit(0)).count() == len(rows())
    kept = sorted(str(r.doc_id) for r in got if r.kept)
    assert sorted(str(r.doc_id) for r in quality.keep_quality(table, labels).collect()) == kept


def test_trees_learn_and_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] - x[:, 1] ** 2 + 0.3 * rng.normal(size=2000) > -0.5).astype(float)
    model = quality.fit_trees(x[:1500], y[:1500], [1, 0, -1])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.88
    for j, sign in ((0, 1), (2, -1)):
        grid = np.repeat(x[:50], 40, axis=0)
        grid[:, j] = np.tile(np.linspace(-3, 3, 40), 50)
        steps = np.diff(model.score(grid).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-12).all()


# 10 Decontamination


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.choice([3, 9, 10, 14, 40]), 30)) for i in range(30)] + [(30, None), (31, "..."), (5, twice := sentence(rng, 12, 30)), (5, twice), (None, sentence(rng, 20, 30))]
    data = []
    for i in range(60):
        part = (rng.choice(items[:30])[1] or "").split()
        cut = rng.randint(0, max(0, len(part) - 10))
        data.append((i, sentence(rng, rng.randint(0, 20), 30) + ", " + " ".join(part[cut : cut + rng.randint(2, 20)]).upper() + "! " + sentence(rng, 4, 30)))
    data += [(100, None), (101, ""), (102, data[1][1]), (102, data[1][1]), (102, "other text"), (None, data[3][1])]
    got = decontamination.contamination(spark.createDataFrame(data, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    word = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add("" if i is None else str(i))
    expected = []
    for i, t in data:
        w, hit, found = word.findall((t or "").translate(LOW)), set(), set()
        for s in range(len(w)):
            for n in range(1, 11):
                if names := windows.get(tuple(w[s : s + n])) if s + n <= len(w) else None:
                    hit |= set(range(s, s + n))
                    found |= names
        expected.append((str(i), len(w), len(hit), tuple(sorted(found)), bool(hit)))
    assert sorted((str(r.doc_id), r.n_words, r.hit_words, tuple(r.item_ids), r.contaminated) for r in got.collect()) == sorted(expected)
    assert sum(e[4] for e in expected) > 10


def test_contamination_empty(spark, table, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(table, none).where("contaminated").count() == 0
    assert decontamination.contamination(empty, none).count() == 0


# All of them


def walked(trees, row):
    """The score of one row, node by node."""
    total = trees.base
    for at in trees.roots.tolist():
        while trees.left[at] != at:
            at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        total += trees.value[at]
    return 1 / (1 + np.exp(-total))


def test_quality_scores_equal_a_walk_through_the_trees(spark):
    rng = random.Random(8)
    data = [(i, " ".join(f"w{rng.randrange(9 if i % 2 else 500)}" for _ in range(60 + i % 7)) + ("!" * (i % 5) if i % 2 else "."), "en", "s", 0) for i in range(120)]
    docs = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    counts = quality.document_statistics(docs).toPandas().sort_values("doc_id")
    model = quality.train(quality.document_statistics(docs), labels)
    x = quality.features({c: counts[c].to_numpy().astype(float) for c in quality.COUNTS})
    assert len(model.roots) > 10
    for i, row in zip(counts["doc_id"], x, strict=True):
        score = walked(model, row)
        assert got[i].score == pytest.approx(score) and got[i].kept == (not got[i].base_failed and score >= 0.5)


def test_extra_columns_with_names_of_outputs(spark):
    names = "fp component_id label node variant held_out n_tokens n_known score key n ids decoded base_failed kept n_words hit_words hit_starts item_ids contaminated words places __key __kept h p".split()
    data = [(1, "one two three four five six seven eight nine ten eleven"), (2, "one two three four five six seven eight nine ten eleven"), (3, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    wide = docs.select("*", *[F.lit("x").alias(n) for n in names])
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    path = queries.tokenizer_path("byte_bpe_50k.json")
    for run in (
        simhash.near_duplicates, lambda d: ppm.score_texts(d, F.lit(False)), lambda d: lexicon.bpe_round_trip(d, path), lambda d: quality.quality(d, labels), lambda d: decontamination.contamination(d, items),
    ):
        assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(docs).collect()))


def test_digests(spark):
    """The queries' columns and types on the smallest tables."""
    from quire.llm.queries import QUERIES

    out = QUERIES["op6_sharding"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    first = out.orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first().text
    assert (first.size, first.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    bpe = QUERIES["op8_bpe_round_trip"](spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    assert bpe.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
