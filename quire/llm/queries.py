"""The queries of this package's operators, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, bwt, decontamination, lexicon, licenses, linededup, merkle, negatives, ppm, quality, sharding, simhash, wrappers
from .shared import tuned


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; the files stay where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    path = bitplanes.write_ids(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return bitplanes.read_documents(spark, path, docs.schema["doc_id"].dataType.simpleString())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(_read(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed_lines"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return ppm.score_texts(_read(spark, sf_dir, "documents"), held_out)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.uniform_shards(_read(spark, sf_dir, "documents"), shards=8)
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_main_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexicon.bpe_round_trip(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", F.col("hit_words").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bwt.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = merkle.manifest(_read(spark, sf_dir, "documents"), fanout=2)
    out = merkle.verified(table, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)))
    hexed = [merkle.as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return out.select("doc_id", *hexed, "proof_sha256", merkle.as_text(F.col("folded_root")).alias("folded_root"), "verified")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_token_output, op3_line_dedup, op4_simhash, op5_lm_score, op6_sharding, op7_main_text, op8_bpe_round_trip, op9_quality, op10_decontamination, op11_hard_negatives, op12_suffix_dedup, op13_merkle_manifest,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
phrase(p, label) AS (VALUES {", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES.items())}),
spot AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS i FROM t, phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS labels FROM spot GROUP BY doc_id),
template(id, label, words, wide) AS (VALUES {", ".join(f"({i}, '{label}', {sorted(set(x.split()))!r}, {licenses.block_words(x)})" for i, (label, x) in enumerate(licenses.TEMPLATES))}),
sized AS (SELECT *, ceil({licenses.CONTAINMENT} * len(words) - 1e-9) AS need FROM template),
met AS (SELECT doc_id, w, id, label, words, wide, need FROM t, sized WHERE len(list_intersect(list_distinct(w), words)) >= need),
block AS (SELECT doc_id, id, label, words, wide, s, len(list_intersect(list_distinct(w[s + 1 : s + wide]), words)) AS n, need FROM (SELECT *, unnest(list_filter(range(len(w)), lambda i: list_contains(words, w[i + 1]))) AS s FROM met) m),
good AS (SELECT * FROM block WHERE n >= need),
narrow AS (SELECT * FROM good a WHERE NOT EXISTS (SELECT 1 FROM good b WHERE a.doc_id = b.doc_id AND len(a.words) < len(b.words) AND list_has_all(b.words, a.words) AND b.s < a.s + a.wide AND a.s < b.s + b.wide)),
own AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(n / len(words)) AS best FROM narrow GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  coalesce(best, 0)::DOUBLE AS score
FROM t LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""

_OP10 = f"""
WITH item AS (SELECT DISTINCT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
gram AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
size AS (SELECT DISTINCT n FROM gram),
place AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)),
met AS (SELECT doc_id, item, n, i FROM place JOIN gram USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

#: CRC-32 of a whole number's decimal digits, bit by bit: each byte enters before the first of its eight steps.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c), 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))),
  lambda acc, x: xor(xor(acc, x) >> 1, (xor(acc, x) & 1) * 3988292384)), 4294967295)"""

_HASHED = "sha256(concat(" + ", ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "#", "text")) + "))"

_OP13 = f"""
WITH RECURSIVE row AS (SELECT doc_id, coalesce('+' || lang, '') AS lang, {_HASHED.replace("#", "n_chars")} AS leaf, {_HASHED.replace("#", "(n_chars + 1)")} AS changed, crc FROM (SELECT *, {_CRC} AS crc FROM documents)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM row),
low AS (SELECT lang, 0 AS k, idx, n, leaf AS h FROM leaves
  UNION ALL SELECT lang, k + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY lang, k, idx // 2),
subs AS (SELECT lang, h, k, row_number() OVER (ORDER BY lang) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS k, idx, n, h FROM subs UNION ALL SELECT k + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY k, idx // 2),
top AS (SELECT h AS root FROM high WHERE n = 1),
-- Each leaf upward: acc is the hash so far, sides the siblings met.
walk AS (SELECT l.doc_id, l.lang, s.h AS subroot, s.k AS height, s.idx AS at, l.leaf, 0 AS k, l.idx, (CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END) AS acc, '' AS sides, false AS done, row_number() OVER () AS r FROM leaves l JOIN subs s USING (lang)
  UNION ALL
  SELECT w.doc_id, w.lang, w.subroot, w.height, w.at, w.leaf, w.k + 1, (CASE WHEN w.k = w.height THEN w.at ELSE w.idx END) // 2,
    CASE WHEN s.h IS NULL THEN sha256(w.acc) WHEN (CASE WHEN w.k = w.height THEN w.at ELSE w.idx END) % 2 = 0 THEN sha256(w.acc || s.h) ELSE sha256(s.h || w.acc) END,
    w.sides || coalesce(s.h, ''), false, w.r
  FROM walk w LEFT JOIN (SELECT lang, k, idx, h FROM low WHERE n > 1 UNION ALL SELECT NULL, k, idx, h FROM high WHERE n > 1) s
    ON s.lang IS NOT DISTINCT FROM (CASE WHEN w.k < w.height THEN w.lang END) AND s.k = (CASE WHEN w.k < w.height THEN w.k ELSE w.k - w.height END) AND s.idx = xor((CASE WHEN w.k = w.height THEN w.at ELSE w.idx END), 1)
  WHERE w.k < w.height + (SELECT max(k) FROM high))
SELECT doc_id, leaf, subroot, root, sha256(sides) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM walk, top WHERE k = height + (SELECT max(k) FROM high)
"""

ORACLE_SQL = {"op1_license_scan": _OP1, "op10_decontamination": _OP10, "op11_hard_negatives": _OP11, "op13_merkle_manifest": _OP13}
