"""Benchmark decontamination by winnowing: the least k-gram hash of each window is kept, joined and extended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, keyed, lower_ascii, stored

#: Words: maximal runs of digits, a-z and characters beyond ASCII (after lower-casing A-Z).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text):
    """The words of a text column; null has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(hashes, k: int):
    """(h, p) of every run of k words, in order."""
    n = F.size(hashes) - k
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda p: F.struct(F.xxhash64(F.lit(k), *[F.get(hashes, p + i) for i in range(k)]).alias("h"), p.alias("p")))
    return F.when(n >= 0, grams).otherwise(F.expr("array()").cast("array<struct<h:bigint,p:int>>"))


def _winnowed(grams, window: int):
    """The least (h, p) of each `window` consecutive grams, consecutive repeats once; fewer grams: none."""
    n = F.size(grams) - window
    least = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(0)) + 1), lambda i: F.array_min(F.slice(grams, i, window)))
    return F.when(n >= 0, least).otherwise(F.expr("array()").cast("array<struct<h:bigint,p:int>>"))


def _selected(df: DataFrame, k: int, window: int, short: list[int], whole_short: bool, carry: list[str]) -> DataFrame:
    """carry, h and p of the fingerprints of column words: winnowed k-grams, and for lengths in `short` all grams of that
    length (whole_short: only where it is the whole text)."""
    df = df.select(*carry, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    df = df.select(*carry, F.size("words").alias("n"), "hashes", _grams(F.col("hashes"), k).alias("grams"))
    df = df.select(*carry, "n", "hashes", _winnowed(F.col("grams"), window).alias("least"))
    least = F.filter("least", lambda x, i: (i == 0) | (x["p"] != F.get(F.col("least"), i - 1)["p"]))
    own = [F.when(F.col("n") == m, _grams(F.col("hashes"), m)).otherwise(F.expr("array()").cast("array<struct<h:bigint,p:int>>")) if whole_short else _grams(F.col("hashes"), m) for m in short]
    return df.select(*carry, F.inline(F.concat(least, *own)))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """doc_id, n_words, hit_starts (ascending starts of matched windows), hit_words (how many words they cover), item_ids
    (sorted strings) and contaminated, for every row of docs(doc_id, text) against benchmark(item_id, text).

    A window is `window` consecutive words of an item, or all words of a shorter one. A shared window holds
    window - gram + 1 consecutive grams, so both sides keep the same least one in it: no window is missed. Places of the
    text whose fingerprint some item has are found first; each gets the words around it that a window with it may take
    (2 * window - gram at most), once, from one reading of its text. These short rows meet the items' own, cut the same way,
    by fingerprint, and every window around the shared gram is compared word by word, so a hash collision cannot make a
    hit. Items shorter than the window have no guarantee by winnowing: all grams of exactly their lengths are compared instead.

    Null texts have no words. An item without id counts as one item with an empty id. Repeated rows each get their
    result; rows of equal doc_id and different text are kept apart. Empty tables give no hits, or no rows. Other columns
    are ignored, whatever their names. Texts of any length are read whole; a text's places are gathered by text, never by
    fingerprint or item. The benchmark side is broadcast only within BROADCAST_BYTES; a hot fingerprint is a hot key
    of inner joins on short rows, which adaptive execution splits.
    """
    k = min(gram, window)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = stored(items.withColumn("item_key", F.xxhash64("item", "words")), "items")
    short = sorted(r.n for r in items.select(F.size("words").alias("n")).where(F.col("n") < window).distinct().collect())
    item_words = items.agg(F.sum(F.length(F.array_join("words", " ")) + 40)).first()[0] or 0
    small = item_words * 2 * window <= BROADCAST_BYTES
    hint = F.broadcast if small else lambda x: x
    back = window - k  # how far before the gram a window may begin

    def around(words, p):
        return F.slice(words, F.greatest(p - back, F.lit(0)) + 1, window + F.least(p, F.lit(back)))

    base = keyed(docs.select("doc_id", "text"), "doc_id", "text")
    prints = _selected(base.select("__key", words_of(F.col("text")).alias("words")), k, window - k + 1, short, False, ["__key"])
    of_items = _selected(items, k, window - k + 1, short, True, ["item_key"]).distinct()
    own = of_items.withColumnRenamed("p", "q").join(items, "item_key")
    own = stored(own.select("h", "item", "q", F.size("words").alias("size"), around(F.col("words"), F.col("q")).alias("own")), "own")
    met = prints.join(hint(own.select("h").distinct()), "h", "left_semi")
    met = stored(met.groupBy("__key").agg(F.collect_set(F.struct("h", "p")).alias("places")), "met")

    size = met.agg(F.sum(F.size("places") * 16 + 40)).first()[0] or 0
    texts = base.dropDuplicates(["__key"]) if size > BROADCAST_BYTES else base
    found = texts.join(F.broadcast(met) if size <= BROADCAST_BYTES else met, "__key")
    found = found.select("__key", words_of(F.col("text")).alias("words"), "places")
    found = found.select("__key", F.explode(F.transform("places", lambda x: F.struct(x["h"].alias("h"), x["p"].alias("p"), around(F.col("words"), x["p"]).alias("near")))).alias("x"))
    found = found.select("__key", "x.*").join(hint(own), "h")
    # '1' where the words at places p + j and q + j are equal, for j from -back to window - 1.
    at = lambda words, place, j: F.get(F.col(words), j + F.least(F.col(place), F.lit(back)))
    same = F.concat(*[F.when(at("near", "p", j) == at("own", "q", j), "1").otherwise("0") for j in range(-back, window)])
    need = F.least(F.lit(window), F.col("size"))
    found = found.select("__key", "item", "p", need.cast("int").alias("need"), same.alias("same"))
    whole = lambda j: F.expr(f"substring(same, {back + 1} + {j}, need) = repeat('1', need)")
    starts = F.array_compact(F.array(*[F.when(whole(j) & ((F.col("need") == window) | F.lit(j == 0)), F.col("p") + j) for j in range(-back, 1)]))
    found = found.select("__key", "item", "need", F.explode(starts).alias("s"))
    hits = found.groupBy("__key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.collect_set(F.struct("s", F.col("need").alias("n"))).alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1))))
    hits = hits.select("__key", "item_ids", F.array_sort(F.array_distinct(F.transform("starts", lambda x: x["s"]))).alias("hit_starts"), F.size(covered).cast("long").alias("hit_words"))

    out = base.select("doc_id", "__key", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_ANY_WORD)).cast("long").alias("n_words")).join(hits, "__key", "left")
    none = F.expr("array()").cast("array<string>")
    return out.select(
        "doc_id", "n_words", F.coalesce("hit_starts", F.expr("array()").cast("array<int>")).alias("hit_starts"), F.coalesce("hit_words", F.lit(0)).cast("long").alias("hit_words"),
        F.coalesce("item_ids", none).alias("item_ids"), F.coalesce(F.col("hit_words") > 0, F.lit(False)).alias("contaminated"),
    )
