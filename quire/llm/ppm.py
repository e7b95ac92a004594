"""LM scoring by partial matching: a byte-context trie with escapes and symbol exclusion, learnt from the corpus."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER_BYTES, span_hashes, stored, text_groups, tidy, word_spans

#: Bytes of context of the longest order, and the symbol that ends a text (no byte of UTF-8).
ORDER = 5
END = 255
#: Entries of the trie's longest order that one pass over the texts holds; a larger trie is scored in several passes.
PASS_ENTRIES = 3_000_000
#: Words whose counts are sent to all workers (the most frequent ones); the others are looked up by a join.
HOT_WORDS = 1 << 20


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The (context, symbol) key of each byte of each text and of its end.

    From the highest bits: the byte before, the one before that, ..., the symbol. Before a text stand ORDER zero bytes.
    """
    n, lengths = len(offsets) - 1, np.diff(offsets)
    room = ORDER + 1
    place = np.arange(len(data), dtype=np.int64) + np.repeat(np.arange(n) * room + ORDER, lengths)
    line = np.zeros(len(data) + room * n, np.uint8)
    line[place] = LOWER_BYTES[data]
    ends = offsets[1:] + np.arange(n) * room + ORDER
    line[ends] = END
    scored = np.ones(len(line), dtype=bool)
    heads = offsets[:-1] + np.arange(n) * room
    for i in range(ORDER):
        scored[heads + i] = False
    at = np.flatnonzero(scored)
    key = line[at].astype(np.uint64)
    for i in range(1, ORDER + 1):
        key |= line[at - i].astype(np.uint64) << np.uint64(8 * (ORDER + 1 - i))
    return key.view(np.int64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and how many each text has."""
    low, starts, ends, counts = LOWER_BYTES[data], [], [], []
    for s, e in zip(offsets[:-1], offsets[1:]):
        a, b = word_spans(low[s:e])
        starts.append(a + s)
        ends.append(b + s)
        counts.append(len(a))
    return span_hashes(low, np.concatenate(starts), np.concatenate(ends)).view(np.int64), np.array(counts, np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def learn(texts: DataFrame) -> DataFrame:
    """kind ('word', 'gram' or 'text'), key and n: counts over all rows of texts(text), stored in the shared folder.

    Workers sum runs of texts first, in bounded memory, and Spark sums the rest; the table grows with the distinct words
    and contexts of the corpus.
    """

    def run(batches):
        held = {"word": [], "gram": []}
        total = 0

        def flush(kind):
            keys, counts = _summed(held[kind])
            held[kind] = []
            for i in range(0, len(keys), 100_000):
                k, c = keys[i : i + 100_000], counts[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(k)), pa.array(k), pa.array(c)], names=["kind", "key", "n"])

        for b in batches:
            for _, data, offsets in text_groups(b.column(0), 2 << 20):
                total += len(offsets) - 1
                for kind, keys in (("word", words(data, offsets)[0]), ("gram", grams(data, offsets))):
                    if len(keys):
                        held[kind].append(np.unique(keys, return_counts=True))
                        if len(held[kind]) > 1 and sum(len(k) for k, _ in held[kind]) > 2_000_000:
                            held[kind] = [_summed(held[kind])]
                            if len(held[kind][0][0]) > 1_000_000:
                                yield from flush(kind)
        for kind in held:
            if held[kind]:
                yield from flush(kind)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(["text"]), pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["kind", "key", "n"])

    counts = texts.select("text").mapInArrow(tidy(run), "kind string, key long, n long")
    return stored(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


class Lookup:
    """Places of 64-bit keys in a sorted array, by an open-addressing table; -1 for absent ones."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        rest, step = np.arange(len(keys)), 0
        home = self._home(keys)
        while len(rest):
            at = (home[rest] + step) & self.mask
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = rest[free]  # of several for one slot, one stays
            rest, step = rest[self.slots[at] != rest], step + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64)
        return (((x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        home = self._home(keys)
        out = self.slots[home].astype(np.int64)
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        step = 1
        while len(wrong):
            out[wrong] = self.slots[(home[wrong] + step) & self.mask]
            wrong, step = wrong[(out[wrong] >= 0) & (self.keys[out[wrong]] != keys[wrong])], step + 1
        return out


class Trie:
    """Log10 probabilities of symbols after contexts of ORDER bytes at most.

    At a context with n symbols, q of them distinct, a symbol seen c times has c / (n + q) and an escape q / (n + q).
    After an escape, the symbols of the longer context are excluded: their counts leave n and their number leaves q.
    Below the empty context, all symbols still possible are equally likely. The probabilities of all symbols sum to 1.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray]):
        """keys and counts: grams of the longest order (all with the same shortest contexts); short: grams of order 1 of
        the whole corpus."""
        tables = {ORDER: (keys, counts)}
        for k in range(ORDER - 1, 1, -1):
            tables[k] = self._shorter(*tables[k + 1]) if len(keys) else tables[k + 1]
        tables[1] = _summed([short]) if len(short[0]) else short
        tables[0] = self._shorter(*tables[1]) if len(short[0]) else short
        self.grams, self.contexts, self.log_c, self.log_p, self.escape = {}, {}, {}, {}, {}
        self.log_rest, self.escape_rest = {}, {}
        for k in range(ORDER + 1):
            grams, c = tables[k]
            first = np.flatnonzero(np.append(True, (grams[1:] >> 8) != (grams[:-1] >> 8))) if len(grams) else np.zeros(0, np.int64)
            n = np.add.reduceat(c, first) if len(grams) else c
            q = np.diff(np.append(first, len(grams)))
            self.grams[k], self.contexts[k] = Lookup(grams), Lookup(grams[first] >> 8)
            self.log_c[k] = np.log10(c).astype(np.float32)
            self.log_p[k] = (self.log_c[k] - np.log10(np.repeat(n + q, q))).astype(np.float32)
            self.escape[k] = np.log10(q / np.maximum(n + q, 1))
            if k:  # what is left at the next shorter context once this one's symbols are out
                at = self.grams[k - 1].find(self._cut(grams))
                gone = np.add.reduceat(tables[k - 1][1][at], first) if len(grams) else c
                above = self.contexts[k - 1].find(self._cut(grams[first]) >> 8)
                left_n, left_q = n_before[above] - gone, q_before[above] - q
                with np.errstate(divide="ignore", invalid="ignore"):
                    self.log_rest[k] = np.log10(left_n + left_q)
                    self.escape_rest[k] = np.where(left_q > 0, np.log10(left_q) - self.log_rest[k], 0.0)
            n_before, q_before = n, q
        self.symbols = int(len(tables[0][0]))

    @staticmethod
    def _cut(keys: np.ndarray) -> np.ndarray:
        """Keys without the oldest byte of their contexts."""
        return (keys >> 16) << 8 | (keys & 255)

    @classmethod
    def _shorter(cls, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _summed([(cls._cut(keys), counts)])

    def score(self, keys: np.ndarray) -> np.ndarray:
        """The log10 probability of each gram's symbol after its context."""
        at = self.grams[ORDER].find(keys)
        out = np.where(at >= 0, self.log_p[ORDER][at] if len(self.log_p[ORDER]) else 0.0, 0.0).astype(np.float64)
        rest = np.flatnonzero(at < 0)
        key, k = keys[rest], ORDER
        barred = np.full(len(rest), -1, np.int64)  # the context of order k + 1 whose symbols are excluded
        while len(rest):
            context = self.contexts[k].find(key >> 8)
            held = barred >= 0
            gone = self.escape_rest[k + 1][barred[held]] if k < ORDER else 0.0
            out[rest[held]] += gone
            free = ~held & (context >= 0)
            out[rest[free]] += self.escape[k][context[free]]
            barred, k = context, k - 1
            if k < 0:
                out[rest] -= math.log10(max(1, 256 - self.symbols))
                break
            key = self._cut(key)
            at = self.grams[k].find(key)
            found = at >= 0
            under = found & (barred >= 0)
            out[rest[under]] += self.log_c[k][at[under]] - self.log_rest[k + 1][barred[under]]
            plain = found & (barred < 0)
            out[rest[plain]] += self.log_p[k][at[plain]]
            rest, key, barred = rest[~found], key[~found], barred[~found]
        return out


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) if table.num_rows else np.zeros(0, np.int64)


def score_texts(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs(doc_id, text).

    held_out is a boolean column: rows where it is true are scored only, all others are learnt from too. Texts are
    scored as lower-cased (A-Z) bytes with their end. base_score: unigram words with one added to each count and to the
    number of distinct words. score: the trie's.

    The trie is sent to the workers whole if its longest order has PASS_ENTRIES contexts with symbols at most; a larger
    one is cut by the two bytes before the symbol, which all orders from 2 on share, and each piece takes one pass over
    the texts. Word counts: the HOT_WORDS most frequent at most are sent, the others are joined by a shuffle of the
    remaining words only, so no frequent word is a hot key there.

    Null texts are empty: they have their end alone. A null held_out counts as false. Without training rows every byte
    has 1/256. Repeated rows each get their result; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = learn(rows.where(~F.col("held_out")))
    texts = counts.where("kind = 'text'").agg(F.sum("n")).first()[0] or 0

    # Words: how many there are by size of count, so that the sent part stays within its bound.
    of_words = counts.where("kind = 'word'")
    steps = sorted(((r.step, r.v, r.n) for r in of_words.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()), reverse=True)
    train, distinct = sum(n for _, _, n in steps) + texts, sum(v for _, v, _ in steps) + (texts > 0)
    room, least = HOT_WORDS, None
    for step, v, _ in steps:
        room -= v
        if room < 0:
            break
        least = step
    hot = of_words.where(F.floor(F.log2("n") * 8) >= least) if least is not None else of_words.limit(0)
    table = hot.select("key", "n").toArrow()
    order = np.argsort(_column(table, "key"))
    hot_words = spark.sparkContext.broadcast((_column(table, "key")[order], np.log10(_column(table, "n")[order] + 1.0).astype(np.float64)))

    # The trie: one piece, or several by the two bytes before the symbol.
    of_grams = counts.where("kind = 'gram'")
    cut = 8 * (ORDER - 1)
    sizes = sorted((r.p, r.v) for r in of_grams.groupBy(F.shiftright("key", cut).alias("p")).agg(F.count("*").alias("v")).collect())
    table = of_grams.groupBy(F.shiftleft(F.shiftright("key", 8 * ORDER), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255))).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    short = (_column(table, "key"), _column(table, "n"))
    pieces, held = [[0, 1 << 16]], 0
    for p, v in sizes:
        if held and held + v > PASS_ENTRIES:
            pieces[-1][1] = p
            pieces.append([p, 1 << 16])
            held = 0
        held += v

    def trie(low: int, high: int):
        table = of_grams.where((F.shiftright("key", cut) >= low) & (F.shiftright("key", cut) < high)).select("key", "n").toArrow()
        order = np.argsort(_column(table, "key"))
        return spark.sparkContext.broadcast((_column(table, "key")[order], _column(table, "n")[order], short))

    def scored(source: DataFrame, low: int, high: int, with_words: bool) -> DataFrame:
        sent, whole = trie(low, high), low == 0 and high == 1 << 16
        kind = docs.schema["doc_id"].dataType.simpleString()

        def run(batches):
            model = Trie(*sent.value)
            if with_words:
                keys, logs = hot_words.value
                known_words = Lookup(keys)
            for b in batches:
                for first, data, offsets in text_groups(b.column("text")):
                    n = len(offsets) - 1
                    key = grams(data, offsets)
                    logs_of = model.score(key) if whole else np.zeros(len(key))
                    if not whole:
                        mine = np.flatnonzero(((key >> cut) >= low) & ((key >> cut) < high))
                        logs_of[mine] = model.score(key[mine])
                    total = np.add.reduceat(logs_of, offsets[:-1] + np.arange(n))
                    own = b.slice(first, n)
                    if not with_words:
                        yield pa.RecordBatch.from_arrays([own.column("__key"), pa.array(total)], names=["__key", "score"])
                        continue
                    hashes, many = words(data, offsets)
                    at = known_words.find(hashes)
                    found = at >= 0
                    sums, seen = np.append(0.0, np.cumsum(np.where(found, logs[at] if len(logs) else 0.0, 0.0))), np.append(0, np.cumsum(found))
                    ends = np.cumsum(many)
                    starts = ends - many
                    left = pa.ListArray.from_arrays(pa.array(np.append(0, (ends - seen[ends])).astype(np.int32)), pa.array(hashes[~found]))
                    yield pa.RecordBatch.from_arrays(
                        [own.column("doc_id"), own.column("held_out"), own.column("__key"), pa.array(many + 1), pa.array(seen[ends] - seen[starts]), pa.array(sums[ends] - sums[starts]), left, pa.array(total)],
                        names=["doc_id", "held_out", "__key", "n_tokens", "known", "log_sum", "left", "score"],
                    )

        if with_words:
            return source.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, __key long, n_tokens long, known long, log_sum double, left array<long>, score double")
        return source.select("text", "__key").dropDuplicates(["__key"]).mapInArrow(tidy(run), "__key long, score double")

    source = rows.withColumn("__key", F.xxhash64("doc_id", "text"))
    first = stored(scored(source, *pieces[0], True).withColumn("row", F.monotonically_increasing_id()), "scored")
    total = first.select("doc_id", "held_out", "__key", "row", "n_tokens", "known", "log_sum", "score")
    for low, high in pieces[1:]:
        more = scored(source, low, high, False).withColumnRenamed("score", "more")
        total = total.join(more, "__key").withColumn("score", F.col("score") + F.col("more")).drop("more")

    cold = of_words if least is None else of_words.where(F.floor(F.log2("n") * 8) < least)
    left = first.select("row", F.explode("left").alias("key")).join(cold.select("key", "n"), "key")
    left = left.groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + 1)).alias("more_sum"))
    out = total.join(left, "row", "left")
    known = F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(texts > 0))
    base = F.col("log_sum") + F.coalesce("more_sum", F.lit(0.0)) + F.lit(math.log10(texts + 1)) - F.col("n_tokens") * F.lit(math.log10(train + distinct + 1))
    return out.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
