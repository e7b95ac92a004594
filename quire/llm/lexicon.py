"""BPE encoding and decoding: a minimal acyclic transducer of frequent words, and exact merges for the others."""

from __future__ import annotations

import heapq
import json
import tempfile
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Cache, binary_array, gather, ids_of_spans, spaced_starts
from .shared import dropped, stored, text_groups, tidy

#: White space of the pre-tokenizer's pattern (fixed values).
_WIDE = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPACE = r"\t-\r " + _WIDE
_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Texts with white space beyond ASCII aren't cut at blanks first.
_WIDE_SPACE = regex.compile(f"[{_WIDE}]")
#: Bits of an id within a pair of integers kept as one.
_BITS = 24
_LOW = (1 << _BITS) - 1


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follows
    from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE tokenizer file: token bytes by id, merges by pair of ids, and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        ids = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in alphabet for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = ids | {t.encode(): i for t, i in self.special.items()}
        size = max(names.values()) + 1
        table = [b""] * size
        for token, i in names.items():
            table[i] = token
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.single = [ids[bytes([b])] for b in range(256)]
        # Pairs of ids, and rank and merged id, each as one integer: a small part of what tuples take.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (bytes(alphabet[c] for c in x) for x in (left, right))
            self.merges.setdefault(ids[a] << _BITS | ids[b], rank << _BITS | ids[a + b])

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: the pair of lowest rank is merged, leftmost first, until none is left."""
        parts = [self.single[b] for b in piece]
        if len(parts) > 64:
            return self._merge_long(parts)
        get, none = self.merges.get, 1 << 62
        found = [get(a << _BITS | b, none) for a, b in zip(parts, parts[1:])]  # rank and merged id of each neighbouring pair
        while found:
            least = min(found)
            if least == none:
                break
            i = found.index(least)
            parts[i : i + 2] = [least & _LOW]
            del found[i]
            if i:
                found[i - 1] = get(parts[i - 1] << _BITS | parts[i], none)
            if i < len(found):
                found[i] = get(parts[i] << _BITS | parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of (rank, place), for pieces where repeated scans would take quadratic time."""
        n = len(parts)
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.merges.get(parts[i] << _BITS | parts[j])) is not None:
                heapq.heappush(heap, (found >> _BITS, i, parts[i], parts[j], found & _LOW))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in parts if x >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' bytes, with U+FFFD for what isn't valid."""
        raw = gather(self.bytes, self.begins[ids], self.lengths[ids]).tobytes()
        return raw.decode("utf-8", "replace").encode("utf-8")


def split_pieces(unit: bytes) -> list[bytes]:
    """What the pre-tokenizer makes of a text without special tokens."""
    return [p.encode("utf-8") for p in _PATTERN.findall(unit.decode("utf-8"))]


class Transducer:
    """A minimal acyclic automaton over words with their ids as outputs.

    Equal right languages share a state. Each edge holds how many words its earlier sisters lead to, so a path adds up to
    the word's rank, which is the row of its ids. All of it is one block of bytes, which workers map into memory.
    """

    def __init__(self, block: memoryview | bytes | np.ndarray):
        head = np.frombuffer(block, np.int64, 5)
        at, arrays = 40, []
        for n, kind in zip(head, (np.int64, np.int64, np.int64, np.int64, np.int32), strict=True):
            arrays.append(np.frombuffer(block, kind, int(n), at))
            at += int(n) * np.dtype(kind).itemsize
        self.edges, self.targets, self.skips, self.offsets, self.ids = arrays

    @staticmethod
    def build(words: dict[bytes, list[int]]) -> bytes:
        """Words in order, one after the other; states behind the common prefix are settled as soon as a word leaves them."""
        ordered = sorted(w for w in words if w)
        register: dict[tuple, int] = {}
        settled: list[tuple] = []  # (final, ((byte, state), ...)) of each state
        path: list[list] = [[False, []]]  # of the last word: [final, settled edges]
        last = b""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                key = (final, tuple(edges))
                if key not in register:
                    register[key] = len(settled)
                    settled.append(key)
                path[-1][1].append((last[len(path) - 1], register[key]))

        for word in ordered:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            settle(common)
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = True
            last = word
        settle(0)
        settled.append((False, tuple(path[0][1])))
        counts: list[int] = []  # words that each state leads to; states come after those that they lead to
        edges, targets, skips = [], [], []
        for state, (final, out) in enumerate(settled):
            passed = int(final)
            for byte, target in out:
                edges.append(state << 8 | byte)
                targets.append(target << 1 | int(settled[target][0]))
                skips.append(passed)
                passed += counts[target]
            counts.append(passed)
        lengths = np.array([len(words[w]) for w in ordered], np.int64)
        arrays = [np.array(edges, np.int64), np.array(targets, np.int64), np.array(skips, np.int64), np.append(0, np.cumsum(lengths)).astype(np.int64), np.array([i for w in ordered for i in words[w]], np.int32)]
        return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *[a.tobytes() for a in arrays]])

    def ranks(self, spans: pa.Array) -> np.ndarray:
        """The rank of each span, -1 if it is no word: all spans walk together, one byte a step."""
        offsets = np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1].astype(np.int64)
        data = np.frombuffer(spans.buffers()[2] or b"", np.uint8)
        out = np.full(len(spans), -1, np.int64)
        if not len(self.edges):
            return out
        root = int(self.edges[-1]) >> 8
        rows = np.flatnonzero(offsets[1:] > offsets[:-1])
        state, rank, step = np.full(len(rows), root, np.int64), np.zeros(len(rows), np.int64), 0
        while len(rows):
            key = state << 8 | data[offsets[rows] + step]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            good = self.edges[at] == key
            rows, at = rows[good], at[good]
            rank, target, step = rank[good] + self.skips[at], self.targets[at], step + 1
            ends = offsets[rows + 1] - offsets[rows] == step
            done = ends & ((target & 1) == 1)
            out[rows[done]] = rank[done]
            rows, rank, state = rows[~ends], rank[~ends], (target >> 1)[~ends]
        return out


def mapped(block: bytes) -> np.ndarray:
    """The block in an unnamed file of this worker, mapped into memory; nothing is left behind."""
    with tempfile.TemporaryFile() as file:
        file.write(block)
        file.flush()
        return np.memmap(file, np.uint8, "r")


class Codec:
    """Whole texts to ids and back. Units that the automaton doesn't hold are kept in a cache once met, the pieces of those
    that fall into several in another."""

    def __init__(self, vocabulary: Vocabulary, block: np.ndarray | bytes):
        self.vocabulary, self.lexicon = vocabulary, Transducer(block)
        self.merged = Cache(lambda pieces: [array("i", vocabulary.merge(p)).tobytes() for p in pieces], 30_000)
        self.unseen = Cache(self._merge, 30_000)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def _merge(self, units: list[bytes]) -> list[bytes]:
        parts = [split_pieces(u) for u in units]
        made = iter(self.merged.ids([p for x in parts if len(x) > 1 for p in x]))
        return [array("i", self.vocabulary.merge(x[0])).tobytes() if len(x) == 1 else b"".join(islice(made, len(x))) for x in parts]

    def ids(self, units: list[bytes]) -> list[bytes]:
        ranks = self.lexicon.ranks(pa.array(units, pa.binary()))
        out: list = [None] * len(units)
        begins, ends, flat = self.lexicon.offsets[:-1], self.lexicon.offsets[1:], self.lexicon.ids
        for i in np.flatnonzero(ranks >= 0).tolist():
            r = ranks[i]
            out[i] = flat[begins[r] : ends[r]].tobytes()
        rest = np.flatnonzero(ranks < 0).tolist()
        for i, ids in zip(rest, self.unseen.ids([units[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def odd(self, text: bytes) -> list[int] | None:
        """The ids of a text with special tokens or white space beyond ASCII, None for any other."""
        special = self.specials is not None and any(s.encode() in text for s in self.vocabulary.special)
        if not special and (text.isascii() or not _WIDE_SPACE.search(text.decode("utf-8"))):
            return None
        out: list[int] = []
        for part in self.specials.split(text.decode("utf-8")) if special else [text.decode("utf-8")]:
            if part in self.vocabulary.special:
                out.append(self.vocabulary.special[part])
            elif part:
                for ids in self.unseen.ids(split_pieces(part.encode("utf-8"))):
                    out += np.frombuffer(ids, np.int32).tolist()
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text."""
        odd = {i: ids for i in range(len(offsets) - 1) if (ids := self.odd(data[offsets[i] : offsets[i + 1]].tobytes())) is not None}
        starts = [np.zeros(0, np.int64) if s == e else (np.array([s]) if i in odd else spaced_starts(data[s:e]) + s) for i, (s, e) in enumerate(zip(offsets[:-1], offsets[1:]))]
        counts = np.array([len(x) for x in starts], np.int64)
        spans = binary_array(data, np.concatenate(starts))
        skip = {data[offsets[i] : offsets[i + 1]].tobytes() for i in odd}
        flat, lengths = ids_of_spans(spans, (lambda units: [b"" if u in skip else x for u, x in zip(units, self.ids([b"" if u in skip else u for u in units]), strict=True)]) if odd else self.ids)
        ends = np.cumsum(lengths)
        last = np.append(0, ends)[np.cumsum(counts)]
        return [np.array(odd[i], np.int32) if i in odd else flat[a:b] for i, (a, b) in enumerate(zip(np.append(0, last[:-1]), last))]


def frequent_words(docs: DataFrame, most: int) -> list[bytes]:
    """The most frequent units of all texts, at most `most`, from counts over the whole corpus.

    Counts are summed by runs of texts in the workers, then by Spark. How many units have counts of each size tells from
    where on they are few enough, so no more than `most` reach the driver, however many partitions there are.
    """

    def summed(tables):
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

    def run(batches):
        tables = []
        for b in batches:
            for _, data, offsets in text_groups(b.column(0), 1 << 18):
                starts = [spaced_starts(data[s:e]) + s for s, e in zip(offsets[:-1], offsets[1:]) if e > s]
                if starts:
                    found = pc.value_counts(binary_array(data, np.concatenate(starts)))
                    tables.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                    if sum(t.num_rows for t in tables) > 100_000:
                        yield from summed(tables)
                        tables = []
        if tables:
            yield from summed(tables)

    counts = docs.select("text").where(F.col("text").isNotNull()).mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    step = F.floor(F.log2("n") * 16)
    counts = stored(counts.where((F.col("n") > 1) & (F.length("word") <= 64)), "words")
    steps = sorted(((r.step, r.v) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).collect()), reverse=True)
    least = None
    for at, v in steps:
        most -= v
        if most < 0:
            break
        least = at
    found = [] if least is None else sorted(bytes(r.word) for r in counts.where(step >= least).select("word").collect())
    dropped(counts)
    return found


def bpe_round_trip(docs: DataFrame, path: str, most_words: int = 50_000) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, as binary) and decoded (string) of every row of docs(doc_id, text), for the byte-level BPE
    tokenizer file at `path` (read by the driver; workers get it with the code).

    The `most_words` most frequent units of the corpus are compiled with their ids into a transducer, sent once to each
    executor and mapped into memory; other units are merged exactly. Truncation and padding play no part, and special
    tokens in a text become their ids. Empty and null texts have no ids and decode to the empty text. Repeated rows each
    get their result; an empty table gives an empty one; other columns are ignored. Units of any length are encoded.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(path)
    words = {w: [i for p in split_pieces(w) for i in vocabulary.merge(p)] for w in frequent_words(docs, most_words) if _utf8(w)}
    shipped = spark.sparkContext.broadcast((vocabulary, Transducer.build(words)))

    def run(batches):
        vocabulary, block = shipped.value
        codec = Codec(vocabulary, mapped(block))  # goes with its task: workers live on between tasks and stages
        for b in batches:
            for first, data, offsets in text_groups(b.column(1), 1 << 18):
                ids = codec.encode(data, offsets)
                decoded = [vocabulary.decode(x).decode("utf-8") for x in ids]
                packed = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(ids)), packed, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def _utf8(word: bytes) -> bool:
    try:
        return not _WIDE_SPACE.search(word.decode("utf-8"))
    except UnicodeDecodeError:
        return False
