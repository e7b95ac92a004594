"""Line dedup: an exact set-similarity join of lines by rare tokens, with prefix, length and positional filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import gather
from .shared import BROADCAST_BYTES, dropped, fresh, mix, released, span_hashes, stored, text_groups, tidy, word_spans

#: Tokens are known by 56 bits of their hash; their counts are kept by 2**BUCKET_BITS buckets of it, as a level of a byte.
BUCKET_BITS = 24
_CHUNK = 16  # bits of a bucket within its chunk
_ID = np.uint64((1 << 56) - 1)
#: A token in more lines than this has its list cut into blocks of about this many lines.
BLOCK = 50_000
#: Candidates of a line and a list that are verified first; lines without a match among them go on to all of theirs.
FIRST = 4
#: Bytes of entries that one task holds at a time, about.
HELD_BYTES = 4 << 20
_LEAST = np.iinfo(np.int64).min
_ENTRY = np.dtype([("slot", "<u8"), ("k1", "<i8"), ("id", "<i8"), ("p0", "<u8"), ("p1", "<u8"), ("line", "<i4"), ("size", "<i4"), ("at", "<i4")])


def _spread(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _spaced(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts, lower-cased (A-Z), with a line end behind each."""
    low = bytes(data).lower()
    return np.frombuffer(b"\n".join([low[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]) + b"\n", np.uint8)


class LineWords:
    """What a unit of a text and its tokens are: here its lines, and their words (lower-cased, cut at ASCII white space).
    SINGLE: whether tokens that seem to be in one unit only are sent as well."""

    SINGLE = False

    @staticmethod
    def tokens(data: np.ndarray, offsets: np.ndarray, two: bool = True) -> tuple:
        """Two independent hashes of all words (or None for the second), the line of each, and for each line its text's
        row and its number in the text, from 0. Lines end at newlines only."""
        n, spaced = len(offsets) - 1, _spaced(data, offsets)
        starts, ends = word_spans(spaced)
        end = spaced == 10
        breaks = np.flatnonzero(end)
        row = np.searchsorted(offsets[1:] + np.arange(n), breaks)
        first = np.searchsorted(row, np.arange(n))
        one, other = span_hashes(spaced, starts, ends, True) if two else (span_hashes(spaced, starts, ends), None)
        return one & _ID, other, np.repeat(np.arange(len(breaks), dtype=np.int32), np.diff(np.searchsorted(starts, breaks), prepend=0)), row, np.arange(len(breaks)) - first[row]

    @staticmethod
    def units(text: bytes) -> list[bytes]:
        return text.split(b"\n")

    @staticmethod
    def words(unit: bytes) -> set:
        return set(unit.lower().split())


class TextShingles:
    """As LineWords, with each text as one unit, whatever its line ends, and its shingles of five words as tokens. Fewer
    words: one shingle of them all, also of none. There are more shingles than a table of fixed size can tell apart, so
    all of a prefix are sent: what is sent is in proportion to the texts at every size."""

    SINGLE, WORDS = True, 5

    @classmethod
    def tokens(cls, data: np.ndarray, offsets: np.ndarray, two: bool = True) -> tuple:
        n, spaced, words = len(offsets) - 1, _spaced(data, offsets), cls.WORDS
        starts, ends = word_spans(spaced)
        row = np.searchsorted(offsets[1:] + np.arange(n), starts)
        count = np.bincount(row, minlength=n)
        place, left = np.arange(len(row)) - (np.cumsum(count) - count)[row], count[row]
        first = np.flatnonzero(place <= np.maximum(left - words, 0))
        out = []
        for hashes in span_hashes(spaced, starts, ends, True) if two else (span_hashes(spaced, starts, ends),):
            hashes = np.append(hashes, np.zeros(words, np.uint64))
            total = np.minimum(left[first], words).astype(np.uint64)
            for j in range(words):
                total += np.where(place[first] + j < left[first], hashes[first + j], np.uint64(0)) * (_spread(np.array([j + 1], np.uint64), 3)[0] | np.uint64(1))
            out.append(mix(np.append(total, np.zeros(int((count == 0).sum()), np.uint64))))
        return out[0] & _ID, out[1] if two else None, np.append(row[first], np.flatnonzero(count == 0)).astype(np.int32), np.arange(n), np.zeros(n, np.int64)

    @staticmethod
    def units(text: bytes) -> list[bytes]:
        return [text]

    @classmethod
    def words(cls, unit: bytes) -> set:
        w = unit.lower().split()
        return set(zip(*(w[j:] for j in range(cls.WORDS)))) if len(w) >= cls.WORDS else {tuple(w)}


class Lines:
    """The units with tokens of some texts as sets, each ordered by level and id: rarest first. Without levels, by id, and
    with the second hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, levels: np.ndarray | None = None, kind=LineWords):
        words, other, line, row, number = kind.tokens(data, offsets, levels is None)
        key = words if levels is None else (levels[(words >> np.uint64(56 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | words
        # Two sorts instead of one by two keys: of 64-bit integers, then a stable one of small integers.
        order = np.argsort(key)
        order = order[np.argsort(line[order].astype(np.uint16 if len(row) < 1 << 16 else np.int32), kind="stable")]
        key, line = key[order], line[order]
        new = np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])) if len(key) else np.zeros(0, bool)
        self.key, self.other, line = key[new], other[order][new] if other is not None else None, line[new]
        self.first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.first, len(line)))
        self.row, self.number = row[line[self.first]], number[line[self.first]]
        self.k1 = np.add.reduceat(_spread(self.key & _ID, 1), self.first).view(np.int64) if len(self.key) else np.zeros(0, np.int64)

    @property
    def k2(self) -> np.ndarray:
        """With k1, the name of the set: sums over its tokens of two independent hashes, of 120 bits together."""
        return np.add.reduceat(_spread(self.other, 2), self.first).view(np.int64) if len(self.key) else np.zeros(0, np.int64)

    def distinct(self, ids: np.ndarray) -> np.ndarray:
        """Whether a line is the earliest of its set here."""
        keep = np.zeros(len(self.k1), bool)
        order = np.lexsort((self.number, ids[self.row], self.k1))
        keep[order[np.append(True, self.k1[order][1:] != self.k1[order][:-1])]] = True
        return keep

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """For each line, the parities of its tokens in 128 classes."""
        at = _spread(self.key & _ID, 11) & np.uint64(127)
        one = np.uint64(1) << (at & np.uint64(63))
        return tuple(np.bitwise_xor.reduceat(np.where(at >> np.uint64(6) == w, one, np.uint64(0)), self.first) if len(self.key) else one for w in (0, 1))


def _texts(batch: pa.RecordBatch, most: int = 1 << 18):
    """Runs of texts of batch(doc_id, __key, text): ids (least for null), keys, bytes and offsets."""
    ids = batch.column("doc_id").fill_null(_LEAST).to_numpy().astype(np.int64)
    keys = batch.column("__key").to_numpy()
    for first, data, offsets in text_groups(batch.column("text"), most):
        yield ids[first : first + len(offsets) - 1], keys[first : first + len(offsets) - 1], data, offsets


def _needed(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def _scan(rows: DataFrame, threshold: float, kind) -> DataFrame:
    """One pass over all texts, stored: the lines with words (kind 'l': k1, k2, id, line, key), the tokens of distinct
    lines of a run of texts by chunk of buckets (kind 'b': k1 is the chunk, packed its buckets and their numbers), each
    text's number of lines with words (kind 'd': k1 and key), and how many tokens all prefixes have (kind 'n', in k1)."""
    names = ["kind", "k1", "k2", "id", "line", "key", "packed"]

    def batch(mark, k1, k2, ids, number, keys, packed):
        return pa.RecordBatch.from_arrays([pa.array([mark] * len(k1)), *(pa.array(v) for v in (k1, k2, ids)), pa.array(number.astype(np.int32)), pa.array(keys), pa.array(packed, pa.binary())], names=names)

    def chunks(held):
        buckets, n = np.unique(np.concatenate(held), return_counts=True)
        part = buckets >> _CHUNK
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        zero = np.zeros(len(cuts) - 1, np.int64)
        packed = [(buckets[i:j] & ((1 << _CHUNK) - 1)).astype("<u2").tobytes() + n[i:j].astype("<u4").tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
        return batch("b", part[cuts[:-1]].astype(np.int64), zero, zero, zero, zero, packed)

    def run(batches):
        held, size, prefixes = [], 0, 0
        for b in batches:
            for ids, keys, data, offsets in _texts(b):
                x = Lines(data, offsets, None, kind)
                zero = np.zeros(len(keys), np.int64)
                yield batch("d", np.bincount(x.row, minlength=len(keys)), zero, zero, zero, keys, [None] * len(keys))
                if not len(x.k1):
                    continue
                yield batch("l", x.k1, x.k2, ids[x.row], x.number, keys[x.row], [None] * len(x.k1))
                one = x.distinct(ids)
                prefixes += int((x.size - _needed(x.size, threshold) + 1)[one].sum())
                held.append((x.key[np.repeat(one, x.size)] >> np.uint64(56 - BUCKET_BITS)).astype(np.int32))
                size += len(held[-1])
                if size > 2_000_000:
                    yield chunks(held)
                    held, size = [], 0
        if size:
            yield chunks(held)
        zero = np.zeros(1, np.int64)
        yield batch("n", zero + prefixes, zero, zero, zero, zero, [None])

    return stored(rows.mapInArrow(tidy(run), "kind string, k1 long, k2 long, id long, line int, key long, packed binary"), "lines")


def token_levels(scan: DataFrame) -> np.ndarray:
    """For each bucket of tokens, 0 if at most one line has a token of it, else 1 + 4 log2 of their number.

    It orders tokens by rarity over the whole corpus in a table whose size is fixed.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, packed in zip(b.column("chunk").to_pylist(), b.column("packed")):
                raw = packed.as_buffer()
                n = raw.size // 6
                at = sums.setdefault(chunk, np.zeros(1 << _CHUNK, np.int64))
                at[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<u4", n, 2 * n)
        for chunk, n in sums.items():
            level = np.where(n > 1, np.floor(np.log2(np.maximum(n, 1)) * 4) + 1, 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([level.tobytes()])], names=["chunk", "level"])

    parts = scan.where("kind = 'b'").select(F.col("k1").cast("int").alias("chunk"), "packed").repartition("chunk")
    table = parts.mapInArrow(tidy(run), "chunk int, level binary").toArrow()
    levels = np.zeros((1 << (BUCKET_BITS - _CHUNK), 1 << _CHUNK), np.uint8)
    for chunk, level in zip(table["chunk"].to_pylist(), table["level"].to_pylist()):
        levels[chunk] = np.frombuffer(level, np.uint8)
    return levels.reshape(-1)


def _held_by(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, object]:
    """The rows that may have one of the ids(id), least for null: a join with them if they take BROADCAST_BYTES at most, else all rows and a broadcast
    bitmap of the ids."""
    ids = stored(ids.distinct(), "ids")
    if ids.count() * 16 > BROADCAST_BYTES:
        return rows, rows.sparkSession.sparkContext.broadcast(_bitmap(ids))
    return rows.join(F.broadcast(ids), F.coalesce("doc_id", F.lit(_LEAST)) == F.col("id"), "left_semi"), None


def _entries(rows: DataFrame, levels, threshold: float, kind, buckets: int, documents=None, lists=None) -> DataFrame:
    """An entry (_ENTRY) for each token of each line's prefix, once for equal lines of a run of texts (the earliest),
    packed by bucket of lists.

    A token that is in one line only has no partner and none is made (unless kind.SINGLE). A list too long for one block is cut: a line is
    held in one block and asks in all. slot is the list's number with the lowest bit set for those that only ask; they
    have rows of their own, which come behind. documents: marks of the ids to read; lists: of the lists to fill; both as
    broadcast bitmaps. With these, all tokens are packed beside the entries.
    """
    whole = lists is not None

    def packed(held):
        entries = np.concatenate([h[0] for h in held])
        tokens = np.concatenate([h[1] for h in held]) if whole else None
        group = _spread(entries["slot"] >> np.uint64(1), 9) % np.uint64(buckets) * np.uint64(2) + (entries["slot"] & np.uint64(1))
        order = np.argsort(group, kind="stable")
        group, heads = group[order], np.cumsum(entries["size"]) - entries["size"] if whole else None
        cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        out, sets = [], []
        for i, j in zip(cuts[:-1], cuts[1:]):
            at = order[i:j]
            out.append(entries[at].tobytes())
            sets.append(gather(tokens, heads[at], entries["size"][at].astype(np.int64)).tobytes() if whole else None)
        columns = [pa.array(group[cuts[:-1]].astype(np.int64)), pa.array(out, pa.binary()), pa.array(sets, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "entries", "tokens"])

    def run(batches):
        table = levels.value
        held, size = [], 0
        for b in batches:
            if documents is not None:
                b = b.filter(pa.array(_marked(documents.value, _mark(b.column("doc_id").fill_null(_LEAST).to_numpy()))))
            for ids, _, data, offsets in _texts(b):
                x = Lines(data, offsets, table, kind)
                if not len(x.k1):
                    continue
                at = np.arange(len(x.key)) - np.repeat(x.first, x.size)
                mine = np.flatnonzero(np.repeat(x.distinct(ids), x.size) & (at < np.repeat(x.size - _needed(x.size, threshold) + 1, x.size)) & ((x.key >> np.uint64(56) > 0) | kind.SINGLE))
                line = np.repeat(np.arange(len(x.size)), x.size)[mine]
                token, level = (x.key[mine] & _ID), (x.key[mine] >> np.uint64(56)).astype(np.float64)
                blocks = np.maximum(1, np.ceil(2 ** (level / 4) / BLOCK)).astype(np.int64)
                home = (_spread(x.k1[line].view(np.uint64), 5) % blocks.astype(np.uint64)).astype(np.int64)
                many = np.repeat(np.arange(len(mine)), blocks)
                block = np.arange(len(many)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                slot = np.where(blocks[many] == 1, token[many] << np.uint64(1), _spread(token[many], 7) + (block.astype(np.uint64) << np.uint64(1)) & ~np.uint64(1))
                slot = slot | (block != home[many]).astype(np.uint64)
                if whole:
                    good = _marked(lists.value, _mark((slot & ~np.uint64(1)).view(np.int64)))
                    many, slot = many[good], slot[good]
                own = line[many]
                # With all tokens an entry is many times as long.
                weight = np.cumsum(x.size[own] * 8 + 52 if whole else np.full(len(own), 52))
                cuts = np.append(np.flatnonzero(np.diff(weight // HELD_BYTES, prepend=-1)), len(own)) if len(own) else [0]
                p0, p1 = x.parities()
                for i, j in zip(cuts[:-1], cuts[1:]):
                    o, e = own[i:j], np.zeros(j - i, _ENTRY)
                    e["slot"], e["k1"], e["id"], e["line"], e["size"], e["at"] = slot[i:j], x.k1[o], ids[x.row[o]], x.number[o], x.size[o], at[mine][many[i:j]]
                    e["p0"], e["p1"] = p0[o], p1[o]
                    held.append((e, gather(x.key & _ID, x.first[o], x.size[o]) if whole else None))
                    size += e.nbytes + (held[-1][1].nbytes if whole else 0)
                    if size > HELD_BYTES:
                        yield packed(held)
                        held, size = [], 0
        if size:
            yield packed(held)

    made = rows.mapInArrow(tidy(run), "part long, entries binary, tokens binary")
    return made.repartition(F.shiftright("part", 1)).sortWithinPartitions("part")


def _similar(tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sets of each pair reach the threshold, token by token."""
    out, sizes = np.zeros(len(left), bool), np.fromiter(map(len, tokens), np.int64, len(tokens))
    low = 0
    while low < len(left):
        high = low + max(1, int(np.searchsorted(np.cumsum((sizes[left] + sizes[right])[low:]), 1_000_000)))
        a, b = left[low:high], right[low:high]
        both = np.concatenate([*(tokens[i] for i in a), *(tokens[i] for i in b)])
        pair = np.concatenate([np.repeat(np.arange(len(a)), sizes[a]), np.repeat(np.arange(len(b)), sizes[b])])
        order = np.lexsort((both, pair))
        both, pair = both[order], pair[order]
        shared = np.bincount(pair[1:][(both[1:] == both[:-1]) & (pair[1:] == pair[:-1])], minlength=len(a))
        out[low:high] = shared >= threshold * (sizes[a] + sizes[b] - shared) - 1e-9
        low = high
    return out


_PAIR = "x long, xid long, xline int, y long, yid long, yline int, slot long, differ int, more boolean"


def _candidates(entries: DataFrame, threshold: float, first: int, asking=None) -> DataFrame:
    """Pairs of a line x and an earlier one y that may match it (_PAIR): their k1 and places, the list, in how many of 128
    parities they differ, and whether x has further candidates in the list.

    For each line and list, the `first` candidates with the fewest different parities are given: a group of near copies
    gives a number of rows in proportion to its lines. A list where a line has more also gives its members, as rows with
    x = y. Equal lines of a list are one, the earliest. Length filter: sizes differ by the threshold at most. Positional
    filter: the tokens after the shared one must suffice. Parity filter: two lines' parities differ in at most as many
    bits as their sets in tokens. asking: a broadcast bitmap of the only x to answer for; the entries then come with all tokens,
    pairs are compared by them before the first are taken, and members aren't given. For members, differ is the set's size.
    """

    def one(e: np.ndarray, tokens) -> dict:
        """Columns of entries by list and size, equal lines of a list once."""
        order = np.lexsort((e["line"], e["id"], e["k1"], e["size"], e["slot"] & ~np.uint64(1)))
        e = e[order]
        slot = e["slot"] & ~np.uint64(1)
        new = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (e["k1"][1:] != e["k1"][:-1])))
        out = {n: np.ascontiguousarray(e[n][new]) for n in _ENTRY.names}
        out["slot"] = slot[new]
        if tokens is not None:
            out["tokens"] = [tokens[k] for k in order[new].tolist()]
        return out

    def pairs(a: dict, left: np.ndarray, b: dict, right: np.ndarray, probing: bool) -> tuple[np.ndarray, ...]:
        """Of the pairs of entries, those that pass all filters: left, right, whether left is later, and how parities differ."""
        sa, sb = a["size"][left], b["size"][right]
        need = np.ceil(threshold / (1 + threshold) * (sa + sb) - 1e-9).astype(np.int32)
        good = np.flatnonzero(np.minimum(sa - a["at"][left], sb - b["at"][right]) >= need)
        left, right, most = left[good], right[good], (sa + sb - 2 * need)[good]
        differ = np.bitwise_count(a["p0"][left] ^ b["p0"][right]).astype(np.int32) + np.bitwise_count(a["p1"][left] ^ b["p1"][right])
        good = np.flatnonzero(differ <= most)
        left, right, differ = left[good], right[good], differ[good]
        (ia, ib), (la, lb), (ka, kb) = ((a[n][left], b[n][right]) for n in ("id", "line", "k1"))
        later = (ia > ib) | ((ia == ib) & ((la > lb) | ((la == lb) & (ka > kb))))
        good = (ka != kb) & (later | (not probing))
        if asking is not None:
            good &= _marked(asking.value, _mark(np.where(later, ka, kb)))
        return left[good], right[good], later[good], differ[good]

    def best(found: list, held: dict) -> tuple:
        """The first candidates of each x among found: (places of x, places of y in held, differ, more)."""
        x, y, differ, more = (np.concatenate(z) for z in zip(*found, strict=True))
        if not len(x):
            return x, y, differ, more
        order = np.lexsort((held["line"][y], held["id"][y], differ, x))
        x, y, differ, more = x[order], y[order], differ[order], more[order]
        head = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        count = np.diff(np.append(head, len(x)))
        keep = np.arange(len(x)) - np.repeat(head, count) < first
        more = np.repeat(np.logical_or.reduceat(more, head) | (count > first), count)
        return x[keep], y[keep], differ[keep], more[keep]

    def given(asks: dict, held: dict, x, y, differ, more) -> Iterator[pa.RecordBatch]:
        columns = [asks["k1"][x], asks["id"][x], asks["line"][x], held["k1"][y], held["id"][y], held["line"][y], asks["slot"][x].view(np.int64), differ.astype(np.int32), more]
        if more.any() and asking is None:
            own = np.flatnonzero(np.isin(held["slot"], np.unique(asks["slot"][x[more]])))
            k, i, n = held["k1"][own], held["id"][own], held["line"][own]
            columns = [np.concatenate(c) for c in zip(columns, [k, i, n, k, i, n, held["slot"][own].view(np.int64), held["size"][own], np.zeros(len(own), bool)])]
        for i in range(0, len(columns[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in columns], names=[c.split()[0] for c in _PAIR.split(", ")])

    def met(asks: dict, held: dict, probing: bool) -> Iterator[pa.RecordBatch]:
        """The pairs of asks with held, both by list and size; held is asks itself if these don't only ask."""
        n = len(asks["slot"])
        if not n or not len(held["slot"]):
            return
        slots, number = np.unique(held["slot"], return_inverse=True)
        place = number.astype(np.int64) << 32 | held["size"]
        if probing:
            mine = np.minimum(np.searchsorted(slots, asks["slot"]), len(slots) - 1)
            there = slots[mine] == asks["slot"]
        else:
            mine, there = number, np.ones(n, bool)
        mine = mine.astype(np.int64) << 32
        begins = np.searchsorted(place, mine | _needed(asks["size"], threshold))
        ends = np.searchsorted(place, mine | np.floor(asks["size"] / threshold + 1e-9).astype(np.int64), side="right") if probing else np.arange(n)
        many = np.where(there, np.maximum(ends - begins, 0), 0)
        total, low = np.cumsum(many), 0
        found, rows = [], 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + 200_000, side="right")))
            k = many[low:high]
            left = np.repeat(np.arange(low, high), k)
            right = np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begins[low:high], k)
            left, right, later, differ = pairs(asks, left, held, right, probing)
            if asking is not None and len(left):
                both = [*(asks["tokens"][i] for i in left.tolist()), *(held["tokens"][i] for i in right.tolist())]
                same = _similar(both, np.arange(len(left)), np.arange(len(left)) + len(left), threshold)
                left, right, later, differ = left[same], right[same], later[same], differ[same]
            found.append((np.where(later, left, right), np.where(later, right, left), differ, np.zeros(len(left), bool)))
            rows += len(left)
            if rows > 200_000:
                found, rows = [best(found, held)], 0
            low = high
        yield from given(asks, held, *best(found, held))

    def read(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, list | None]:
        e = np.frombuffer(b.column("entries")[i].as_buffer(), _ENTRY)
        if asking is None:
            return e, None
        values, ends = np.frombuffer(b.column("tokens")[i].as_buffer(), np.uint64), np.cumsum(e["size"])
        return e, np.split(values, ends[:-1])

    def run(batches):
        now, own, held = None, [], None

        def begun():
            return one(np.concatenate([o[0] for o in own]), [t for o in own for t in o[1]] if asking is not None else None)

        for b in batches:
            for i, part in enumerate(b.column("part").to_pylist()):
                if part >> 1 != now:
                    if own:
                        held = begun()
                        yield from met(held, held, False)
                    now, own, held = part >> 1, [], None
                if part & 1 == 0:
                    own.append(read(b, i))
                    continue
                if own:
                    held, own = begun(), []
                    yield from met(held, held, False)
                if held is not None:
                    yield from met(one(*read(b, i)), held, True)
        if own:
            held = begun()
            yield from met(held, held, False)

    return entries.mapInArrow(tidy(run), _PAIR)


def _mark(*parts: np.ndarray) -> np.ndarray:
    """A hash of integers, a column each."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = mix((h ^ p.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return h


def _bitmap(values: DataFrame, bits: int = 27) -> np.ndarray:
    """At most 2**bits marks, about 64 or more for each 64 bits that are set, at the top bits of the hashes (_mark) of the rows' long
    columns: false ones are possible, misses aren't.

    Tasks give only the words that they set; the driver holds the bitmap, whose size is bounded.
    """
    names = values.columns

    def run(batches):
        for b in batches:
            at = _mark(*(b.column(n).to_numpy() for n in names)) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["w", "b"])

    table = values.mapInArrow(run, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    full = np.zeros(1 << (bits - 6), np.uint64)
    if table.num_rows:
        full[table["w"].to_numpy()] = table["b"].to_numpy().view(np.uint64)
    own = min(bits, max(10, int(table.num_rows).bit_length() + 6))
    if own < bits:  # few marks: a smaller map tells them apart as well
        at = np.flatnonzero(np.unpackbits(full.view(np.uint8), bitorder="little")) >> (bits - own)
        small = np.zeros(1 << own, np.uint8)
        small[at] = 1
        return np.packbits(small, bitorder="little").view(np.int64)
    return full.view(np.int64)


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is marked."""
    bits = int(len(bitmap)).bit_length() - 1 + 6
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1


def _verified(rows: DataFrame, pairs: DataFrame, threshold: float, kind) -> DataFrame:
    """x, xid and xline of the pairs (x, xid, xline, y, yid, yline) whose sets reach the threshold, compared word by word.

    The lines themselves are fetched, from the documents that hold them (bitmaps of fixed size leave the others out),
    and meet in a join.
    """
    spark = rows.sparkSession
    named = stored(pairs.select(F.col("x").alias("k"), F.col("xid").alias("id"), F.col("xline").alias("line")).union(pairs.select("y", "yid", "yline")).distinct(), "named")
    places = spark.sparkContext.broadcast(_bitmap(named.select("id", F.col("line").cast("long"))))
    rows, documents = _held_by(rows, named.select("id"))

    def run(batches):
        for b in batches:
            if documents is not None:
                b = b.filter(pa.array(_marked(documents.value, _mark(b.column("doc_id").fill_null(_LEAST).to_numpy()))))
            for ids, _, data, offsets in _texts(b):
                units = [kind.units(bytes(data[s:e])) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                count = np.fromiter(map(len, units), np.int64, len(units))
                id_of, number = np.repeat(ids, count), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                mine = np.flatnonzero(_marked(places.value, _mark(id_of, number)))
                if not len(mine):
                    continue
                units = [u for own in units for u in own]
                units = [units[i] for i in mine.tolist()]
                joined = np.frombuffer(b"".join(units), np.uint8)
                x = Lines(joined, np.append(0, np.cumsum([len(u) for u in units])), None, kind)
                at = mine[x.row]
                yield pa.RecordBatch.from_arrays([pa.array(x.k1), pa.array(id_of[at]), pa.array(number[at].astype(np.int32)), pa.array([units[r] for r in x.row.tolist()], pa.binary())], names=["k", "id", "line", "unit"])

    units = rows.mapInArrow(tidy(run), "k long, id long, line int, unit binary").join(named, ["k", "id", "line"], "left_semi").dropDuplicates(["k", "id", "line"])
    units = stored(units, "units")
    one, two = (units.select(*[F.col(c).alias(f"{side}_{c}") for c in units.columns]) for side in ("x", "y"))
    both = pairs.select("x", "xid", "xline", "y", "yid", "yline")
    both = both.join(one, (F.col("x") == F.col("x_k")) & (F.col("xid") == F.col("x_id")) & (F.col("xline") == F.col("x_line")))
    both = both.join(two, (F.col("y") == F.col("y_k")) & (F.col("yid") == F.col("y_id")) & (F.col("yline") == F.col("y_line")))

    def compared(batches):
        for b in batches:
            good = []
            for p, q in zip(b.column("x_unit"), b.column("y_unit")):
                p, q = kind.words(p.as_py()), kind.words(q.as_py())
                shared = len(p & q)
                good.append(shared >= threshold * (len(p) + len(q) - shared) - 1e-9)
            yield b.filter(pa.array(good, pa.bool_())).select(["x", "xid", "xline"])

    out = stored(both.select("x", "xid", "xline", "x_unit", "y_unit").mapInArrow(compared, "x long, xid long, xline int").distinct(), "verified")
    dropped(named, units)
    for b in (places, documents):
        if b is not None:
            b.destroy()
    return out


def _earliest(rows: DataFrame, threshold: float, kind=LineWords) -> tuple[DataFrame, DataFrame]:
    """Of rows(doc_id, __key, text): key and line of each line that no earlier one matches, and each row's key and number
    of lines."""
    spark = rows.sparkSession
    scan = _scan(rows, threshold, kind)
    levels = spark.sparkContext.broadcast(token_levels(scan))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefixes = scan.where("kind = 'n'").agg(F.sum("k1")).first()[0] or 0
    first = stored(scan.where("kind = 'l'").groupBy("k1", "k2").agg(F.min(F.struct("id", "line", "key")).alias("place")), "first")
    counts = stored(scan.where("kind = 'd'").groupBy("key").agg(F.max("k1").alias("n")), "counts")
    dropped(scan)

    def held(size: int) -> int:
        return max(parts, -(-size // HELD_BYTES))

    pairs = stored(_candidates(_entries(rows, levels, threshold, kind, held(prefixes * _ENTRY.itemsize)), threshold, FIRST), "pairs")
    released(spark)
    line, ends = ["x", "xid", "xline"], ["x", "xid", "xline", "y", "yid", "yline"]
    near = stored(pairs.where("x <> y").groupBy(*ends).agg(F.min("differ").alias("differ")), "near")
    closest = stored(near.groupBy(*line).agg(F.min(F.struct("differ", "y", "yid", "yline")).alias("c")).select(*line, "c.y", "c.yid", "c.yline"), "closest")
    matched = _verified(rows, closest, threshold, kind)
    others = stored(near.join(matched, line, "left_anti").join(closest, ends, "left_anti"), "others")
    if others.limit(1).count():
        matched = matched.union(_verified(rows, others, threshold, kind))

    # Lines with more candidates than were given, and no match among these.
    rest = stored(pairs.where("more").select(*line, "slot").distinct().join(matched, line, "left_anti"), "rest")
    most = FIRST
    while rest.limit(1).count():
        members = stored(pairs.where("x = y").join(rest.select("slot").distinct(), "slot", "left_semi").select(F.col("xid").alias("id"), "differ"), "members")
        size = members.agg(F.sum(F.col("differ") * F.lit(8).cast("long") + _ENTRY.itemsize)).first()[0] or 0
        lists, asking = (spark.sparkContext.broadcast(_bitmap(t)) for t in (rest.select("slot").distinct(), rest.select("x").distinct()))
        some, documents = _held_by(rows, members.select("id").union(rest.select("xid")))
        again = stored(_candidates(_entries(some, levels, threshold, kind, held(size), documents, lists), threshold, most, asking), "again")
        matched = matched.union(_verified(rows, again.select(*ends).distinct(), threshold, kind))
        dropped(rest, members)
        for b in (documents, lists, asking):
            if b is not None:
                b.destroy()
        rest, most = stored(again.where("more").select(*line, "slot").distinct().join(matched, line, "left_anti"), "rest"), most * 8
    gone = matched.select(F.col("x").alias("k1"), F.struct(F.col("xid").alias("id"), F.col("xline").alias("line")).alias("at")).distinct()
    kept = first.withColumn("at", F.struct("place.id", "place.line")).join(gone, ["k1", "at"], "left_anti")
    kept = stored(kept.select("place.key", "place.line"), "kept")
    dropped(first, pairs, near, closest, others, rest)
    levels.destroy()
    return kept, counts


def _row_ids(docs: DataFrame):
    """doc_id as a long; ids that aren't integers are ordered by their hash."""
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.col("doc_id").cast("long") if whole else F.xxhash64(F.col("doc_id").cast("string"))


def near_copies(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """__key of each row of docs(doc_id, __key, text) that repeats an earlier one: the Jaccard similarity of their sets
    of five-word shingles is `threshold` or more. Earlier means by doc_id, rows without id last, then by the set.

    The join is that of line_dedup, with each text as one line: exact, whatever the texts' line ends. A null text is an
    empty one, and all of these are copies. Rows of equal __key share their result.
    """
    rows = docs.select(F.when(F.col("doc_id").isNull(), F.lit(np.iinfo(np.int64).max)).otherwise(_row_ids(docs)).alias("doc_id"), "__key", F.coalesce("text", F.lit("")).alias("text"))
    kept, counts = _earliest(rows, threshold, TextShingles)
    return counts.select(F.col("key").alias("__key")).join(kept.select(F.col("key").alias("__key")), "__key", "left_anti")


def line_dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """All columns of docs(doc_id, text, ...) with the text without repeated lines, and n_lines, n_removed and removed
    (their numbers from 0).

    A line is removed if an earlier line of any document, kept or not, has a set of words whose Jaccard similarity with
    its own is `threshold` or more; earlier means by (doc_id, number of the line), null ids first; ids that aren't integers
    are ordered by their hash. Words are cut at ASCII white space and lower-cased (A-Z). Lines without words count for
    nothing and stay. A text left without any line is empty; n_lines counts lines with words.

    Equal sets are one class with its earliest line, named by two independent hashes of its words (120 bits); classes are
    joined by their rare tokens (_entries, _candidates), and each match is confirmed on the lines' words (_verified). Lines
    that have further candidates and no match among the first are asked again, with all candidates compared where
    their lists are.

    Null texts stay null. Rows equal in doc_id and text share their result. An empty table gives an empty one. Long texts
    and long lines are read whole; one line's tokens must fit in memory. Columns named n_lines, n_removed or removed are
    replaced, all others stay, whatever their names. Texts are shuffled only for lines in pairs, and for documents that
    lose lines if what these keep is too much to broadcast.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "removed")])
    key, kept_lines, lost_mark = (fresh(docs, c) for c in ("__key", "__kept", "__lost"))
    docs = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    rows = docs.select(_row_ids(docs).alias("doc_id"), F.col(key).alias("__key"), "text").where(F.col("text").isNotNull())
    kept, counted = _earliest(rows, threshold)
    kept = stored(kept.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_set("line")).alias(kept_lines)), "kept")

    # Documents that lose lines, with what they keep; no row for the others.
    lost = counted.withColumnRenamed("key", key).join(kept, key, "left").where(F.coalesce(F.size(kept_lines), F.lit(0)) < F.col("n"))
    lost = stored(lost.select(key, F.coalesce(kept_lines, F.array().cast("array<int>")).alias(kept_lines)), "lost")
    size = lost.agg(F.sum(F.size(kept_lines) * 4 + 40)).first()[0] or 0
    dropped(kept)

    def cut(table: DataFrame, small: bool) -> DataFrame:
        t = table.join(F.broadcast(lost) if small else lost, key, "left")
        t = t.withColumn("removed", F.when(F.col(kept_lines).isNotNull(), F.array_except(_line_numbers(F.col("text")), kept_lines)).otherwise(F.array().cast("array<int>")))
        t = t.withColumn("n_lines", _line_count(F.col("text")))
        left = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("removed", i))
        t = t.withColumn("text", F.when(F.size("removed") > 0, F.array_join(left, "\n")).otherwise(F.col("text")))
        return t.withColumn("n_removed", F.size("removed").cast("long")).drop(kept_lines, key)

    if size <= BROADCAST_BYTES:
        return cut(docs, True)
    marks = spark.sparkContext.broadcast(_bitmap(lost.select(key)))

    @F.pandas_udf("boolean")
    def loses(keys):
        import pandas as pd

        return pd.Series(_marked(marks.value, _mark(keys.to_numpy())))

    flagged = docs.withColumn(lost_mark, loses(key))
    whole = flagged.where(~F.col(lost_mark)).drop(lost_mark).withColumn("n_lines", _line_count(F.col("text")))
    whole = whole.withColumn("removed", F.array().cast("array<int>")).withColumn("n_removed", F.lit(0).cast("long")).drop(key)
    return cut(flagged.where(lost_mark).drop(lost_mark), False).unionByName(whole)


def _line_numbers(text):
    """The numbers of lines with words."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    numbered = F.transform(parts, lambda line, i: F.when(line.rlike(r"[^\x20\x09-\x0D]"), i))
    return F.filter(numbered, lambda i: i.isNotNull())


def _line_count(text):
    """How many lines have words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("long")
