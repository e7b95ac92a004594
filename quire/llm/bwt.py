"""Suffix-array dedup: strings of `length` bytes that stand twice, by merging Burrows-Wheeler transforms.

1. Every window of `length` bytes is named by its least K-gram hash; neighbouring windows of one name are a piece (their
   bytes, `length` - 1 more than windows). Equal windows have equal names, so only pieces of one name are compared, and
   only names that occur twice are.
2. Equal pieces are one, at its first place; their later places are covered whole. This is done before any exchange of
   what follows, so a passage that a third of all documents hold is one piece.
3. Names with more than one piece are dealt into buckets of bounded bytes. Each task makes the transform of its pieces of
   a bucket, a shard; a bucket's task merges the shards' transforms by refining their interleaving symbol by symbol. What
   is apart after h rounds had a common prefix of h - 1; what isn't after `length` rounds are the repeated intervals. No
   suffix is sorted again.
4. A name whose pieces are more than a bucket holds is cut anew by longer grams, at last by the whole window, by which
   equal windows are equal pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .shared import BROADCAST_BYTES, dropped, fresh, stored, text_groups, tidy

#: Shares of a window's length that name it, one after the other.
GRAMS = (0.32, 0.8, 1.0)
#: Windows of a piece at most; bytes that a bucket holds on average, and those of one name that it takes; bytes of a shard.
PIECE, BUCKET, NAME, SHARD = 1024, 1 << 19, 1 << 20, 1 << 18
#: Bytes of texts hashed at a time, so that their arrays stay in a cache.
GROUP = 1 << 17

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64; those of usual sizes are kept."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1 << 21), base, np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if n <= 1 << 21:
            _powers[int(base)] = kept
    return kept[:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on; equal grams hash alike."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(_STEP, n)
    np.cumsum(terms, out=sums[1:])
    out = sums[k:] - sums[:-k]
    out *= powers(_BACK, n - k + 1)
    out ^= out >> np.uint64(32)
    out *= _STEP
    out ^= out >> np.uint64(29)
    return out


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over every `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(name, start, windows, often) of the pieces of texts laid end to end: a name is the least k-gram hash of a window,
    start is a place in data; often: the name's gram stands more than once in the piece, so a window may, too."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(bool)
    grams = gram_hashes(data, k)
    least = slide(grams, length - k + 1, np.minimum)
    n = len(least)
    sizes = np.diff(offsets)
    edges = np.zeros(n + 1, np.int32)
    whole = sizes >= length
    np.add.at(edges, offsets[:-1][whole], 1)
    np.add.at(edges, np.minimum(offsets[1:][whole] - length + 1, n), -1)
    # A window is of one text; a text that ends where the next begins changes no sum, hence the first places.
    inside = np.cumsum(edges[:n]) > 0
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    first = offsets[:-1][whole]
    new[first] = True
    start = np.flatnonzero(inside & new)
    last = np.ones(n, bool)
    last[:-1] = new[1:] | ~inside[1:]
    count = np.flatnonzero(inside & last) + 1 - start
    # Places of grams that are the least of some window, and how many of each piece have its name.
    most = np.concatenate([least, np.zeros(length - k, np.uint64)])
    padded = np.concatenate([np.zeros(length - k, np.uint64), most])
    chosen = np.flatnonzero(slide(padded, length - k + 1, np.maximum)[: len(grams)] == grams)
    lo, hi = np.searchsorted(chosen, start), np.searchsorted(chosen, start + count - 1 + length - k + 1)
    piece = np.repeat(np.arange(len(start)), hi - lo)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[piece]
    often = np.bincount(piece[grams[chosen[at]] == least[start[piece]]], minlength=len(start)) > 1
    name = least[start].view(np.int64)
    if len(count) and count.max() > PIECE:  # cut long ones
        cuts = -(-count // PIECE)
        piece = np.repeat(np.arange(len(start)), cuts)
        shift = (np.arange(len(piece)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * PIECE
        name, start, often, count = name[piece], start[piece] + shift, often[piece], np.minimum(count[piece] - shift, PIECE)
    return name, start, count, often


def _names(rows: DataFrame, text: str, length: int, k: int) -> DataFrame:
    """name and how many pieces have it (a piece that may repeat a window counts twice), for names of more than one."""

    def run(batches):
        for b in batches:
            for _, data, offsets in text_groups(b.column(0), GROUP):
                name, _, _, often = runs(data, offsets, length, k)
                names, at = np.unique(name, return_inverse=True)
                n = np.bincount(at, 1.0 + often, len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], names=["name", "n"])

    return rows.select(text).mapInArrow(tidy(run), "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name")


def _cut(rows: DataFrame, text: str, at: str | None, own: list[str], length: int, k: int, wanted: np.ndarray | None) -> DataFrame:
    """The pieces of a text or binary column: own columns, start (counted from column `at`), n, name, often, id and
    bytes. wanted: sorted names, broadcast; other pieces are left out. None: all pieces, without id and bytes."""
    given = rows.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches):
        for b in batches:
            base = b[at].to_numpy() if at else None
            for first, data, offsets in text_groups(b[text].cast(pa.large_binary()), GROUP):
                name, start, n, often = runs(data, offsets, length, k)
                if given is not None and len(name):
                    place = np.minimum(np.searchsorted(given.value, name), len(given.value) - 1)
                    good = given.value[place] == name if len(given.value) else np.zeros(len(name), bool)
                    name, start, n, often = name[good], start[good], n[good], often[good]
                if not len(name):
                    continue
                row = np.searchsorted(offsets, start, side="right") - 1
                whole = data.tobytes()
                piece = [whole[s:e] for s, e in zip(start.tolist(), (start + n + length - 1).tolist())] if given is not None else []
                place = start - offsets[row] + (base[first + row] if base is not None else 0)
                made = [pa.array(place), pa.array(n), pa.array(name), pa.array(often), *([pa.array([xxh3_128_digest(p) for p in piece], pa.binary()), pa.array(piece, pa.binary())] if given is not None else [pa.nulls(len(n), pa.binary())] * 2)]
                yield pa.RecordBatch.from_arrays([*[b[c].take(pa.array(first + row)) for c in own], *made], names=[*own, "start", "n", "name", "often", "id", "piece"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own)
    return rows.select(*own, text, *([at] if at else [])).mapInArrow(tidy(run), f"{kinds}, start long, n long, name long, often boolean, id binary, piece binary")


def _taken(rows: DataFrame, text: str, own: list[str], length: int) -> DataFrame:
    """The pieces that rows(own, text, __base, asked) ask for, as _cut gives them."""

    def run(batches):
        for b in batches:
            texts, out = b[text].cast(pa.large_binary()), []
            for row, (base, asked) in enumerate(zip(b["__base"].to_pylist(), b["asked"].to_pylist())):
                whole = texts[row].as_py()
                for x in asked:
                    piece = whole[x["start"] - base : x["start"] - base + x["n"] + length - 1]
                    out.append((row, x["start"], x["n"], x["name"], x["often"], xxh3_128_digest(piece), piece))
            if out:
                row, *made = zip(*out)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([*[b[c].take(pa.array(row)) for c in own], *[pa.array(m, k) for m, k in zip(made, kinds)]], names=[*own, "start", "n", "name", "often", "id", "piece"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own)
    return rows.select(*own, text, "__base", "asked").mapInArrow(tidy(run), f"{kinds}, start long, n long, name long, often boolean, id binary, piece binary")


def _pieces(rows: DataFrame, text: str, at: str | None, own: list[str], length: int, k: int) -> DataFrame:
    """The pieces whose names occur more than once, stored. The names are broadcast if they take BROADCAST_BYTES at most, and
    joined otherwise."""
    names = stored(_names(rows, text, length, k), "names")
    if names.count() * 8 <= BROADCAST_BYTES:
        found = _cut(rows, text, at, own, length, k, np.sort(names.toArrow()["name"].to_numpy()))
    else:
        # Places are joined with the names; only then are bytes cut from the texts that they stand in.
        base = F.col(at) if at else F.lit(0).cast("long")
        places = _cut(rows.withColumn("__base", base), text, at, [*own, "__base"], length, k, None).join(names, "name", "left_semi")
        asked = places.groupBy("key", "__base").agg(F.collect_set(F.struct("start", "n", "name", "often")).alias("asked"))
        found = _taken(rows.withColumn("__base", base).join(asked, ["key", "__base"]), text, own, length)
    found = stored(found, "pieces", compression="zstd")
    dropped(names)
    return found


# Transforms


def transform(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of several strings of UTF-8, and their sizes. Each string has an end of its own that
    is less than any byte, earlier strings' ends being less. Symbols that stand before the sorted suffixes: 0 for an end,
    else byte + 1 (no byte of UTF-8 is 255).

    Suffixes are sorted by their first seven symbols, then by prefix doubling; each round sorts only what isn't apart yet.
    """
    sizes = np.array([len(p) for p in pieces])
    n = int(sizes.sum()) + len(pieces)
    text = np.zeros(n + 7, np.int64)
    text[:n] = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text[:n] += 1
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    key, live = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(7):  # nothing counts behind an end
        symbol = np.where(live, text[j : n + j], 0)
        key = key << 9 | symbol
        live &= symbol > 0
    order = np.argsort(key)
    key, ended = key[order], ~live[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    # Suffixes that end within the seven symbols are in the order of their strings.
    group = np.cumsum(new)[ended]
    order[ended] = np.sort(group * np.int64(n) + order[ended]) % n
    new |= ended
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    span = 7
    while True:
        single = new.copy()
        single[:-1] &= new[1:]
        at = np.flatnonzero(~single)
        if not len(at):
            break
        # A group lies together in `order`; its rank is its first place.
        part = order[at]
        base, key = rank[part], rank[np.minimum(part + span, n - 1)]
        moved = np.argsort(base * np.int64(n) + key)
        part, base, key = part[moved], base[moved], key[moved]
        order[at] = part
        split = np.ones(len(at), bool)
        split[1:] = (base[1:] != base[:-1]) | (key[1:] != key[:-1])
        new[at] = split
        rank[part] = np.maximum.accumulate(np.where(split, at, 0))
        span *= 2
    return text[order - 1].astype(np.uint8) * (order > 0), sizes


def backwards(symbols: np.ndarray) -> np.ndarray:
    """For each sorted suffix, the row of the one that is longer by the symbol before it."""
    out = np.empty(len(symbols), np.int32)
    out[np.argsort(symbols, kind="stable")] = np.arange(len(symbols), dtype=np.int32)
    return out


def places(symbols: np.ndarray, sizes: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and place in it of every sorted suffix, read backwards from the ends, all strings at a time."""
    string, place = np.empty(len(symbols), np.int32), np.empty(len(symbols), np.int32)
    at, own, left = np.arange(len(sizes)), np.arange(len(sizes)), sizes.copy()
    while len(at):
        string[at], place[at] = own, left
        more = left > 0
        at, own, left = back[at[more]], own[more], left[more] - 1
    return string, place


def merge(shards: list[np.ndarray], rounds: int, backs: list[np.ndarray] | None = None, rows: np.ndarray | None = None, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """common, rows and interval of the merged transforms; a row is a suffix's place in the shards laid end to end.

    The interleaving of the shards begins as one block. A round deals the suffixes out by the `step` symbols (1 or 2) before
    them, which refines the blocks by as many: those of a block share `step` symbols for each round. A block of one suffix is
    settled, as are all longer suffixes that end in it; it leaves the interleaving. common is the length that a row shares
    with any other, `rounds` at most, in steps; rows are those that share `rounds`, in order, and interval is their block.

    Given rows begin the interleaving in place of all: those with `rounds` symbols before them are enough for the
    intervals, as others reach their string's start too soon; common is then that among what is left.
    """
    backs = backs or [backwards(s) for s in shards]
    start = np.cumsum([0, *map(len, shards)])
    symbols, back = np.concatenate(shards), np.concatenate([b + np.int32(o) for b, o in zip(backs, start)])
    common = np.zeros(len(symbols), np.int32)
    rows = np.arange(len(symbols), dtype=np.int32) if rows is None else rows
    block = np.zeros(len(rows), np.int32)
    by_one = symbols, back
    by_two = (np.where((symbols > 0) & (symbols[back] > 0), symbols[back].astype(np.uint16) << np.uint16(8) | symbols, 0).astype(np.uint16), back[back]) if step == 2 else None
    h = 0
    while h < rounds and len(rows):
        before, next_ = by_two if step == 2 and h + 2 <= rounds else by_one
        h += 1 if before is symbols else 2
        own = before[rows]
        order = np.argsort(own, kind="stable")
        own = own[order]
        ends = np.searchsorted(own, 1)  # ends stand alone
        own, order = own[ends:], order[ends:]
        block, rows = block[order], next_[rows[order]]
        new = np.ones(len(rows) + 1, bool)
        np.not_equal(block[1:], block[:-1], out=new[1:-1])
        new[1:-1] |= own[1:] != own[:-1]
        kept = ~(new[:-1] & new[1:])
        rows, block = rows[kept], np.cumsum(new[:-1], dtype=np.int32)[kept]
        common[rows] = h
    return common, rows, block


def covered(shards: list[dict], length: int) -> pa.Table | None:
    """key, from and to: the spans of the pieces of a bucket whose windows also stand earlier.

    A shard has its transform and, by piece, doc_id, key, start and n. Earlier is by doc_id (null last), key, place.
    """
    string, place, backs, offset = [], [], [], 0
    for s in shards:
        backs.append(backwards(s["symbols"]))
        own = places(s["symbols"], s["sizes"], backs[-1])
        string.append(own[0] + offset)
        place.append(own[1])
        offset += len(s["sizes"])
    string, place = np.concatenate(string), np.concatenate(place)
    _, suffixes, interval = merge([s["symbols"] for s in shards], length, backs, np.flatnonzero(place >= length).astype(np.int32), step=2)
    if not len(suffixes):
        return None
    string, place = string[suffixes].astype(np.int64), place[suffixes].astype(np.int64)
    rows = pa.concat_tables([s["rows"] for s in shards])
    ranked = pc.sort_indices(rows.append_column("none", pc.is_null(rows["doc_id"])), [("none", "ascending"), ("doc_id", "ascending"), ("key", "ascending")]).to_numpy()
    keys = rows["key"].combine_chunks()
    sorted_keys = keys.take(pa.array(ranked))
    changes = np.ones(len(ranked), bool)
    changes[1:] = pc.not_equal(sorted_keys[1:], sorted_keys[:-1]).to_numpy(zero_copy_only=False)
    doc = np.empty(len(ranked), np.int64)
    doc[ranked] = np.cumsum(changes)
    starts = rows["start"].to_numpy()
    address = (doc[string] << 36) | (starts[string] + place)
    least = np.full(interval.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, interval, address)
    late = address > least[interval]
    string, place = string[late], starts[string[late]] + place[late]
    if not len(string):
        return None
    order = np.lexsort((place, string))
    string, place = string[order], place[order]
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (place[1:] > place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(string)) - 1
    return pa.table({"key": keys.take(pa.array(string[first])), "from": pa.array(place[first]), "to": pa.array(place[last] + length)})


def _shards(pieces: DataFrame, length: int) -> DataFrame:
    """bucket and shard: the transforms of each task's pieces, bucket by bucket."""
    own = ["doc_id", "key", "start", "n"]

    def pack(bucket, held):
        t = pa.concat_tables(held)
        symbols, sizes = transform(t["piece"].to_pylist())
        out = {"bucket": pa.array([bucket], pa.int64()), "symbols": pa.array([symbols.tobytes()])}
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.select(own).schema) as f:
            f.write_table(t.select(own))
        out["rows"], out["sizes"] = pa.array([sink.getvalue().to_pybytes()]), pa.array([sizes.astype(np.int32).tobytes()])
        return pa.RecordBatch.from_pydict(out)

    def run(batches):
        held, now, weight = [], None, 0
        for b in batches:
            buckets = b["bucket"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and (now != buckets[lo] or weight > SHARD):
                    yield pack(now, held)
                    held, weight = [], 0
                part = pa.Table.from_batches([b.slice(lo, hi - lo)])
                now = int(buckets[lo])
                held.append(part)
                weight += pc.sum(pc.binary_length(part["piece"])).as_py()
        if held:
            yield pack(now, held)

    return pieces.sortWithinPartitions("bucket").mapInArrow(tidy(run), "bucket long, symbols binary, rows binary, sizes binary")


def _merged(shards: DataFrame, length: int, parts: int) -> DataFrame:
    """key, from and to of what the buckets' merges find."""

    def opened(x: dict) -> dict:
        return {"symbols": np.frombuffer(x["symbols"], np.uint8), "sizes": np.frombuffer(x["sizes"], np.int32), "rows": pa.ipc.open_stream(x["rows"]).read_all()}

    def run(batches):
        held, now = [], None
        for b in batches:
            for x in b.to_pylist():
                if held and x["bucket"] != now:
                    if (out := covered(held, length)) is not None:
                        yield from out.to_batches()
                    held = []
                now = x["bucket"]
                held.append(opened(x))
        if held and (out := covered(held, length)) is not None:
            yield from out.to_batches()

    return shards.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), "key binary, from long, to long")


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """key, from and to (bytes) of what to remove from docs(doc_id, key, text); spans may overlap. Stored."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grams = sorted({max(1, round(g * length)) for g in GRAMS})
    own = ["doc_id", "key"]
    found, spans = _pieces(docs, "text", None, own, length, grams[0]), []
    address = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key", "start")
    for k in grams[1:] + [0]:
        firsts = found.groupBy("id").agg(F.min(address).alias("a"), F.first("piece").alias("piece"), F.first("name").alias("name"), F.first("n").alias("n"), F.first("often").alias("often"))
        firsts = stored(firsts.select("id", F.col("a.doc_id").alias("doc_id"), F.col("a.key").alias("key"), F.col("a.start").alias("start"), "piece", "name", "n", "often"), "firsts", compression="zstd")
        place = firsts.select("id", F.col("key").alias("k"), F.col("start").alias("s"))
        later = found.select("id", "key", "start", "n").join(place, "id").where((F.col("key") != F.col("k")) | (F.col("start") != F.col("s")))
        spans.append(stored(later.select("key", F.col("start").alias("from"), (F.col("start") + F.col("n") + length - 1).alias("to")), "spans"))
        weight = F.sum(F.octet_length("piece") + 1)
        by_name = firsts.groupBy("name").agg(weight.alias("weight"), F.count("*").alias("pieces"), F.max("often").alias("any")).where("pieces > 1 OR any").select("name", "weight")
        hard = stored(firsts.join(by_name, "name"), "hard", compression="zstd")
        total, hot = hard.agg(F.coalesce(F.sum(F.when(F.col("weight") <= NAME, F.octet_length("piece"))), F.lit(0)), F.count(F.when(F.col("weight") > NAME, 1))).first()
        buckets = max(1, -(-total // BUCKET))
        # At the last length a window is its own name: what is left there are other windows of one hash.
        cool = hard.where(F.col("weight") <= NAME) if k else hard
        cool = cool.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)))
        spans.append(stored(_merged(_shards(cool, length), length, max(1, min(buckets, 4 * parts))), "spans"))
        if not (k and hot):
            dropped(found, firsts, hard)
            break
        cut = _pieces(hard.where(F.col("weight") > NAME), "piece", "start", own, length, k)
        dropped(found, firsts, hard)
        found = cut
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs(doc_id, text, ...) with spans (array of from and to, in bytes) and kept (the other bytes) of every row.

    A byte goes if it is in a string of `length` bytes that also starts earlier: in a document of smaller doc_id, or
    earlier in its own. Strings are those of the input, never across documents; overlapping ones count. spans are
    maximal runs, in order; kept need not be valid UTF-8.

    Null and empty texts have no spans and nothing kept, as have texts shorter than `length` no spans. Documents with a
    null doc_id come after all others; those of one doc_id but different texts are ordered by a digest of the text. Rows
    equal in both are one document, and each has its result. An empty table gives an empty one. Columns named spans or
    kept are replaced; all others stay.
    """
    key, held, found_, whole_ = (fresh(docs, c) for c in ("__key", "__held", "__spans", "__text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.withColumn(key, F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text))))
    spans = repeated_spans(named.where(F.octet_length("text") >= length).select("doc_id", F.col(key).alias("key"), "text"), length)
    listed = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias(found_)).withColumnRenamed("key", held)

    def run(batches):
        for b in batches:
            spans, kept, whole = [], [], b[found_].is_null()
            for row, found in enumerate(b[found_].to_pylist()):
                if found is None:
                    spans.append([])
                    kept.append(None)
                    continue
                text, runs_ = b[whole_][row].as_py(), []
                for x in found:
                    if runs_ and x["from"] <= runs_[-1]["to"]:
                        runs_[-1]["to"] = max(runs_[-1]["to"], x["to"])
                    else:
                        runs_.append(dict(x))
                edges = [0, *[e for x in runs_ for e in (x["from"], x["to"])], len(text)]
                spans.append(runs_)
                kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2])))
            rest = [c for c in b.schema.names if c not in (whole_, found_)]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in rest], pa.array(spans, SPANS), pc.if_else(whole, b[whole_], pa.array(kept, b[whole_].type))], names=[*rest, "spans", "kept"])

    rest = [c for c in docs.columns if c.lower() not in ("spans", "kept")]
    joined = named.join(listed, named[key] == listed[held], "left").select(*[F.col(f"`{c}`") for c in rest], text.cast("binary").alias(whole_), found_)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return joined.mapInArrow(tidy(run), f"{kinds}, spans array<struct<from:long,to:long>>, kept binary")


SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
