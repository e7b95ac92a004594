"""Token-ID output: blocks of ids transposed into byte or bit planes, each compressed, with a chunk index."""

from __future__ import annotations

import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import Cache, ids_of_spans, script_cuts
from .shared import BROADCAST_BYTES, new_path, stored, text_groups, tidy, word_spans

#: Head of a chunk: magic, version, plane kind (0 bytes, 1 bits), ids, planes, crc32 of the ids as little-endian uint32.
_HEAD = struct.Struct("<4sBBIHI")
_MAGIC = b"QBPL"


def pack_chunk(ids: np.ndarray, kind: str = "byte", level: int = 3) -> bytes:
    """A chunk: head, the planes' compressed lengths (uint32 each), the planes from the lowest on.

    Only planes up to the largest id's are kept. A byte plane holds the same byte of every id; a bit plane the same bit,
    eight ids to a byte.
    """
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        planes = [np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4)[:, i]).tobytes() for i in range((top + 7) // 8)]
    else:
        planes = [np.packbits(((ids >> np.uint32(i)) & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes() for i in range(top)]
    pressed = [zstandard.ZstdCompressor(level=level).compress(p) for p in planes]
    head = _HEAD.pack(_MAGIC, 1, int(kind == "bit"), len(ids), len(planes), zlib.crc32(ids.tobytes()))
    return head + struct.pack(f"<{len(pressed)}I", *map(len, pressed)) + b"".join(pressed)


def unpack_chunk(block: bytes) -> np.ndarray:
    """The ids of a chunk; raises ValueError if it isn't one or is damaged."""
    magic, version, bit, n, planes, crc = _HEAD.unpack_from(block)
    if magic != _MAGIC or version != 1:
        raise ValueError("not a chunk of ids")
    at = _HEAD.size + 4 * planes
    ids = np.zeros(n, "<u4")
    for i, size in enumerate(struct.unpack_from(f"<{planes}I", block, _HEAD.size)):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[at : at + size], max_output_size=n or 1), np.uint8)
        ids |= np.unpackbits(raw, count=n, bitorder="little").astype("<u4") << np.uint32(i) if bit else raw.astype("<u4") << np.uint32(8 * i)
        at += size
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a damaged chunk of ids")
    return ids


def word_encoder(tokenizer):
    """(data, offsets) to the ids of each text, exactly as the tokenizer would give for whole texts.

    Texts are cut where no step of the tokenizers meant here looks across: at ASCII white space, which they drop, and
    between a letter of ASCII or Latin-1 and an ASCII mark other than the apostrophe, where they start a new piece. Each
    distinct run is encoded once. A-Z before another ASCII character is lower-cased first (as these tokenizers do, and no
    composition can be touched). Texts that may hold special tokens are only cut at white space.
    """
    known = Cache(lambda runs: [array("i", e.ids).tobytes() for e in tokenizer.encode_batch_fast([r.decode("utf-8") for r in runs], add_special_tokens=False)], 250_000)

    def encode(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(offsets) - 1
        spaced = np.full(len(data) + n, 32, np.uint8)  # a blank behind each text
        for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            spaced[s + i : e + i] = data[s:e]
        cut = np.zeros(len(spaced), dtype=bool)  # before this byte
        if b"<|" not in data.tobytes():
            upper = (spaced >= 65) & (spaced <= 90)
            upper[:-1] &= spaced[1:] < 128
            spaced = spaced + upper.astype(np.uint8) * np.uint8(32)
            cut = script_cuts(spaced)
        starts, ends = word_spans(spaced)
        inner = np.flatnonzero(cut)
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        # Arrow arrays hold adjoining spans: the gaps between runs are entries too, and are not taken.
        bounds = np.sort(np.concatenate([starts, ends]))
        bounds = bounds[np.append(True, bounds[1:] != bounds[:-1])].astype(np.int32) if len(bounds) else bounds.astype(np.int32)
        every = pa.Array.from_buffers(pa.binary(), max(0, len(bounds) - 1), [None, pa.py_buffer(bounds), pa.py_buffer(spaced)])
        flat, lengths = ids_of_spans(every.take(pa.array(np.searchsorted(bounds, starts))) if len(bounds) else every, known.ids)
        behind = np.searchsorted(starts, offsets[1:] + np.arange(n))  # how many runs the texts so far have
        last = np.append(0, np.cumsum(lengths))[behind]
        return [flat[a:b] for a, b in zip(np.append(0, last[:-1]), last)]

    return encode


_encoders: dict[int, object] = {}


def _encoder(spec: str):
    """This worker's encoder for a tokenizer file, with what it has met in earlier tasks; one at a time is kept."""
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; threads of its own cost memory
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _encoders.clear()
        _encoders[key] = word_encoder(tokenizer)
    return _encoders[key]


_CHUNKS = "part int, chunk int, first long, n_ids int, lead_start long, doc_starts array<long>, doc_ids array<{0}>, block binary"


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, chunk_ids: int = 1 << 16, kind: str = "byte", partitions: int | None = None) -> str:
    """Encodes every text of docs(doc_id, text), appends end_id, and writes the ids in ascending doc_id order; the path.

    Rows are range-partitioned by doc_id (equal ids by the text's hash; null first) and each partition writes its ids as
    chunks of `chunk_ids` ids, which run across documents. A row of the Parquet files is one chunk: `block` holds the
    planes (pack_chunk); the other columns are the chunk index: the partition, the chunk's number in it, the place of its
    first id in the partition, and where documents start. Columns are read apart, so the index costs no read of blocks.
    Blocks are compressed already, so the files are written without page compression. Memory: one chunk and the longest text. Null texts have the end id alone; an empty table writes no chunks.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "ids")
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()

    def run(batches):
        encode = _encoder(spec)
        part, chunk, first, lead = TaskContext.get().partitionId(), 0, 0, -1
        held, size, starts, keys, end = [], 0, [], [], np.array([end_id], np.int32)
        position = 0  # of the next document's first id

        def cut(ids: np.ndarray):
            nonlocal chunk, first, lead, starts, keys
            inside = sum(1 for s in starts if s < first + len(ids))
            row = (part, chunk, first, len(ids), lead, starts[:inside], keys[:inside], pack_chunk(ids, kind))
            if inside:
                lead = starts[inside - 1]
            starts, keys = starts[inside:], keys[inside:]
            chunk, first = chunk + 1, first + len(ids)
            return row

        def batch(rows, schema):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names=["part", "chunk", "first", "n_ids", "lead_start", "doc_starts", "doc_ids", "block"])

        kinds = None
        for b in batches:
            kinds = kinds or [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(b.column(0).type), pa.binary()]
            for at, data, offsets in text_groups(b.column(1), 1 << 20):
                names = b.column(0).slice(at, len(offsets) - 1).to_pylist()
                for name, ids in zip(names, encode(data, offsets), strict=True):
                    starts.append(position)
                    keys.append(name)
                    held += [ids, end]
                    position += len(ids) + 1
                    size += len(ids) + 1
                rows = []
                if size >= chunk_ids:
                    whole = np.concatenate(held)
                    rows = [cut(whole[i : i + chunk_ids]) for i in range(0, size - chunk_ids + 1, chunk_ids)]
                    rest = whole[len(rows) * chunk_ids :]
                    held, size = [rest], len(rest)
                if rows:
                    yield batch(rows, kinds)
        if size:
            yield batch([cut(np.concatenate(held))], kinds)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    rows = rows.sortWithinPartitions(*keys).select("doc_id", "text")
    rows.mapInArrow(tidy(run), _CHUNKS.format(docs.schema["doc_id"].dataType.simpleString())).write.option("compression", "none").parquet(path)
    return path


def _chunks(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    return spark.read.schema(_CHUNKS.format(id_type)).parquet(path)


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The crc32 of a concatenation from each part's (bytes, crc32). A crc is linear, so the left part's moves past the
    right part as past as many zeros."""
    out = 0
    for size, crc in parts:
        while size > 0:
            zeros = bytes(min(size, 1 << 18))
            out = zlib.crc32(zeros, out) ^ zlib.crc32(zeros)
            size -= len(zeros)
        out ^= crc
    return out


def read_documents(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in files of write_ids.

    Each chunk is unpacked by itself; a document that runs over chunks is put together from its segments' lengths and
    checksums, which are a few bytes each. Partition sums, one row for each file partition, give the places; they are
    broadcast if they take BROADCAST_BYTES at most.
    """
    chunks = _chunks(spark, path, id_type)

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                ids = unpack_chunk(r["block"])
                starts = [*([r["lead_start"]] if r["lead_start"] >= 0 and (not r["doc_starts"] or r["doc_starts"][0] > r["first"]) else []), *r["doc_starts"]]
                names = [*[None] * (len(starts) - len(r["doc_ids"])), *r["doc_ids"]]
                cuts = [max(0, s - r["first"]) for s in starts] + [len(ids)]
                for s, name, a, z in zip(starts, names, cuts, cuts[1:]):
                    rows.append((r["part"], s, name, r["chunk"], z - a, zlib.crc32(ids[a:z].tobytes())))
            if rows:
                part, start, name, chunk, n, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array(start, pa.int64()), pa.array(name, b.schema.field("doc_ids").type.value_type), pa.array(chunk, pa.int32()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "begin", "doc_id", "chunk", "n", "crc"],
                )

    segments = chunks.mapInArrow(run, f"part int, begin long, doc_id {id_type}, chunk int, n long, crc long")

    @F.pandas_udf("long")
    def combined(column):
        return column.map(lambda parts: joined_crc([(4 * p["n"], p["crc"]) for p in parts]) if len(parts) > 1 else parts[0]["crc"])

    docs = segments.groupBy("part", "begin").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("chunk", "n", "crc"))).alias("parts")
    )
    sizes = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = stored(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), "before")
    small = before.count() * 16 <= BROADCAST_BYTES
    return docs.join(F.broadcast(before) if small else before, "part").select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", combined("parts").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """part, chunk, first and ids (array of int) of every chunk: the ids themselves, in file order by (part, chunk)."""

    def run(batches):
        for b in batches:
            ids = [unpack_chunk(x).astype(np.int32) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.list_(pa.int32()))], names=["part", "chunk", "first", "ids"])

    return _chunks(spark, path, id_type).select("part", "chunk", "first", "block").mapInArrow(run, "part int, chunk int, first long, ids array<int>")
