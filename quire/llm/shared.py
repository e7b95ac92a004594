"""Helpers that several operators of this package use."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound, in bytes, of a table that an operator broadcasts after measuring it.
BROADCAST_BYTES = 64 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: 256-entry tables: lower-casing of A-Z, and the white space 0x20, 0x09-0x0D.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True


#: Rows and bytes of the batches that workers get, where the session has Spark's own values: a row may hold a whole text.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}
#: The same for stages that follow one another in the same executors, where each one's buffers add up.
SMALL_BATCHES = BATCHES | {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "1048576b")}


def tuned(spark: SparkSession, batches: dict[str, tuple[str, str]] = BATCHES) -> SparkSession:
    """The session with batches of a size that fits texts (BATCHES or SMALL_BATCHES); other values that its owner has set
    stay."""
    for key, (usual, own) in batches.items():
        if spark.conf.get(key, usual) in (usual, BATCHES[key][1], SMALL_BATCHES[key][1]):
            spark.conf.set(key, own)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all run on
    this machine (local mode); else an error, since executors would write where nobody reads."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths written by this process and not deleted yet.
_WRITTEN: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    """Intermediate tables go with the session, if it still runs."""
    for path, spark in _WRITTEN.items():
        with contextlib.suppress(Exception):
            _delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; it is deleted when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df to the shared folder and reads it back: it is computed once, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def written(spark: SparkSession, name: str, text: str) -> str:
    """The path of a new text file in the shared folder."""
    path = new_path(spark, name)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return path


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._stored_at)
        _WRITTEN.pop(t._stored_at, None)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are gone: it does so when the driver collects its garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def tidy(run):
    """run(batches), which gives the memory it used back to the system at its end: Python workers live on between tasks."""

    def out(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return out


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """df without the rows whose column is among ids(column), null being a value; ids are broadcast if they take
    BROADCAST_BYTES at most, else both sides are shuffled."""
    name = fresh(df, "__id")
    ids = stored(ids.select(F.col(column).alias(name)).distinct(), "ids")
    if ids.count() * 32 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return df.join(ids, df[column].eqNullSafe(F.col(name)), "left_anti")


def lower_ascii(column):
    """A-Z to a-z; other letters stay (lower() would change them too)."""
    return F.translate(column, UPPER, LOWER)


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """df with __key, equal for equal rows in these columns, nulls included."""
    return df.withColumn("__key", F.xxhash64(*columns))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, without copying, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def text_groups(column: pa.Array, most: int = 1 << 20):
    """(first row, bytes, offsets from 0) of runs of rows of about `most` bytes together; a longer text is a run of its own.

    It bounds the arrays that numpy makes beside a batch.
    """
    data, offsets = text_buffer(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE_BYTES[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, two: bool = False):
    """64-bit hashes of byte spans, eight bytes a step: equal spans get equal hashes. two: a pair of independent ones."""
    lengths = (ends - starts).astype(np.uint64)
    padded = np.zeros(-(-len(data) // 8) * 8 + 16, np.uint8)
    padded[: len(data)] = data
    whole = padded.view("<u8")
    seeds = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[: 1 + two]
    out = [mix(lengths * np.uint64(seed) + np.uint64(seed >> 7)) for seed in seeds]
    at, left, rows = starts.astype(np.int64), lengths.copy(), None
    while len(at):
        place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        # The second word's shift is split in two, since a shift by 64 bits is undefined.
        value = (whole[place] >> shift) | ((whole[place + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        value &= ~np.uint64(0) >> (np.uint64(64) - (np.minimum(left, np.uint64(8)) << np.uint64(3)))
        for k, seed in enumerate(seeds):
            state = out[k] if rows is None else out[k][rows]
            state = mix((state ^ value) * np.uint64(seed))
            if rows is None:
                out[k] = state
            else:
                out[k][rows] = state
        more = np.flatnonzero(left > 8)
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - np.uint64(8)
    return tuple(out) if two else out[0]
