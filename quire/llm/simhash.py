"""SimHash near-dedup: fingerprints, meet-in-the-middle ball hashing, and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import dropped, stored, tidy

_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, signed: A-Z lower-cased, words split at ASCII white space, shingles of `words`
    words with repeats, each hashed by XXH64. Fewer words: one shingle of them all; none, or null: zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = (ends - np.fromiter(map(len, parts), np.int64, len(parts)) - 1).tolist()
    ends = (ends - 1).tolist()
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    ones, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, _CHUNK):
        hashes = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[at : at + _CHUNK], last[at : at + _CHUNK])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (signed 64-bit) of every row of docs(doc_id, text); other columns are not read."""

    def run(batches):
        for b in batches:
            made = [fingerprint(t.as_py(), words, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def ball(column, radius: int):
    """All values at most `radius` (0, 1 or 2) bits from a 64-bit column."""
    bits = [F.lit(0)] if radius == 0 else None
    if bits:
        return F.array(column)
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: column.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    out = F.concat(F.array(column), flips)
    if radius == 1:
        return out
    if radius > 2:
        raise ValueError("a radius of 5 bits at most is supported")
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(62)),
            lambda i: F.transform(F.sequence(i + 1, F.lit(63)), lambda j: column.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))),
        )
    )
    return F.concat(out, pairs)


def close_edges(values: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct values of column fp whose closure links every two values at most `radius` bits
    apart.

    Every value emits all variants within half the radius; two values within the radius meet at a variant. A variant
    gathers at most the values of one ball (65 for radius 2), however many rows hold them, so its group is bounded. In
    it, edges go from the least value to the others: their number is linear, and each is verified by its distance.
    Values that meet but are more than radius apart (odd radius) are joined pair by pair instead.
    """
    half = (radius + 1) // 2
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (
        values.select("fp").distinct().repartition(parts, "fp").select("fp", F.explode(ball(F.col("fp"), half)).alias("variant"))
        .groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    )
    if 2 * half == radius:
        pairs = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    else:
        pairs = met.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b"))
    return pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and label (the least node of its component) for every node of edges(a, b).

    Rounds of taking the least neighbouring label and of pointer jumping, each written to the shared folder, until
    nothing changes. Sums and minima are partial before the shuffle, so a hub is not gathered in one task.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        now = labels.select("node", "label")
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hooked = now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("m"))
        made = stored(hooked.join(jump, "label").select("node", "old", F.least("label", "m").alias("label")), "labels")
        dropped(labels)
        labels = made
        if not made.where("label <> old").limit(1).count():
            dropped(both)
            return labels.select("node", "label")
    raise RuntimeError("components: not converged")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id of every row of docs(doc_id, text).

    component_id is the least doc_id reachable over links of at most `radius` differing bits. Equal fingerprints are one
    node whatever their number. Null texts have fingerprint zero; a component without any doc_id has a null id; repeated
    rows stay and share their component; an empty table gives an empty one; other columns are dropped.
    """
    prints = stored(fingerprints(docs, words, seed), "prints")
    values = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    labels = components(close_edges(values, radius))
    node = values.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("label", "fp").alias("label"))
    node = stored(node, "nodes")
    # Only values whose component has another least id than their own need a look-up in the large table.
    least = node.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_value = node.join(least, "label").select("fp", "component_id")
    return prints.join(by_value, "fp").select("doc_id", "fp", "component_id")
