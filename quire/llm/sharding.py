"""Sharding: a uniform shuffle into shards of exact size, by a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, stored, written

#: numpy draws hypergeometric variates of populations below this size only.
_NUMPY_LIMIT = 10**9


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows drawn without replacement from good + bad rows are good.

    Beyond numpy's limit: rejection under a Laplace envelope around the mode (log-concavity makes the envelope hold).
    """
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def weight(x: int) -> float:
        return _log_choose(good, x) + _log_choose(bad, draws - x)

    top = weight(mode)
    # For a log-concave law with mass p at its mode m: p(m + x) <= p * min(1, exp(w - p * |y|)) wherever y rounds to x, w = 1 + p / 2.
    peak = math.exp(top - _log_choose(good + bad, draws))
    flat = 1 + peak / 2
    while True:
        tail = 0.0 if rng.random() <= flat / (1 + flat) else rng.exponential()
        y = (flat + tail) / peak if tail else rng.random() * flat / peak
        x = mode + int(round(y if rng.random() < 0.5 else -y))
        if low <= x <= high and math.log(max(rng.random(), 1e-300)) - tail <= weight(x) - top:
            return x


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows from each partition to each shard, as a uniform permutation of all rows would send them.

    Row sums are the partitions' counts and column sums the shards' sizes, exactly.
    """
    rng, left = np.random.Generator(np.random.Philox(seed)), list(sizes)
    matrix = []
    for count in counts:
        row, total, need = [], sum(left), count
        for s, room in enumerate(left):
            total -= room
            take = need if s == len(left) - 1 else hypergeometric(rng, room, total, need)
            row.append(take)
            need -= take
        left = [room - take for room, take in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def uniform_shards(df: DataFrame, shards: int = 8, seed: int = 42, bucket_rows: int = 50_000) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in each shard): a uniform random permutation, cut into
    shards whose row counts differ by one at most.

    Stages: (1) rows get two random numbers, are permuted within their partition by the first, get its number and their
    place in it, and are written once to the shared folder, so that a recomputation cannot draw anew; (2) the driver
    draws the communication matrix from the partitions' counts (one row of `shards` integers for each input partition),
    which is broadcast within BROADCAST_BYTES and written to the shared folder and joined beyond;
    (3) a partition's first a[p, 0] rows go to shard 0, the next a[p, 1] to shard 1, ...; (4) they are exchanged by
    shard and by range of the second random number, at most about `bucket_rows` together, and ordered there: no task
    sorts a whole shard. So whole rows are exchanged once.

    Any rows may repeat or hold nulls; keys play no part, so none is hot. An empty table gives an empty one. Columns of
    df named shard or slot are replaced.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    drawn = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.rand(seed).alias("r1"), F.rand(seed + 1).alias("r2")).sortWithinPartitions("r1", "r2")
    # In the lower 33 bits, the place in the partition.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(drawn.select("row", "r1", "r2", F.spark_partition_id().alias("part"), place.alias("at")), "shards")
    found = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in found)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in found], sizes, seed)
    ends = [{"part": p, "ends": np.cumsum(row).tolist()} for (p, _), row in zip(found, matrix, strict=True)]
    small = len(found) * (shards + 4) * 8 <= BROADCAST_BYTES
    if small:
        plan = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<part:int,ends:array<bigint>>>"))))
    else:
        plan = spark.read.schema("part int, ends array<bigint>").json(written(spark, "matrix", "\n".join(map(json.dumps, ends))))

    sent = rows.join(plan, "part")
    buckets = max(1, math.ceil(total / shards / bucket_rows))
    sent = sent.select("row", "r1", "r2", F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("shard"), F.floor(F.col("r2") * buckets).alias("bucket"))

    starts = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    again = Window.partitionBy("shard", "bucket").orderBy("r2", "r1")
    placed = sent.withColumn("place", F.row_number().over(again) - 1).join(F.broadcast(starts) if buckets * shards <= 100_000 else starts, ["shard", "bucket"])
    return placed.select("row.*", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
