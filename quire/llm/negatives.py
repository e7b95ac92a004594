"""Hard-negative mining: exact search in k-means inverted lists whose centroids have radii.

Every row lies in the list of its nearest centroid, cut into blocks; a centroid's radius is the largest distance of its
rows. By Cauchy-Schwarz no row of a list scores above q.c + |q| r or below q.c - |q| r. A query visits lists by
descending upper bound, a few in each round and four times as many in the next; it skips lists whose bounds lie outside
its windows and ends once the bound is strictly below its k-th score. So the results are those of a full scan.

A round's visits are grouped by list into chunks of queries, joined with the blocks of the list and scored as matrices.
Neither side of a pair is larger than CHUNK queries or BLOCK rows, whatever share of the rows a list, a label or a group
of copies has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import dropped, stored, tidy

#: Rows of a block, and queries of a chunk.
BLOCK, CHUNK = 2048, 256
#: Bounds of the centroids' number and bytes, and of the rows and values of the sample that they are fitted on.
MOST_LISTS, LIST_BYTES = 4096, 8 << 20
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 4_000_000
#: Lists a query visits in the first round, and the factor from round to round.
FIRST, FACTOR = 4, 4
#: Scores beyond any that 64 bits hold.
ENDLESS = (1 << 63) - 1
#: Distances that one step of the search for centers holds (8 MB).
STEP_VALUES = 1 << 20


def whole_vectors(table: DataFrame, anchors: Column, id: str, label: str, vector: str, scale: int) -> DataFrame:
    """row, id, label, v (floor(scale * x) of each component) and anchor of the rows that take part; stored."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    own = (F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("label"), v.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    return stored(table.where(sound).select(*own), "vectors")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists as rows of `width` values; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    if len(column):
        out[np.repeat(np.arange(len(column)), sizes), np.concatenate([np.arange(n) for n in sizes]).astype(int) if len(sizes) else []] = column.flatten().to_numpy()
    return out


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The index of the nearest center, the first among equals; rows are taken in steps, whose distances are bounded."""
    norms, step = (centers**2).sum(axis=1), max(1, STEP_VALUES // max(len(centers), 1))
    return np.concatenate([np.zeros(0, np.intp), *[np.argmin(norms - 2 * (x[at : at + step] @ centers.T), axis=1) for at in range(0, len(x), step)]])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """At most k centers of x by Lloyd's algorithm; centers without rows go."""
    centers = np.unique(x[np.random.default_rng(seed).permutation(len(x))[:k]], axis=0)
    for _ in range(rounds):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        centers = total[n > 0] / n[n > 0, None]
    return centers


class Lists:
    """Inverted lists over the rows of whole_vectors: centers and radii (arrays), blocks (a stored table)."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        size = F.size("v")
        n, width, most = vectors.agg(F.count("*"), F.max(size), F.max(F.array_max(F.transform("v", F.abs)))).first()
        self.width, self.rows = int(width or 0), n
        #: Whether every product of two rows is exact in doubles.
        self.exact = (most or 0) ** 2 * max(self.width, 1) < 2**53
        k = int(min(MOST_LISTS, max(1, LIST_BYTES // (8 * max(self.width, 1))), max(1, math.isqrt(n))))
        sample = vectors.orderBy(F.xxhash64("row"), "row").select("v").limit(max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(self.width, 1)))).toArrow()
        self.centers = kmeans(matrix(sample["v"], self.width), k) if n else np.zeros((0, self.width))
        given = spark.sparkContext.broadcast(self.centers)

        def assign(batches):
            for b in batches:
                x = matrix(b["v"], given.value.shape[1])
                own = nearest(x, given.value)
                far = np.sqrt(((x - given.value[own]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(far)], names=[*b.schema.names, "list", "far"])

        self.assigned = stored(vectors.mapInArrow(tidy(assign), "row long, id long, label int, v array<double>, anchor boolean, list int, far double"), "assigned")
        sizes = self.assigned.groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        # A row for each centroid: at most MOST_LISTS.
        kept = {r["list"]: r["radius"] for r in sizes.collect()}
        self.radii = np.array([kept.get(i, -1.0) for i in range(len(self.centers))])
        salts = F.broadcast(sizes.select("list", F.ceil(F.col("n") / (4 * BLOCK)).alias("salts")))
        dealt = self.assigned.join(salts, "list").withColumn("salt", F.expr("pmod(xxhash64(row), salts)"))
        dealt = dealt.repartition("list", "salt").sortWithinPartitions("list").select("list", "row", "id", "label", "v")
        width_ = self.width

        def pack(batches):
            held: list[pa.RecordBatch] = []

            def block(parts):
                t = pa.Table.from_batches(parts)
                ids = t["id"].combine_chunks()
                packed = (t["row"].to_numpy(), ids.fill_null(ENDLESS).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), t["label"].to_numpy(), matrix(t["v"], width_))
                return pa.RecordBatch.from_arrays([t["list"].combine_chunks()[:1], pa.array([packed[0][0]], pa.int64()), *[pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in packed]], names=NAMES)

            for b in batches:
                lists = b["list"].to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
                for lo, hi in zip(cuts, cuts[1:]):
                    while lo < hi:
                        if held and (held[0]["list"][0].as_py() != lists[lo] or sum(map(len, held)) >= BLOCK):
                            yield block(held)
                            held = []
                        take = min(hi - lo, BLOCK - sum(map(len, held)))
                        held.append(b.slice(lo, take))
                        lo += take
            if held:
                yield block(held)

        self.blocks = stored(dealt.mapInArrow(tidy(pack), "list int, block long, rows binary, ids binary, nulls binary, labels binary, vecs binary"), "blocks")


NAMES = ["list", "block", "rows", "ids", "nulls", "labels", "vecs"]
WINDOW = "array<struct<w:int,lo:long,hi:long,kth:long>>"
QUERY = f"q long, label int, v array<double>, windows {WINDOW}, done int"
FOUND = "q long, w int, score long, id long, row long"


def bounds(q: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores in each list, for rows of q, a little wider for rounding; lists without rows
    are never in reach."""
    middle = q @ centers.T
    norms = np.sqrt((q**2).sum(axis=1))[:, None]
    reach = norms * np.maximum(radii, 0) + 1e-9 * (norms * (np.sqrt((centers**2).sum(axis=1)) + np.maximum(radii, 0)) + 1)
    low, high = middle - reach, middle + reach
    low[:, radii < 0], high[:, radii < 0] = np.inf, -np.inf
    return low, high


def next_lists(low: np.ndarray, high: np.ndarray, windows: list[dict], done: int, step: int) -> tuple[list[int], int]:
    """The next lists of one query, at most `step`, and how far in the order of its upper bounds it is then."""
    order = np.argsort(-high, kind="stable")[done:]
    up, down = high[order], low[order]
    wanted = np.zeros(len(order), bool)
    for w in windows:
        wanted |= (up >= w["lo"]) & (down <= w["hi"]) & ((up >= w["kth"]) if w["kth"] is not None else True)
    at = np.flatnonzero(wanted)[:step]
    return order[at].tolist(), done + (int(at[-1]) + 1 if len(at) else len(order))


def best(scores, ids, nulls, rows, k: int) -> np.ndarray:
    """Places of the k first by descending score, then id (nulls last), then row."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= least)
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((rows[place], ids[place], nulls[place], -scores[place]))][:k]


def search(lists: Lists, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
    """q, w, score, id and row of the first k rows for every query and window; stored.

    queries(q, label, v, windows): q is the query's own row, which it never finds; a window is (w, lo, hi, kth null).
    Rows of the same label, or of others, whose score lies in the window; higher scores first, ties by id, then row.
    """
    spark: SparkSession = queries.sparkSession
    width, exact = lists.width, lists.exact
    given = spark.sparkContext.broadcast((lists.centers, lists.radii))
    state = queries.select("q", "label", "v", F.col("windows").cast(WINDOW).alias("windows"), F.lit(0).alias("done"))
    found, step = spark.createDataFrame([], FOUND), FIRST
    while True:

        def turn(batches, step=step):
            for b in batches:
                for at in range(0, len(b), CHUNK):
                    part = b.slice(at, CHUNK)
                    low, high = bounds(matrix(part["v"], width), *given.value)
                    went = [next_lists(low[i], high[i], w, d, step) for i, (w, d) in enumerate(zip(part["windows"].to_pylist(), part["done"].to_pylist()))]
                    own = [*part.columns[:-1], pa.array([x[1] for x in went], pa.int32()), pa.array([x[0] for x in went], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(own, names=[*part.schema.names, "lists"])

        turned = stored(state.mapInArrow(tidy(turn), QUERY + ", lists array<int>").where(F.size("lists") > 0), "turn")
        if not turned.limit(1).count():
            dropped(turned)
            return found

        def chunks(batches):
            for b in batches:
                for at in range(0, len(b), CHUNK):
                    part = b.slice(at, CHUNK)
                    visits = part["lists"].to_pylist()
                    for one in sorted({x for v in visits for x in v}):
                        rows = pa.array([i for i, v in enumerate(visits) if one in v])
                        sink = pa.BufferOutputStream()
                        taken = pa.Table.from_batches([part]).select(["q", "label", "v", "windows"]).take(rows)
                        with pa.ipc.new_stream(sink, taken.schema) as out:
                            out.write_table(taken)
                        yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([sink.getvalue().to_pybytes()])], names=["list", "chunk"])

        def scored(batches):
            for b in batches:
                for x in b.to_pylist():
                    asked = pa.ipc.open_stream(x["chunk"]).read_all()
                    rows, ids = np.frombuffer(x["rows"], np.int64), np.frombuffer(x["ids"], np.int64)
                    nulls, labels = np.frombuffer(x["nulls"], bool), np.frombuffer(x["labels"], np.int32)
                    have, want = np.frombuffer(x["vecs"]).reshape(len(rows), width), matrix(asked["v"], width)
                    if exact:
                        scores = (want @ have.T).astype(np.int64)
                    else:  # whole numbers of any size
                        whole = lambda m: np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape)
                        scores = (whole(want) @ whole(have).T).astype(np.int64)
                    out = []
                    for q, label, windows, s in zip(asked["q"].to_pylist(), asked["label"].to_pylist(), asked["windows"].to_pylist(), scores):
                        fits = ((labels == label) == same_label) & (rows != q)
                        for w in windows:
                            place = np.flatnonzero(fits & (s >= max(w["lo"], w["kth"] if w["kth"] is not None else w["lo"])) & (s <= w["hi"]))
                            out += [(q, w["w"], int(s[i]), None if nulls[i] else int(ids[i]), int(rows[i])) for i in place[best(s[place], ids[place], nulls[place], rows[place], k)]]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j == 1 else pa.int64()) for j, c in enumerate(zip(*out))], names=["q", "w", "score", "id", "row"])

        # A chunk holds its queries once for each list, far more than its stored table: never through the driver.
        met = turned.mapInArrow(tidy(chunks), "list int, chunk binary").hint("merge").join(lists.blocks, "list").drop("list", "block")
        first = Window.partitionBy("q", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
        now = stored(found.unionByName(met.mapInArrow(tidy(scored), FOUND)).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r"), "found")
        kth = now.groupBy("q", "w").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kths"))
        windows = F.transform("windows", lambda w: F.struct(w["w"].alias("w"), w["lo"].alias("lo"), w["hi"].alias("hi"), F.col("kths")[w["w"]].alias("kth")))
        renewed = stored(turned.join(kth, "q", "left").select("q", "label", "v", windows.cast(WINDOW).alias("windows"), "done"), "state")
        dropped(turned, *[t for t in (state, found) if hasattr(t, "_stored_at")])
        state, found, step = renewed, now, step * FACTOR


def mine(table: DataFrame, anchors: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every anchor.

    A component counts as floor(scale * x), a score is the inner product, which must fit a long (else the job fails).
    Positives are an anchor's first `positives` other rows of its label; for each of them the first `negatives` rows of
    other labels that score from `low` to `high` percent of it, in hundredths of the exact whole numbers.

    Rows with a null label or vector, or a null or non-finite component, take no part. A null id is never smaller than
    another. Of vectors of different lengths the shorter counts as ending in zeros; empty vectors score 0. A repeated
    row is another row: as anchor it has results of its own, and it finds its copies. An anchor without a positive or
    without any fitting negative has no rows; an empty table has none. Other columns are not read, except by `anchors`.
    """
    vectors = whole_vectors(table, anchors, id, label, vector, scale)
    lists = Lists(vectors)
    # Anchors of one list lie together, so that a chunk of them visits few lists.
    asked = lists.assigned.where("anchor").repartitionByRange("list", "row").sortWithinPartitions("list")
    asked = stored(asked.select(F.col("row").alias("q"), "id", "label", "v"), "anchors")
    every = F.expr(f"array(named_struct('w', 0, 'lo', -{ENDLESS}L, 'hi', {ENDLESS}L, 'kth', CAST(NULL AS BIGINT)))")
    near = search(lists, asked.withColumn("windows", every), positives, True)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row"))
    near = stored(near.withColumn("w", place).select("q", "w", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    # At a negative score, low percent of it is above high percent: nothing fits.
    window = F.struct("w", F.expr(f"(CAST(positive_score AS DECIMAL(20, 0)) * {low} + 99) div 100").alias("lo"), F.expr(f"(CAST(positive_score AS DECIMAL(20, 0)) * {high}) div 100").alias("hi"), F.lit(None).cast("long").alias("kth"))
    windows = near.where("positive_score >= 0").groupBy("q").agg(F.collect_list(window).alias("windows"))
    hard = search(lists, asked.join(windows, "q"), negatives, False)
    rank = F.row_number().over(Window.partitionBy("q", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")).cast("int")
    hard = hard.select("q", "w", rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(hard, ["q", "w"]).join(asked.select("q", F.col("id").alias("anchor_id")), "q")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
