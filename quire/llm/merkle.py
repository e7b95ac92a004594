"""Merkle dataset manifest: a tree of hashes over the rows of a table, level by level as DataFrames.

Rows get an index in their tree (row_number over range partitions, so that no tree is gathered in one task); a level's
indices divided by the fanout name the parents, whose hash is that of their children in order. From the root down, each
level is joined with its parents and puts its siblings before what stands above it: a row's path has all siblings from
its own level to the root. Both ways a level has a fanout-th of the rows of the one below, so the work is that of a few
passes over the leaves, not of one for each level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, stored

#: What stands for null in a hashed row.
ABSENT = "-"
#: Levels joined in one plan on the way down before its rows are written.
AT_ONCE = 6


def digest(value: Column) -> Column:
    """SHA-256 of a string or binary column, as 32 bytes."""
    return F.unhex(F.sha2(value, 256))


def as_text(value: Column) -> Column:
    """Digests as lowercase hex, which is what parents hash."""
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    """A value in a hashed row: its UTF-8 byte count, a colon, itself; ABSENT for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(ABSENT))


def leaf(*values: Column) -> Column:
    """The hash of a row, over its values in this order."""
    return digest(F.concat(*[field(v) for v in values]))


def numbered(df: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """df, written to the shared folder, with idx (from 0, in order within each tree) and n (rows of the tree).

    Rows are range-partitioned by tree and order, ties by their place in the input, so that a tree with a third of all
    rows, or a value that a third of all rows share, lies in many partitions. Only the counts of each partition and tree
    are summed over partitions.
    """
    placed = df.withColumn("__row", F.monotonically_increasing_id())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(parts, tree, *order, "__row").withColumn("__part", F.spark_partition_id())
    placed = stored(placed, name)
    counts = placed.groupBy(tree, "__part").agg(F.count("*").alias("__own"))
    trees = counts.groupBy(tree).agg(F.sum("__own").alias("n"))
    before = Window.partitionBy(tree).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__own").over(before), F.lit(0))).drop("__own").join(trees, tree)
    local = F.row_number().over(Window.partitionBy(tree, "__part").orderBy(*[F.col(c).asc_nulls_first() for c in order], "__row"))
    out = placed.withColumn("__local", local).join(counts, [tree, "__part"])
    return out.withColumn("idx", F.col("__before") + F.col("__local") - 1).drop("__part", "__row", "__local", "__before")


@dataclass
class Levels:
    """nodes[k] is a stored table (tree, idx, n, hash, kids) of level k, n being the level's nodes of that tree; tops is
    (tree, hash, level) of what remains of each tree."""

    nodes: list[DataFrame]
    tops: DataFrame


def build(leaves: DataFrame, fanout: int, name: str) -> Levels:
    """The levels over leaves(tree, idx, n, hash): every `fanout` consecutive nodes become their hash, while a tree has
    more than one."""
    own = ["tree", "idx", "n", "hash"]
    nodes = [stored(leaves.select(*own, F.lit(None).cast("array<binary>").alias("kids")), f"{name}-0")]
    most = nodes[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        most = -(-most // fanout)
        child = F.struct("idx", "hash")
        made = nodes[-1].where("n > 1").groupBy("tree", F.expr(f"idx div {fanout}").alias("idx")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(child)).alias("kids"))
        made = made.select("tree", "idx", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.col("kids.hash").alias("kids"))
        made = made.withColumn("hash", digest(F.concat_ws("", F.transform("kids", as_text)))).select(*own, "kids")
        nodes.append(stored(made, f"{name}-{len(nodes)}"))
    tops = [t.where("n = 1").select("tree", "hash", F.lit(k).alias("level")) for k, t in enumerate(nodes)]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return Levels(nodes, stored(out, f"{name}-tops"))


def paths(levels: Levels, fanout: int, above: DataFrame | None = None) -> DataFrame:
    """tree, idx, hash and path of every leaf.

    path is an array of (left, right): the concatenated digests of a node's siblings before and after it, from the
    leaf's level up. above(tree, path) is what stands over each tree's top; none: nothing.
    """
    empty = F.array().cast("array<struct<left:binary,right:binary>>")
    kept, state = [], None
    for k in range(len(levels.nodes) - 1, -1, -1):
        nodes = levels.nodes[k]
        ended = nodes.where("n = 1").select("tree", "idx", "hash", "kids")
        ended = ended.withColumn("path", empty) if above is None else ended.join(above, "tree")
        if state is None:
            state = ended
            continue
        parent = state.select("tree", F.col("idx").alias("__parent"), F.col("kids").alias("__kids"), F.col("path").alias("__path"))
        place = F.col("idx") - F.col("__parent") * fanout
        run = lambda a, n: F.array_join(F.transform(F.slice("__kids", a, n), F.hex), "")
        siblings = F.struct(F.unhex(run(F.lit(1), place.cast("int"))).alias("left"), F.unhex(run((place + 2).cast("int"), F.lit(fanout))).alias("right"))
        under = nodes.where("n > 1").withColumn("__parent", F.expr(f"idx div {fanout}")).join(parent, ["tree", "__parent"])
        state = under.select("tree", "idx", "hash", "kids", F.concat(F.array(siblings), "__path").alias("path")).unionByName(ended)
        if k and k % AT_ONCE == 0:
            state = stored(state, "paths")
            kept.append(state)
    out = stored(state.select("tree", "idx", "hash", "path"), "paths")
    dropped(*kept)
    return out


def proof(path: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right, as hex."""
    return F.sha2(F.array_join(F.transform(path, lambda p: as_text(F.concat(p["left"], p["right"]))), ""), 256)


def fold(path: Column, hash: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, hash, lambda acc, p: digest(as_text(F.concat(p["left"], acc, p["right"]))))


def manifest(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """doc_id, leaf, used, subroot, root (digests as bytes) and path of every row of docs(doc_id, source,
    lang, n_chars, text).

    One tree for each lang, its leaves ascending by doc_id; the trees' tops, ascending by lang, are the leaves of the
    last tree. used is the leaf of the row with n_chars raised by 1 (a null stays), for checks with tampered rows.

    Null is a value: such a lang has a tree of its own, the first; a null doc_id stands first in its tree. Rows of equal
    doc_id are ordered by their leaf; repeated rows stay, each with a path of its own. Null and empty texts differ. An
    empty table gives an empty manifest. Other columns are not read.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = [F.col("n_chars") + 1 if k == 3 else v for k, v in enumerate(values)]
    # The prefix sets null apart from every lang and keeps the order of bytes.
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))
    rows = docs.select(tree.alias("tree"), "doc_id", leaf(*values).alias("hash"), leaf(*tampered).alias("used"))
    rows = stored(numbered(rows, "tree", ["doc_id", "hash"], "rows"), "leaves")
    own = build(rows, fanout, "level")
    tops = own.tops.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "hash")
    tops = stored(numbered(tops, "tree", ["lang"], "tops"), "subroots")
    upper = build(tops, fanout, "upper")
    root = upper.tops.select(F.col("hash").alias("root"), F.lit("").alias("tree"))
    over = paths(upper, fanout)
    over = tops.select("tree", "idx", "lang", F.col("hash").alias("subroot")).join(over.select("tree", "idx", "path"), ["tree", "idx"]).join(root, "tree")
    over = stored(over.select(F.col("lang").alias("tree"), "subroot", "root", "path"), "over")
    found = paths(own, fanout, over.select("tree", "path"))
    out = rows.select("tree", "idx", "doc_id", F.col("hash").alias("leaf"), "used").join(found.select("tree", "idx", "path"), ["tree", "idx"])
    return out.join(over.select("tree", "subroot", "root"), "tree").drop("idx", "tree")


def verified(table: DataFrame, tampered: Column) -> DataFrame:
    """A manifest with proof_sha256, folded_root (from used where `tampered` holds, else from leaf) and verified."""
    folded = fold(F.col("path"), F.when(tampered, F.col("used")).otherwise(F.col("leaf")))
    return table.withColumn("proof_sha256", proof(F.col("path"))).withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
