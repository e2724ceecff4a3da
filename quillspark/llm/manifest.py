"""Merkle manifest of a dataset, by Pregel-style supersteps over RDDs.

Every row is a leaf: the SHA-256 of its fields, each `-` if null, else its UTF-8 byte count, a
colon and its value. The leaves of a source, in the order of their ids, are the vertices of a
tree in which every ARITY consecutive nodes of a level have one parent; the top of a source's
tree is a leaf of the top tree, whose root stands for the dataset.

Vertices are dealt by blocks of ARITY ** LEVELS consecutive nodes, so that the messages of LEVELS
levels stay within one task and only a block's top goes on through a shuffle. Upward, a
block that holds all its nodes (their number follows from the size of the tree, known before the
first superstep) is complete, hashes and messages the block above it. Downward, a block gets the path of siblings
above its top, lengthens it by its own levels and messages the blocks below; at the leaves
the path is folded with the leaf of the text as it is found at verification, and
compared with the root. A tree of n leaves takes log(n) / log(ARITY ** LEVELS) supersteps each way,
all known from the start, so both directions are one job without a loop on the driver, and a lost
executor costs the parts of the shuffles that it held.

Cases: a null source is a source of its own, before all others; a null id comes before all others
and is never tampered with; rows of one id are leaves in the order of their digests;
rows alike are leaves of their own, with digests alike, and places in no given order among themselves; a source of one
row has its leaf as subroot, and a dataset of one source its subroot as root; without siblings the proof
is the digest of nothing; an empty table gives no rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.llm.common import cut, partitions

ARITY = 3
#: Levels that one superstep climbs: a block has at most ARITY ** LEVELS nodes.
LEVELS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Runs of one source within one sorted partition that may be broadcast to the rows (their source and three numbers each).
BROADCAST_RUNS = 100_000
#: The tree over the sources' subroots.
TOP = -1


def encoded(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def parent(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def without_line_feeds(doc_id: Column, text: Column) -> Column:
    """The text as found at verification: where 2 divides the id's checksum its line feeds are gone."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def placed(leaves: DataFrame) -> DataFrame:
    """leaves (source, doc_id, leaf, found) with tree (the rank of the source), index (the place in it) and n (its leaves).

    One range-partitioned sort; each sorted partition's runs of one source are counted, and sums over these few
    rows give every run its first place.
    """
    # the last key deals rows alike over several tasks
    ranked = cut(leaves.orderBy(F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", F.monotonically_increasing_id()).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    runs = ranked.groupBy("source", part.alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("n_run"))
    by_source = W.partitionBy("source")
    runs = runs.withColumns({"before": F.sum("n_run").over(by_source.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), "n": F.sum("n_run").over(by_source)})
    runs = cut(runs.select("source", "part", "first", F.coalesce("before", F.lit(0)).alias("before"), "n"))
    # a source is ranked by its first row: sources that begin in earlier partitions come first, then those before it in its own
    starts = runs.where("before = 0").select(F.col("source").alias("s"), F.col("part").alias("p"), F.col("first").alias("f"))
    in_part = starts.groupBy("p").agg(F.count("*").alias("n_starts"))
    # one row for each partition of the sort
    in_part = in_part.select(F.col("p").alias("q"), F.coalesce(F.sum("n_starts").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ranks = starts.join(in_part, F.col("p") == F.col("q")).select("s", (F.col("ahead") + F.row_number().over(W.partitionBy("p").orderBy("f")) - 1).alias("tree"))
    runs = cut(runs.join(ranks, F.col("source").eqNullSafe(F.col("s"))).select(F.col("part").alias("p"), F.col("source").alias("s"), "tree", "first", "before", "n"))
    if runs.count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    rows = ranked.join(runs, (part == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return rows.select("tree", (F.col("before") + F.col("place") - F.col("first")).alias("index"), "n", "doc_id", "leaf", "found")


def width(n: int, steps: int) -> int:
    """Nodes of a tree of n leaves after so many supersteps."""
    for _ in range(steps):
        n = -(-n // ARITY**LEVELS)
    return n


def levels(block: list[tuple], n: int) -> list[list[str]]:
    """The digests of a block's nodes level by level, up to its top, in a level of n nodes."""
    out = [[node[1] for node in sorted(block, key=lambda node: node[0])]]
    for _ in range(LEVELS):
        if n == 1:
            break
        below = out[-1]
        out.append([parent(below[k : k + ARITY]) for k in range(0, len(below), ARITY)])
        n = -(-n // ARITY)
    return out


def climb(nodes: RDD, widest: int, tasks: int) -> tuple[list[RDD], RDD]:
    """The blocks of every superstep, and (tree, (digest, superstep)) of every tree's top.

    nodes are (tree, index, n, digest, payload); a block is ((tree, block), (n, its nodes as (index, digest, payload))).
    """
    span, blocks, tops = ARITY**LEVELS, [], []
    step, n = 0, widest
    while True:
        dealt = nodes.map(lambda x: ((x[0], x[1] // span), (x[2], (x[1], x[3], x[4])))).groupByKey(tasks)
        complete = dealt.mapValues(lambda messages: (lambda m: (m[0][0], [x[1] for x in m]))(list(messages)))
        blocks.append(complete)
        hashed = complete.map(lambda kv: (kv[0][0], kv[0][1], width(kv[1][0], 1), levels(kv[1][1], kv[1][0])[-1][0], None))
        tops.append(hashed.filter(lambda x: x[2] == 1).map(lambda x, step=step: (x[0], (x[3], step))))
        if (n := width(n, 1)) <= 1:
            return blocks, nodes.context.union(tops)
        nodes, step = hashed.filter(lambda x: x[2] > 1), step + 1


def descend(blocks: list[RDD], above: RDD, tasks: int) -> RDD:
    """(tree, index, digest, payload, path, above) of every leaf of the trees.

    above has ((tree, superstep), (path, anything)) of every tree's top; a path is a tuple of (siblings before, siblings after)
    for each level, the lowest first.
    """

    def expand(kv: tuple) -> Iterator[tuple]:
        (tree, _), ((n, nodes), (path, top)) = kv
        rows = levels(nodes, n)
        first = min(node[0] for node in nodes)
        for index, digest, payload in nodes:
            at, own = index - first, []
            for level in rows[:-1]:
                start = at - at % ARITY
                own.append((tuple(level[start:at]), tuple(level[at + 1 : start + ARITY])))
                at //= ARITY
            yield tree, index, digest, payload, (*own, *path), top

    down = None
    for step in range(len(blocks) - 1, -1, -1):
        arrived = above.filter(lambda kv, step=step: kv[0][1] == step).map(lambda kv: ((kv[0][0], 0), kv[1]))
        if down is not None:  # a node of the level above is a block of this one
            arrived = arrived.union(down.map(lambda x: ((x[0], x[1]), (x[4], x[5]))))
        down = blocks[step].join(arrived, tasks).flatMap(expand)
    return down


def folded(digest: str, path: tuple) -> str:
    for before, after in path:
        digest = parent([*before, digest, *after])
    return digest


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", found: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    `found` is the text at verification, over docs' columns; the recorded text where it isn't given.
    """
    recorded = [F.col(f) for f in fields]
    at_hand = [found if found is not None and f == text_column else F.col(f) for f in fields]
    spark, tasks = docs.sparkSession, partitions(docs)
    leaves = docs.select(F.col(source_column).cast("string").alias("source"), F.col(id_column).cast("long").alias("doc_id"), leaf(recorded).alias("leaf"), leaf(at_hand).alias("found"))
    rows = cut(placed(leaves))
    shape = rows.agg(F.max("n").alias("widest"), F.max("tree").alias("last")).first()
    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if shape.widest is None:
        return spark.createDataFrame([], out)
    nodes = rows.select("tree", "index", "n", "leaf", "doc_id", "found").rdd.map(lambda r: (*r[:4], r[4:]))
    blocks, subroots = climb(nodes, shape.widest, tasks)
    trees = shape.last + 1
    top_blocks, root = climb(subroots.map(lambda x: (TOP, x[0], trees, x[1][0], x[1][1])), trees, tasks)
    # the digest of the top tree's top is the root, and there is nothing above it
    down = descend(top_blocks, root.map(lambda x: ((x[0], x[1][1]), ((), x[1][0]))), tasks)
    above = down.map(lambda x: ((x[1], x[3]), (x[4], (x[2], x[5]))))

    def verify(x: tuple) -> tuple:
        _, _, digest, (doc_id, at_hand), path, (subroot, root) = x
        fold = folded(at_hand, path)
        return doc_id, digest, subroot, root, parent([d for level in path for side in level for d in side]), fold, fold == root

    return spark.createDataFrame(descend(blocks, above, tasks).map(verify), out, verifySchema=False)
