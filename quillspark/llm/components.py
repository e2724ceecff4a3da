"""Distributed union-find: connected components of an edge table.

Large-star / small-star rounds, each a map-side combined minimum per node joined back to
its edges, so that a hub's neighbours are never gathered in one task; the joins are plain
equi-joins that adaptive execution may split where a hub is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import cut


def _star(edges: DataFrame) -> tuple[DataFrame, int, int]:
    """Edges point from u down to a smaller v. One large star and one small star."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    small = cut(small)
    seen = small.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return small, seen.n, int(seen.h)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), root the least node that it reaches; a root itself has no row.

    Nulls have no place in edges. No edges: no rows. Loops and repeated edges change nothing.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = cut(edges), None
    while True:
        edges, *seen = _star(edges)
        if seen == before or not seen[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
