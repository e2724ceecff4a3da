"""Running sums and as-of look-ups of long sequences, by blocks: no window is over a whole work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.sources.shared import cut


def same(df: DataFrame, other: DataFrame, pairs: dict[str, str]) -> Column:
    """Null-safe equality of columns of both."""
    test = F.lit(True)
    for a, b in pairs.items():
        test = test & df[a].eqNullSafe(other[b])
    return test


def running(rows: DataFrame, key: str, order: str, n: str, block: int) -> DataFrame:
    """rows with n_before (the sum of n over the key's rows that come before) and n_total (over all of them).

    `order` is an integer that no two rows of a key share; `block` neighbouring values of it are one window. Sums of the
    blocks (a row each) are what a key's blocks learn from one another.
    """
    rows = cut(rows.withColumn("block_", F.floor(F.col(order) / block)))
    sums = rows.groupBy(F.col(key).alias("key_"), F.col("block_").alias("b_")).agg(F.sum(n).alias("sum_"))
    by_key = W.partitionBy("key_")
    before = F.coalesce(F.sum("sum_").over(by_key.orderBy("b_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("key_", "b_", before.alias("base_"), F.sum("sum_").over(by_key).alias("n_total"))
    inner = F.coalesce(F.sum(n).over(W.partitionBy(key, "block_").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("inner_", inner)
    joined = rows.join(sums, same(rows, sums, {key: "key_", "block_": "b_"}))
    return joined.withColumn("n_before", F.col("base_") + F.col("inner_")).drop("block_", "key_", "b_", "base_", "inner_")
