"""Statistics of chunks by work: the one place where rates become means, least, greatest, deviations and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rounded(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5 + 1e-9) / 10000


def chunk_stats(chunks: DataFrame, features: dict[str, Column], totals: dict[str, Column], constants: dict[str, float] | None = None) -> DataFrame:
    """work, metric, value: mean, least, greatest and population deviation of each feature over a work's chunks, then sums of the totals.

    chunks: work, chunk_id, n_words and what the columns use. A row with a null chunk_id is of no chunk: it makes its work
    appear (with zeros if that is all there is) and may bring totals. Values become rows before they are added up, so
    one aggregate serves any number of features.
    """
    totals = {**totals, "token_total": F.col("n_words"), "chunk_count_used": F.col("chunk_id").isNotNull().cast("int")}
    values = F.array(*[x.cast("double") for x in (*features.values(), *totals.values())])
    by = chunks.select("work", F.posexplode(values).alias("k", "x")).groupBy("work", "k")
    by = by.agg(F.avg("x").alias("avg"), F.min("x").alias("min"), F.max("x").alias("max"), F.stddev_pop("x").alias("sd"), F.sum("x").alias("sum"))
    name = F.get(F.array(*[F.lit(x) for x in (*features, *totals)]), F.col("k"))
    row = lambda metric, x: F.struct(metric.alias("metric"), F.coalesce(x, F.lit(0.0)).cast("double").alias("value"))
    four = F.array(*[row(F.concat(name, F.lit(f"_{s}")), rounded(F.col(s))) for s in ("avg", "min", "max", "sd")])
    one = F.array(row(name, F.col("sum")))
    fixed = F.array(row(name, F.col("sum")), *[row(F.lit(k), F.lit(float(x))) for k, x in (constants or {}).items()])
    last = len(features) + len(totals) - 1
    return by.select("work", F.inline(F.when(F.col("k") < len(features), four).when(F.col("k") < last, one).otherwise(fixed)))
