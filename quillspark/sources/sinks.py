"""Writers: feature tables, cleaned texts, archives and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from quillspark.sources.datasource import register_sources


def wide(stats: DataFrame, works: list[str], order: list[str] | None = None) -> DataFrame:
    """metric by work, in the order of `order`; the caller names the works, whose number is that of the columns."""
    out = stats.groupBy("metric").pivot("work", works).agg(F.first("value"))
    if order:
        rank = F.array_position(F.array(*map(F.lit, order)), F.col("metric"))
        return out.where(rank > 0).orderBy(rank)
    return out.orderBy("metric")


def one_file(df: DataFrame, path: str, fmt: str, **options) -> None:
    """df, in its order, as one file of exactly that name; folders above it are made."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, folder = hadoop.Path(path), hadoop.Path(path + ".parts")
    df.coalesce(1).write.format(fmt).options(**options).mode("overwrite").save(folder.toString())
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(folder, True)


def write_feature_csv(stats: DataFrame, works: list[str], path: str, order: list[str] | None = None) -> None:
    """A row per metric in the given order, a column per work."""
    one_file(wide(stats, works, order), path, "csv", header=True, encoding="UTF-8")


def write_first_sentences(sentences: DataFrame, works: list[str], numbers: str, texts: str | None = None) -> None:
    """The two lengths of each work's first sentence as a feature table, and, where asked for, its text, a row per work by name."""
    lengths = ["n_words_first_sentence", "n_chars_first_sentence"]
    long = sentences.withColumnRenamed("text_name", "work").unpivot("work", [F.col(c).cast("double").alias(c) for c in lengths], "metric", "value")
    write_feature_csv(long, works, numbers, lengths)
    if texts:
        one_file(sentences.select("text_name", "first_sentence", *lengths).orderBy("text_name"), texts, "csv", header=True, encoding="UTF-8", quoteAll=True)


def write_texts(cleaned: DataFrame, path: str, archive: bool = False, mode: str = "overwrite") -> dict[str, float]:
    """A file {work}_cleaned.txt for each work (or archives of them, one a task), all or none; the totals are taken on the way.

    files, n_in, n_out and reduction (in percent) of what was written: the texts are not cleaned a second time for them.
    """
    register_sources(cleaned.sparkSession)
    seen = Observation()
    n_in, n_out = F.length(F.coalesce("text", F.lit(""))) if "text" in cleaned.columns else F.lit(None).cast("int"), F.length("cleaned")
    counted = [F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(n_in), F.lit(0)).alias("n_in"), F.coalesce(F.sum(n_out), F.lit(0)).alias("n_out")]
    rows = cleaned.observe(seen, *counted).select(F.col("work").cast("string").alias("work"), "cleaned")
    rows.write.format("works").option("archive", str(archive).lower()).mode(mode).save(path)
    out = seen.get
    return {**out, "reduction": 100 * (1 - out["n_out"] / max(1, out["n_in"]))}


def zip_texts(cleaned: DataFrame, path: str) -> dict[str, float]:
    """Deflated archives of {work}_cleaned.txt in a folder, one a task, and the totals."""
    return write_texts(cleaned, path, archive=True)


def report(cleaned: DataFrame) -> DataFrame:
    """Per work: characters in and out, reduction in percent and a preview of 600 characters."""
    n_in, n_out = F.length(F.coalesce("text", F.lit(""))), F.length("cleaned")
    flat = F.regexp_replace("cleaned", "\n", " ")
    return cleaned.select("work", n_in.alias("n_in"), n_out.alias("n_out"), (100 * (1 - n_out / F.greatest(F.lit(1), n_in))).alias("reduction"), F.when(F.length(flat) > 600, F.concat(F.left(flat, F.lit(600)), F.lit("..."))).otherwise(flat).alias("preview"))


def totals(cleaned: DataFrame) -> DataFrame:
    return report(cleaned).agg(F.count("*").alias("files"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))


def overuse_lines(ranked: DataFrame) -> DataFrame:
    """The printed form of the overuse report."""
    return ranked.orderBy("work", "rank").select("work", F.format_string("%d. %s %.1f%% (text %.4f%% vs ref %.4f%%, count %d, cap_ratio %.2f)", "rank", "word", "deviation_pct", "book_pct", "ref_pct", "n", "cap_ratio").alias("line"))
