"""Readers: text folders, frequency lists and concreteness ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.sources.datasource import register_sources

#: Spellings of header and missing values that the lists come with.
SCORE_HEADERS = ("conc.m", "conc_m", "concreteness", "concreteness mean", "mean")
MISSING = ("", "#n/a", "n/a", "na", "nan", "none", "null")


def _texts(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(file_name().alias("file_name"), decoded("value").alias("text"))


def file_name() -> Column:
    """The name of a row's file as it is, not as a URI has it."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def decoded(column: str) -> Column:
    """Undecodable bytes become U+FFFD, which goes."""
    return F.replace(F.make_valid_utf8(column), F.lit("�"), F.lit(""))


def some(files: DataFrame, what: str) -> DataFrame:
    """files, or an error where there are none."""
    if files.isEmpty():
        raise FileNotFoundError(f"no {what}")
    return files


def read_raw(spark: SparkSession, folder: str, start: int = 1, end: int = 2**31 - 1) -> DataFrame:
    """book_no, file_name, text of the numbered .txt files directly in a folder, within [start, end]; none is an error."""
    files = numbered(_texts(spark, folder, "*.[tT][xX][tT]")).where(F.col("book_no").between(start, end))
    return some(files, f"numbered text from {start} to {end} in {folder}")


def skipped(spark: SparkSession, folder: str) -> DataFrame:
    """Names of files without a leading number, sorted."""
    return numbered(_texts(spark, folder, "*.[tT][xX][tT]")).where("book_no is null").select("file_name").orderBy("file_name")


def numbered(files: DataFrame) -> DataFrame:
    return files.select(F.expr(r"try_cast(regexp_extract(file_name, r'^(\d+)_', 1) as int)").alias("book_no"), "file_name", "text")


def read_works(spark: SparkSession, paths, pattern: str = "*_cleaned.txt") -> DataFrame:
    """work, text of cleaned files in a folder or of an explicit list of paths; a path that isn't there is an error of the reader, and so is a folder without any."""
    files = some(_texts(spark, paths, None if isinstance(paths, list) else pattern), f"file {pattern} in {paths}")
    return files.select(F.regexp_replace("file_name", r"_cleaned\.txt$|\.txt$", "").alias("work"), "text")


def read_spreadsheet(spark: SparkSession, path: str, sheets: str = "first") -> DataFrame:
    """The first sheet (or all) of .xlsx workbooks as a table of strings, its first row the header; a task for each sheet."""
    register_sources(spark)
    return spark.read.format("workbook").option("sheets", sheets).load(path)


def number(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def read_frequency_list(spark: SparkSession, path: str, word: str = "Word", count: str = "Count (per billion)", missing=MISSING) -> DataFrame:
    """word, ref_pct of a tab-separated list with a header. Proportions are of all rows; of a repeated word the last row counts."""
    raw = spark.read.csv(path, sep="\t", header=True)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    if lost := {word, count} - set(raw.columns):
        raise ValueError(f"the frequency list lacks {sorted(lost)}")
    rows = raw.select(F.lower(F.trim(word)).alias("word"), number(F.col(count)).alias("n"), F.monotonically_increasing_id().alias("row"))
    rows = rows.where(F.col("word").isNotNull() & ~F.col("word").isin(*missing) & F.col("n").isNotNull())
    total = rows.agg(F.sum("n").alias("total"))
    return rows.groupBy("word").agg(F.max_by("n", "row").alias("n")).join(F.broadcast(total)).select("word", (F.col("n") / F.col("total")).alias("ref_pct"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words: second field of white-space separated lines with two fields or more."""
    fields = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    return fields.where(F.size("f") >= 2).select(F.lower(F.col("f")[1]).alias("word")).distinct()


def concreteness(table: DataFrame) -> DataFrame:
    """word, score (mean per word) of a ratings table under any of the known headers; decimal commas are read."""
    names = {c.strip().lower(): c for c in table.columns}
    word = next((names[k] for k in ("word", "words") if k in names), None)
    score = next((names[k] for k in SCORE_HEADERS if k in names), None)
    if word is None or score is None:
        raise ValueError(f"no word or score column among {table.columns}")
    q = lambda c: F.col(f"`{c}`").cast("string")
    return table.select(F.lower(F.trim(q(word))).alias("word"), F.replace(q(score), F.lit(","), F.lit(".")).try_cast("double").alias("score")).dropna().groupBy("word").agg(F.avg("score").alias("score"))
