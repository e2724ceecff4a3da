"""Cleaning as a stream: new text files are cleaned as they arrive (the rules are stateless per work)."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from quillspark.operators.cleaner import clean
from quillspark.sources.texts import decoded, file_name


def clean_stream(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """A query that writes work, text and cleaned of each new file as Parquet."""
    files = spark.readStream.option("pathGlobFilter", "*.[tT][xX][tT]").text(folder, wholetext=True)
    works = files.select(F.regexp_replace(file_name(), r"\.[^.]*$", "").alias("work"), decoded("value").alias("text"))
    return clean(works).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
