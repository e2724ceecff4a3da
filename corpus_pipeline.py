"""From documents to packed training sequences in five stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import decontaminate, line_dedup, packing, quality, simhash
from quillspark.llm.common import cut, free_name, numbered, read, remove_folder, shared_folder, without
from quillspark.llm.queries import tokenizer


def without_rows(docs: DataFrame, rejected: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows that `rejected` names, given docs with a number of each row's own (the id, if ids are distinct) as doc_id."""
    own = free_name(docs, "own")
    rows = numbered(docs, own)
    return without(rows, rejected(rows.withColumn("doc_id", F.col(own))), own).drop(own)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return without_rows(docs, lambda d: quality.quality(d).where("not kept").select("doc_id"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that another place keeps; a document may lose all its lines."""
    return line_dedup.rewrite(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates; of rows alike one stays."""
    return without_rows(docs, lambda d: simhash.near_duplicates(d).where("doc_id != component_id").select("doc_id"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_rows(docs, lambda d: decontaminate.contaminated(d, read(spark, sf_dir, "benchmark")).select("doc_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in the packed sequences."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages hash, embed and merge in ways that SQL can't express; tests hold each against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again. At the end, or when a stage fails, these tables go."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        name, stage = STAGES[-1]
        return cut(stage(spark, docs, sf_dir))
    finally:  # also where a stage fails
        remove_folder(spark, folder)
