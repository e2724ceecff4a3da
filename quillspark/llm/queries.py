"""Queries over the driver's tables, one for each training-data operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import chat, classifier, collocations, decontaminate, html_extract, line_dedup, manifest, packing, quality, simhash, substring_dedup, token_counts, toxicity
from quillspark.llm.common import read


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from the labels that aren't held out."""
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold; documents that hold none have no row."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether the tokens are over 512."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, radius=4)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in the packed sequences."""
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    both = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    nodes = chat.conversation_nodes(rows)
    out = chat.read_back(chat.format_paths(nodes, chat.paths(nodes)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them another place keeps, and a digest of the rest."""
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many of them repeat a passage of a smaller id, and a digest of the rest."""
    out = substring_dedup.substring_dedup(read(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rule and the verdict of the adaptive limits."""
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality(read(spark, sf_dir, "documents")).select(*cols)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of two to five words that score highest in each language."""
    return collocations.collocations(read(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from the labels that aren't held out."""
    return classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), label="quality", threshold=0.3)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaf, roots and proof of every document, and whether its text, line feeds of some being lost, verifies."""
    found = manifest.without_line_feeds(F.col("doc_id"), F.col("text"))
    return manifest.manifest(read(spark, sf_dir, "documents"), found=found)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
