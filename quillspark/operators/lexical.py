"""Lookups of words in loaded lists: out-of-vocabulary rate and concreteness; statistics of chunks by work."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.operators.statistics import chunk_stats


#: Words of the lists that may be broadcast to the texts' words (about 60 bytes each).
BROADCAST_WORDS = 500_000


def coverage(words: DataFrame, vocabulary: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per chunk: out-of-list and in-list rates, and concreteness of words found by surface or else by lemma.

    words: work, chunk_id, lower, lemma. Lists of a counted size go to the words, which then are
    added up by chunk where they are; longer lists are joined to words counted by chunk first, and adaptive execution
    splits what a frequent word makes heavy.
    """
    vocabulary, ratings = vocabulary.select("word").distinct(), ratings.select("word", "score")
    if vocabulary.count() + ratings.count() <= BROADCAST_WORDS:
        small, counted = F.broadcast, words.select("work", "chunk_id", "lower", "lemma", F.lit(1).alias("k"))
    else:
        small, counted = (lambda df: df), words.groupBy("work", "chunk_id", "lower", "lemma").agg(F.count("*").alias("k"))
    v = small(vocabulary.select(F.col("word").alias("lower"), F.lit(1).alias("known")))
    by = lambda key, name: small(ratings.select(F.col("word").alias(key), F.col("score").alias(name)))
    j = counted.join(v, "lower", "left").join(by("lower", "s1"), "lower", "left").join(by("lemma", "s2"), "lemma", "left").withColumn("score", F.coalesce("s1", "s2"))
    n, of = F.sum("k"), lambda test: F.sum(F.when(test, F.col("k")).otherwise(0))
    return j.groupBy("work", "chunk_id").agg(
        n.alias("n_words"),
        (of(F.col("known").isNull()) * 100.0 / n).alias("oov_per100"),
        (of(F.col("known").isNotNull()) * 100.0 / n).alias("in_list_per100"),
        (of(F.col("score").isNotNull()) * 100.0 / n).alias("concreteness_coverage_percent"),
        F.coalesce(F.sum(F.col("score") * F.col("k")) / F.nullif(of(F.col("score").isNotNull()), F.lit(0)), F.lit(0.0)).alias("concreteness_mean_matched"),
        (F.coalesce(F.sum(F.col("score") * F.col("k")), F.lit(0.0)) * 100.0 / n).alias("concreteness_sum_per100"),
    )


COVERAGE_FEATURES = ["oov_per100", "in_list_per100", "concreteness_coverage_percent", "concreteness_mean_matched", "concreteness_sum_per100"]


def coverage_stats(chunks: DataFrame) -> DataFrame:
    """Statistics of coverage() by work, with the numbers of words out of the list, in it, and rated."""
    count = lambda c: F.round(F.col(c) * F.col("n_words") / 100)
    totals = {"oov_total": count("oov_per100"), "in_list_total": count("in_list_per100"), "concreteness_matched_total": count("concreteness_coverage_percent")}
    return chunk_stats(chunks, {f: F.col(f) for f in COVERAGE_FEATURES}, totals)


def model_stats(chunks: DataFrame) -> DataFrame:
    """Statistics of scoring.humor() and scoring.metaphor() by work, with the numbers of chunks and words found positive."""
    features = ["humor_prob", "nonhumor_prob", "humor_label", "metaphor_word_percent", "metaphor_prob_mean", "metaphor_words_total"]
    return chunk_stats(chunks, {f: F.col(f) for f in features}, {"humor_chunks_positive_total": F.col("humor_label"), "metaphor_words_positive_total": F.col("metaphor_words_total")})
