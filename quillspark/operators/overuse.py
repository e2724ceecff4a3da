"""Words a group of texts overuses against a reference frequency list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.sources.shared import cut

WORD = "[A-Za-z']+"


#: Words of a list that are broadcast; a longer list meets the counts in a shuffle.
BROADCAST_WORDS = 1_000_000
#: Parts below this number and places of words make one long; others a wide decimal.
LEAST_WIDE = 1 << 32


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_counts(texts: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """work, word, n, caps (with a capital first) and at (place of the first one) of texts (work, text, part); of `only` (word, each once) or of all words.

    A work may have several parts, ordered by number; words are counted within each part's
    rows first, so one frequent word or one large work is no hot spot.
    """
    part = F.col("part").cast("long")
    words = texts.select("work", part.alias("part"), F.posexplode(words_of("text")).alias("i", "tok"))
    # a number that orders as (part, i) does; ids of any size fit the decimal, which is slow
    ends = texts.agg(F.min(part).alias("least"), F.max(part).alias("most")).first()
    wide = ends.most is not None and (ends.least < 0 or ends.most >= LEAST_WIDE)
    at = F.col("part").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("i") if wide else F.col("part") * (1 << 31) + F.col("i")
    capital = F.col("tok").between("A", "Z" + chr(0x7F))  # words begin with an ASCII letter or an apostrophe
    words = words.withColumn("word", F.lower("tok"))
    if only is not None:  # before words are counted: those of no list are not shuffled
        words = words.join(F.broadcast(only), "word", "left_semi")
    return words.groupBy("work", "word").agg(F.count("*").alias("n"), F.sum(capital.cast("int")).alias("caps"), F.min(at).alias("at"))


def frequencies(counts: DataFrame) -> DataFrame:
    """word, ref_pct over all works of word_counts()."""
    freq = counts.groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return freq.join(F.broadcast(total)).select("word", (F.col("n") / F.col("total")).alias("ref_pct"))  # one row


def ranked(counts: DataFrame, ref: DataFrame, sizes: DataFrame | None = None, top_n: int = 10, min_count: int = 5, cap_threshold: float = 0.90) -> DataFrame:
    """The ranked report of word_counts() against a list (word, ref_pct).

    sizes has the words of each work (w, total); without it they are added up from the counts, which are best cut off then as they are read twice. Ties keep the order of first occurrence; proportions use all words of the work. A work
    without words over the limits has no rows.
    """
    if sizes is None:
        sizes = counts.groupBy(F.col("work").alias("w")).agg(F.sum("n").alias("total"))
    known = counts.where((F.col("n") >= min_count) & (F.col("caps") / F.col("n") < cap_threshold)).join(ref.where("ref_pct > 0"), "word")
    found = known.join(sizes, F.col("work").eqNullSafe(F.col("w"))).withColumn("book", F.col("n") / F.col("total")).withColumn("ratio", F.col("book") / F.col("ref_pct")).where("ratio > 1")
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("work").orderBy(F.desc("ratio"), "at"))).where(F.col("rank") <= top_n)
    return best.select("work", F.col("rank").cast("long").alias("rank"), "word", "n", (F.col("caps") / F.col("n")).alias("cap_ratio"), (F.col("book") * 100).alias("book_pct"), (F.col("ref_pct") * 100).alias("ref_pct"), ((F.col("ratio") - 1) * 100).alias("deviation_pct"))


def report(texts: DataFrame, ref: DataFrame, **limits) -> DataFrame:
    """Each text (work, text) on its own against a loaded list; a text that is null or has no words has no rows and stops no other."""
    ref = cut(ref.where("ref_pct > 0"))
    few = ref.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    counts = word_counts(texts.select("work", "text", F.lit(0).alias("part")), ref.select("word").distinct() if few else None)
    sizes = texts.groupBy(F.col("work").alias("w")).agg(F.sum(F.size(words_of("text"))).alias("total"))
    return ranked(counts, ref, sizes, **limits)


def by_source(documents: DataFrame) -> DataFrame:
    """Each source's English documents against the word frequencies of all English documents."""
    counts = cut(word_counts(documents.where("lang = 'en'").select(F.col("source").alias("work"), "text", F.col("doc_id").alias("part"))))
    return ranked(counts, frequencies(counts))
