"""Quality rules with adaptive thresholds.

Each document's integer measures come from one pass. Per language and source, each measure
is kept as a quantile sketch of fixed resolution: a histogram of per-mille bins, so two
sketches merge by adding counts, the result does not depend on the order of merging, and a
quantile is off by one bin at most. Thresholds are Tukey fences on the sketches' quartiles;
a group with few documents takes the fence of its language's merged sketch, and then that of
the whole corpus. The fences are joined back to the measures.

Cases: a null or empty text has no words and fails the base rule; null language or source is
a group of its own; ties in a measure share a bin; rows of repeated or null ids are measured and judged each, and counted each in
the sketches; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.llm.common import cut, segment_sums, split_words, steps, word_ids

SYMBOLS = b"#*$%&|<>"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Measure, its per-mille bin from the base columns, and the slack above the fence that every group is given.
MEASURES = {
    "symbols": ("n_symbols * 1000 div greatest(word_chars, 1)", 20),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", 400),
    "lines": ("n_dup_lines * 1000 div greatest(n_words, 1)", 50),
    "length": ("word_chars * 1000 div greatest(n_words, 1)", 700),
}
#: Times the quartile range above the upper quartile.
FENCE = 3
#: Documents that a group's own sketch needs.
LEAST_DOCS = 40


def repeat_words(words: list[bytes], bounds: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in that text."""
    n = len(words)
    if n < 3:
        return np.zeros(len(bounds) - 1, dtype=np.int64)
    ids, owner = word_ids(words), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # ids and owners of one step are below 2**21 each: two exact keys, the first made dense
    pairs = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1]
    first = np.flatnonzero(owner[:-2] == owner[2:])
    keys = pairs[first] << 32 | ids[first + 2]
    order = np.lexsort((owner[first], keys))
    k, o = keys[order], owner[first][order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    again = np.r_[same, False] | np.r_[False, same]
    covered = np.zeros(n, dtype=np.int64)
    at = first[order[again]]
    for i in range(3):
        covered[at + i] = 1
    return segment_sums(covered, bounds)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts of every whole text; one pass, no shuffle."""
    flags = np.zeros(256, dtype=np.uint8)
    flags[[b for b in range(256) if b & 0xC0 != 0x80 and b not in WHITE]] = 1
    marks = np.zeros(256, dtype=np.uint8)
    marks[list(SYMBOLS)] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            raw, ends = np.frombuffer(b"".join(texts), dtype=np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
            words, bounds = split_words(texts)
            lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
            cols = [np.diff(bounds), segment_sums(flags[raw], ends), segment_sums(marks[raw], ends), [len(x) - len(set(x)) for x in lines], repeat_words(words, bounds)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array(c, pa.int64()) for c in cols]], [*part.schema.names[:3], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def sketches(base: DataFrame) -> DataFrame:
    """Histogram sketches: lang, source, measure, bin, n. Merged upward by adding n."""
    bins = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(e).alias("bin")) for m, (e, _) in MEASURES.items()]))
    return base.where(~base_failed()).select("lang", "source", bins.alias("x")).groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Fence and size of each group's sketch at one level of merging; a quantile is the least bin that reaches its rank."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "measure")
    ranked = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "docs": F.sum("n").over(w)})
    q = [F.min(F.expr(f"if(4 * upto >= {k} * docs, bin, null)")) for k in (1, 3)]
    slack = F.element_at(F.create_map(*[F.lit(x) for m, (_, s) in MEASURES.items() for x in (m, s)]), F.col("measure"))
    return ranked.groupBy(*keys, "measure").agg(F.first("docs").alias("docs"), q[0].alias("q1"), q[1].alias("q3")).select(*keys, "measure", "docs", (F.col("q3") + FENCE * (F.col("q3") - F.col("q1")) + slack).alias("fence"))


def thresholds(base: DataFrame) -> DataFrame:
    """One row per language and source with a fence for each measure."""
    sketch = sketches(base)
    own, lang, whole = (fences(sketch, k) for k in (["lang", "source"], ["lang"], []))
    lang = lang.select(F.col("lang").alias("l"), "measure", F.col("docs").alias("lang_docs"), F.col("fence").alias("lang_fence"))
    whole = whole.select("measure", F.col("fence").alias("any_fence"))
    best = own.join(lang, [F.col("l").eqNullSafe(own["lang"]), lang["measure"] == own["measure"]]).drop(lang["measure"]).join(whole, "measure")
    fence = F.expr(f"case when docs >= {LEAST_DOCS} then fence when lang_docs >= {LEAST_DOCS} then lang_fence else any_fence end")
    return best.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, fence)).alias(f"max_{m}") for m in MEASURES])


def quality(docs: DataFrame) -> DataFrame:
    """The measures of every document with base_failed and kept.

    The number of groups is that of distinct (lang, source) pairs; the join is left to the
    planner, which broadcasts the thresholds only below the session's size limit and may
    split a hot source otherwise.
    """
    base = cut(measures(docs))
    t = thresholds(base).select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[f"max_{m}" for m in MEASURES])
    joined = base.join(t, [base["lang"].eqNullSafe(t["t_lang"]), base["source"].eqNullSafe(t["t_source"])], "left")
    within = F.lit(True)
    for m, (e, _) in MEASURES.items():
        within = within & (F.expr(e) <= F.col(f"max_{m}"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).drop("t_lang", "t_source")
