"""Model scores of chunks: any scorer over the words of 100-word chunks, and the folding of what it says.

A scorer is loaded once in each Python worker and given batches of chunks; what it returns are plain
columns (label scores, and probabilities of sub-word pieces), which Spark folds into probabilities of chunks and words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

CHUNK = 100
#: Chunks that a scorer is given at a time.
BATCH = 64
OUTPUT = "predictions array<struct<label: string, score: double>>, pieces array<struct<word_ix: int, prob: double>>"


class Scorer(Protocol):
    """What a model must offer; both get a batch of chunks and return one list for each of them."""

    def labels(self, texts: Sequence[str]) -> list[list[tuple[str, float]]]:
        """Label and score of each label the model gives a text."""

    def pieces(self, words: Sequence[Sequence[str]]) -> list[list[tuple[int | None, float]]]:
        """Word number (None: of no word) and probability of each sub-word piece; a model that cuts long input leaves words out."""


def chunk_words(works: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """work, chunk_id and words of works (work, text): runs of letters, sliced in the work's own row without a shuffle."""
    words = works.select("work", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}+"), F.lit(0)).alias("w")).where("size(w) > 0")
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / chunk).cast("int")), lambda k: F.slice("w", k * chunk + 1, F.lit(chunk)))
    return words.select("work", F.posexplode(slices).alias("chunk_id", "words")).withColumn("chunk_id", F.col("chunk_id").cast("long"))


_loaded: dict[str, Scorer] = {}


def loaded(name: str, load: Callable[[], Scorer]) -> Scorer:
    """The worker's scorer of that name, loaded when first asked for."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def score(chunks: DataFrame, name: str, load: Callable[[], Scorer], batch: int = BATCH) -> DataFrame:
    """chunks with n_words, predictions and pieces of their words column by the scorer that `load` makes."""

    @F.pandas_udf(OUTPUT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = loaded(name, load)
        for rows in batches:
            labels, pieces = [], []
            for k in range(0, len(rows), batch):
                words = [list(w) for w in rows.iloc[k : k + batch]]
                labels += [[{"label": x, "score": float(p)} for x, p in own] for own in scorer.labels([" ".join(w) for w in words])]
                pieces += [[{"word_ix": -1 if ix is None else ix, "prob": float(p)} for ix, p in own] for own in scorer.pieces(words)]
            yield pd.DataFrame({"predictions": labels, "pieces": pieces})

    return chunks.withColumn("n_words", F.size("words")).withColumn("_s", run("words")).select("*", "_s.predictions", "_s.pieces").drop("_s")


def humor(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """humor_prob, nonhumor_prob and humor_label from predictions: an array of label and score, or one label and score.

    Labels count trimmed and in any case, of repeated ones the last. In an array a side that is
    missing or 0 is 1 less the other if that is above 0; one label alone always gives the other.
    """
    name = "upper(trim(BOTH ' \t\n\r' FROM {}.label))"
    if isinstance(scored.schema["predictions"].dataType, StructType):
        p = F.coalesce("predictions.score", F.lit(0.0))
        is_yes = F.expr(f"coalesce({name.format('predictions')} in ('HUMOR', 'LABEL_1'), false)")
        both = {"humor_prob": F.when(is_yes, p).otherwise(1 - p), "nonhumor_prob": F.when(is_yes, 1 - p).otherwise(p)}
    else:
        pick = lambda x: F.expr(f"try_element_at(filter(predictions, p -> {name.format('p')} = '{x}'), -1).score")
        yes, no = (F.coalesce(pick(a), pick(b), F.lit(0.0)) for a, b in (("HUMOR", "LABEL_1"), ("NO_HUMOR", "LABEL_0")))
        both = {"humor_prob": F.when((yes == 0) & (no > 0), 1 - no).otherwise(yes), "nonhumor_prob": F.when((no == 0) & (yes > 0), 1 - yes).otherwise(no)}
    return scored.withColumns(both).withColumn("humor_label", (F.col("humor_prob") >= threshold).cast("int"))


def metaphor(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """From sub-word probabilities (pieces: array of word_ix and prob; n_words) to word shares; words cut off count as 0.

    Pieces are folded once in the order of their words, a word's probability being the mean of its pieces.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0, the probability of words cut off")
    mean = "if(a.n > 0, a.s / a.n, cast(0 as double))"
    closed = f"a.hits + if({mean} >= {threshold}, 1, 0) as hits, a.mass + {mean} as mass"
    state = "struct(-1 as ix, cast(0 as double) as s, 0 as n, 0 as hits, cast(0 as double) as mass)"
    step = f"(a, p) -> if(p.ix = a.ix, struct(a.ix as ix, a.s + p.prob as s, a.n + 1 as n, a.hits as hits, a.mass as mass), struct(p.ix as ix, p.prob as s, 1 as n, {closed}))"
    known = "array_sort(transform(filter(pieces, p -> p.word_ix >= 0 and p.word_ix < n_words), p -> struct(cast(p.word_ix as int) as ix, cast(p.prob as double) as prob)))"
    name = next(x for x in ("_p", "__p", "___p") if x not in scored.columns)
    out = scored.withColumn(name, F.expr(f"aggregate({known}, {state}, {step}, a -> struct({closed}))"))
    share = lambda x: F.expr(f"if(n_words > 0, {x} / n_words, cast(0 as double))")
    return out.select("*", F.expr(f"coalesce({name}.hits, 0)").alias("metaphor_words_total"), share(f"100 * coalesce({name}.hits, 0)").alias("metaphor_word_percent"), share(f"coalesce({name}.mass, 0)").alias("metaphor_prob_mean")).drop(name)
