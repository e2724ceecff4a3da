"""Quoted and dash-led spans, and the joins between spans and tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Opening and closing marks, marks that end speech, and dash-led lines.
QUOTES = ['""', "''", "«»", "“”", "‘’"]
DIALOGUE = ["«»", "“”", "„”", "‘’", "‚’", "‹›", '""']
SPEECH_ENDS = ".?!…,"
DASH_LINE = re.compile(r"^[ \t]*[—–-][ \t].*$", re.M)
DASH_SPEECH = re.compile(r"^[ \t]*[-—]{1,2}\s+[A-Z].*$", re.M)
#: For each pair: an opening mark before a capital, and an end of speech before a closing mark.
SPEECH = [(re.compile(rf"{a}\s*(?=[A-Z])"), re.compile(rf"[{SPEECH_ENDS}]\s*{b}")) for a, b in DIALOGUE]


def quotes_in(text: str) -> list[tuple[int, int]]:
    """Spans from an opening mark to the next closing one, of each pair in turn, then dash-led lines; time grows with the length."""
    out = []
    for a, b in QUOTES:
        at = text.find(a)
        while at >= 0 and (end := text.find(b, at + 1)) >= 0:
            out.append((at, end + 1))
            at = text.find(a, end + 1)
    return out + [m.span() for m in DASH_LINE.finditer(text)]


def dialogue_in(text: str) -> list[tuple[int, int]]:
    """Quoted segments from an opening mark and a capital to the next end of speech before a closing mark, and dash-led lines; they may overlap.

    White space may stand inside both marks. The next end of a pair serves all openings before it, so time grows with the length.
    """
    out = []
    for opens, ends in SPEECH:
        end, at = None, opens.search(text)
        while at:
            if end is None or end.start() <= at.end():  # a capital lies between
                end = ends.search(text, at.end() + 1)
                if end is None:
                    break
            out.append((at.start(), end.end()))
            at = opens.search(text, end.end())
    return out + [m.span() for m in DASH_SPEECH.finditer(text)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Touching and overlapping spans as one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _find(works: DataFrame, find) -> DataFrame:
    """(work, begin, end) of what `find` gives for each text: engines have no all-positions function, so batches of texts go through one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *span) for k, t in enumerate(batch.column("text").to_pylist()) if t for span in find(t)]
            row, begin, end = (pa.array([f[j] for f in found], pa.int32()) for j in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("work").take(row), begin, end], ["work", "begin", "end"])

    schema = works.select("work", F.lit(0).alias("begin"), F.lit(0).alias("end")).schema
    return works.select("work", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def quote_spans(works: DataFrame) -> DataFrame:
    """Speech of either kind, touching spans merged."""
    return _find(works, lambda t: merged(quotes_in(t)))


def dialogue_spans(works: DataFrame) -> DataFrame:
    """Quoted segments that begin with a capital and end with a mark, and dash-led lines; not merged."""
    return _find(works, dialogue_in)


#: Characters of a bucket of places; joins by place go by work and bucket.
BUCKET = 1 << 14


def bucket(place: Column, size: int) -> Column:
    return F.floor(place / size)


def next_word(spans: DataFrame, words: DataFrame, size: int = BUCKET) -> DataFrame:
    """Forward as-of join: each span (work, begin, end) with word_ix of the first word (work, idx, word_ix) at or after it, or null.

    word_ix grows with idx. Spans and words meet by work and bucket of places; a span without a word after it in its bucket
    has the first word of the next bucket that has one, known from a row for each bucket.
    """
    long_ = lambda x: F.lit(None).cast("long").alias(x)
    both = spans.select("work", F.col("begin").alias("at"), F.lit(0).alias("kind"), "end", long_("ix")).unionByName(words.select("work", F.col("idx").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("end"), F.col("word_ix").cast("long").alias("ix")))
    both = both.withColumn("bucket", bucket(F.col("at"), size))
    firsts = both.groupBy(F.col("work").alias("w_"), F.col("bucket").alias("b_")).agg(F.min("ix").alias("first"))
    later = W.partitionBy("w_").orderBy("b_").rowsBetween(1, W.unboundedFollowing)
    firsts = firsts.select("w_", "b_", F.min("first").over(later).alias("carried"))
    here = W.partitionBy("work", "bucket").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("ix", F.min("ix").over(here)).where("kind = 0")
    joined = found.join(firsts, F.col("work").eqNullSafe(F.col("w_")) & (F.col("bucket") == F.col("b_")), "left")
    return joined.select("work", F.col("at").alias("begin"), "end", F.coalesce("ix", "carried").alias("word_ix"))


def outside(tokens: DataFrame, merged: DataFrame, size: int = BUCKET) -> DataFrame:
    """Interval anti join: tokens (work, idx) in no merged span (work, begin, end).

    A span goes to every bucket that it touches, cut at the bucket's ends; within a bucket the last span begun at each token decides.
    """
    cols = tokens.columns
    touched = merged.where("end > begin").select("work", "begin", "end", F.explode(F.sequence(bucket(F.col("begin"), size), bucket(F.col("end") - 1, size))).alias("_b"))
    marks = touched.select("work", "_b", F.greatest("begin", F.col("_b") * size).alias("_at"), F.least("end", (F.col("_b") + 1) * size).alias("_end"), F.lit(0).alias("_kind"))
    rows = tokens.withColumns({"_b": bucket(F.col("idx"), size), "_at": F.col("idx").cast("long"), "_end": F.lit(None).cast("long"), "_kind": F.lit(1)})
    w = W.partitionBy("work", "_b").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_open", F.max("_end").over(w))
    return both.where("_kind = 1 and (_open is null or _at >= _open)").select(*cols)


@cache
def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    out = np.zeros(0x110000, dtype=bool)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out[np.frombuffer("".join(regex.findall(r"\p{L}+", every)).encode("utf-32-le"), dtype=np.uint32)] = True
    return out


def points(utf8: bytes | memoryview) -> np.ndarray:
    """Code points of UTF-8."""
    return np.frombuffer(str(utf8, "utf-8").encode("utf-32-le"), dtype=np.uint32)


#: Characters in which words are looked for at a time, and words of a batch.
SCAN, PLACES = 1 << 18, 10_000


def slices(texts: pa.Array) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Rows, places and texts of about SCAN characters in all; a longer text is cut where a word ends."""
    rows, places, found, size = [], [], [], 0
    for k, text in enumerate(x.as_py() or "" for x in texts):  # one at a time
        a = 0
        while a < len(text):
            b = min(len(text), a + SCAN)
            while b < len(text) and letters()[ord(text[b])]:
                b += 1
            rows.append(k), places.append(a), found.append(text[a:b])
            size, a = size + b - a, b
            if size >= SCAN:
                yield rows, places, found
                rows, places, found, size = [], [], [], 0
    if rows:
        yield rows, places, found


def words_in(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the runs of letters in texts: the text's number, the place in it, and the run."""
    # a blank after each text, so that no run goes over its end
    found = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    letter = letters()[found]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    edge = np.r_[0, edge] if letter[:1].any() else edge
    first, last = edge[::2], edge[1::2]
    of = np.searchsorted(begins, first, "right") - 1
    size = 1 + (found >= 0x80) + (found >= 0x800) + (found >= 0x10000)
    ends = np.r_[0, np.cumsum(size * letter)]
    utf8 = found[letter].tobytes().decode("utf-32-le").encode()
    return of, first - begins[of], pa.StringArray.from_buffers(len(first), pa.py_buffer(np.r_[0, ends[last]].astype(np.int32).tobytes()), pa.py_buffer(utf8))


def word_places(works: DataFrame) -> DataFrame:
    """work, idx, word_ix and word: the runs of letters of each work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, before = -1, 0  # words of a cut work that came before
            for rows, places, texts in slices(batch.column("text")):
                of, place, word = words_in(texts)
                k, n = np.array(rows)[of], np.bincount(of, minlength=len(rows))
                same = np.searchsorted(k, k) if len(k) else k
                ix = np.arange(len(k)) - same + np.where(k == row, before, 0)
                before = int(n[np.array(rows) == rows[-1]].sum()) + (before if row == rows[-1] else 0)
                row = rows[-1]
                idx = place + np.array(places)[of]
                for a in range(0, len(k), PLACES):
                    part = slice(a, a + PLACES)
                    yield pa.RecordBatch.from_arrays([batch.column("work").take(pa.array(k[part])), pa.array(idx[part], pa.int32()), pa.array(ix[part], pa.int64()), word[part]], ["work", "idx", "word_ix", "word"])

    schema = works.select("work", F.lit(0).alias("idx"), F.lit(0).cast("long").alias("word_ix"), F.lit("").alias("word")).schema
    return works.select("work", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def dialogue_by_chunk(works: DataFrame, chunk: int = 100, size: int = BUCKET) -> DataFrame:
    """work, chunk_id, n of dialogue spans by the chunk of the first word at or after their begin (null: none follows)."""
    placed = next_word(dialogue_spans(works), word_places(works), size)
    return placed.groupBy("work", F.floor(F.col("word_ix") / chunk).alias("chunk_id")).agg(F.count("*").alias("n"))


def narrated_by_chunk(works: DataFrame, chunk: int = 100, size: int = BUCKET) -> DataFrame:
    """work, chunk_id, n of words outside quoted and dash-led speech, by the chunk of their number among all words."""
    return outside(word_places(works), quote_spans(works), size).groupBy("work", F.floor(F.col("word_ix") / chunk).alias("chunk_id")).agg(F.count("*").alias("n"))


class SpeechSpans:
    """Table function speech_spans(text, kind): begin, end and said of each span; kind is quotes (merged) or dialogue."""

    def eval(self, text: str, kind: str):
        found = {"quotes": lambda t: merged(quotes_in(t)), "dialogue": dialogue_in}
        if kind not in found:
            raise ValueError(f"speech_spans: kind is {' or '.join(found)}, not {kind}")
        for begin, end in found[kind](text) if text else ():
            yield begin, end, text[begin:end]


def register_functions(spark: SparkSession) -> None:
    """Makes speech_spans known to the session's SQL: select work, s.* from works, lateral speech_spans(text, 'dialogue') s."""
    spark.udtf.register("speech_spans", F.udtf(SpeechSpans, returnType="begin int, end int, said string"))


#: Characters of a work in which the first sentence is looked for.
SCANNED = 50_000


def first_sentence(works: DataFrame) -> DataFrame:
    """text_name, first_sentence and its words and characters.

    The candidate reaches to the first end mark before white space (else to the end of the line). It is cut where an
    end mark is followed by a letter, and the first part with a letter is the sentence; without one it is empty.
    """
    trimmed = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    scanned = F.substring(trimmed, 1, SCANNED)
    scan = F.regexp_extract(scanned, r"(?s)^(.*?[.!?…][\x22»”)\]'›]*)(\s|$)", 1)
    candidate = F.when(scan != "", scan).otherwise(F.regexp_extract(scanned, r"^([^\n]*)", 1))
    parts = F.regexp_extract_all(candidate, F.lit(r"(?s).+?(?:[.!?…][^\p{L}\p{N}]*(?=\p{L})|\z)"), F.lit(0))
    rows = works.select(F.col("work").alias("text_name"), F.coalesce(F.get(F.filter(parts, lambda x: F.regexp_like(x, F.lit(r"\p{L}"))), F.lit(0)), F.lit("")).alias("x"))
    rows = rows.select("text_name", F.regexp_replace("x", r"^\s+|\s+$", "").alias("first_sentence"))
    return rows.select("*", F.regexp_count("first_sentence", F.lit(r"\p{L}+(?:['’]\p{L}+)*")).alias("n_words_first_sentence"), F.length("first_sentence").alias("n_chars_first_sentence"))
