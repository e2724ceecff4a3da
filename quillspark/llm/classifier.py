"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal updates.

A text's features are its words (one and two in a row) and the shapes of its words (one, two and three in a
row), hashed to 2 ** BITS places. A word's shape keeps its cases, digits and marks and forgets
its letters and their number; a word that repeats the one before it is marked. A place's value is
the logarithm of one more than its count, and the values of a text have a fixed length, so that long and short texts weigh
alike. Language, source, ids and labels are no features.

At most `max_labelled` labelled documents that aren't held out are the sample, those of the least
hashes of their ids. They pass `epochs` times, in the order of those hashes, through one task that holds only the two
numbers of each place, so the model is the same however the tables are partitioned. Its
weights that aren't zero (at most one a place) go to all workers, and every text is scored by a sparse dot product, without a shuffle.

Cases: a null or empty text has no features and the score of the intercept; labels are null: not used; of labels of one
document the highest counts, of rows of one id the text of the least hash is the example; no usable labels: every
score is 0.5; a null id is scored, its held_out is null; repeated rows are scored alike; an empty table gives no
rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import MEMO_WORDS, cut, kept, mix, steps, text_of

#: Labelled rows that the model is trained on at most, and how often each is seen.
MAX_LABELLED, EPOCHS = 20_000, 2
BITS = 18
#: FTRL-proximal: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.5, 0.1
#: Length of a text's vector of values.
LENGTH = 3.0

_SHAPE = bytes(ord("0") if 48 <= c <= 57 else ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    return _RUN.sub(rb"\1", word.translate(_SHAPE))


class Hashes(dict):
    """Raw word to its place in two arrays: hashes of the word in lower case and of its shape."""

    def __init__(self) -> None:
        self.word, self.shape = [], []

    def __missing__(self, raw: bytes) -> int:
        self[raw] = place = len(self.word)
        self.word.append(xxhash.xxh3_64_intdigest(raw.lower()))
        self.shape.append(xxhash.xxh3_64_intdigest(shape(raw), 1))
        return place


def features(texts: list[bytes], memo: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, the place and the value of every feature, in the order of texts and places."""
    words: list[bytes] = []
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    for k, t in enumerate(texts):
        words += t.split()
        bounds[k + 1] = len(words)
    if len(memo) > MEMO_WORDS:
        memo.clear(), memo.word.clear(), memo.shape.clear()
    at = np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    word, form = (np.array(x, dtype=np.uint64)[at] for x in (memo.word, memo.shape))
    again = np.r_[False, (at[1:] == at[:-1]) & (text[1:] == text[:-1])][: len(at)]
    form = mix(form + again.astype(np.uint64))
    keys = []
    for kind, (h, size) in enumerate([(word, 1), (word, 2), (form, 1), (form, 2), (form, 3)], 1):
        n = max(0, len(h) - size + 1)
        run = np.full(n, kind, dtype=np.uint64)
        for k in range(size):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        within = text[:n] == text[size - 1 : size - 1 + n]
        keys.append(text[:n][within] << BITS | (run[within] >> np.uint64(64 - BITS)).astype(np.int64))
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    value = np.log1p(np.diff(np.r_[first, len(key)]))
    text, place = key[first] >> BITS, key[first] & ((1 << BITS) - 1)
    length = np.sqrt(np.bincount(text, value * value, minlength=len(texts)))
    return text, place, value * (LENGTH / length[text])


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """turn, label and text of at most `most` documents with labels that aren't held out."""
    train = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("label")).where("label is not null and crc32(cast(label_id as string)) % 5 != 0")
    # at most `most` pairs of numbers, so they may be broadcast
    train = train.groupBy("label_id").agg(F.max("label").alias("label")).withColumn("turn", F.xxhash64("label_id")).orderBy("turn", "label_id").limit(most)
    rows = docs.join(F.broadcast(train), F.col("doc_id") == F.col("label_id")).where("text is not null")
    return rows.groupBy("label_id", "turn", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).select("label_id", "turn", "label", "least.text")


def updated(place: np.ndarray, value: np.ndarray, label: float, z: np.ndarray, n: np.ndarray) -> None:
    """One FTRL-proximal update of the sums z and n in the places of one example."""
    g, w = n[place], weights(z[place], n[place])
    g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
    more = np.sqrt(n[place] + g * g)
    z[place] += g - (more - np.sqrt(n[place])) / ALPHA * w
    n[place] += g * g


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(rows: DataFrame, epochs: int) -> np.ndarray:
    """Weights of all places, the last one the intercept; rows (label_id, turn, label, text) are a sample of bounded size."""
    size = 1 << BITS

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept(("classifier",), Hashes)
        for part, texts in steps(batches):
            text, place, value = features(texts, memo)
            ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (place.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column("label_id"), part.column("turn"), part.column("label"), *lists], ["label_id", "turn", "label", "places", "vals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        for batch in batches:
            for label, place, value in zip(batch.column("label").to_pylist(), batch.column("places"), batch.column("vals"), strict=True):
                updated(np.r_[place.values.to_numpy(), size], np.r_[value.values.to_numpy(), 1.0], float(label > 0), z, n)
        w = weights(z, n)
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w[used])], ["place", "weight"])

    examples = rows.mapInArrow(measure, "label_id long, turn long, label int, places array<int>, vals array<float>")
    if not epochs:
        return np.zeros(size + 1)
    seen = cut(examples).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    # in order through one task: `max_labelled` rows an epoch at most
    model = seen.coalesce(1).sortWithinPartitions("epoch", "turn", "label_id").select("label", "places", "vals").mapInArrow(run, "place long, weight double").collect()
    w = np.zeros(size + 1)
    for r in model:
        w[r.place] = r.weight
    return w


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, max_labelled: int = MAX_LABELLED, epochs: int = EPOCHS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    docs = text_of(docs, id_column, text_column)
    w = train(sample(docs, labels, label, max_labelled), epochs)
    model = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(w).astype(np.int32), w[w != 0]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, weight = kept(("classifier",), Hashes), np.zeros((1 << BITS) + 1)
        weight[model.value[0]] = model.value[1]
        for part, texts in steps(batches):
            text, place, value = features(texts, memo)
            s = 1 / (1 + np.exp(-np.clip(np.bincount(text, weight[place] * value, minlength=len(texts)) + weight[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(score, "doc_id long, score double, predicted int").select("doc_id", F.expr("crc32(cast(doc_id as string)) % 5 = 0").alias("held_out"), "score", "predicted")
