"""Exact removal of repeated passages by super-k-mer partitioning.

A window is `width` consecutive words of one document. Each window's minimiser is its least
word in an order that puts the longest words, which are rare, first; consecutive windows that share
it travel as one packed string to the minimiser's bucket, where the windows of all strings
are sorted and every one that also starts in a document of smaller id is marked. Words are
compared exactly: hashes only order the windows.

A first pass counts the packed strings of each minimiser and notes in a bit map of fixed size
which minimisers have two strings or more; the only string of another can't repeat anywhere
and doesn't travel (a false positive of the bit map only sends a string in vain).

Skew: by the same counts, minimisers above a fraction of a
partition (so a bounded number of minimisers) are hot: their windows travel one by one, get
their least document by a map-side combined minimum, and are joined back to it by a join that
adaptive execution may split.

Cases: a null or empty text and a text of fewer words than a window lose nothing; a passage
repeated within one document only stays; an empty table gives no rows. A null id is neither
smaller nor larger than another: its row loses nothing and makes no other lose. Rows of one id
are rows of their own that lose by smaller ids only, not by each other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from quillspark.llm.common import MEMO_WORDS, cut, distinct_ids, mix, numbered, partitions, split_words, steps, text_of, word_ids

#: A minimiser is hot above this share of a partition's packed strings, or this many if that is more.
HOT_SHARE, HOT_LEAST = 0.25, 2000
#: Packed strings that one task sorts (about 100 bytes each); there are as many tasks as that takes.
STRINGS_PER_TASK = 500_000
#: Spans that may be broadcast to the documents (24 bytes each); more are shuffled.
BROADCAST_SPANS = 1_000_000
#: Words of 64 bits in the bit map of minimisers that two strings share (32 MB, broadcast).
MAP_WORDS = 1 << 22


class Order(dict):
    """Word to its place in the order of minimisers."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        n = len(word)
        self[word] = k = xxhash.xxh64_intdigest(word) >> 6 | 63 - min(n, 63) << 58
        return k


def runs(words: list[bytes], bounds: np.ndarray, order: Order, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window, number of windows and text of each run of windows that share a minimiser."""
    n = len(words)
    if n < width:
        return (*(np.zeros(0, dtype=np.int64) for _ in range(4)),)
    low, span = np.fromiter(map(order.__getitem__, words), dtype=np.uint64, count=n), 1
    while span < width:
        step = min(span, width - span)
        low, span = np.minimum(low[:-step], low[step:]), span + step
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    valid = owner[: n - width + 1] == owner[width - 1 :]
    first = np.r_[True, (low[1:] != low[:-1]) | (owner[1 : len(low)] != owner[: len(low) - 1]) | ~valid[:-1]] & valid
    starts = np.flatnonzero(first)
    sizes = np.add.reduceat(valid, starts, dtype=np.int64) if len(starts) else starts
    return low[starts].view(np.int64), starts, sizes, owner[starts]


def super_kmers(docs: DataFrame, width: int, mode: str, hot: frozenset[int] = frozenset(), shared=None) -> DataFrame:
    """mode count: minimisers with their numbers of strings; strings: those of the others than hot; windows: the windows of hot ones.

    Columns of docs other than the text travel with each string.
    """
    ids = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, hots = Order(), np.array(sorted(hot), dtype=np.int64)
        for part, texts in steps(batches):
            words, bounds = split_words(texts)
            low, starts, sizes, owner = runs(words, bounds, order, width)
            if mode == "count":
                keys, n = np.unique(low, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int32))], ["bucket", "n"])
                continue
            take = np.isin(low, hots) == (mode == "windows")
            if mode == "strings":
                bit = bit_of(low)
                take &= (np.frombuffer(shared.value, dtype=np.uint64)[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
            low, starts, sizes, owner = low[take], starts[take], sizes[take], owner[take]
            if mode == "windows":
                at = np.repeat(starts - np.r_[0, np.cumsum(sizes)][:-1], sizes) + np.arange(sizes.sum())
                low, owner, starts, sizes = np.repeat(low, sizes), np.repeat(owner, sizes), at, np.ones(len(at), dtype=np.int64)
            packed = [b" ".join(words[s:e]) for s, e in zip(starts.tolist(), (starts + sizes + width - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(low), *[part.column(c).take(pa.array(owner)) for c in ids], pa.array(starts - bounds[owner]), pa.array(packed, pa.binary())], ["bucket", *ids, "pos", "packed"])

    return docs.mapInArrow(run, "bucket long, n int" if mode == "count" else "bucket long, " + "".join(f"{c} long, " for c in ids) + "pos long, packed binary")


def bit_of(keys: np.ndarray) -> np.ndarray:
    return mix(keys.view(np.uint64)) % np.uint64(64 * MAP_WORDS)


def bit_map(keys: DataFrame) -> bytes:
    """A bit map of fixed size over all keys; what reaches the driver is at most its MAP_WORDS words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = bit_of(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], ["word", "bits"])

    words = keys.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(MAP_WORDS, dtype=np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out.tobytes()


def marked(doc: np.ndarray, pos: np.ndarray, packed: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (string, begin, end) of the words of windows that also start in a smaller document, within whole buckets."""
    words, bounds = split_words(packed)
    ids, sizes = word_ids(words), np.diff(bounds) - width + 1
    row = np.repeat(np.arange(len(packed)), sizes)
    offset = np.arange(sizes.sum()) - np.repeat(np.r_[0, np.cumsum(sizes)][:-1], sizes)
    at = bounds[row] + offset
    power = np.cumprod(np.full(len(ids) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    inverse = np.cumprod(np.full(len(ids) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), dtype=np.uint64))
    upto = np.r_[np.uint64(0), np.cumsum(mix(ids.view(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)]
    h = (upto[at + width] - upto[at]) * inverse[at]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.r_[same, False] | np.r_[False, same]
    order = order[again]
    if not len(order):
        return (*(np.zeros(0, dtype=np.int64) for _ in range(3)),)
    seqs = ids[at[order][:, None] + np.arange(width)]
    key = h[order]
    if (seqs[1:][key[1:] == key[:-1]] != seqs[:-1][key[1:] == key[:-1]]).any():  # two sequences with one hash
        key = np.unique(seqs, axis=0, return_inverse=True)[1].reshape(-1)
        again = np.argsort(key, kind="stable")
        order, key = order[again], key[again]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    own = doc[row[order]]
    least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.r_[starts, len(key)]))
    hit = np.sort(order[own > least])
    if not len(hit):
        return (*(np.zeros(0, dtype=np.int64) for _ in range(3)),)
    first = np.r_[True, (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])]
    last = np.r_[first[1:], True]
    begin = pos[row[hit[first]]] + offset[hit[first]]
    return row[hit[first]], begin, begin + (hit[last] - hit[first]) + width


def spans(docs: DataFrame, width: int = 13) -> DataFrame:
    """(own, begin, end): word spans to remove; they may touch and overlap. docs: doc_id, text, and own where it isn't doc_id."""
    docs = docs.where("doc_id is not null")
    own = "own" if "own" in docs.columns else "doc_id"
    counts = super_kmers(docs, width, "count").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(counts.where("n > 1").select("bucket")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    n = max(partitions(docs), -(-total // STRINGS_PER_TASK))
    limit = max(HOT_LEAST, HOT_SHARE * total / n)
    # at most n / HOT_SHARE minimisers can be above the limit
    hot = frozenset(r.bucket for r in counts.where(F.col("n") > limit).select("bucket").collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts:
                t = pa.Table.from_batches(parts)
                row, begin, end = marked(t["doc_id"].to_numpy(), t["pos"].to_numpy(), t["packed"].to_pylist(), width)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t[own].to_numpy()[row], begin, end)], ["own", "begin", "end"])

        for whole in batches:
            for k in range(0, whole.num_rows, 4000):
                batch = whole.slice(k, 4000)
                size += batch.num_rows
                if size < 16000:
                    held.append(batch)
                    continue
                b = batch.column("bucket").to_numpy()
                last = int(np.searchsorted(b, b[-1]))  # rows before belong to buckets that have ended
                if last or held and held[-1].column("bucket")[-1].as_py() != b[0]:
                    yield from out([*held, batch.slice(0, last)])
                    held, size = [batch.slice(last)], batch.num_rows - last
                else:
                    held.append(batch)
        yield from out(held)

    strings = super_kmers(docs, width, "strings", hot, shared).repartition(n, "bucket").sortWithinPartitions("bucket")
    found = strings.mapInArrow(run, "own long, begin long, end long")
    if hot:
        windows = cut(super_kmers(docs, width, "windows", hot).drop("bucket"))
        least = windows.groupBy("packed").agg(F.min("doc_id").alias("least"))
        more = windows.join(least, "packed").where("doc_id > least").select(F.col(own).alias("own"), F.col("pos").alias("begin"), (F.col("pos") + width).alias("end"))
        found = found.unionByName(more)
    return found


def remove_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept of every row of docs (own, doc_id, text) without the spans found (own, begin, end)."""
    # touching and overlapping spans of a document are one
    w = W.partitionBy("own").orderBy("begin", "end")
    fresh = found.withColumn("fresh", F.coalesce(F.col("begin") > F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    island = fresh.withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    found = cut(island.groupBy("own", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")))
    by_doc = found.groupBy(F.col("own").alias("cut_own")).agg(F.collect_list(F.struct("begin", "end")).alias("cuts"))
    if found.count() <= BROADCAST_SPANS:
        by_doc = F.broadcast(by_doc)
    joined = docs.join(by_doc, F.col("own") == F.col("cut_own"), "left").select("doc_id", "text", F.col("cuts.begin").alias("begins"), F.col("cuts.end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            n, removed, kept = [], [], []
            for t, b, e in zip(texts, part.column("begins").to_pylist(), part.column("ends").to_pylist(), strict=True):
                words = t.split()
                n.append(len(words))
                if b:
                    edge = np.bincount(b, minlength=len(words) + 1) - np.bincount(e, minlength=len(words) + 1)
                    gone = np.cumsum(edge)[: len(words)] > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, width: int = 13, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row."""
    cols = text_of(docs, id_column, text_column)
    if distinct_ids(cols):
        return remove_spans(cols.withColumn("own", F.col("doc_id")), spans(cols, width))
    cols = numbered(cols, distinct=False)
    return remove_spans(cols, spans(cols, width))
