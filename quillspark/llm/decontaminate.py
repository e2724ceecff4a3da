"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

The CGK embedding walks a string with a shared random bit per step and symbol: at each step
it outputs the symbol under the pointer and moves on or stays. Strings a small edit distance
apart then agree on most outputs, so edit distance becomes Hamming distance. Symbols are
words. In each repetition every item starts its walk at a random anchor word of its own, a
few outputs within the walk are sampled as its key, and the walk from every word of every
document is compared with all keys at once, coordinate by coordinate: only places that still
agree with some item go on. A place that agrees on the whole key is an item-sized window,
and the window around it is verified by exact word edit distance, free at both window ends.

Repetitions are as many as the target recall needs at the given agreement of one coordinate.
Items are handled in blocks of ITEM_BLOCK, so the broadcast side is bounded at any number.

Cases: an item or text without words never matches; an item of few words takes shorter
walks, from any of its words; repeated items each match; null ids of items are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import cut, kept, split_words, steps, text_of

#: Items that are broadcast at a time.
ITEM_BLOCK = 20_000
#: Sampled coordinates (the anchor word included), and the longest walk.
SAMPLED, WALK = 4, 16
#: Items of fewer words anchor at any of their words, so that no single edited word is in every key.
SHORT = 15
#: Agreement of one sampled coordinate that recall is planned for, and the target.
AGREEMENT, RECALL = 0.75, 0.999
#: Words outside the items' vocabulary share so many symbols; they only steer walks.
OTHERS = 1 << 14
#: Raw words that a worker's memo of symbols may hold before it starts anew.
MEMO_RAW = 1_000_000
#: A place's bits beside its item's number, and the value of place 0.
PLACE_BITS, PLACE_ZERO = 40, 1 << 38
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„‘’…¿¡–—"
EDGE_ASCII = EDGE.encode("ascii", "ignore")


def plain(word: bytes) -> str:
    text = word.decode("utf-8", "replace").lower()
    return text if text.isalpha() else text.strip(EDGE) or text


def edit_distance(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least word edit distance of the item to any part of the window, with that part's begin and end; most + 1 if more."""
    n = len(window)
    row, begin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    place = np.arange(n + 1)
    for k, x in enumerate(item.tolist(), 1):
        change = row[:-1] + (window != x)
        drop = row + 1
        take = drop[1:] < change
        new, source = np.full(n + 1, k), np.zeros(n + 1, dtype=np.int64)
        np.minimum(drop[1:], change, out=new[1:])
        np.copyto(source[1:], np.where(take, begin[1:], begin[:-1]))
        # insertions: the least of new[i] + (j - i) over i <= j
        base = new - place
        low = np.minimum.accumulate(base)
        from_ = np.maximum.accumulate(np.where(base == low, place, 0))
        row, begin = low + place, source[from_]
        if row.min() > most:
            return most + 1, 0, 0
    end = int(np.argmin(row))
    return int(row[end]), int(begin[end]), end


class Level:
    """Partial keys of one length in one repetition, numbered, as arrays.

    Those of `ended` are whole keys with their items; a row whose partial key is of `opened`
    goes on to `following`, found by its number and the next symbol.
    """

    def __init__(self, names: dict[tuple[int, ...], int], ended: dict[tuple[int, ...], list[int]], opened: set[tuple[int, ...]]) -> None:
        sizes = np.zeros(len(names), dtype=np.int64)
        for key, own in ended.items():
            sizes[names[key]] = len(own)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.items = np.array([i for key in sorted(ended, key=names.__getitem__) for i in ended[key]], dtype=np.int64)
        self.is_open = np.zeros(len(names), dtype=bool)
        self.is_open[[names[key] for key in opened]] = True
        self.goes_on = bool(opened)
        self.known, self.number = np.zeros(1, dtype=np.int64), np.full(1, -1, dtype=np.int64)

    def lead_to(self, names: dict[tuple[int, ...], int], following: dict[tuple[int, ...], int], size: int) -> None:
        codes = sorted((names[key[:-1]] * size + key[-1], i) for key, i in following.items())
        if codes:
            self.known, self.number = (np.array(x, dtype=np.int64) for x in zip(*codes, strict=True))

    def found(self, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row's start, item) of every row on a whole key."""
        n = self.sizes[group]
        ends = np.cumsum(n)
        ramp = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        return np.repeat(start, n), self.items[np.repeat(self.starts[group], n) + ramp]


class Items:
    """The keys of one block of items in every repetition."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float, seed: int = 7) -> None:
        split = [(i, [plain(w) for w in (t or "").encode().split()]) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, own in split for w in own}))}
        self.ids = [i for i, _ in split]
        self.words = [np.array([self.vocabulary[w] for w in own], dtype=np.int32) for _, own in split]
        self.distinct = [np.unique(w) for w in self.words]
        self.most = [int((1 - similarity) * len(w) + 1e-9) for w in self.words]
        self.reps = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREEMENT**SAMPLED))
        self.keys = []
        rng = np.random.default_rng(seed)
        known, size = len(self.vocabulary), len(self.vocabulary) + OTHERS
        self.seen = np.zeros(size, dtype=bool)
        for _ in range(self.reps if split else 0):
            bits = rng.integers(0, 2, (WALK, size), dtype=np.int8)
            at = np.sort(rng.choice(np.arange(1, WALK), SAMPLED - 1, replace=False)).tolist()
            anchors = [int(rng.integers(0, len(w) if len(w) < SHORT else len(w) - WALK // 2)) for w in self.words]
            # the key's coordinates in turn; an item whose walk leaves it stops there with the key it has
            ended: list[dict[tuple[int, ...], list[int]]] = [{} for _ in range(SAMPLED)]
            opened: list[set[tuple[int, ...]]] = [set() for _ in range(SAMPLED)]
            for k, (w, a) in enumerate(zip(self.words, anchors, strict=True)):
                p, key = a, (int(w[a]),)
                for j in range(WALK):
                    if j in at:
                        if p >= len(w):
                            break
                        opened[len(key) - 1].add(key)
                        key += (int(w[p]),)
                    if p < len(w):
                        p += int(bits[j, w[p]])
                ended[len(key) - 1].setdefault(key, []).append(k)
            names = [{key: i for i, key in enumerate(sorted(e.keys() | o))} for e, o in zip(ended, opened, strict=True)]
            levels = [Level(*x) for x in zip(names, ended, opened, strict=True)]
            for level, own, following in zip(levels, names, names[1:]):
                level.lead_to(own, following, known)
            first = np.full(known, -1, dtype=np.int64)
            for key, i in names[0].items():
                first[key[0]] = i
            self.keys.append((bits, at, np.array(anchors, dtype=np.int64), first, levels))

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(item, place where it would begin) of all windows that agree with a key, in order."""
        found = [np.zeros(0, dtype=np.int64)]
        n, size = len(ids), len(self.vocabulary)
        padded = np.concatenate([ids, np.full(WALK + 1, size, dtype=np.int32)])
        inside = np.flatnonzero(ids < size)
        symbols = ids[inside]
        for bits, at, anchors, first, levels in self.keys:
            group = first[symbols]
            start, group = inside[group >= 0], group[group >= 0]
            pos, j = start, 0
            for level, step in zip(levels, [*at, None], strict=True):
                rows, items = level.found(start, group)
                found.append(items << PLACE_BITS | (rows - anchors[items] + PLACE_ZERO))
                if step is None or not level.goes_on:
                    break
                live = level.is_open[group]
                start, pos, group = start[live], pos[live], group[live]
                while j < step:
                    pos = pos + bits[j, padded[pos]]
                    j += 1
                here = padded[pos].astype(np.int64)
                code = np.where(here < size, group * size + here, -1)
                spot = np.minimum(np.searchsorted(level.known, code), len(level.known) - 1)
                ok = (level.known[spot] == code) & (level.number[spot] >= 0) & (pos < n)
                start, pos, group = start[ok], pos[ok], level.number[spot[ok]]
        codes = np.unique(np.concatenate(found))
        return list(zip((codes >> PLACE_BITS).tolist(), ((codes & (1 << PLACE_BITS) - 1) - PLACE_ZERO).tolist(), strict=True))

    def share(self, item: int, window: np.ndarray) -> int:
        """Distinct words of the item that the window holds."""
        self.seen[window] = True
        n = int(np.count_nonzero(self.seen[self.distinct[item]]))
        self.seen[window] = False
        return n


def prepared(block: tuple[tuple[int | None, str], ...], similarity: float) -> tuple[Items, Symbols]:
    """A worker's keys and symbols of a block, kept from task to task."""

    def make() -> tuple[Items, Symbols]:
        keys = Items(list(block), similarity)
        return keys, Symbols(keys.vocabulary)

    return kept(("decontaminate", block, similarity), make)


class Symbols(dict):
    """Raw word, its A-Z in lower case, to its symbol."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.raw = {w.encode(): k for w, k in vocabulary.items()}

    def __missing__(self, raw: bytes) -> int:
        if len(self) > MEMO_RAW:
            self.clear()
        if raw.isalpha():  # A-Z and a-z only
            v = self.raw.get(raw)
        else:
            v = self.raw.get(raw.strip(EDGE_ASCII) or raw) if raw.isascii() else self.vocabulary.get(plain(raw))
        self[raw] = v = len(self.vocabulary) + zlib.crc32(raw) % OTHERS if v is None else v
        return v


def matches(texts: list[bytes], items: Items, symbols: Symbols) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, begin, end) of the best verified window of each text and item."""
    words, bounds = split_words([t.lower() for t in texts])
    if not words or not items.words:
        return []
    ids = np.fromiter(map(symbols.__getitem__, words), dtype=np.int32, count=len(words))
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[tuple[int, int], int] = {}
    for i, p in items.candidates(ids):
        item, most = items.words[i], items.most[i]
        d = int(owner[min(max(p + len(item) // 2, 0), len(ids) - 1)])
        for d in {d, int(owner[min(max(p, 0), len(ids) - 1)]), int(owner[min(max(p + len(item) - 1, 0), len(ids) - 1)])}:
            if done.get((d, i), -1) == p or best.get((d, i), (1,))[0] == 0:
                continue
            done[d, i] = p
            slack = most + 2
            lo, hi = max(int(bounds[d]), p - slack), min(int(bounds[d + 1]), p + len(item) + slack)
            if hi - lo < len(item) - most:
                continue
            window = ids[lo:hi]
            if items.share(i, window) < len(items.distinct[i]) - most:  # each edit takes one of its words away at most
                continue
            dist, b, e = edit_distance(item, window, most)
            if dist <= most and (dist, lo + b) < best.get((d, i), (most + 1, 0))[:2]:
                best[d, i] = (dist, lo + b - int(bounds[d]), lo + e - int(bounds[d]))
    return [(d, i, *x) for (d, i), x in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, item_id, distance, similarity, begin, end (words) of every document and item that it holds.

    An item is held if a part of the text is within (1 - similarity) of the item's words by
    word edit distance; rows of the benchmark alike in id and text are one item. One pass over the documents for each block of
    items, no shuffle; of several blocks each is written to the shared folder before the next.
    """
    docs = text_of(docs, id_column, text_column)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    n, out = items.count(), None
    blocks = max(1, -(-n // ITEM_BLOCK))
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = tuple((r.item_id, r.text) for r in own.toLocalIterator())
        found = found_in(docs, block, similarity)
        if blocks > 1:  # the driver holds the texts of one block at a time
            found = cut(found)
        out = found if out is None else out.unionByName(found)
    return out


def found_in(docs: DataFrame, block: tuple[tuple[int | None, str], ...], similarity: float) -> DataFrame:
    """contaminated() of the items of one block, which travel with its tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, symbols = prepared(block, similarity)
        for part, texts in steps(batches):
            rows = matches(texts, keys, symbols)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            size = [len(keys.words[i]) for i in cols[1]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array([keys.ids[i] for i in cols[1]], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([1 - x / s for x, s in zip(cols[2], size, strict=True)], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["doc_id", "item_id", "distance", "similarity", "begin", "end"])

    return docs.mapInArrow(run, "doc_id long, item_id long, distance long, similarity double, begin long, end long")
