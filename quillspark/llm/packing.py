"""Best-fit packing with certified bounds.

Pieces of documents are packed partition by partition by best-fit decreasing. Dual feasible
functions give a lower bound on each partition's bins; a partition that meets its bound is
certified and keeps its packing but for its emptiest bin. Partitions with a gap keep their
full bins and hand the documents of the others to a pool; the pool is dealt anew to fewer
partitions and packed again, until it is one partition or a round retires less than a tenth of it.

Cases: a null or empty text is the one end token; a document longer than the capacity is cut
into full pieces and one last shorter piece; an empty table gives no rows; equal lengths are
packed in any order; rows of repeated or null ids are packed each, as pieces of their own.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import math
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import MEMO_WORDS, cut, kept, split_words, steps, text_of
from quillspark.llm.token_counts import SPACE, RankMerger

#: Pieces that one packing task holds (about 40 bytes each).
PIECES_PER_TASK = 200_000


#: Fixed value: the word-level pattern of the vocabulary file's pre-tokenizer.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


class Numbers(dict):
    """Numbers words as they are first looked up, and lists those that are new."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordEncoder:
    """Ids of whole texts as the tokenizer gives them.

    Its pre-tokens never cross white space, so ids are memoised by word; the distinct new
    words of a batch are normalised (composed, lower case) and merged together as arrays.
    A text with strings of special tokens goes through the tokenizer itself.
    """

    def __init__(self, vocabulary: str) -> None:
        self.vocabulary = vocabulary
        self.merger = RankMerger(vocabulary)
        self.special = [s.encode() for s in self.merger.special]
        self.find = regex.compile(WORDS).findall
        self.clear()

    @functools.cached_property
    def tok(self):
        """The tokenizer itself, loaded when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def clear(self) -> None:
        self.index = Numbers()
        self.ids, self.starts = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def normal(self, word: bytes) -> list[str]:
        text = word.decode("utf-8", "replace")
        if text.isascii():
            return [text.lower()] if text.isalpha() else self.find(text.lower())
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()  # a sigma's place in its word doesn't count
        return [text] if text.isalpha() else self.find(text)

    def learn(self, new: list[bytes]) -> None:
        # bytes.isalpha() is true of A-Z and a-z only
        parts = [[w.lower()] if w.isalpha() else [p.encode() for p in self.normal(w)] for w in new]
        flat = [p for own in parts for p in own]
        ids, sizes = self.merger.merge(flat) if flat else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        bounds = np.r_[0, np.cumsum([len(own) for own in parts])]
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.starts = np.r_[self.starts, self.starts[-1] + np.r_[0, np.cumsum(sizes)][bounds[1:]]]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and the bounds of each."""
        if len(self.index) > 2 * MEMO_WORDS:
            self.clear()
        whole = {i: self.tok.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for i, t in enumerate(texts) if b"<|" in t and any(x in t for x in self.special)}
        words, bounds = split_words([b"" if i in whole else t for i, t in enumerate(texts)])
        at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        if new := self.index.fresh:
            self.learn(new)
            new.clear()
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.r_[0, np.cumsum(sizes)]
        ids, cuts = self.ids[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])], ends[bounds]
        if whole:
            each = [np.array(whole[i], dtype=np.uint32) if i in whole else ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
            ids, cuts = np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]
        return ids, cuts


def encoder(vocabulary: str) -> WordEncoder:
    return kept(("packing", vocabulary), lambda: WordEncoder(vocabulary))


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token pieces of at most `capacity`: doc_id, piece, start, length, ids_crc32. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], dtype=np.uint32)
        for part, texts in steps(batches):
            ids, bounds = enc.encode(texts)
            rows = []
            for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own = np.concatenate([ids[a:b], end]).astype("<u4")
                rows += [(d, k, s, len(x := own[s : s + capacity]), zlib.crc32(x.tobytes())) for k, s in enumerate(range(0, len(own), capacity))]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_of(docs, id_column, text_column).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Least number of bins, by the dual feasible functions u_e: 1 above capacity - e, the length between, 0 below e."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)
    over, mass = np.cumsum(n[::-1])[::-1], np.r_[0, np.cumsum(n * np.arange(capacity + 1))]
    e = np.arange(0, capacity // 2 + 1)
    large = np.where(e > 0, over[np.minimum(capacity - e + 1, capacity)], 0)
    return int(np.max(large - (-(mass[capacity - e + 1] - mass[e]) // capacity)))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the room left in each bin. Bins are found in a bit set of rooms."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room: list[int] = []
    open_rooms = 0
    order = np.argsort(-lengths, kind="stable")
    for i, x in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if fit := open_rooms >> x:
            r = x + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i], room[b] = b, capacity - r, r - x
        if r > x:
            by_room[r - x].append(b)
            open_rooms |= 1 << (r - x)
    return bins, offsets, np.array(room, dtype=np.int64)


def pack(pieces: DataFrame, capacity: int = 4096, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length at least): gapless sequences of at most `capacity`.

    Each round moves only pieces still in the pool, and a task holds about `per_task` of them.
    """
    columns = pieces.columns
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "pooled": F.lit(True)}).schema

    def packer(turn: int, last: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            own = pd.concat(list(frames), ignore_index=True)
            if not len(own):
                return
            lengths = own["length"].to_numpy(np.int64)
            bins, offsets, room = best_fit_decreasing(lengths, capacity)
            loose = np.zeros(len(room), dtype=bool)
            if not last:
                loose = room > 0 if len(room) > lower_bound(lengths, capacity) else (room == room.max()) & (room > 0) & (np.cumsum(room == room.max()) == 1)
            own["sequence_id"] = np.int64(turn << 56) + (np.int64(TaskContext.get().partitionId()) << 32) + bins
            own["offset"], own["pooled"] = offsets, loose[bins]
            yield own

        return run

    pool, done, turn, before = pieces, None, 0, math.inf
    n = pool.count()
    while n:
        tasks = -(-n // per_task)
        last = tasks == 1 or n > 0.9 * before
        # dealt by all of a piece's columns, so that the pieces of one id, null or repeated, don't meet in one task
        packed = cut(pool.repartition(tasks, *columns).mapInPandas(packer(turn, last), schema))
        kept = packed.where("not pooled").drop("pooled")
        done = kept if done is None else done.unionByName(kept)
        pool, before = packed.where("pooled").select(*columns), n
        n, turn = (0 if last else pool.count()), turn + 1
    return done if done is not None else pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """pieces(), then pack(): the pieces are cut off first, as texts are tokenised once."""
    return pack(cut(pieces(docs, vocabulary, capacity, end_id)), capacity)
