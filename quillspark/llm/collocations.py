"""Phrase collocations by PCY/DHP passes.

Pass k counts phrases of k words exactly, and while it does, hashes those of k + 1 words into
a table of a fixed number of buckets. Before pass k + 1 the tables of all tasks are added up
and the buckets that reach the least count become a bit map; a second bit map holds the hashes
of the phrases of k words that are frequent. Both are broadcast (their size is fixed), and pass k + 1
counts a phrase only if its bucket's bit is set and (Apriori) both its parts of k words are in
the map of the frequent. Bit maps only ever admit too much, so the counts are exact at any size of the
corpus; a corpus that fills the buckets is pruned less, which `bits` mends. A bucket's counter
stops at the least count in every task: the sums reach it exactly where the whole counts would.

Texts are cut into words as arrays: the hash of any run of words is a difference of prefix sums
over the bytes, and equal hashes are compared byte by byte before they count as one phrase.

A candidate's score is the least, over the places to cut it in two, of
1000 * a * n / (l * r), rounded down (exact, in decimals of 38 digits). A candidate inside a longer one
that is as frequent (in `percent` of its count) is dropped; it is enough to look at candidates one word longer, as a
phrase between the two is at least as frequent as the longer.

Cases: a null or empty text has no words; a null language is `und`; repeated rows and ids count as rows of their
own; ties in score go by count, then by the phrase's bytes; an empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window as W, functions as F

from quillspark.llm.common import STEP_BYTES, cut, kept, mix, partitions, steps

LEAST, LONGEST, TOP, PERCENT = 100, 5, 2000, 100
#: Buckets are 2 ** BITS: a byte each in a task's table and a bit each in the broadcast map.
BITS = 22
#: Buckets of one row of a table on its way to be added up.
CHUNK = 4096
#: Bytes of frequent phrases that may be broadcast to the candidates; more are shuffled.
BROADCAST_BYTES = 32 << 20
#: Bucket numbers that a task gathers before it adds them to its table.
GATHERED = 2_000_000

BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(10 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_RANDOM = np.random.default_rng(5).integers(0, 1 << 63, 258, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as were ever asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self.base = _RANDOM[256]
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, STEP_BYTES + 4096)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, dtype=np.uint64)]) for x in (self.base, self.inverse))
        return self.up, self.down


class Words:
    """Words of some texts: their bytes with one byte between, their bounds, pieces and languages."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, powers: Powers) -> None:
        raw = np.frombuffer(b"\n".join([*texts, b""]).translate(_PLAIN), dtype=np.uint8)
        apart = (raw == 32) | (raw == 10)
        edge = np.flatnonzero(np.diff(apart, prepend=True))  # where words begin and end by turns
        begin, end = edge[::2], edge[1::2]
        size = end - begin
        self.bytes = raw[~apart | np.r_[False, ~apart[:-1]]]
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size
        self.piece = np.cumsum(raw == 10, dtype=np.int32)[begin]
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.lang = langs[np.searchsorted(bounds, begin, "right")]
        up, self.down = powers.of(len(self.bytes) + 1)
        self.sums = np.zeros(len(self.bytes) + 1, dtype=np.uint64)
        np.cumsum(_RANDOM[self.bytes] * up[: len(self.bytes)], out=self.sums[1:])

    def runs(self, k: int) -> np.ndarray:
        """Whether k words from each word on (as far as there are k) lie in one piece."""
        n = max(0, len(self.begin) - k + 1)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def hashes(self, at: np.ndarray, k: int, salts: np.ndarray) -> np.ndarray:
        """Hashes of the runs of k words from the words `at` on, each in its language."""
        first = self.begin[at]
        h = (self.sums[self.end[at + (k - 1)]] - self.sums[first]) * self.down[first]
        return mix(h ^ salts[self.lang[at]])

    def phrases(self, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all phrases one after another, and where each begins."""
        ends = np.cumsum(size)
        flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
        return self.bytes[flat], ends - size

    def counted(self, at: np.ndarray, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """First words, counts and texts of the distinct phrases of k words from the words `at` on, by their hashes."""
        order = np.argsort(h)
        at, h = at[order], h[order]
        first, size, lang = self.begin[at], self.end[at + (k - 1)] - self.begin[at], self.lang[at]
        fresh = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, dtype=bool)
        # the phrases of a group of equal hashes must be the group's first in every byte; any that isn't is a group of its own
        lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        again = np.flatnonzero(~fresh)
        same = (size[again] == size[lead[again]]) & (lang[again] == lang[lead[again]])
        fresh[again[~same]] = True
        again = again[same]
        if len(again):
            a, starts = self.phrases(first[again], size[again])
            b, _ = self.phrases(first[lead[again]], size[again])
            fresh[again[~np.logical_and.reduceat(a == b, starts)]] = True
        alone = fresh & (lead != np.arange(len(at)))
        n = np.bincount(lead[~alone], minlength=len(at))
        n[alone] = 1
        reps = np.flatnonzero(fresh)
        data, starts = self.phrases(first[reps], size[reps])
        offsets = np.r_[starts, len(data)].astype(np.int64)
        return at[reps], n[reps], pa.Array.from_buffers(pa.large_string(), len(reps), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())


class Buckets:
    """A task's table of counters that stop at the least count."""

    def __init__(self, bits: int, least: int) -> None:
        self.shift, self.least, self.gathered, self.waiting = np.uint64(64 - bits), least, [], 0
        self.table = np.zeros(1 << bits, dtype=np.uint8 if least < 256 else np.uint32)

    def add(self, h: np.ndarray) -> None:
        self.gathered.append((h >> self.shift).astype(np.uint32))
        self.waiting += len(h)
        if self.waiting > GATHERED:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            more = np.bincount(np.concatenate(self.gathered), minlength=len(self.table))
            more += self.table
            self.table = np.minimum(more, self.least).astype(self.table.dtype)
            self.gathered, self.waiting = [], 0

    def rows(self) -> tuple[np.ndarray, list[bytes]]:
        self.settle()
        chunks = self.table.reshape(-1, min(CHUNK, len(self.table)))
        used = np.flatnonzero(chunks.any(axis=1))
        return used, [chunks[c].tobytes() for c in used.tolist()]


def short(texts: list[bytes]) -> list[bytes]:
    """The texts in parts; a long text is cut at breaks, which no phrase crosses."""
    out: list[bytes] = []
    for t in texts:
        start = 0
        while len(t) - start > STEP_BYTES and (found := _BREAK.search(t, start + STEP_BYTES // 2)):
            out.append(t[start : found.end()])
            start = found.end()
        out.append(t[start:] if start else t)
    return out


_BREAK = re.compile(b"[" + re.escape(BREAKS) + b"]")


def texts_by_step(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, list[str]]]:
    """Texts, the numbers of their languages, and the languages, of about STEP_BYTES each."""
    for part, texts in steps(batches):
        coded = part.column("lang").dictionary_encode()
        codes, langs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        if len(texts) == 1 and len(texts[0]) > STEP_BYTES:
            for t in short(texts):
                yield [t], codes, langs
        else:
            yield texts, codes, langs


def salts_of(langs: list[str]) -> np.ndarray:
    """A number for each language that is the same in every task."""
    codes = [np.frombuffer(x.encode(), dtype=np.uint8) for x in langs]
    return np.array([np.bitwise_xor.reduce(mix(_RANDOM[c] * np.arange(1, 2 * len(c), 2, dtype=np.uint64)), initial=_RANDOM[257]) for c in codes], dtype=np.uint64)


ROW = "lang string, phrase string, n long, chunk int, counters binary"
_ROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("chunk", pa.int32()), ("counters", pa.binary())])


def row_batch(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _ROW], schema=_ROW)


def table_rows(buckets: Buckets) -> pa.RecordBatch:
    used, rows = buckets.rows()
    return row_batch(chunk=used, counters=rows)


def one_pass(docs: DataFrame, k: int, last: bool, heavy: bytes, frequent: bytes, least: int, bits: int) -> DataFrame:
    """Counts of phrases of k words (lang, phrase, n; with no phrase all words of a language, in the first pass), and bucket tables of the next length."""
    maps = docs.sparkSession.sparkContext.broadcast((heavy, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = kept(("collocations",), Powers)
        admit, known = (np.unpackbits(np.frombuffer(m, dtype=np.uint8)).view(bool) for m in maps.value)
        shift, buckets = np.uint64(64 - bits), Buckets(bits, least)
        for texts, codes, langs in texts_by_step(batches):
            words, salts = Words(texts, codes, powers), salts_of(langs)
            if not len(words.begin):
                continue
            runs = words.runs(k)
            if k == 1:
                n = np.bincount(words.lang, minlength=len(langs))
                yield row_batch(lang=langs, n=n)
                at = np.arange(len(runs))
                h = words.hashes(at, 1, salts)
            else:
                part = np.flatnonzero(words.runs(k - 1))
                is_known = np.zeros(len(words.begin), dtype=bool)
                is_known[part] = known[words.hashes(part, k - 1, salts) >> shift]
                at = np.flatnonzero(runs & is_known[: len(runs)] & is_known[1 : len(runs) + 1])
                h = words.hashes(at, k, salts)
                at, h = (x[admit[h >> shift]] for x in (at, h))
            if not last:
                is_candidate = np.zeros(len(words.begin) + 1, dtype=bool)
                is_candidate[at] = True
                longer = words.runs(k + 1)
                longer = np.flatnonzero(longer & is_candidate[: len(longer)] & is_candidate[1 : len(longer) + 1])
                buckets.add(words.hashes(longer, k + 1, salts))
            if len(at):
                first, n, phrases = words.counted(at, k, h)
                yield row_batch(lang=pa.array(langs).take(pa.array(words.lang[first])), phrase=phrases, n=n)
        if not last:
            yield table_rows(buckets)

    return docs.mapInArrow(run, ROW)


def bit_map(tables: DataFrame, least: int, bits: int) -> bytes:
    """The buckets that reach `least` in the sum of all tables, a bit each: of fixed size, so it may come to the driver."""
    size = min(CHUNK, 1 << bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, counters in zip(batch.column("chunk").to_pylist(), batch.column("counters"), strict=True):
                row = np.frombuffer(counters.as_buffer(), dtype=np.uint8 if least < 256 else np.uint32)
                sums[c] = np.minimum(sums.get(c, 0) + row.astype(np.int64), least)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(s >= least).tobytes() for s in sums.values()], pa.binary())], ["chunk", "map"])

    out = np.zeros(((1 << bits) // size, size // 8), dtype=np.uint8)
    for r in tables.select("chunk", "counters").repartition(partitions(tables), "chunk").mapInArrow(add, "chunk int, map binary").collect():
        out[r.chunk] = np.frombuffer(r.map, dtype=np.uint8)
    return out.tobytes()


def tables_of(counts: DataFrame, k: int, least: int, bits: int) -> DataFrame:
    """Bucket tables in which every phrase of counts (lang, phrase), of k words each, fills its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, buckets = kept(("collocations",), Powers), Buckets(bits, least)
        for part, texts in steps(batches, "phrase"):
            coded = part.column("lang").dictionary_encode()
            words = Words(texts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), powers)
            buckets.add(np.repeat(words.hashes(np.arange(len(texts)) * k, k, salts_of(coded.dictionary.to_pylist())), least))
        yield table_rows(buckets)

    return counts.select("lang", "phrase").mapInArrow(run, ROW)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, a) of every phrase of up to `longest` words with a count a of `least` or more, and (lang, n) of all words."""
    nothing = bytes((1 << bits) // 8)
    heavy = frequent = nothing
    found, totals = [], None
    for k in range(1, longest + 1):
        last = k == longest
        # both results of a pass are read from it; a lost executor's parts are made again
        out = one_pass(docs, k, last, heavy, frequent, least, bits).persist(StorageLevel.DISK_ONLY)
        counts = cut(out.where("chunk is null").groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(f"phrase is null or a >= {least}"))
        if k == 1:
            totals = counts.where("phrase is null").select("lang", F.col("a").alias("n"))
        found.append(counts.where("phrase is not null").select("lang", "phrase", F.lit(k).alias("k"), "a"))
        heavy = nothing if last else bit_map(out.where("chunk is not null"), least, bits)
        out.unpersist()
        if last or not any(heavy):
            break
        frequent = bit_map(tables_of(found[-1], k, least, bits), least, bits)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole, totals


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of every phrase of two words or more."""
    size = counts.agg(F.sum(F.octet_length("phrase") + 64)).first()[0] or 0
    small = (lambda df: F.broadcast(df)) if size <= BROADCAST_BYTES else (lambda df: df)
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(c.alias("cut"), F.array_join(F.slice(words, F.lit(1), c), " ").alias("head"), F.array_join(F.slice(words, c + 1, F.col("k") - c), " ").alias("tail")))
    rows = counts.where("k > 1").select("lang", "phrase", "k", "a", F.inline(cuts))
    part = lambda name, count: small(counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count)))
    rows = rows.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    # a language's number of words: as many rows as languages, of which there is one for each phrase of one word at most
    rows = rows.join(small(totals), "lang")
    exact = F.expr("(cast(a as decimal(19,0)) * 1000 * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = rows.withColumn("score", exact).groupBy("lang", "phrase").agg(*[F.first(c).alias(c) for c in ("k", "a", "n")], F.min(F.struct("score", "cut", "l", "r")).alias("least"))
    return best.select("lang", "phrase", "k", "a", "least.l", "least.r", "n", "least.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, bits: int = BITS, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases."""
    texts = docs.select(F.col(text_column).cast("string").alias("text"), F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"))
    counts, totals = phrase_counts(texts, least, longest, bits)
    rows = scored(counts, totals)
    words = F.split("phrase", " ")
    inner = F.array(*[F.array_join(F.slice(words, F.lit(1 + s), F.col("k") - 1), " ") for s in (0, 1)])
    covers = counts.where("k > 2").select(F.col("lang").alias("lang_"), F.explode(inner).alias("phrase_"), "a").groupBy("lang_", "phrase_").agg(F.max("a").alias("covered"))
    rows = rows.join(covers, (F.col("lang") == F.col("lang_")) & (F.col("phrase") == F.col("phrase_")), "left").where(f"covered is null or 100 * covered < {percent} * a")
    # the rank's bound goes below the exchange: a task passes on `top` rows of a language at most
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank).where(f"rank <= {top}").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
