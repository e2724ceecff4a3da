"""Fuzzy line dedup by MinHash.

Lines are compared in lower case with white space collapsed. Every line with a character left
takes part: equal lines are one row, found by their 128-bit hash. Each distinct line of at
least SHINGLE characters also gets MinHash values of its character shingles, banded so that a
pair at the threshold shares a band with probability over 0.99.
Distinct lines that share a band meet with their texts and are verified by exact Jaccard
similarity of their shingle sets; a bucket emits a spanning forest of its verified links.
Lines of a bucket of over WHOLE lines (numbered lines, table rows) don't meet in it: their shingles
are ordered, rare ones first, and lines meet by each of the first n - ceil(0.8 n) + 1 of their n shingles, of which two
similar lines always share one; so a large bucket is dealt over tasks by shingles and loses no link.
Distributed union-find joins them, and of each component the line that comes first (by
document id, then line number) stays, in that place only.

Cases: a null or empty text stays as it is and has no lines; lines of white space only stay;
a line shorter than a shingle has none, so only lines equal to it are found; lines that
repeat within one document count like those of other documents; a document may lose all its
lines and stays with an empty text; an empty table gives no rows. A null id comes after all
others; rows of one id are documents of their own, in the order of their texts' hashes, and of
rows alike in id and text one keeps the lines. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import cut, free_name, mix, numbered, partitions, steps, text_of
from quillspark.llm.components import components

SHINGLE = 9
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
#: Characters whose shingles are hashed at a time; a longer line is a run of its own.
CACHED = 1 << 15
#: Places of lines that may be broadcast to the documents (40 bytes each at most); more are shuffled.
BROADCAST_LINES = 1_000_000
#: Digests of lines that a task remembers to have signed before it starts anew.
MEMO_LINES = 200_000
#: Band keys that one task sorts (16 bytes each); there are as many tasks as that takes.
KEYS_PER_TASK = 4_000_000


def normal(line: str) -> str:
    """Lower case, white space collapsed."""
    line = line.lower()
    if line.isprintable() and "  " not in line:  # then single spaces are its only white space
        return line.strip()
    return " ".join(line.split())


def signatures(lines: list[str], width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys (bands per line) of lines of at least `width` characters, in runs of lines that a core's cache holds."""
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    turn = np.cumsum(sizes) // CACHED
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(lines)]
    multipliers = np.random.default_rng(11).integers(1, 1 << 31, bands * rows).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.zeros((len(lines), bands), dtype=np.uint64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            out[a:b] = band_keys(lines[a:b], sizes[a:b], width, bands, multipliers)
    return out.view(np.int64)


def band_keys(lines: list[str], sizes: np.ndarray, width: int, bands: int, multipliers: np.ndarray) -> np.ndarray:
    """Shingles get a mixed 32-bit hash; an odd multiplier permutes it, and the least product is the MinHash value."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(sizes)
    m = len(codes) - width + 1
    h = np.zeros(m, dtype=np.uint32)
    for k in range(width):
        h *= np.uint32(0x01000193)
        h += codes[k : k + m]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    # shingles that cross into the next line leave
    inside = np.ones(m, dtype=bool)
    for e in range(1, width):
        at = ends[:-1] - e
        inside[at[at < m]] = False
    h = h[inside]
    starts = np.r_[0, np.cumsum(sizes - width + 1)[:-1]]
    least, x = np.zeros((len(multipliers), len(lines)), dtype=np.uint64), np.empty_like(h)
    for k, times in enumerate(multipliers):
        np.multiply(h, times, out=x)
        least[k] = np.minimum.reduceat(x, starts)
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for row in least.reshape(bands, -1, len(lines)).transpose(1, 0, 2):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys.T


def occurrences(docs: DataFrame) -> DataFrame:
    """h, g (the 128-bit hash of the normalised line), own, line_no, and whether it is the line's first in its row.

    The first of a line in a task (as far as that remembers) has its band keys as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[bytes] = set()
        for part, texts in steps(batches):
            doc, number, lines, first = [], [], [], []
            for d, t in enumerate(texts):
                here = set()
                for k, line in enumerate(t.decode("utf-8", "replace").split("\n")):
                    if x := normal(line):
                        doc.append(d), number.append(k), lines.append(x), first.append(x not in here)
                        here.add(x)
            if not lines:
                continue
            distinct = dict.fromkeys(lines)
            place = dict(zip(distinct, range(len(distinct)), strict=True))
            at = np.fromiter(map(place.__getitem__, lines), dtype=np.int64, count=len(lines))
            digests = [xxhash.xxh3_128_digest(x.encode()) for x in distinct]
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            fresh = np.fromiter((len(x) >= SHINGLE and k not in signed for x, k in zip(distinct, digests, strict=True)), dtype=bool, count=len(digests))
            if len(signed) > MEMO_LINES:
                signed.clear()
            signed.update(digests)
            row_of = np.full(len(digests), -1)
            row_of[fresh] = np.arange(np.count_nonzero(fresh))
            bearer = np.zeros(len(lines), dtype=bool)
            bearer[np.unique(at, return_index=True)[1]] = True
            row = pa.array(row_of[at], mask=~bearer | (row_of[at] < 0))
            keys = signatures([x for x, f in zip(distinct, fresh.tolist(), strict=True) if f]).T if fresh.any() else np.zeros((BANDS, 0), dtype=np.int64)
            bands = [pa.array(np.ascontiguousarray(k)).take(row) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(halves[at, 0]), pa.array(halves[at, 1]), part.column("own").take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(first), *bands], ["h", "g", "own", "line_no", "first", *BAND_COLUMNS])

    return docs.mapInArrow(run, "h long, g long, own long, line_no int, first boolean, " + ", ".join(f"{b} long" for b in BAND_COLUMNS))


BAND_COLUMNS = [f"b{k}" for k in range(BANDS)]


def shingle_codes(lines: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingles of each line as numbers, equal for equal shingles of these lines and for no others."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32)
    m = max(0, len(codes) - width + 1)
    seen = np.zeros(0x110000, dtype=bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    if len(letters) ** width < 1 << 64:  # the letters are digits of one number
        digit = np.zeros(0x110000, dtype=np.uint64)
        digit[letters] = np.arange(len(letters), dtype=np.uint64)
        codes = digit[codes]
        h = np.zeros(m, dtype=np.uint64)
        for k in range(width):
            h *= np.uint64(len(letters))
            h += codes[k : k + m]
    else:  # numbers of prefixes of the shingle, one letter longer each time
        h = codes[:m].astype(np.int64)
        for k in range(1, width):
            h = np.unique(h << 21 | codes[k : k + m], return_inverse=True)[1]
    out, at = [], 0
    for line in lines:
        own = np.sort(h[at : at + len(line) - width + 1])
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        at += len(line)
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def few(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links of a few lines: a line is compared with each component so far until one member links."""
    out, components = [], []
    for x in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        joined, others, size = [x], [], len(sets[x])
        for component in components:
            for y in reversed(component):
                n = len(sets[y])
                if n < similarity * size:  # too short for this line, as are all before it
                    others.append(component)
                    break
                both = common(sets[x], sets[y])
                if both >= similarity * (size + n - both):
                    out.append((x, y))
                    joined = component + joined
                    break
            else:
                others.append(component)
        joined.sort(key=lambda k: len(sets[k]))
        components = [*others, joined]
    return out


def many(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links of any number of lines: each line reached is compared with all lines not yet reached at once, by the lists of its shingles' lines."""
    n, sizes = len(sets), np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    _, number, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    lines = np.repeat(np.arange(n), sizes)[np.argsort(number, kind="stable")]
    ends, bounds = np.cumsum(df), np.r_[0, np.cumsum(sizes)]
    unseen, left, out = np.ones(n, dtype=bool), n, []
    for seed in range(n):
        if not unseen[seed]:
            continue
        unseen[seed] = False
        left, reached = left - 1, [seed]
        while reached and left:
            x = reached.pop()
            own = number[bounds[x] : bounds[x + 1]]
            both = np.bincount(np.concatenate([lines[e - k : e] for e, k in zip(ends[own].tolist(), df[own].tolist(), strict=True)]), minlength=n)
            new = np.flatnonzero(unseen & (both >= similarity * (sizes + sizes[x] - both))).tolist()
            unseen[new] = False
            left -= len(new)
            reached += new
            out += [(x, y) for y in new]
    return out


#: Lines up to which a bucket's lines are compared one by one.
FEW = 16


def verified(keys: np.ndarray, ids: np.ndarray, texts: list[str], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between lines within each bucket."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0])
    place = {t: k for k, t in enumerate(dict.fromkeys(texts))}
    sets = shingle_codes(list(place))
    out: set[tuple[int, int]] = set()
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        if e - s < 2:
            continue
        rows = order[s:e].tolist()
        own = [sets[place[texts[r]]] for r in rows]
        for x, y in (few if e - s <= FEW else many)(own, similarity):
            a, b = int(ids[rows[x]]), int(ids[rows[y]])
            if a != b:
                out.add((max(a, b), min(a, b)))
    return list(out)


def shingle_hashes(lines: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingles of each line as sorted 64-bit hashes that are the same in every task."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(codes) - width + 1), dtype=np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(h)]
    h, out, at = mix(h), [], 0
    for line in lines:
        out.append(np.unique(h[at : at + len(line) - width + 1]))
        at += len(line)
    return out


#: A bucket of more lines is dealt by its lines' rare shingles.
WHOLE = 10_000
#: Counters of shingles by their hashes, by which rare ones are told: a table of fixed size.
COUNTERS = 1 << 18


def shingle_counts(lines: DataFrame) -> np.ndarray:
    """How many lines (id, line_text) have shingles of each counter, as a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(np.concatenate(shingle_hashes(batch.column("line_text").to_pylist())) % np.uint64(COUNTERS), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["counter", "n"])

    out = np.zeros(COUNTERS, dtype=np.int64)
    for r in lines.mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.counter] = r.n
    return out


def rare_shingles(lines: DataFrame, similarity: float) -> DataFrame:
    """Keys in the form of dealt()'s: each line (id, line_text) under its rarest shingles, enough of them that two similar lines share one.

    Any one order of the shingles does for that; rare ones first makes few lines meet.
    """
    counts = lines.sparkSession.sparkContext.broadcast(shingle_counts(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for k, own in zip(batch.column("id").to_pylist(), shingle_hashes(batch.column("line_text").to_pylist()) if batch.num_rows else [], strict=True):
                first = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
                own = own[np.lexsort((own, counts.value[(own % np.uint64(COUNTERS)).astype(np.int64)]))][:first]
                keys.append(own.view(np.int64))
                ids.append(np.full(len(own), k, dtype=np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, keys)], ["id", "b0"])

    return lines.mapInArrow(run, "id long, b0 long")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and its normalised text of `wanted` (id, own, line_no)."""
    by_doc = wanted.groupBy(F.col("own").alias("want_own")).agg(F.collect_list(F.struct("line_no", "id")).alias("want"))
    if wanted.count() <= BROADCAST_LINES:
        by_doc = F.broadcast(by_doc)
    joined = docs.join(by_doc, F.col("own") == F.col("want_own")).select("text", F.col("want.line_no").alias("numbers"), F.col("want.id").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            ids, out = [], []
            for t, numbers, own in zip(texts, part.column("numbers").to_pylist(), part.column("ids").to_pylist(), strict=True):
                lines = t.decode("utf-8", "replace").split("\n")
                ids += own
                out += [normal(lines[k]) for k in numbers]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["id", "line_text"])

    return joined.mapInArrow(run, "id long, line_text string")


def dealt(lines: DataFrame, tasks: int) -> DataFrame:
    """Keys (b0 and on) with their lines' ids, packed into one row per batch and task."""
    columns = [c for c in lines.columns if c in BAND_COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.concatenate([batch.column(c).to_numpy() for c in columns])
            pairs = np.stack([keys, np.tile(batch.column("id").to_numpy(), len(columns))], axis=1)
            task = (keys.view(np.uint64) % np.uint64(tasks)).astype(np.int32)
            order = np.argsort(task, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(task[order]) != 0]) if len(order) else order
            ends = np.r_[starts, len(order)].astype(np.int32) * np.int32(16)
            packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(pairs[order]))])
            yield pa.RecordBatch.from_arrays([pa.array(task[order][starts]), packed], ["task", "pairs"])

    return lines.where("b0 is not null").select("id", *columns).mapInArrow(run, "task int, pairs binary").repartitionById(tasks, "task")


def shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of every band key that two or more lines have, with the bucket's size and two digests of its ids."""
    packed = [x for batch in batches for x in batch.column("pairs").to_pylist()]
    band, own = np.frombuffer(b"".join(packed), dtype=np.int64).reshape(-1, 2).T
    order = np.argsort(band)
    band, own = band[order], own[order]
    same = band[1:] == band[:-1]
    keep = np.r_[same, False] | np.r_[False, same] if len(band) else np.zeros(0, dtype=bool)
    band, own = band[keep], own[keep]
    if len(band):
        starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        n = np.diff(np.r_[starts, len(band)])
        digests = [np.bitwise_xor.reduceat(x, starts) for x in (own, mix(mix(own.view(np.uint64))).view(np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(own), *[pa.array(np.repeat(x, n)) for x in (n, *digests)]], ["band", "id", "n", "x", "y"])


def members(lines: DataFrame, n_keys: int) -> DataFrame:
    """band, id and n of the keys that two lines or more share, n lines in all; of keys with the same lines one."""
    tasks = max(partitions(lines), -(-n_keys // KEYS_PER_TASK))
    buckets = dealt(lines, tasks).mapInArrow(shared_buckets, "band long, id long, n long, x long, y long")
    return cut(buckets.groupBy("id", "n", "x", "y").agg(F.min("band").alias("band")).select("id", "band", "n"))


def links(docs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """(u, v): verified links between the ids of distinct lines, enough to connect all that are linked through a shared band."""
    by_band = members(distinct, distinct.count() * BANDS)
    wanted = cut(distinct.join(by_band.select(F.col("id").alias("w")).distinct(), F.col("id") == F.col("w"), "left_semi").select("id", "own", "line_no"))
    texts = line_texts(docs, wanted)
    met = by_band.where(f"n <= {WHOLE}")
    if by_band.where(f"n > {WHOLE}").limit(1).count():
        crowded = by_band.where(f"n > {WHOLE}").select(F.col("id").alias("w")).distinct()
        lines = cut(texts.join(crowded, F.col("id") == F.col("w"), "left_semi"))
        keys = cut(rare_shingles(lines, similarity))
        met = met.unionByName(members(keys, keys.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            pairs = verified(t["band"].to_numpy(), t["id"].to_numpy(), t["line_text"].to_pylist(), similarity)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                b = batch.column("band").to_numpy()
                last = int(np.searchsorted(b, b[-1]))  # rows before belong to buckets that have ended
                if last or held and held[-1].column("band")[-1].as_py() != b[0]:
                    held.append(batch.slice(0, last))
                    yield from out()
                    held = [batch.slice(last)]
                else:
                    held.append(batch)
        if held:
            yield from out()

    met = met.join(texts, "id").select("band", "id", "line_text").repartition(partitions(docs), "band").sortWithinPartitions("band")
    return met.mapInArrow(run, "u long, v long")


def duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(own, line_no) of every line to remove from docs (own, text)."""
    occ = cut(occurrences(docs))
    least = F.min(F.expr("if(first, own, null)")), F.expr("min_by(line_no, if(first, own, null))")
    distinct = occ.groupBy("h", "g").agg(least[0].alias("own"), least[1].alias("line_no"), F.count("*").alias("n"), *[F.max(b).alias(b) for b in BAND_COLUMNS])
    distinct = cut(distinct.withColumn("id", F.monotonically_increasing_id()))
    roots = components(links(docs, distinct, similarity))
    # a root has no row of its own, and a component's lines are few beside the lines alone
    ties = cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    tied = distinct.join(ties, F.col("id") == F.col("node")).select("h", "g", "root", F.struct("own", "line_no").alias("place"))
    stays = tied.groupBy(F.col("root").alias("r")).agg(F.min("place").alias("stays"))
    tied = tied.join(stays, F.col("root") == F.col("r")).select("h", "g", "stays.own", "stays.line_no")
    alone = distinct.where("n > 1").join(ties, F.col("id") == F.col("node"), "left_anti").select("h", "g", "own", "line_no")
    stays = cut(alone.unionByName(tied)).toDF("h_", "g_", "own_", "line_no_")
    if stays.count() <= BROADCAST_LINES:
        stays = F.broadcast(stays)
    again = occ.join(stays, (F.col("h") == F.col("h_")) & (F.col("g") == F.col("g_")))
    return again.where("own != own_ or line_no != line_no_").select("own", "line_no")


def gone_by_row(docs: DataFrame, similarity: float) -> DataFrame:
    """own_ and gone (the numbers of the lines to remove) of the rows that lose lines."""
    gone = cut(duplicate_lines(docs, similarity))
    by_row = gone.groupBy(F.col("own").alias("own_")).agg(F.collect_set("line_no").alias("gone"))
    return F.broadcast(by_row) if gone.count() <= BROADCAST_LINES else by_row


def line_dedup(docs: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and text (the lines that stay; null stays null) of every row."""
    cols = numbered(text_of(docs, id_column, text_column))
    by_row = gone_by_row(cols.select("own", "text"), similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            n, removed, kept = [], [], []
            for t, cutted in zip(texts, part.column("gone").to_pylist(), strict=True):
                lines = t.split(b"\n") if t else []
                stay = lines
                if cutted:
                    out = set(cutted)
                    stay = [x for k, x in enumerate(lines) if k not in out]
                n.append(len(lines)), removed.append(len(lines) - len(stay)), kept.append(b"\n".join(stay).decode("utf-8", "replace"))
            text = pc.if_else(pc.is_valid(part.column("text")), pa.array(kept, pa.string()), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), text], ["doc_id", "n_lines", "n_removed", "text"])

    return cols.join(by_row, F.col("own") == F.col("own_"), "left").select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_lines long, n_removed long, text string")


def rewrite(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs (doc_id, text, any other columns) with the text of every row that loses lines replaced; other columns stay.

    Where there is a column n_chars it follows the text.
    """
    names, own, gone = docs.columns, free_name(docs, "own"), free_name(docs, "gone")
    rows = numbered(docs, own)
    by_row = gone_by_row(rows.select(F.col(own).alias("own"), F.col("text").cast("string").alias("text")), similarity)
    by_row = by_row.toDF(key := free_name(rows, "own_"), gone)
    joined = rows.join(by_row, F.col(own) == F.col(key), "left")
    # lines are numbered from 0 by splitting on line feeds only, as in occurrences()
    # each step is linear in the lines, and a lambda's argument is worked out once
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda k: F.get(lines, k))
    stay = F.get(F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.array_join(kept(lines), "\n")), F.lit(0))
    out = joined.withColumn("text", F.when(F.col(gone).isNull() | F.col("text").isNull(), F.col("text")).otherwise(stay))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
