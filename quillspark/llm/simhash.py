"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's ball of radius 4 / 2 over 64 bits has 2,081 members, 33 kB a document, which
no corpus of 3 kB documents can shuffle. The radius is therefore met in the middle twice: of
two fingerprints at most `radius` bits apart, one 32-bit half differs in at most radius // 2
bits, and two halves that near share a variant at most half of that (rounded up on one side)
away. Every distinct fingerprint emits all such variants of both halves (66 at radius 4),
variants are shuffled, and the pairs that collide are deduplicated and verified on all bits.
No link is lost. A bucket emits a spanning forest of its verified links, not all pairs, and
exact copies are one fingerprint, so a group of copies makes one row.

Cases: a null or empty text has fingerprint zero and links like any other; fewer words than a
shingle are one shingle; an empty table gives no rows; extra columns are ignored. Rows of one
id are fingerprinted each; a row of a null id is linked too, and a component is named by its
least id that isn't null (null if all are).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import Forest, cut, partitions, steps, text_of
from quillspark.llm.components import components

#: Pairs verified at once within a bucket, and members from which a bucket is cut further.
BLOCK, LARGE = 1 << 22, 2048
#: Variants that one task sorts (16 bytes each); there are as many tasks as that takes.
VARIANTS_PER_TASK = 2_000_000


def fingerprints(docs: DataFrame, width: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp (64 bits in a long): a bit is set if it is in over half the shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for part, texts in steps(batches):
            fps = np.zeros(len(texts), dtype=np.uint64)
            for i, t in enumerate(texts):
                words = t.lower().split()  # bytes.lower() lower-cases A-Z only
                if not words:
                    continue
                joined = b" ".join(words)
                if len(words) <= width:
                    hashes = np.array([digest(joined, 42)], dtype="<u8")
                else:
                    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
                    starts = np.r_[0, ends[:-width]].tolist()
                    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
                fps[i] = np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return text_of(docs, id_column, text_column).mapInArrow(run, "doc_id long, fp long")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 200):  # sums of 200 fit a byte
        total += np.unpackbits(hashes[k : k + 200].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return total


def masks(radius: int) -> list[int]:
    """Changes of a 32-bit half of at most ceil(radius // 2 / 2) bits."""
    most = (radius // 2 + 1) // 2
    return [sum(1 << b for b in bits) for r in range(most + 1) for bits in combinations(range(32), r)]


def near_groups(fps: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Groups of places such that any two fingerprints at most `radius` bits apart meet in one.

    Few are one group; of many, two that near agree on one of radius + 1 ranges of bits.
    """
    if len(fps) <= LARGE:
        yield np.arange(len(fps))
        return
    cuts = np.linspace(0, 64, radius + 2).astype(int).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = (fps.view(np.uint64) >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
        yield from (own for own in np.split(order, starts[1:]) if len(own) > 1)


def verified(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within buckets of equal keys."""
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    near = lambda a, b: np.bitwise_count((a ^ b).view(np.uint64)) <= radius
    us, vs = [], []
    for size in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == size]
        if size <= 8:
            for i in range(size):
                for j in range(i):
                    a, b = fps[at + i], fps[at + j]
                    ok = near(a, b)
                    us.append(a[ok]), vs.append(b[ok])
            continue
        for s in at.tolist():
            own, forest = np.unique(fps[s : s + size]), Forest()
            for at in near_groups(own, radius):
                rows = max(1, BLOCK // len(at))
                for k in range(0, len(at), rows):
                    i, j = np.nonzero(near(own[at[k : k + rows], None], own[None, at]))
                    i, j = at[i + k], at[j]
                    i, j = i[i > j], j[i > j]
                    links = [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.union(x, y)]
                    us.append(own[[x for x, _ in links]]), vs.append(own[[y for _, y in links]])
    none = np.zeros(0, dtype=np.int64)
    u, v = np.concatenate([none, *us]), np.concatenate([none, *vs])
    pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v): links between distinct fingerprints fp, enough to connect all that are linked."""
    tasks = max(partitions(distinct), -(-distinct.count() * 2 * len(masks(radius)) // VARIANTS_PER_TASK))
    flips = F.array(*[F.lit(m).cast("long") for m in masks(radius)])
    halves = F.array(F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))
    variants = distinct.select("fp", F.explode(F.flatten(F.transform(halves, lambda h: F.transform(flips, lambda m: h.bitwiseXOR(m))))).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("key").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if parts:
            u, v = verified(*(np.concatenate(x) for x in zip(*parts, strict=True)), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return variants.repartition(tasks, "key").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) of every row."""
    fps = cut(fingerprints(docs, width, id_column, text_column))
    firsts = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp"), radius))
    member = firsts.join(roots, F.col("node") == F.col("fp"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    found = member.join(least, "root").select(F.col("fp").alias("f"), "component_id")
    return fps.join(found, F.col("f") == F.col("fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
