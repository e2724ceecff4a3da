"""Dependency features over a parser's token table (work, sent_id, tok_i, lemma, pos, dep, head_i, verbform).

A sentence's tokens are numbered by a walk over its tree, so that a subtree is a range of numbers
and "something in the subtree" a difference of two running counts; time is linear in the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from quillspark.operators.statistics import chunk_stats
from quillspark.sources.shared import cut

#: Clause relations, and words that head a free relative.
CLAUSES = ("ccomp", "xcomp", "advcl", "acl", "relcl")
FREE = ("how", "what", "whatever", "when", "where", "which", "who", "whoever", "whom", "why")


def tour(head: list[int], starts: list[int] | None = None) -> tuple[list[int], list[int], list[int]]:
    """For each token its number in a walk from the roots down, the number after its subtree's last, and its depth.

    head is the place of each token's head; a root's is its own or none (-1). `starts` says in which order
    trees are walked (roots first, if not given); a ring of heads is cut at its first token in that order.
    """
    n = len(head)
    children: list[list[int] | None] = [None] * n
    roots = []
    for k in range(n - 1, -1, -1):
        h = head[k]
        if h < 0 or h == k:
            roots.append(k)
        elif children[h] is None:
            children[h] = [k]
        else:
            children[h].append(k)
    enter, leave, depth, number = [-1] * n, [0] * n, [0] * n, 0
    for start in starts if starts is not None else [*reversed(roots), *range(n)]:
        if enter[start] >= 0:
            continue
        stack, down = [start], 0
        while stack:
            k = stack.pop()
            if k < 0:
                leave[~k] = number
                down -= 1
            elif enter[k] < 0:
                enter[k], depth[k] = number, down
                number += 1
                if children[k] is None:
                    leave[k] = number
                else:
                    stack.append(~k)
                    stack += children[k]
                    down += 1
    return enter, leave, depth


def walked(sentence: np.ndarray, tok_i: np.ndarray, wanted: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, ...]:
    """enter, leave, depth and head (places in the arrays), what subtrees hold, and the token that stands for each on the way up.

    sentence ascends and tok_i within it; `wanted` is the head's tok_i; the first column of hit is `top`, the others are what is held.
    """
    n = len(sentence)
    # tokens come in the order of their numbers: a head is looked up among its sentence's
    key, wanted = sentence << 32 | tok_i, sentence << 32 | wanted & 0xFFFFFFFF
    at = np.minimum(np.searchsorted(key, wanted), max(0, n - 1))
    head = np.where(key[at] == wanted, at, -1) if n else at
    starts = np.lexsort((np.arange(n), ~((head < 0) | (head == np.arange(n))), sentence))
    enter, leave, depth = (np.array(x, dtype=np.int64) for x in tour(head.tolist(), starts.tolist()))
    order = np.argsort(enter)
    counts = np.zeros((n + 1, hit.shape[1] - 1), dtype=np.int64)
    np.cumsum(hit[order, 1:], axis=0, out=counts[1:])
    within = counts[leave] > counts[enter]
    up = np.where(hit[:, 0] & (depth > 0), np.arange(n), -1)
    by_depth, ends = np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth)) if n else depth
    for low, high in zip(ends[:-1], ends[1:], strict=True):  # level by level, heads before their tokens
        level = by_depth[low:high]
        open_ = level[up[level] < 0]
        up[open_] = up[head[open_]]
    return enter, leave, depth, head, within, np.where(up < 0, np.arange(n), up)


def subtrees(tokens: DataFrame, holds: dict[str, str], top: str = "false") -> DataFrame:
    """work, sent_id and t: a sentence's tokens in order, as structs of their columns and more.

    enter, leave, depth: the token's subtree is the tokens numbered enter to leave - 1; head_pos; for each name and
    condition of `holds`, in_<name> (whether a token of its subtree meets it) and top_<name> (the same of the nearest token on
    the way up, itself first, that meets `top` and isn't a root; of itself where there is none).
    """
    own = [c for c in tokens.columns if c not in ("work", "sent_id")]
    marks = F.array(*[F.coalesce(F.expr(e), F.lit(False)) for e in (top, *holds.values())])
    row = F.struct("tok_i", F.col("head_i").alias("head_"), marks.alias("marks_"), *[c for c in own if c not in ("tok_i",)])
    grouped = tokens.groupBy("work", "sent_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    names = list(holds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("t")
            flat, sizes = t.flatten(), pc.list_value_length(t).to_numpy().astype(np.int64)
            n = len(flat)
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            first = (np.cumsum(sizes) - sizes)[sentence]
            hit = flat.field("marks_").flatten().to_numpy(zero_copy_only=False).reshape(n, len(names) + 1)
            wanted = flat.field("head_").fill_null(-1).to_numpy().astype(np.int64)
            enter, leave, depth, head, within, up = walked(sentence, flat.field("tok_i").to_numpy().astype(np.int64), wanted, hit)
            found = [enter - first, leave - first, depth, np.where(head >= 0, head - first, -1)]
            lists = [pa.ListArray.from_arrays(t.offsets, pa.array(x.astype(np.int32))) for x in found]
            lists += [pa.ListArray.from_arrays(t.offsets, pa.array(np.ascontiguousarray(x[:, k]))) for x in (within, within[up]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, *columns])

    columns = ["enter", "leave", "depth", "head_at", *[f"in_{x}" for x in names], *[f"top_{x}" for x in names]]
    kinds = ["int"] * 4 + ["boolean"] * (2 * len(names))
    schema = grouped.select("*", *[F.expr(f"cast(null as array<{k}>)").alias(c) for c, k in zip(columns, kinds, strict=True)]).schema
    rows = grouped.mapInArrow(run, schema)
    fields = [f"x.{c} as {c}" for c in own] + [f"{c}[k] as {c}" for c in columns if c != "head_at"]
    return rows.select("work", "sent_id", F.expr(f"transform(t, (x, k) -> struct({', '.join(fields)}, if(head_at[k] >= 0, t[head_at[k]].pos, null) as head_pos))").alias("t"))


HOLDS = {"that": "dep = 'mark' and lemma = 'that'", "finite": "pos in ('VERB', 'AUX') and verbform = 'Fin'"}
CLAUSE_FLAGS = ["that_verb_ccomp", "that_adj_ccomp", "wh_free_rel"]


#: What a token brings to the clause features, a bit each: a clause's head, that and finite verbs below, and what the flags ask of it.
BITS = [f"dep in {CLAUSES}", *HOLDS.values(), "pos not in ('SPACE', 'PUNCT')", "dep = 'ccomp'", "pos = 'VERB'", "pos = 'ADJ'", f"lemma in {FREE}"]
ZSTD = pa.Codec("zstd", 1)
#: Sentences of a work that go together.
SENTENCES = 1000
#: Tokens of the blocks that are walked at a time, about.
STEP_TOKENS = 1 << 16


def packed(ints: np.ndarray) -> bytes:
    """sent_id, tok_i, head_i and bits of tokens as bytes."""
    x = ints.copy()
    x[2] -= x[1]
    x[:2, 1:] -= ints[:2, :-1]
    return ZSTD.compress(x.tobytes(), asbytes=True)


def unpacked(n: int, t: bytes) -> np.ndarray:
    x = np.frombuffer(ZSTD.decompress(t, decompressed_size=32 * n, asbytes=True), np.int64).reshape(4, n).copy()
    np.cumsum(x[:2], axis=1, out=x[:2])
    x[2] += x[1]
    return x


def clause_fragments(tokens: DataFrame, sentences: int) -> DataFrame:
    """work, block_, n and t: what a batch of tokens has of each block of sentences, packed: sent_id, tok_i, head_i and BITS."""
    bits = F.lit(0)
    for k, test in enumerate(BITS):
        bits = bits.bitwiseOR(F.when(F.expr(test), 1 << k).otherwise(0))
    longs = [F.coalesce(F.col(c).cast("long"), F.lit(other)).alias(c) for c, other in (("sent_id", 0), ("tok_i", 0), ("head_i", -1))]
    rows = tokens.select("work", F.floor(F.col("sent_id") / sentences).cast("long").alias("block_"), *longs, bits.cast("long").alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work, block = (pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy().astype(np.int64) for c in ("work", "block_"))
            ints = np.stack([batch.column(c).to_numpy() for c in ("sent_id", "tok_i", "head_i", "bits")])
            key = work << 32 | block
            order = np.lexsort((*ints[1::-1], key))
            key, ints = key[order], ints[:, order]
            bounds = [*np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)]).tolist(), len(key)]
            t = [packed(ints[:, a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            at = pa.array(order[bounds[:-1]] if len(key) else order)
            yield pa.RecordBatch.from_arrays([batch.column("work").take(at), batch.column("block_").take(at), pa.array(np.diff(bounds), pa.int64()), pa.array(t, pa.binary())], ["work", "block_", "n", "t"])

    schema = rows.select("work", "block_", F.lit(0).cast("long").alias("n"), F.expr("cast(null as binary)").alias("t")).schema
    return rows.mapInArrow(run, schema)


def clause_blocks(tokens: DataFrame, sentences: int) -> DataFrame:
    """work, block_, n_words, and a value for each sentence of the block: sent_id, n (its words), flags (bits in the order of CLAUSE_FLAGS) and before (the block's words before it).

    Tokens are shuffled once, packed.
    """
    pieces = F.collect_list(F.struct("n", "t")).alias("p")
    grouped = clause_fragments(tokens, sentences).groupBy("work", "block_").agg(pieces, F.sum("n").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn = np.cumsum(batch.column("size").to_numpy()) // STEP_TOKENS
            cut_at = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
            yield from (step(batch.slice(a, b - a)) for a, b in zip(cut_at[:-1], cut_at[1:], strict=True) if b > a)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        blocks = []
        for k, p in enumerate(batch.column("p").to_pylist()):
            for piece in p:
                x = unpacked(piece["n"], piece["t"])
                blocks.append(np.r_[np.full((1, x.shape[1]), k), x])
        x = np.concatenate(blocks, axis=1)
        block, sent, tok_i, head_i, bits = x[:, np.lexsort(x[::-1])]
        new = np.r_[True, (block[1:] != block[:-1]) | (sent[1:] != sent[:-1])]
        first, sentence = np.flatnonzero(new), np.cumsum(new) - 1
        has = [bits >> k & 1 == 1 for k in range(len(BITS))]
        _, _, _, head, within, up = walked(sentence, tok_i, head_i, np.stack(has[:3], axis=1))
        that, finite = within[:, 0], within[:, 1]
        _, _, _, word, ccomp, verb, adjective, free = has
        flags = [ccomp & (head >= 0) & verb[head] & that, adjective & that & finite, free & finite[up]]
        flags = sum(np.logical_or.reduceat(f, first).astype(np.int64) << k for k, f in enumerate(flags))
        n = np.add.reduceat(word.astype(np.int64), first)
        at = np.searchsorted(block[first], np.arange(batch.num_rows + 1))
        before = np.cumsum(n) - n
        before -= before[at[:-1]][block[first]]
        lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for v in (sent[first], n, flags, before)]
        total = np.add.reduceat(n, at[:-1])
        return pa.RecordBatch.from_arrays([batch.column("work"), batch.column("block_"), pa.array(total), *lists], ["work", "block_", "n_words", "sent_id", "n", "flags", "before"])

    lists = [F.expr("cast(null as array<bigint>)").alias(c) for c in ("sent_id", "n", "flags", "before")]
    return grouped.mapInArrow(run, grouped.select("work", "block_", F.lit(0).cast("long").alias("n_words"), *lists).schema)


def clause_features(tokens: DataFrame) -> DataFrame:
    """work, sent_id, n_words and three flags: that-clauses under verbs and adjectives, and free relatives."""
    rows = clause_blocks(tokens, SENTENCES).select("work", "block_", F.explode(F.arrays_zip("sent_id", "n", "flags")).alias("x"))
    sent_id = F.when(F.col("block_").isNotNull(), F.col("x.sent_id")).cast(tokens.schema["sent_id"].dataType)
    return rows.select("work", sent_id.alias("sent_id"), F.col("x.n").alias("n_words"), *[(F.getbit("x.flags", F.lit(k)) == 1).alias(f) for k, f in enumerate(CLAUSE_FLAGS)])


def clause_stats(tokens: DataFrame, chunk: int = 100, sentences: int = SENTENCES) -> DataFrame:
    """work, metric, value of the three features per 100 words: a sentence counts in the chunk of its first word."""
    # of each block its words, and of the sentences in which something is found the words before (in the block) and the flags
    found = F.filter(F.arrays_zip("before", "n", "flags"), lambda x: (x["flags"] > 0) & (x["n"] > 0))
    blocks = cut(clause_blocks(tokens, sentences).select("work", "block_", "n_words", F.transform(found, lambda x: (x["before"] * 8 + x["flags"])).alias("found")))
    sums = blocks.select(F.col("work").alias("k_"), F.col("block_").alias("b_"), "n_words").select("k_", "b_", F.coalesce(F.sum("n_words").over(W.partitionBy("k_").orderBy("b_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    hits = blocks.where("size(found) > 0").join(sums, F.col("work").eqNullSafe(F.col("k_")) & F.col("block_").eqNullSafe(F.col("b_"))).select("work", "base", F.explode("found").alias("x"))
    flags = [F.getbit("x", F.lit(k)).cast("int").alias(f) for k, f in enumerate(CLAUSE_FLAGS)]
    hits = hits.select("work", F.floor((F.col("base") + F.shiftright("x", 3)) / chunk).alias("chunk_id"), *flags).groupBy("work", "chunk_id").agg(*[F.sum(f).alias(f) for f in CLAUSE_FLAGS])
    # a work's chunks follow from its number of words
    sizes = blocks.groupBy(F.col("work").alias("w_")).agg(F.sum("n_words").alias("n")).where("n > 0")
    sizes = sizes.select("w_", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk))).alias("c_"))
    sizes = sizes.select("w_", "c_", F.least(F.lit(chunk), F.col("n") - F.col("c_") * chunk).alias("n_words"))
    rated = sizes.join(hits, F.col("work").eqNullSafe(F.col("w_")) & (F.col("chunk_id") == F.col("c_")), "left")
    rated = rated.select(F.col("w_").alias("work"), F.col("c_").alias("chunk_id"), "n_words", *[F.coalesce(f, F.lit(0)).alias(f) for f in CLAUSE_FLAGS])
    return chunk_stats(rated, {f"{f}_per100": F.col(f) * 100 / F.col("n_words") for f in CLAUSE_FLAGS}, {f"{f}_total": F.col(f) for f in CLAUSE_FLAGS})
