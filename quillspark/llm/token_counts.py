"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are held as one ragged numpy array of symbols. In each round
every sequence looks up the ranks of its adjacent pairs, applies its own lowest-rank pair at
all its places at once, and leaves when no pair of it can merge; the surviving symbols are
the tokens. A worker memoises counts by pre-token, so a common word is merged once.

Cases: a null or empty text has no tokens; a text of one endless pre-token is one long
sequence; strings of added special tokens inside a text are one token each, which is the
default of the library that the vocabulary file is for. Columns of the input other than the
id and the text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillspark.llm.common import MEMO_WORDS, kept, segment_sums, steps, text_of

#: White_Space of Unicode, as the vocabulary's library reads \s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the byte-level pre-tokenizer's published pattern.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NONE = np.int64(1 << 40)


def byte_alphabet() -> list[str]:
    """The published byte-to-character rule of byte-level vocabularies: printable Latin-1 stays, the rest moves past U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(moved)) for b in range(256)]


class RankMerger:
    """A byte-level BPE vocabulary as sorted arrays."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.first = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int64)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.last = np.array([vocab[c + suffix] for c in byte_alphabet()], dtype=np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        # a hash table in front of the sorted keys: a pair whose slot two keys claim is searched for
        slots = self.slot(self.keys)
        self.table, self.crowded = np.full(1 << 18, -1, dtype=np.int64), np.zeros(1 << 18, dtype=bool)
        self.table[slots] = np.arange(len(slots))
        self.crowded[np.flatnonzero(np.bincount(slots, minlength=1 << 18) > 1)] = True
        self.keys, self.ranks = np.r_[self.keys, -1], np.r_[self.ranks, NONE]
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.memo: dict[str, int] = {}

    @staticmethod
    def slot(pair: np.ndarray) -> np.ndarray:
        return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).view(np.int64)

    def rank_of(self, pair: np.ndarray) -> np.ndarray:
        slot = self.slot(pair)
        at = self.table[slot]
        if (odd := np.flatnonzero(self.crowded[slot])).size:
            at[odd] = np.searchsorted(self.keys[:-1], pair[odd]) % len(self.keys)
        return np.where(self.keys[at] == pair, self.ranks[at], NONE)

    def merge(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in one array, and how many each has; pre-tokens aren't empty."""
        sizes = np.fromiter(map(len, pretokens), dtype=np.int64, count=len(pretokens))
        raw = np.frombuffer(b"".join(pretokens), dtype=np.uint8)
        symbols, ends = self.first[raw], np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(pretokens)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), NONE)
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.rank_of(symbols[:-1] << 32 | symbols[1:]), NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            mine = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbols)]))
            over = mine == NONE  # sequences that merge no more leave
            done.append((owner[over], symbols[over]))
            # of places that overlap (equal symbols in a row), every second counts from the left
            place = np.flatnonzero((rank == mine) & ~over)
            fresh = np.r_[True, np.diff(place) != 1][: len(place)]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run) % 2 == 0]
            symbols[place] = self.made[rank[place]]
            over[place + 1] = True
            symbols, owner = symbols[~over], owner[~over]
        owner = np.concatenate([np.zeros(0, dtype=np.int64), *[x for x, _ in done]])
        return np.concatenate([symbols, *[x for _, x in done]])[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pretokens))

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special strings it holds."""
        if self.split_special is None or "<" not in text or not (n := len(self.split_special.findall(text))):
            return self.find(text), 0
        return [p for part in self.split_special.split(text) for p in self.find(part)], n

    def counts(self, texts: list[bytes]) -> np.ndarray:
        tokens: list[str] = []
        bounds, special = np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            found, special[i] = self.pretokens(t.decode("utf-8", "replace"))
            tokens += found
            bounds[i + 1] = len(tokens)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        if new := list(set(tokens) - self.memo.keys()):
            self.memo.update(zip(new, self.merge([x.encode() for x in new])[1].tolist(), strict=True))
        return segment_sums(np.fromiter(map(self.memo.__getitem__, tokens), dtype=np.int64, count=len(tokens)), bounds) + special


def merger(vocabulary: str) -> RankMerger:
    return kept(("token_counts", vocabulary), lambda: RankMerger(vocabulary))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for part, texts in steps(batches):
            n = m.counts(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return text_of(docs, id_column, text_column).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
