"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon (words and word beginnings with their evidence) is learned from a bounded sample
of labelled documents. A term that is in neither form is run as a Levenshtein automaton of
one edit through the trie of lexicon words, which catches misspellings; disguised spellings
(digits for letters, separators, drawn-out letters) are undone first. A spelling near a
lexicon word that the sample shows to be no more toxic than any word is not taken for one.
Each hit gets a score from its context window: other hits near it add; quotation marks that
open before it and close after it, both within the window, or a reporting word before it take
away. A small logistic model on these scores, fitted on the same sample, gives the document's
score.

Cases: a null or empty text has no hits; without toxic labels every score is the base rate;
an empty table gives no rows; rows of repeated and null ids are scored each (of a null id held_out
is null). Labels, language, source and id are never inputs of a
score, and other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.classifier import sample as labelled
from quillspark.llm.common import MEMO_WORDS, cut, steps, text_of

#: Labelled documents that the lexicon and the model are fitted on, at most (those of least hash).
MAX_LABELLED = 20_000
PREFIXES = (4, 5, 6, 7)
#: Letters that a word near a lexicon word must have, as must that; among shorter ones a neighbour is mostly another word.
LEAST_LETTERS = 4
#: States of the automaton that a worker holds before it starts anew, and words of its memo.
MAX_STATES, MEMO_RAW = 100_000, 1_000_000
#: Words on each side of a hit that are its context.
CONTEXT = 12
LEET = str.maketrans("013457@$!", "oieastasi")
DRAWN = re.compile(r"(.)\1{2,}")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[\W\d_]+")
#: Quotation marks at the edges of a word (UTF-8), and words that report another's words, by language.
QUOTES = [q.encode() for q in "\"“”„«»"]
REPORTS = frozenset(
    "said says wrote writes called calls quoted quote told tells reported stated word words term "
    "dit disait écrit appelle cité mot mots terme sagte sagt schrieb nannte zitiert wort wörter begriff "
    "dijo dice escribió llamó citó palabra palabras término".split()
)


NO_HIT = (0, 0.0, "")


def plain(word: bytes) -> str:
    """The letters of a word, lower case, disguises undone."""
    text = word.decode("utf-8", "replace").lower()
    if text.isalpha():
        return DRAWN.sub(r"\1", text)
    text = EDGE.sub("", text) if text[-1:] not in "@$!" or text[:-1].isalpha() else text
    if not text.isalpha():
        if any(c.isalpha() for c in text):
            text = INNER.sub("", text.translate(LEET))
        else:
            return ""
    return DRAWN.sub(r"\1", text)


class State(dict):
    """Letter to the next state; a state is the trie nodes that what was read can be at, with 0 or 1 edits spent."""

    def __init__(self, trie: Trie, nodes: frozenset[tuple[int, int]]) -> None:
        super().__init__()
        self.trie, self.nodes = trie, nodes
        self.term = max((trie.ends[n] for n, _ in nodes if n in trie.ends), default=(0.0, None))[1]

    def __missing__(self, letter: str) -> State:
        self[letter] = state = self.trie.state(self.trie.read(self.nodes, letter))
        return state


class Trie:
    """Lexicon words as a trie, intersected with the Levenshtein automaton of one edit.

    Both run as one automaton over the letters of the text's word; its states are made when
    they are first reached, so a word costs one look-up per letter until no term is near.
    """

    def __init__(self, words: Iterable[str], weight: Callable[[str], float] = lambda w: 0.0) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[float, str]] = {}
        for w in words:
            node = 0
            for c in w:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.ends[node] = (weight(w), w)
        self.begin()

    def begin(self) -> None:
        self.known: dict[frozenset[tuple[int, int]], State] = {}
        self.start = self.state({(0, 0)})

    def state(self, nodes: set[tuple[int, int]]) -> State:
        """The state of these nodes and of those that a left-out letter leads to."""
        whole = frozenset(nodes | {(child, 1) for n, spent in nodes if not spent for child in self.children[n].values()})
        if whole not in self.known:
            self.known[whole] = State(self, whole)
        return self.known[whole]

    def read(self, nodes: frozenset[tuple[int, int]], letter: str) -> set[tuple[int, int]]:
        out = {(self.children[n][letter], spent) for n, spent in nodes if letter in self.children[n]}
        for n, spent in nodes:
            if not spent:  # an added letter, or another one in its place
                out.add((n, 1))
                out.update((child, 1) for child in self.children[n].values())
        return out

    def near(self, word: str) -> str | None:
        """The lexicon word of most weight at most one edit away."""
        if len(self.known) > MAX_STATES:
            self.begin()
        state = self.start
        for c in word:
            state = state[c]
            if not state.nodes:
                return None
        return state.term


class Lexicon(dict):
    """Raw word to (kind, weight, term); kinds: 0 none, 1 word, 2 beginning, 3 misspelling."""

    def __init__(self, words: dict[str, float], starts: dict[str, float], banned: frozenset[str] = frozenset(), edits: bool = True) -> None:
        super().__init__()
        self.words, self.starts, self.banned = words, starts, banned
        self.trie = Trie([w for w in words if len(w) >= LEAST_LETTERS] if edits else [], words.__getitem__)
        self.heads = {w[: PREFIXES[0]] for w in starts}

    def __missing__(self, raw: bytes) -> tuple[int, float, str]:
        if len(self) > MEMO_RAW:
            self.clear()
        self[raw] = hit = self.look(plain(raw))
        return hit

    def look(self, word: str) -> tuple[int, float, str]:
        if w := self.words.get(word):
            return 1, w, word
        if word[: PREFIXES[0]] in self.heads and (best := max(self.starts.get(word[:k], 0.0) for k in PREFIXES)):
            return 2, best, word
        if len(word) >= LEAST_LETTERS and word not in self.banned and (near := self.trie.near(word)):
            return 3, self.words[near], word
        return NO_HIT


@functools.lru_cache(maxsize=2)
def lexicon_of(words: tuple[tuple[str, float], ...], starts: tuple[tuple[str, float], ...], banned: frozenset[str], edits: bool = True) -> Lexicon:
    """A worker's lexicon, kept from task to task."""
    return Lexicon(dict(words), dict(starts), banned, edits)


def within_quotes(words: list[bytes], at: int) -> bool:
    """Whether the mark nearest before the word's end opens and the one nearest after its begin closes, both within its window."""
    opens = lambda w: w.startswith(tuple(QUOTES))
    before = next((k for k in range(at, max(-1, at - CONTEXT - 1), -1) if opens(words[k]) or k < at and closes(words[k])), None)
    if before is None or before < at and closes(words[before]):
        return False
    after = next((k for k in range(at, min(len(words), at + CONTEXT + 1)) if closes(words[k]) or k > at and opens(words[k])), None)
    return after is not None and not (after > at and opens(words[after]))


def closes(word: bytes) -> bool:
    return word.rstrip(b".,;:!?)").endswith(tuple(QUOTES))


def hits(words: list[bytes], lexicon: Lexicon) -> list[tuple[int, int, float, str, bool]]:
    """(place, kind, weight, term, quoted) of each hit."""
    out = []
    for i, (kind, weight, term) in enumerate(map(lexicon.__getitem__, words)):
        if kind:
            told = any(plain(w) in REPORTS for w in words[max(0, i - 4) : i])
            out.append((i, kind, weight, term, told or within_quotes(words, i)))
    return out


def features(found: list[tuple[int, int, float, str, bool]], n_words: int) -> list[float]:
    if not found:
        return [0.0] * 7
    at = np.array([f[0] for f in found])
    value = np.array([f[2] * (0.4 if f[4] else 1.0) * (0.5 if f[1] == 3 else 1.0) for f in found])
    total = np.r_[0.0, np.cumsum(value)]
    window = total[np.searchsorted(at, at + CONTEXT, "right")] - total[np.searchsorted(at, at - CONTEXT)]
    kinds = Counter(f[1] for f in found if not f[4])
    quoted = sum(f[4] for f in found)
    return [1.0, math.log1p(kinds[1]), math.log1p(kinds[2]), math.log1p(kinds[3]), math.log1p(quoted), float(window.max()), min(5.0, 100 * len(found) / n_words)]


class Terms(dict):
    """Raw word to its terms: =word, and ^beginning of each length."""

    def __missing__(self, raw: bytes) -> tuple[str, ...]:
        if len(self) > MEMO_WORDS:
            self.clear()
        w = plain(raw)
        self[raw] = terms = ("=" + w, *["^" + w[:k] for k in PREFIXES if len(w) >= k]) if len(w) >= 3 else ()
        return terms


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text and toxic of at most `most` labelled training documents, a row for each label's id.

    Of labels of one document the highest counts, of rows of one id the text of the least hash.
    """
    return labelled(docs, labels, "toxic", most).select(F.col("label_id").alias("doc_id"), "text", F.col("label").alias("toxic"))


def learn_lexicon(train: DataFrame) -> tuple[dict[str, float], dict[str, float], int, int]:
    """Terms whose presence in toxic documents can't be chance (G test above what the best of all terms would reach by chance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, memo = (Counter(), Counter()), Terms()
        for part, texts in steps(batches):
            for t, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                seen[1 if toxic else 0].update({""}.union(*map(memo.__getitem__, set(t.split()))))
            if len(seen[0]) + len(seen[1]) > MEMO_WORDS:
                yield out(seen)
                seen = (Counter(), Counter())
        yield out(seen)

    def out(seen) -> pa.RecordBatch:
        terms = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([s.get(t, 0) for t in terms], pa.int64()) for s in reversed(seen)]], ["term", "toxic", "clean"])

    counts = train.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = cut(counts)
    base = counts.where("term = ''").first()
    n1, n0 = (base.toxic, base.clean) if base else (0, 0)
    if not n1 or not n0:
        return {}, {}, n1, n0
    share = n1 / (n1 + n0)
    least = 2 * math.log(max(2, 400 * (n1 + n0))) + 2
    g = F.expr(f"2 * (toxic * ln(toxic / ((toxic + clean) * {share!r}d)) + if(clean > 0, clean * ln(clean / ((toxic + clean) * {1 - share!r}d)), 0d))")
    # significant terms of a bounded sample are few, and all of them are the lexicon
    found = counts.where(f"term != '' and toxic >= 4 and toxic > {3 * share!r}d * (toxic + clean)").where(g >= least).collect()
    weigh = lambda r: math.log((r.toxic + 0.5) / (r.clean + 0.5)) - math.log(share / (1 - share))
    words, starts = ({r.term[1:]: weigh(r) for r in sorted(found) if r.term[0] == mark} for mark in "=^")
    return words, starts, n1, n0


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def near_misses(train: DataFrame, terms: tuple) -> frozenset[str]:
    """Spellings near a lexicon word that the sample shows in clean documents as often as chance would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen = lexicon_of(*terms, frozenset()), (Counter(), Counter())
        for part, texts in steps(batches):
            for t, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                near = {h[2] for h in map(lexicon.__getitem__, set(t.split())) if h[0] == 3}
                seen[1 if toxic else 0].update(near | {""})
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([s.get(w, 0) for w in words], pa.int64()) for s in reversed(seen)]], ["word", "toxic", "clean"])

    rows = train.select("text", "toxic").mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    n1, n0 = next(((r.toxic, r.clean) for r in rows if not r.word), (0, 0))
    return frozenset(r.word for r in rows if r.word and r.clean and (r.toxic + 0.5) * (n0 + 1) <= 3 * (r.clean + 0.5) * (n1 + 1))


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text", misspellings: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits and n_near (hits by a misspelling) of every row; scoring is one pass without a shuffle.

    Without `misspellings` no term is run through the trie, to tell what the automaton adds.
    """
    docs = text_of(docs, id_column, text_column)
    train = cut(sample(docs, labels, max_labelled))
    words, starts, n1, n0 = learn_lexicon(train)
    terms, banned = (tuple(words.items()), tuple(starts.items())), frozenset()
    n_features = len(features([], 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(*terms, banned, misspellings)
        for part, texts in steps(batches):
            x = [features(hits(w, lexicon), len(w)) for t in texts for w in (t.split(),)]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    if words or starts:
        banned = near_misses(train, terms) if misspellings else banned
        rows = train.select("text", "toxic").mapInArrow(measure, "toxic int, x array<double>").collect()  # a row of a few numbers for each of at most max_labelled ids
        w = fit(np.array([r.x for r in rows]), np.array([float(r.toxic > 0) for r in rows]))
    else:
        w = np.r_[math.log((n1 + 0.5) / (n0 + 0.5)), np.zeros(n_features)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(*terms, banned, misspellings)
        for part, texts in steps(batches):
            found = [(hits(own := t.split(), lexicon), len(own)) for t in texts]
            z = np.array([features(*f) for f in found]) @ w[1:] + w[0]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            counts = [pa.array([sum(h[1] in kinds for h in f) for f, _ in found], pa.int64()) for kinds in ((1, 2, 3), (3,))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *counts], ["doc_id", "score", "predicted", "n_hits", "n_near"])

    scored = docs.mapInArrow(score, "doc_id long, score double, predicted int, n_hits long, n_near long")
    return scored.select("doc_id", F.expr("crc32(cast(doc_id as string)) % 5 = 0").alias("held_out"), "score", "predicted", "n_hits", "n_near")
