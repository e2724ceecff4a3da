"""Stylometric features of works: rates per 100 words in 100-word chunks.

Token features are summed in the chunk of the token; sentence features are aggregated per
sentence and counted in the chunk of the sentence's first word; dialogue spans in the chunk of
the first word at or after their begin. Per work each feature gets mean, least, greatest and
population deviation over its chunks (unweighted, last chunk kept unless asked otherwise).

Texts travel to workers in batches of bounded size, are annotated there and come back as a row of
counts for each chunk; rates, statistics and totals are Spark's. A long work is cut into parts at sentences; the words
of the parts are counted first, and from sums over the parts each knows its words' numbers, so that any tasks can take them.
A parser's token table takes the same way, in parts of some hundred sentences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import lexicons as L
from quillspark.operators import spans
from quillspark.operators.annotate import DEPS, FIN, INF, PART, PAST, POS, PRES, TOKEN, D, P, Parsed, Tokens, Words
from quillspark.operators.statistics import chunk_stats
from quillspark.sources.shared import cut

CHUNK = 100
#: Bytes of text annotated at a time; a longer work is a step of its own. A worker's arrays take some hundred times that.
STEP_BYTES = 1 << 18
BOUND = r"[^\p{L}\p{N}_]"
SPACES = "\t\n\x0b\x0c\r "


class Phrases:
    """A class of phrases, found in a text in any case between word bounds."""

    def __init__(self, pattern: str, hints: list[str] | None = None) -> None:
        inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
        self.hints = hints or [regex.match("[a-z' ]+", x)[0] for x in inner.removeprefix("(?:").removesuffix(")").split("|")]
        self.search = regex.compile(rf"(?:^|{BOUND}){inner}(?:$|{BOUND})", regex.I).search

    def each(self, texts: list[str], low: str, begins: np.ndarray) -> np.ndarray:
        """For each text whether the phrase is in it; low is all of them in lower case, one after the other, a mark between."""
        out, hinted = np.zeros(len(texts), dtype=bool), set()
        for hint in self.hints:
            at = low.find(hint)
            while at >= 0:
                k = int(np.searchsorted(begins, at, "right")) - 1
                hinted.add(k)
                at = low.find(hint, int(begins[k + 1])) if k + 1 < len(begins) else -1
        for k in hinted:
            out[k] = self.search(texts[k]) is not None
        return out


def opening(words: list[str]):
    found = regex.compile(rf"[{SPACES}]*(?:{'|'.join(words)})(?:$|{BOUND})", regex.I).match
    return lambda text, low: found(text) is not None


def contains(hint: str, pattern: str):
    found = regex.compile(pattern, regex.I).search
    return lambda text, low: hint in low and found(text) is not None


#: Tests of a sentence's text, given as it is and in lower case.
TEXT_TESTS = {
    **{name: Phrases(pattern) for name, pattern in L.PHRASES.items()},
    "question": lambda text, low: text.rstrip(SPACES).endswith("?"),
    "question words": Phrases("(?:what kind of|how (?:many|much|long|often|far))", ["what k", "how "]),
    "no one": lambda text, low: "no one" in low,
    "which": contains("which", rf",[{SPACES}]*which(?:$|{BOUND})"),
    "particle": opening(["well", "so", "anyway", "now"]),
    "clause start": opening(L.CLAUSE_STARTS),
    "going to": contains(" going to ", rf"(?:^|{BOUND})(?:am|is|are|was|were|be|been|being) going to \p{{L}}"),
    "look like": contains(" like", rf"(?:^|{BOUND})look(?:s|ed|ing)? like(?:$|{BOUND})"),
    "quoted": lambda text, low: not L.QUOTE_CHARS.isdisjoint(text),
}


class Sentences:
    """Aggregates of tokens over sentences, and tests of the sentences' texts."""

    def __init__(self, t: Tokens) -> None:
        self.t = t
        self.n = int(t.sent[-1]) + 1 if t.n else 0
        self.first = np.flatnonzero(np.r_[True, t.sent[1:] != t.sent[:-1]][: t.n])
        self.doc = t.doc[self.first]
        last = np.r_[self.first[1:], t.n][: self.n] - 1
        begins, ends = t.idx[self.first], t.idx[last] + t.length[last]
        self.texts = [t.texts[d][a:b] for d, a, b in zip(self.doc.tolist(), begins.tolist(), ends.tolist(), strict=True)]
        self.low = [x.lower() for x in self.texts]
        # the mark between is in no hint
        self.all_low = "\0".join(self.low)
        sizes = np.fromiter(map(len, self.low), dtype=np.int64, count=self.n) + 1
        self.begins = np.cumsum(sizes) - sizes

    def count(self, test: np.ndarray) -> np.ndarray:
        return np.bincount(self.t.sent[test], minlength=self.n)

    def any(self, test: np.ndarray) -> np.ndarray:
        return self.count(test) > 0

    def says(self, name: str) -> np.ndarray:
        test = TEXT_TESTS[name]
        if isinstance(test, Phrases):
            return test.each(self.texts, self.all_low, self.begins)
        return np.fromiter(map(test, self.texts, self.low), dtype=bool, count=self.n)


def then(t: Tokens, rows: np.ndarray, group: np.ndarray, skip: np.ndarray, wanted: np.ndarray, most: int) -> np.ndarray:
    """Whether the first of the next `most` rows of a group that isn't skipped is wanted."""
    out, open_ = np.zeros(t.n, dtype=bool), np.ones(len(rows), dtype=bool)
    for k in range(1, min(most, len(rows) - 1) + 1):
        here = np.flatnonzero(open_[:-k] & (group[:-k] == group[k:]) & ~skip[rows[k:]])
        out[rows[here]] = wanted[rows[here + k]]
        open_[here] = False
    return out


def token_tests(t: Tokens, which: str) -> dict[str, np.ndarray]:
    """Feature to a test on a token; its number per 100 words of the chunk is the value."""
    isin = lambda x, names: np.isin(x, [P[n] for n in names])
    if which == "tokens2":
        death, sex = t.has(L.DEATH), t.has(L.SEX)
        return {
            "words_different_from_lemma_per100": t.lemma != t.lower,
            "verbs_per100": t.pos == P["VERB"],
            "nouns_per100": t.pos == P["NOUN"],
            "propn_per100": t.pos == P["PROPN"],
            "death_words_per100": death,
            "sex_words_per100": sex & ~death,
            "total_flagged_words_per100": death | sex,
        }
    words = np.flatnonzero(t.w[1])
    skip = isin(t.pos, L.PERFECT_SKIP_POS) | t.has(sql_form(L.PERFECT_SKIP)) | t.not_end
    perfect = then(t, words, t.doc[words] << 32 | t.ix[1][words] // CHUNK, skip, t.form == PART, 3)
    groups = {"1p": L.FIRST_PERSON, "2p": L.SECOND_PERSON, "3p": L.THIRD_PERSON, "demonstrative": L.DEMONSTRATIVES, "indefinite": L.INDEFINITES}
    every = [w for g in groups.values() for w in g]
    key = np.where(t.has(every), t.lemma, t.lower)
    ends = t.words.each("nominal", lambda s: s.endswith(tuple(L.NOMINAL_SUFFIXES))) > 0
    ing = t.words.each("ing", lambda s: s.endswith("ing"))[t.lemma] > 0
    return {
        "past_per100": t.tense == PAST,
        "present_per100": t.tense == PRES,
        "perfect_per100": (t.pos == P["AUX"]) & t.has(["have"]) & (t.form == FIN) & perfect,
        "place_adverbials_per100": (t.pos == P["ADV"]) & t.has(L.PLACE_ADVERBS),
        "time_adverbials_per100": (t.pos == P["ADV"]) & t.has(L.TIME_ADVERBS),
        "pronouns_total_per100": t.words.member(every)[key],
        **{f"pronouns_{k}_per100": t.words.member(g)[key] for k, g in groups.items()},
        "nominal_suffix_per100": (t.pos == P["NOUN"]) & ends[t.lemma],
        "gerund_nominals_ing_per100": (t.pos == P["NOUN"]) & (t.ing | ing),
        "total_pps_per100": (t.pos == P["ADP"]) & (t.dep == D["prep"]),
        "attributive_adjs_per100": (t.pos == P["ADJ"]) & (t.dep == D["amod"]) & isin(t.head_pos, ["NOUN", "PROPN"]),
        "predicative_adjs_per100": (t.pos == P["ADJ"]) & ((t.dep == D["acomp"]) | t.cop_child),
        "total_adverbs_per100": t.pos == P["ADV"],
    }


def sql_form(words: list[str]) -> list[str]:
    """Lexicon words with the apostrophe that texts are compared with."""
    return [w.replace("'", "’") for w in words]


def in_speech(t: Tokens) -> np.ndarray:
    """Tokens that begin within quoted or dash-led speech."""
    if isinstance(t, Parsed):
        return t.quoted
    inside = np.zeros(t.n, dtype=bool)
    for d, text in enumerate(t.texts):
        a, b = int(t.first[d]), int(t.first[d + 1]) if d + 1 < len(t.texts) else t.n
        for begin, end in t.speech[d] if t.speech is not None else spans.merged(spans.quotes_in(text)):
            inside[a + np.searchsorted(t.idx[a:b], begin) : a + np.searchsorted(t.idx[a:b], end)] = True
    return inside


def sentence_counts(t: Tokens, which: str) -> dict[str, np.ndarray]:
    """Feature to its number in each sentence."""
    s = Sentences(t)
    isin = lambda x, names: np.isin(x, [P[n] for n in names])
    finite = t.verb & (t.form == FIN)
    if which == "sentences3":
        alpha, quoted = s.any(t.w[3]), s.says("quoted")
        return {
            "no_verb_fragments_per100": alpha & ~s.any(t.verb),
            "no_finite_fragments_per100": alpha & ~s.any(finite),
            "indirect_speech_per100": ~quoted & s.any(t.verb & t.has(L.SPEECH_VERBS)),
        }
    if which == "narration":
        inside = in_speech(t)
        return {"first_person_narration_per100": s.count(isin(t.pos, ["PRON", "DET"]) & t.has(L.NARRATOR) & ~inside)}
    seen, group = t.seen, t.sent[t.seen]
    skip = isin(t.pos, L.PASSIVE_SKIP_POS) | t.has(sql_form(L.NEGATIONS)) | t.not_end
    participle = then(t, seen, group, skip, (t.form == PART) | t.vbn, 4)
    near = lambda x, ks: np.logical_or.reduce([t.nearby(x, k, False) for k in ks])
    infinitive = t.verb & (t.form == INF)
    inf_right, comma_right = near(infinitive, range(1, 7)), near(t.comma, range(1, 6))
    nth = np.zeros(t.n, dtype=np.int64)
    nth[seen] = np.arange(len(seen)) - np.searchsorted(group, group) + 1 if len(seen) else 0
    words = np.flatnonzero(t.w[1])
    leads = np.zeros(t.n, dtype=bool)
    leads[words[np.r_[True, t.sent[words][1:] != t.sent[words][:-1]][: len(words)]]] = True
    passive = s.any((t.pos == P["AUX"]) & t.has(["be", "get"]) & participle)
    by = s.any((t.pos == P["ADP"]) & t.has(["by"]))
    be, there = s.any(t.has(["be"])), s.any(t.has(["there"]))
    analytic = s.any((t.dep == D["neg"]) | t.has_lower(["not", "n’t"]) | t.not_end)
    synthetic = s.any(t.has_lower(["nobody", "nothing", "none", "nowhere", "neither", "without"])) | s.says("no one")
    clause = np.isin(t.dep, [D["advcl"], D["acl"]]) | (nth <= 3) & comma_right
    part = lambda ing: s.any((t.form == PART) & (t.ing == ing) & clause & ~t.space)
    adverb = t.pos == P["ADV"]
    classed = lambda lemmas, name, more: s.count(t.has(lemmas) & more) + s.says(name)
    modal = lambda lemmas: s.any(t.verb & t.has(lemmas) & inf_right)
    amplifies = adverb & ~(t.has(["so"]) & leads) & ((t.dep == D["advmod"]) | isin(t.head_pos, ["ADJ", "ADV", "VERB"]))
    return {
        "direct_wh_questions_per100": s.says("question") & (s.any(t.has_lower(L.WH_WORDS)) | s.says("question words")),
        "by_passives_per100": passive & by,
        "agentless_passives_per100": passive & ~by,
        "copular_per100": s.any(t.has(["be"]) & (t.dep == D["cop"])) | be & ~there,
        "existential_per100": there & be,
        "infinitive_per100": s.any(t.form == INF),
        "present_participial_per100": part(True),
        "past_participial_per100": part(False),
        "rel_sentence_per100": s.says("which"),
        **{f"{k}_subord_per100": s.says(k) for k in ("causal", "concessive", "conditional", "other")},
        "conjuncts_per100": classed(L.CONJUNCTS, "conjuncts", isin(t.pos, ["ADV", "SCONJ", "CCONJ"])),
        "downtoners_per100": classed(L.DOWNTONERS, "downtoners", adverb | t.has(["rather"]) & np.isin(t.dep, [D["advmod"], D["mod"]])),
        "hedges_per100": classed(L.HEDGES, "hedges", adverb | t.has(["about", "around"]) & (t.pos == P["ADP"])),
        "amplifiers_per100": classed(L.AMPLIFIERS, "amplifiers", amplifies),
        "emphatics_per100": classed(L.EMPHATICS, "emphatics", adverb),
        "discourse_particles_per100": s.says("particle") | s.any(leads & t.has(L.DISCOURSE)),
        "demonstrative_dets_per100": s.count((t.pos == P["DET"]) & t.has(L.DEMONSTRATIVES)),
        "demonstrative_prons_per100": s.count((t.pos == P["PRON"]) & t.has(L.DEMONSTRATIVES)),
        "possibility_per100": modal(L.POSSIBILITY),
        "necessity_per100": modal(L.NECESSITY) | modal(L.NECESSITY_MORE) & s.any(t.has_lower(["to"]) & t.nearby(infinitive, 1, False)),
        "predictive_per100": modal(L.PREDICTION) | s.says("going to"),
        "public_reporting_per100": s.count(t.verb & t.has(L.PUBLIC_VERBS)),
        "private_cognition_per100": s.count(t.verb & t.has(L.PRIVATE_VERBS)),
        "suasive_directive_per100": s.count(t.verb & t.has(L.SUASIVE_VERBS)),
        "seem_appear_per100": s.count(t.verb & t.has(L.SEEM_VERBS)) + s.says("look like"),
        "phrasal_coord_per100": s.count((t.dep == D["conj"]) & (t.pos == t.head_pos) & isin(t.pos, ["ADJ", "ADV", "NOUN", "VERB"])),
        "clause_coord_per100": (s.says("clause start") | s.any(leads & t.has_lower(L.CLAUSE_STARTS))) & s.any(~t.space & (nth <= 7) & finite),
        "analytic_negation_per100": analytic,
        "synthetic_negation_per100": ~analytic & synthetic,
    }


class Chunks:
    """The chunks of a word definition that a work or part has words in (or the first word after it), and where its tokens belong."""

    def __init__(self, t: Tokens, word: int) -> None:
        self.t, self.word, self.index = t, t.w[word] & t.own, t.ix[word]
        docs = len(t.first)
        base, self.total_of_doc = t.base[:, word - 1], t.total[:, word - 1]
        self.base = base
        self.end = base + t.counts[:, word - 1]
        self.low = base // CHUNK
        last = np.minimum(self.end, self.total_of_doc - 1)
        self.of_doc = np.where(self.total_of_doc > base, last // CHUNK - self.low + 1, 0)
        self.slot = np.cumsum(self.of_doc) - self.of_doc
        self.n = int(self.of_doc.sum())
        self.doc = np.repeat(np.arange(docs), self.of_doc)
        self.id = np.arange(self.n) - self.slot[self.doc] + self.low[self.doc]
        self.at = self.place(t.doc, self.index)
        self.n_words = self.count(np.ones(t.n, dtype=bool))

    def place(self, doc: np.ndarray, ix: np.ndarray) -> np.ndarray:
        """Chunk of the word number of a work, -1 if it has none."""
        own = ix // CHUNK - self.low[doc]
        return np.where((ix >= 0) & (own >= 0) & (own < self.of_doc[doc]), self.slot[doc] + own, -1)

    def count(self, test: np.ndarray) -> np.ndarray:
        at = self.at[self.word & test]
        return np.bincount(at[at >= 0], minlength=self.n)

    def total(self, x: np.ndarray) -> np.ndarray:
        ok = self.word & (self.at >= 0)
        return np.bincount(self.at[ok], weights=x[ok], minlength=self.n).astype(np.int64)

    def distinct(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values in each chunk, and those that occur once."""
        ok = self.word & (self.at >= 0)
        keys, n = np.unique(self.at[ok].astype(np.int64) << 32 | x[ok], return_counts=True)
        return np.bincount(keys >> 32, minlength=self.n), np.bincount((keys >> 32)[n == 1], minlength=self.n)


WORD = {"tokens1": 1, "sentences1": 1, "tokens2": 2, "narration": 2, "readability": 2, "richness": 2, "sentences3": 3, "dialogue": 3}
FAMILIES = tuple(WORD)
#: Counts of a chunk's different values can't be added up: a chunk that goes over the end of a part brings its words along instead.
DISTINCT = {"richness": {"ttr_word": "lower", "ttr_lemma": "lemma"}, "readability": {"once": "lemma"}}


def counted(t: Tokens, which: str) -> tuple[Chunks, dict[str, np.ndarray], np.ndarray]:
    """Chunks of a family, its counts in each chunk, and (dialogue) what belongs to no chunk by work or part."""
    c = Chunks(t, WORD[which])
    nowhere = np.zeros(len(t.first), dtype=np.int64)
    if which == "richness":
        return c, {"ttr_word": c.distinct(t.lower)[0], "ttr_lemma": c.distinct(t.lemma)[0]}, nowhere
    if which == "readability":
        inside = c.word & (c.at >= 0)
        sent = np.unique(c.at[inside].astype(np.int64) << 32 | t.sent[inside])
        # marks lie between a word and the next of the same chunk
        inner = t.own & t.punct & (c.index >= 0) & (c.index < c.total_of_doc[t.doc] - 1) & ((c.index + 1) // CHUNK == c.index // CHUNK)
        at = c.place(t.doc, c.index)[inner]
        return c, {
            "sentences": np.bincount(sent >> 32, minlength=c.n),
            "letters": c.total(t.letters),
            "syllables": c.total(t.syllables),
            "marks": np.bincount(at[at >= 0], minlength=c.n),
            "once": c.distinct(t.lemma)[1],
            "content": c.count(np.isin(t.pos, [P[n] for n in L.CONTENT_POS])),
        }, nowhere
    if which == "dialogue":
        hits = np.zeros(c.n, dtype=np.int64)
        for d, text in enumerate(t.texts):
            begins = t.begins[d] if t.begins is not None else [begin for begin, _ in spans.dialogue_in(text)]
            a, b = int(t.first[d]), int(t.first[d + 1]) if d + 1 < len(t.texts) else t.n
            own = t.idx[a:b][c.word[a:b]]
            ix = c.end[d] - len(own) + np.searchsorted(own, begins)  # the number of the first word at or after
            at = c.place(np.full(len(ix), d), ix)
            at = at[ix < c.total_of_doc[d]]
            np.add.at(hits, at, 1)
            nowhere[d] = len(begins) - len(at)
        return c, {"dialogue_per100": hits}, nowhere
    if which.startswith("tokens"):
        return c, {name: c.count(test) for name, test in token_tests(t, which).items()}, nowhere
    place = np.full(int(t.sent[-1]) + 1 if t.n else 0, -1)
    words = np.flatnonzero(c.word)[::-1]
    place[t.sent[words]] = c.at[words]  # the first word of a sentence is written last
    return c, {name: np.bincount(place[place >= 0], weights=x[place >= 0], minlength=c.n).astype(np.int64) for name, x in sentence_counts(t, which).items()}, nowhere


def count_names(which: str) -> list[str]:
    return list(counted(Tokens([], Words()), which)[1])


def rows_of(t: Tokens, which: str, parts: bool) -> list[pa.Array]:
    """place (the work or part), chunk_id, n_words, counts, and where parts are asked for the words of chunks that go over their ends.

    Every work or part has a row of no chunk too.
    """
    c, counts, nowhere = counted(t, which)
    docs, lists = len(t.first), []
    table = np.zeros((c.n + docs, len(counts)), dtype=np.int64)
    table[: c.n] = np.stack(list(counts.values()), axis=1) if c.n else table[:0]
    if which == "dialogue":
        table[c.n :, 0] = nowhere
    if parts:
        # chunks that have words of another part too
        edge = (c.id * CHUNK < c.base[c.doc]) | ((c.id + 1) * CHUNK > c.end[c.doc]) & (c.end < c.total_of_doc)[c.doc]
        names = np.array(list(t.words.strings) if DISTINCT.get(which) else [], dtype=object)
        for k, name in enumerate(counts):
            if source := DISTINCT.get(which, {}).get(name):
                table[: c.n, k][edge] = 0
                rows = np.flatnonzero(c.word & (c.at >= 0))
                rows = rows[edge[c.at[rows]]]
                ends = np.cumsum(np.bincount(c.at[rows], minlength=c.n + docs))
                values = names[(t.lower if source == "lower" else t.lemma)[rows]] if len(rows) else []
                lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values, pa.string())))
    chunk = np.r_[c.id, np.zeros(docs, dtype=np.int64)]
    at = np.arange(0, table.size + 1, max(1, len(counts)), dtype=np.int32)
    return [
        pa.array(np.r_[c.doc, np.arange(docs)]),
        pa.array(chunk, pa.int64(), mask=np.arange(len(chunk)) >= c.n),
        pa.array(np.r_[c.n_words, np.zeros(docs, dtype=np.int64)], pa.int64()),
        pa.ListArray.from_arrays(pa.array(at), pa.array(table.reshape(-1))),
        *lists,
    ]


#: Characters of a work that are annotated in one part; longer works are cut at sentences into parts that any tasks take.
SEGMENT = 1 << 18
#: The first word of a sentence: what follows an end mark and anything that is no word.
SENTENCE = regex.compile(rf"[.!?…][^\p{{L}}\p{{N}}{regex.escape(''.join(sorted(L.SYMBOLS)))}]*")
#: Words that are looked at beyond the end of a part.
AHEAD = 3


def cuts(text: str, size: int) -> list[int]:
    """Where parts of about `size` characters begin: each at a sentence's first word."""
    out, at = [0], 0
    while at + size < len(text) and (found := SENTENCE.search(text, at + size)) and found.end() < len(text):
        at = found.end()
        out.append(at)
    return out


def segments(works: DataFrame, size: int) -> DataFrame:
    """work, seg, text, own, speech and begins: the parts of long works, with some words more than their own, and the work's spans in each part's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for k, text in enumerate(x.as_py() for x in batch.column("text")):  # one at a time
                begins = cuts(text, size)
                ends = [*begins[1:], len(text)]
                quotes = np.array(spans.merged(spans.quotes_in(text)), dtype=np.int64).reshape(-1, 2)
                speech = np.sort(np.array([begin for begin, _ in spans.dialogue_in(text)], dtype=np.int64))
                for seg, (a, b) in enumerate(zip(begins, ends, strict=True)):
                    beyond, left = b, AHEAD
                    for found in TOKEN.finditer(text, b):
                        beyond = found.end()
                        if not (row := words.describe(found[0]))[4] and not row[5]:  # neither space nor mark
                            left -= 1
                        if not left:
                            break
                    own = quotes[np.searchsorted(quotes[:, 1], a, "right") : np.searchsorted(quotes[:, 0], b)].clip(a, b) - a
                    starts = speech[np.searchsorted(speech, a) : np.searchsorted(speech, b)] - a
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("work").slice(k, 1), pa.array([seg], pa.int32()), pa.array([text[a:beyond]]), pa.array([b - a], pa.int32()), pa.array([own.reshape(-1).tolist()], pa.list_(pa.int32())), pa.array([starts.tolist()], pa.list_(pa.int32()))],
                        ["work", "seg", "text", "own", "speech", "begins"],
                    )

    empty = "cast(null as array<int>)"
    schema = works.select("work", F.lit(0).alias("seg"), "text", F.lit(0).alias("own"), F.expr(empty).alias("speech"), F.expr(empty).alias("begins")).schema
    return works.mapInArrow(run, schema)


def with_bases(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """parts (work, seg and more) with base and total: sums of counts (work, seg, n: four numbers) over the parts before, and over the whole work."""
    by_work = W.partitionBy("work")
    before = by_work.orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    each = lambda over: F.array(*[F.coalesce(F.sum(F.col("n")[k]).over(over), F.lit(0)) for k in range(4)])
    sums = counts.select(F.col("work").alias("w_"), F.col("seg").alias("s_"), each(before).alias("base"), each(by_work).alias("total"))
    return parts.join(sums, F.col("work").eqNullSafe(F.col("w_")) & (F.col("seg") == F.col("s_"))).drop("w_", "s_")


def four(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, 4)


def part_tokens(batch: pa.RecordBatch, words: Words) -> Tokens:
    """The tokens of a batch of whole works (work, text), or of parts as segments() and with_bases() give them."""
    texts = [x or "" for x in batch.column("text").to_pylist()]
    if "own" not in batch.schema.names:
        return Tokens(texts, words)
    numbered = "base" in batch.schema.names
    t = Tokens(texts, words, batch.column("own").to_numpy(), four(batch.column("base")) if numbered else None, four(batch.column("total")) if numbered else None)
    t.speech = [np.array(x).reshape(-1, 2).tolist() for x in batch.column("speech").to_pylist()]
    t.begins = batch.column("begins").to_pylist()
    return t


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        a = 0
        while a < batch.num_rows:  # as many works as fit, one at least
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + STEP_BYTES, "right")))
            yield batch.slice(a, b - a)
            a = b


def chunk_rows(rows: DataFrame, families: list[str], tokens_of: Callable[[pa.RecordBatch, Words], Tokens], in_steps: Callable, parts: bool) -> DataFrame:
    """family, work, chunk_id, n_words, counts (and, of parts, two lists of words) of annotated batches."""
    lists = ["words", "words2"] if parts else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in in_steps(batches):
            t = tokens_of(part, words)
            for which in families:
                place, *columns = rows_of(t, which, parts)
                n = len(place)
                columns += [pa.nulls(n, pa.list_(pa.string()))] * (3 + len(lists) - len(columns))
                yield pa.RecordBatch.from_arrays([pa.array([which], pa.string()).take(pa.array(np.zeros(n, dtype=np.int32))), part.column("work").take(place), *columns], ["family", "work", "chunk_id", "n_words", "counts", *lists])

    texts = [F.expr("cast(null as array<string>)").alias(x) for x in lists]
    schema = rows.select(F.lit("").alias("family"), "work", F.lit(None).cast("long").alias("chunk_id"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(null as array<bigint>)").alias("counts"), *texts).schema
    return rows.mapInArrow(run, schema)


def added_up(rows: DataFrame, families: list[str]) -> DataFrame:
    """Chunks of parts as chunks of works: counts add up, words that chunks at the ends of parts brought along are counted together.

    Most chunks lie in one part and stay as they are.
    """
    lists = ["words", "words2"] if DISTINCT.keys() & set(families) else []
    rows = rows.groupBy("family", "work", "chunk_id").agg(F.collect_list(F.struct("n_words", "counts", *lists)).alias("p"))
    counts = "if(size(p) = 1, p[0].counts, aggregate(p, array_repeat(0L, size(p[0].counts)), (a, x) -> zip_with(a, x.counts, (y, z) -> y + z)))"
    if lists:
        words, words2 = (f"flatten(filter(p.{x}, w -> w is not null))" for x in lists)
        once = count_names("readability").index("once")
        rows = rows.withColumns({"words": F.expr(words), "words2": F.expr(words2)})
        lone = "size(filter(array_distinct(words), x -> size(filter(words, y -> y = x)) = 1))"
        more = "case when family = 'richness' and k = 0 then size(array_distinct(words)) when family = 'richness' and k = 1 then size(array_distinct(words2))"
        counts = f"transform({counts}, (c, k) -> c + {more} when family = 'readability' and k = {once} then {lone} else 0 end)"
    n_words = F.expr("aggregate(p, 0L, (a, x) -> a + x.n_words)").alias("n_words")
    return rows.select("family", "work", "chunk_id", n_words, F.expr(counts).alias("counts"))


def count_words(parts: DataFrame) -> DataFrame:
    """work, seg and n: the words of each part by the four definitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in steps(batches):
            n = part_tokens(part, words).counts
            yield pa.RecordBatch.from_arrays([part.column("work"), part.column("seg"), pa.ListArray.from_arrays(pa.array(np.arange(0, n.size + 1, 4, dtype=np.int32)), pa.array(n.reshape(-1).astype(np.int64)))], ["work", "seg", "n"])

    return parts.mapInArrow(run, parts.select("work", "seg", F.expr("cast(null as array<bigint>)").alias("n")).schema)


def family_stats(rows: DataFrame, which: str, keep_tail: bool) -> DataFrame:
    """work, metric, value of a family's chunks: rates, their statistics and totals, all in Spark."""
    names = count_names(which)
    count = lambda name: F.get("counts", F.lit(names.index(name)))
    n = F.col("n_words")
    in_chunk = lambda x: F.when(F.col("chunk_id").isNotNull(), x)
    if which == "readability":
        sentences, rest = F.greatest(count("sentences"), F.lit(1)), n - count("content")
        features = {
            "words_per_sentence": n / sentences,
            "syllables_per_sentence": count("syllables") / sentences,
            "letters_per_word": count("letters") / n,
            "syllables_per_word": count("syllables") / n,
            "punctuation_per100": count("marks") * 100.0 / n,
            "hapax_lemma_per100": count("once") * 100.0 / n,
            "content_to_function_ratio": F.when(rest > 0, count("content") / rest).when(count("content") > 0, 9999.0).otherwise(0.0),
        }
        totals = {"punctuation_total": count("marks"), "hapax_lemma_total": count("once"), "content_total": count("content"), "function_total": rest, "sentence_total_used": count("sentences")}
    else:
        features = {name: count(name) * 100.0 / n for name in names}
        totals = {} if which == "richness" else {name.removesuffix("_per100") + "_total": count(name) for name in names}
    if not keep_tail:
        rows = rows.where(f"chunk_id is null or n_words = {CHUNK}")
    return chunk_stats(rows, {name: in_chunk(x) for name, x in features.items()}, totals, {"chunk_size_words": CHUNK})


def works_rows(works: DataFrame, families: list[str], size: int = SEGMENT) -> DataFrame:
    """family, work, chunk_id, n_words, counts of works (work, text): works of up to `size` characters as they come, longer ones in parts."""
    cols = works.select("work", F.col("text").cast("string").alias("text"))
    short = chunk_rows(cols.where(f"text is null or octet_length(text) <= {size}"), families, part_tokens, steps, False)
    long_works = cols.where(f"octet_length(text) > {size}")
    if long_works.isEmpty():
        return short
    parts = cut(segments(long_works, size))
    numbered = with_bases(parts, count_words(parts))
    long_ = added_up(chunk_rows(numbered, families, part_tokens, steps, True), families)
    return short.unionByName(long_)


def family(works: DataFrame, which: str, keep_tail: bool = True, size: int = SEGMENT) -> DataFrame:
    """work, metric, value of one family of works (work, text). A null text has no words; works have names of their own."""
    return family_stats(works_rows(works, [which], size), which, keep_tail)


def stats(works: DataFrame, families: tuple[str, ...] | list[str] = FAMILIES, keep_tail: bool = True, size: int = SEGMENT) -> DataFrame:
    """family, work, metric, value of several families; the works are annotated once."""
    rows = cut(works_rows(works, list(families), size))
    each = [family_stats(rows.where(F.col("family") == which), which, keep_tail).select(F.lit(which).alias("family"), "*") for which in families]
    return reduce(DataFrame.unionByName, each)


ZSTD = pa.Codec("zstd", 1)
#: Sentences of one part of a parsed work.
SENTENCES = 500
#: What a parser's token table has, and what stands for a column that is missing.
TOKEN_COLUMNS = {
    "sent_id": None, "tok_i": None, "idx": None, "text": None, "lemma": None, "pos": None, "head_i": None, "dep": "''", "tag": "''", "verbform": "''", "tense": "''", "quoted": "false",
    "is_space": "pos = 'SPACE'", "is_punct": "pos = 'PUNCT'", "is_alpha": r"text rlike r'^\p{L}+$'", "like_num": "pos = 'NUM'",
}


#: Marks of a token, a bit each.
MARKS = ("vbn", "quoted", "is_space", "is_punct", "is_alpha", "like_num")
#: Tokens of a parsed work that are annotated at a time, about.
STEP_TOKENS = 1 << 15


def place_in(column: str, names: list[str]) -> Column:
    """A name's place in the list from 1, 0 if it isn't there."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(column)), F.lit(0)).cast("int")


def pack(ints: np.ndarray, strings: list[tuple[np.ndarray, memoryview]]) -> bytes:
    """Tokens as bytes: sent_id, tok_i, idx, head_i and bits as differences, then two columns of strings (lengths and UTF-8)."""
    x = ints.copy()
    x[3] -= x[1]
    x[:3, 1:] -= ints[:3, :-1]
    parts = [np.array([ints.shape[1]], dtype=np.int64), x, *[y.astype(np.int32) for y, _ in strings]]
    return ZSTD.compress(b"".join([*[y.tobytes() for y in parts], *[bytes(y) for _, y in strings]]), asbytes=True)


def unpack(packed: bytes) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """ints, lengths and bytes of the strings, as they were packed."""
    size, raw = int.from_bytes(packed[:8], "little"), packed[8:]
    raw = ZSTD.decompress(raw, decompressed_size=size, asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    x, at = np.frombuffer(raw, np.int64, 5 * n, 8).reshape(5, n).copy(), 8 + 40 * n
    np.cumsum(x[:3], axis=1, out=x[:3])
    x[3] += x[1]
    lengths = [np.frombuffer(raw, np.int32, n, at + 4 * n * k) for k in range(2)]
    cut_at = at + 8 * n + int(lengths[0].sum())
    return x, lengths, [raw[at + 8 * n : cut_at], raw[cut_at:]]


def parsed_fragments(tokens: DataFrame, sentences: int) -> DataFrame:
    """work, seg, size, n, t and head: what a batch of tokens has of each part, packed; its words by the four definitions, and its first words, packed.

    A token is some bytes then, where a row of its columns is some hundred.
    """
    have = {c.lower() for c in tokens.columns}
    morph = {"verbform": "element_at(morph['VerbForm'], 1)", "tense": "element_at(morph['Tense'], 1)"} if "morph" in have else {}
    columns = [F.coalesce(F.expr(c if c in have else morph.get(c, other)), F.expr(other or "null")).alias(c) for c, other in TOKEN_COLUMNS.items()]
    rows = tokens.select("work", *columns).withColumn("vbn", F.col("tag") == "VBN")
    dep = F.when(F.col("dep").endswith(":neg"), D["neg"]).otherwise(F.greatest(place_in("dep", DEPS) - 1, F.lit(0)))
    bits = place_in("pos", POS).bitwiseOR(F.shiftleft(dep, 5)).bitwiseOR(F.shiftleft(place_in("verbform", ["Part", "Inf", "Fin"]), 9)).bitwiseOR(F.shiftleft(place_in("tense", ["Past", "Pres"]), 11))
    for k, name in enumerate(MARKS):
        bits = bits.bitwiseOR(F.when(F.col(name), 1 << 13 + k).otherwise(0))
    longs = [F.coalesce(F.col(c).cast("long"), F.lit(other)).alias(c) for c, other in (("sent_id", 0), ("tok_i", 0), ("idx", 0), ("head_i", -1))]
    # few columns, as each takes its time on the way to the workers
    rows = rows.where("sent_id is not null").select("work", *longs, bits.cast("long").alias("bits"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lemma")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pc.dictionary_encode(batch.column("work"), null_encoding="encode").indices.to_numpy().astype(np.int64)
            ints = np.stack([batch.column(c).to_numpy() for c in ("sent_id", "tok_i", "idx", "head_i", "bits")])
            key, seg = key << 32, ints[0] // sentences
            key = key + seg
            order = np.lexsort((ints[2], ints[1], ints[0], key))
            key, ints, strings = key[order], ints[:, order], []
            for c in ("text", "lemma"):
                column = batch.column(c).take(pa.array(order))
                if c == "text":
                    lengths = pc.utf8_length(column).to_numpy()
                strings.append((np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset), memoryview(column.buffers()[2] or b"")))
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            pos, num, space, punct, alpha = ints[4] & 31, *[ints[4] >> 13 + MARKS.index(m) & 1 == 1 for m in ("like_num", "is_space", "is_punct", "is_alpha")]
            word = ~space & ~punct
            at, texts = strings[0]
            letters = np.r_[0, np.cumsum(spans.letters()[spans.points(texts[: at[-1]])])]
            ends = np.r_[0, np.cumsum(lengths)]
            lettered = word & ~num & (pos != P["SYM"] + 1) & (letters[ends[1:]] > letters[ends[:-1]])
            counts = np.stack([np.add.reduceat(w.astype(np.int64), first) for w in (word, lettered, alpha, alpha & ~num)], axis=1) if len(key) else np.zeros((0, 4), dtype=np.int64)

            def packed(rows: np.ndarray) -> bytes:
                own = [(x[rows + 1] - x[rows], y[x[rows[0]] : x[rows[-1] + 1]] if rows[-1] - rows[0] + 1 == len(rows) else memoryview(b"".join(y[x[r] : x[r + 1]] for r in rows.tolist()))) for x, y in strings]
                raw_size = 8 + len(rows) * 48 + sum(len(y) for _, y in own)
                return raw_size.to_bytes(8, "little") + pack(ints[:, rows], own)

            bounds = [*first.tolist(), len(key)]
            t, heads = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                t.append(packed(np.arange(a, b)))
                some = a + np.flatnonzero(word[a:b])[:AHEAD]
                heads.append(packed(some) if len(some) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("work").take(pa.array(order[first])), pa.array(seg[order[first]], pa.int32()), pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, 4, dtype=np.int32)), pa.array(counts.reshape(-1))), pa.array(t, pa.binary()), pa.array(heads, pa.binary())],
                ["work", "seg", "size", "n", "t", "head"],
            )

    schema = rows.select("work", F.lit(0).alias("seg"), F.lit(0).cast("long").alias("size"), F.expr("cast(null as array<bigint>)").alias("n"), F.expr("cast(null as binary)").alias("t"), F.expr("cast(null as binary)").alias("head")).schema
    return rows.mapInArrow(run, schema)


def parsed_parts(tokens: DataFrame, sentences: int) -> DataFrame:
    """work, seg, own (its tokens), t (they, packed), ahead (the first words of the parts after it, packed), base and total.

    Tokens are shuffled once, packed; what parts learn of one another is a small row for each part.
    """
    fragments = cut(parsed_fragments(tokens, sentences))
    sums = F.array(*[F.sum(F.col("n")[k]) for k in range(4)]).alias("n")
    parts = fragments.groupBy("work", "seg").agg(sums, F.collect_list("head").alias("head"))
    by_work = W.partitionBy("work").orderBy("seg")
    each = lambda over: F.array(*[F.coalesce(F.sum(F.col("n")[k]).over(over), F.lit(0)) for k in range(4)])
    later = F.flatten(F.collect_list("head").over(by_work.rowsBetween(1, AHEAD)))
    known = parts.select("work", "seg", F.lit(0).cast("long").alias("size"), F.expr("cast(null as binary)").alias("t"), later.alias("ahead"), each(by_work.rowsBetween(W.unboundedPreceding, -1)).alias("base"), each(W.partitionBy("work")).alias("total"))
    nothing = [F.expr("cast(null as array<binary>)").alias("ahead"), *[F.expr("cast(null as array<bigint>)").alias(x) for x in ("base", "total")]]
    both = fragments.select("work", "seg", "size", "t", *nothing).unionByName(known)
    return both.groupBy("work", "seg").agg(F.sum("size").alias("own"), F.collect_list("t").alias("t"), *[F.first(x, True).alias(x) for x in ("ahead", "base", "total")])


def parsed_tokens(batch: pa.RecordBatch, words: Words) -> Tokens:
    """Tokens of packed parts: each part's own in order, then the first words after it."""
    own, pieces = batch.column("own").to_numpy().astype(np.int64), []
    for k, (t, ahead) in enumerate(zip(batch.column("t").to_pylist(), batch.column("ahead").to_pylist(), strict=True)):
        pieces += [(k, 0, unpack(x)) for x in t] + [(k, 1, unpack(x)) for x in ahead]
    ints = np.concatenate([x for _, _, (x, _, _) in pieces], axis=1)
    sizes = [x.shape[1] for _, _, (x, _, _) in pieces]
    part, after = np.repeat([k for k, _, _ in pieces], sizes), np.repeat([k for _, k, _ in pieces], sizes)
    strings = []
    for c in range(2):
        ends = np.cumsum(np.concatenate([x[c] for _, _, (_, x, _) in pieces]), dtype=np.int64).astype(np.int32)
        strings.append(pa.StringArray.from_buffers(len(part), pa.py_buffer(np.r_[np.int32(0), ends].tobytes()), pa.py_buffer(b"".join(x[c] for _, _, (_, _, x) in pieces))))
    keys = (ints[2], ints[1], ints[0], after, part)
    order = np.lexsort(keys)
    same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in keys])
    if same.any():  # tokens of one place go by all they have, so that their order is always the same
        rest = [ints[4], ints[3], *[pc.rank(x, "ascending", tiebreaker="dense").to_numpy() for x in reversed(strings)]]
        order = np.lexsort((*rest, *keys))
    group = part[order] << 1 | after[order]
    rank = np.arange(len(order)) - np.searchsorted(group, group)
    order = order[(after[order] == 0) | (rank < AHEAD)]
    text, lemma = (x.take(pa.array(order)) for x in strings)
    letters = memoryview(text.buffers()[2] or b"")[: int(np.frombuffer(text.buffers()[1], np.int32, len(text) + 1)[-1])] if len(text) else b""
    distinct = [(x.dictionary.to_pylist(), x.indices.to_numpy()) for x in (text.dictionary_encode(), lemma.dictionary_encode())]
    sent_id, tok_i, idx, head_i, bits = ints[:, order]
    pos = np.where(bits & 31 > 0, (bits & 31) - 1, P["X"])
    marks = {m: bits >> 13 + k & 1 == 1 for k, m in enumerate(MARKS)}
    columns = {"sent_id": sent_id, "tok_i": tok_i, "idx": idx, "head_i": head_i, "text": distinct[0], "lemma": distinct[1], "length": pc.utf8_length(text).to_numpy().astype(np.int64), "utf8": letters, "pos": pos, "dep": bits >> 5 & 15, "form": bits >> 9 & 3, "tense": bits >> 11 & 3, **marks}
    return Parsed(np.bincount(part[order], minlength=len(own)), own, columns, words, four(batch.column("base")), four(batch.column("total")))


def parsed_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of about STEP_TOKENS tokens at a time."""
    for batch in batches:
        turn = np.cumsum(batch.column("own").to_numpy()) // STEP_TOKENS
        cut_at = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cut_at[:-1], cut_at[1:], strict=True) if b > a)


def family_of_tokens(tokens: DataFrame, which: str, keep_tail: bool = True, sentences: int = SENTENCES) -> DataFrame:
    """work, metric, value of one family of a parser's tokens: work and TOKEN_COLUMNS (or morph in place of verbform and tense), any order.

    head_i is the tok_i of the head, in the same sentence; narration goes by `quoted` (spans.outside() can tell), dialogue needs the texts.
    """
    if which == "dialogue":
        raise ValueError("dialogue is found in texts, not in tokens")
    return family_stats(added_up(chunk_rows(parsed_parts(tokens, sentences), [which], parsed_tokens, parsed_steps, True), [which]), which, keep_tail)
