"""Rule annotator: texts as arrays of tokens.

A batch of works is one run of arrays, a row per token: what depends on a token's letters
alone (lower case, lemma, classes) is worked out once per distinct token and worker and
gathered by number; what depends on neighbours (sentences, part of speech after a sentence's
begin, verb forms, shallow dependencies) is array arithmetic over the run. A part of a work that begins
with a sentence is annotated as it would be within its work. A parser's token table can take the place of the rules.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from itertools import islice

import numpy as np
import regex

from quillspark.functions import lexicons as L

#: Covers every character of a text: words, digit runs, white space, single other characters.
TOKEN = regex.compile(r"\p{L}+(?:['’]\p{L}+)*|\p{N}+|[\t-\r ]+|[^\t-\r \p{L}\p{N}]")
POS = ["SPACE", "SYM", "PUNCT", "NUM", "AUX", "PART", "CCONJ", "PRON", "DET", "ADV", "SCONJ", "ADP", "VERB", "NOUN", "ADJ", "PROPN", "INTJ", "X"]
P = {name: k for k, name in enumerate(POS)}
#: Verb forms and tenses as numbers; 0 is none.
PART, INF, FIN = 1, 2, 3
PAST, PRES = 1, 2
#: Relations that any feature asks for; the rules find the first few, a parser all of them.
DEPS = ["", "neg", "amod", "acomp", "prep", "advmod", "conj", "cop", "advcl", "acl", "mod"]
D = {name: k for k, name in enumerate(DEPS)}
#: Distinct tokens that a worker remembers before it starts anew.
MEMO_TOKENS = 50_000

LETTERS, DIGITS = regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+")
ANY_LETTER, NOT_LETTERS = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}]")
VOWELS, ENDS_NOT = regex.compile("[aeiouy]+"), regex.compile("n['’]t$")
FORM_OF = {form: lemma for lemma, forms in L.IRREGULAR.items() for form in forms.split()}
VERBS = frozenset(L.VERBS)
NOUN_ENDS, ADJECTIVE_ENDS = tuple(L.NOUN_ENDS), tuple(L.ADJECTIVE_ENDS)
WORD_CLASSES = {w: P[c] for c, words in reversed([("AUX", L.MODALS), ("PART", ["to", "not"]), ("CCONJ", L.COORDINATORS), ("PRON", L.PRONOUNS), ("DET", L.DETERMINERS), ("ADV", L.ADVERBS)]) for w in words}
LATER_CLASSES = {w: P[c] for c, words in reversed([("SCONJ", L.SUBORDINATORS), ("ADP", L.ADPOSITIONS)]) for w in words}


def lemma_of(w: str) -> str:
    if w in FORM_OF:
        return FORM_OF[w]
    stem = w[:-2] if w.endswith("ed") and len(w) >= 4 else w[:-3] if w.endswith("ing") and len(w) >= 5 else None
    if stem is not None and stem in VERBS:
        return stem
    if stem is not None and stem + "e" in VERBS:
        return stem + "e"
    if w.endswith("ied") and len(w) >= 5 and w[:-3] + "y" in VERBS:
        return w[:-3] + "y"
    if w.endswith("ies") and len(w) >= 5:
        return w[:-3] + "y"
    if w.endswith(("ches", "shes", "sses", "xes")):
        return w[:-2]
    if len(w) > 3 and w[-1] == "s" and w[-2] not in "su" and not w.endswith(("is", "’s", "'s")):
        return w[:-1]
    return w


def pos_of(tok: str, lower: str, lemma: str) -> int:
    """Part of speech of a word that begins no sentence."""
    if lemma == "be" or lower in L.MODALS or lemma in ("have", "do"):
        return P["AUX"]
    if ENDS_NOT.search(lower) or lower in ("to", "not"):
        return P["PART"]
    if lower in WORD_CLASSES:
        return WORD_CLASSES[lower]
    if lower.endswith("ly") and len(lower) >= 4:
        return P["ADV"]
    if lower in LATER_CLASSES:
        return LATER_CLASSES[lower]
    if lemma in VERBS:
        return P["VERB"]
    if lower.endswith(NOUN_ENDS):
        return P["NOUN"]
    if lower.endswith("ed") and len(lower) >= 5:
        return P["VERB"]
    if lower.endswith(ADJECTIVE_ENDS):
        return P["ADJ"]
    return P["PROPN"] if "A" <= tok[0] <= "Z" else P["NOUN"]


def syllables(w: str) -> int:
    if not ANY_LETTER.search(w):
        return 0
    n = len(VOWELS.findall(w))
    silent = n > 1 and w.endswith("e") and not (w.endswith("le") and w[-3:-2] in tuple("aeiouy"))
    return max(1, n - silent)


class Words:
    """A worker's memo of distinct tokens: a column for each thing that their letters alone decide."""

    COLUMNS = ("lower", "lemma", "pos", "length", "space", "punct", "alpha", "num", "lettered", "end", "comma", "part", "base", "tense", "letters", "syllables", "ing", "not_end")

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.strings: dict[str, int] = {}
        self.told: dict[str, np.ndarray] = {}
        self.of = dict.fromkeys(self.COLUMNS, np.zeros(0, dtype=np.int32))

    def string(self, s: str) -> int:
        return self.strings.setdefault(s, len(self.strings))

    def learn(self, new: list[str]) -> None:
        rows = [self.describe(t) for t in new]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        for name, column in zip(self.COLUMNS, zip(*rows, strict=True), strict=True):
            self.of[name] = np.concatenate([self.of[name], np.array(column, dtype=np.int32)])

    def describe(self, tok: str) -> tuple:
        lower = tok.lower()
        space, letters = tok[0] in "\t\n\x0b\x0c\r ", ANY_LETTER.search(tok) is not None
        symbol = tok in L.SYMBOLS
        digits = DIGITS.fullmatch(tok) is not None
        punct = not (space or letters or digits or symbol)
        num = digits or lower in L.NUMBER_WORDS
        lemma = lemma_of(lower)
        pos = P["SPACE"] if space else P["SYM"] if symbol else P["PUNCT"] if punct else P["NUM"] if num else pos_of(tok, lower, lemma)
        changed = lemma != lower and (lower.endswith("ed") and len(lower) >= 4 or lower.endswith("ing") and len(lower) >= 5)
        tense = PAST if lower.endswith("ed") or lower in L.PAST_FORMS else PRES if lower.endswith("ing") else PAST if lower in L.PARTICIPLES else PRES
        return (
            self.string(lower), self.string(lemma), pos, len(tok), space, punct, LETTERS.fullmatch(tok) is not None, num, letters, tok in (".", "!", "?", "…"), tok == ",",
            lower in L.PARTICIPLES or changed, lemma == lower, tense, len(NOT_LETTERS.sub("", lower)), syllables(lower), lower.endswith("ing"), ENDS_NOT.search(lower) is not None,
        )

    def member(self, words) -> np.ndarray:
        """By string: whether it is one of the words."""
        out = np.zeros(len(self.strings), dtype=bool)
        out[[self.strings[w] for w in words if w in self.strings]] = True
        return out

    def each(self, name: str, tell: Callable[[str], int]) -> np.ndarray:
        """By string: what `tell` says of it, asked once for each string; the name is that of the question."""
        known = self.told.get(name, np.zeros(0, dtype=np.int32))
        if more := len(self.strings) - len(known):
            self.told[name] = known = np.r_[known, np.fromiter(map(tell, islice(self.strings, len(known), None)), dtype=np.int32, count=more)]
        return known


def shifted(x: np.ndarray, k: int, group: np.ndarray, fill=0) -> np.ndarray:
    """x of the row k later (or -k earlier) in the same group of neighbouring rows, else fill."""
    out = np.full(len(x), fill, dtype=x.dtype)
    if 0 < k < len(x):
        out[:-k] = np.where(group[:-k] == group[k:], x[k:], fill)
    elif k < 0 and -k < len(x):
        out[-k:] = np.where(group[-k:] == group[:k], x[:k], fill)
    return out


def since(flag: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Place of the last flagged row before each row, or one before its work's first if there is none."""
    last = np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1)) if len(flag) else np.zeros(0, dtype=np.int64)
    return np.maximum(np.r_[-1, last[:-1]] if len(flag) else last, start - 1)


class Tokens:
    """Works, or parts of works, as token arrays: doc, tok columns, sent (a number of each sentence over all), word numbers ix[1] to ix[4].

    w[1] to w[4] are the four word definitions: neither space nor mark; of those with a letter and
    no number; letters only; letters only and no number word. A part has `base` words of each definition before it in
    its work and `total` in the whole work (docs x 4 each); only its first `own` characters are counted, what comes after
    them is there to be looked at. speech and begins are spans found before, by doc, where a part can't tell.
    """

    speech = begins = None

    def __init__(self, texts: list[str], words: Words, own: np.ndarray | None = None, base: np.ndarray | None = None, total: np.ndarray | None = None) -> None:
        found = [TOKEN.findall(t) for t in texts]
        of = self.describe(words, [t for one in found for t in one], np.array([len(one) for one in found], dtype=np.int64))
        self.texts, self.lemma, self.num, self.vbn = texts, of["lemma"], of["num"].astype(bool), np.zeros(self.n, dtype=bool)
        self.space, self.punct = of["space"].astype(bool), of["punct"].astype(bool)
        alpha, lettered = of["alpha"].astype(bool), of["lettered"].astype(bool)
        start = self.first[self.doc]
        ends = np.cumsum(self.length)
        self.idx = ends - self.length - np.r_[0, ends][start]
        word = ~self.space & ~self.punct
        last_word = since(word, start)
        starts = word & ((since(of["end"].astype(bool), start) > last_word) | (last_word < start))
        number = np.cumsum(starts)
        number = np.maximum(number - np.r_[0, number][start], 1)
        self.sent = np.cumsum(np.r_[True, (number[1:] != number[:-1]) | (self.doc[1:] != self.doc[:-1])][: self.n]) - 1
        self.pos = np.where(starts & (of["pos"] == P["PROPN"]), P["NOUN"], of["pos"])
        self.verb = (self.pos == P["VERB"]) | (self.pos == P["AUX"])
        # infinitives follow a modal or "to" within the sentence
        led = words.member([*L.MODALS, "to"])[self.lower]
        before, before2 = shifted(led & ~self.space, -1, self.doc, False), shifted(led, -2, self.doc, False)
        led = np.where(shifted(self.space, -1, self.doc, True), before2, before) & shifted(np.ones(self.n, dtype=bool), -1, self.sent, False)
        form = np.where(of["part"], PART, np.where(of["base"].astype(bool) & led, INF, FIN))
        self.form, self.tense = np.where(self.verb, form, 0), np.where(self.verb, of["tense"], 0)
        self.number(alpha, lettered, None if own is None else self.idx < own[self.doc], base, total)
        self.depend()

    def describe(self, words: Words, flat: list[str], sizes: np.ndarray) -> dict[str, np.ndarray]:
        """Columns that the tokens' letters alone decide."""
        if max(len(words.number), len(words.strings)) > MEMO_TOKENS:
            words.__init__()
        if new := list(dict.fromkeys(t for t in flat if t not in words.number)):
            words.learn(new)
        at = np.fromiter(map(words.number.__getitem__, flat), dtype=np.int64, count=len(flat))
        self.words, self.n = words, len(flat)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.cumsum(sizes) - sizes
        of = {name: column[at] for name, column in words.of.items()}
        self.lower, self.length, self.letters, self.syllables = (of[k] for k in ("lower", "length", "letters", "syllables"))
        self.ing, self.comma, self.not_end = (of[k].astype(bool) for k in ("ing", "comma", "not_end"))
        return of

    def number(self, alpha: np.ndarray, lettered: np.ndarray, own: np.ndarray | None, base: np.ndarray | None, total: np.ndarray | None) -> None:
        """The word definitions and the words' numbers in their works."""
        docs, word = len(self.first), ~self.space & ~self.punct
        self.w = {1: word, 2: word & ~self.num & (self.pos != P["SYM"]) & lettered, 3: alpha, 4: alpha & ~self.num}
        self.own = np.ones(self.n, dtype=bool) if own is None else own
        self.base = np.zeros((docs, 4), dtype=np.int64) if base is None else base
        self.counts = np.stack([np.bincount(self.doc[w & self.own], minlength=docs) for w in self.w.values()], axis=1)
        self.total = self.counts if total is None else total
        start = self.first[self.doc]
        self.ix = {k: np.cumsum(w) - np.r_[0, np.cumsum(w)][start] - 1 + self.base[self.doc, k - 1] for k, w in self.w.items()}
        self.seen = np.flatnonzero(~self.space)

    def has(self, words) -> np.ndarray:
        """Whether the lemma is one of the words; has_lower: the lower-case form."""
        return self.words.member(words)[self.lemma]

    def has_lower(self, words) -> np.ndarray:
        return self.words.member(words)[self.lower]

    def nearby(self, x: np.ndarray, k: int, fill=0) -> np.ndarray:
        """x of the token k later in the sentence, spaces left out; for tokens that aren't spaces."""
        out = np.full(self.n, fill, dtype=x.dtype)
        out[self.seen] = shifted(x[self.seen], k, self.sent[self.seen], fill)
        return out

    def depend(self) -> None:
        """Shallow dependencies from neighbours: relation and the head's part of speech (-1: none)."""
        after, before, before2 = self.nearby(self.pos, 1, -1), self.nearby(self.pos, -1, -1), self.nearby(self.pos, -2, -1)
        be = self.nearby(self.has(["be"]), -1, False)
        isin = lambda x, *names: np.isin(x, [P[n] for n in names])
        tests = {
            "neg": self.has_lower(["not"]) | self.not_end,
            "amod": isin(self.pos, "ADJ") & isin(after, "NOUN", "PROPN"),
            "acomp": isin(self.pos, "ADJ") & be,
            "prep": isin(self.pos, "ADP") & isin(after, "DET", "ADJ", "NOUN", "PROPN", "PRON", "NUM"),
            "advmod": isin(self.pos, "ADV") & isin(after, "ADJ", "ADV", "VERB"),
            "conj": isin(self.pos, "ADJ", "ADV", "NOUN", "VERB") & isin(before, "CCONJ") & (before2 == self.pos),
        }
        self.dep = np.where(self.space, 0, np.select(list(tests.values()), [D[k] for k in tests], 0))
        self.cop_child = np.zeros(self.n, dtype=bool)
        self.head_pos = np.select([(self.dep == D["amod"]) | (self.dep == D["advmod"]), self.dep == D["conj"], self.dep == D["acomp"], self.dep == D["prep"]], [after, before2, before, before], -1)


class Parsed(Tokens):
    """The same arrays from a parser's tokens: sentences, classes, forms and relations are the parser's, the rest follows from the letters.

    text and lemma are the distinct ones and each token's number among them; length is a token's characters, utf8 the tokens' letters in a row.
    What follows from letters is worked out once per distinct string and only where a family asks for it.
    """

    def __init__(self, sizes: np.ndarray, own: np.ndarray, columns: dict, words: Words, base: np.ndarray, total: np.ndarray) -> None:
        if len(words.strings) > MEMO_TOKENS:
            words.__init__()
        self.words, self.n = words, len(columns["idx"])
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.cumsum(sizes) - sizes
        self.lower, self.lemma = (np.fromiter((words.string(x.lower()) for x in distinct), dtype=np.int64, count=len(distinct))[at] for distinct, at in (columns["text"], columns["lemma"]))
        self.length, self.utf8 = columns["length"], columns["utf8"]
        self.pos, self.form, self.dep, self.vbn = (np.asarray(columns[k]) for k in ("pos", "form", "dep", "vbn"))
        self.space, self.punct, self.num = (np.asarray(columns[k], dtype=bool) for k in ("is_space", "is_punct", "like_num"))
        self.idx = np.asarray(columns["idx"], dtype=np.int64)
        self.idx = self.idx - np.r_[self.idx, 0][self.first][self.doc]
        sent = np.asarray(columns["sent_id"], dtype=np.int64)
        self.sent = np.cumsum(np.r_[True, (sent[1:] != sent[:-1]) | (self.doc[1:] != self.doc[:-1])][: self.n]) - 1
        self.verb = (self.pos == P["VERB"]) | (self.pos == P["AUX"])
        self.tense = np.where(self.verb, columns["tense"], 0)
        lettered = words.each("lettered", lambda w: ANY_LETTER.search(w) is not None)[self.lower] > 0
        self.number(np.asarray(columns["is_alpha"], dtype=bool), lettered, np.arange(self.n) - self.first[self.doc] < own[self.doc], base, total)
        # a head is a token of the same sentence
        place = self.sent.astype(np.int64) << 32 | np.asarray(columns["tok_i"], dtype=np.int64)
        order = np.argsort(place, kind="stable")
        wanted = self.sent.astype(np.int64) << 32 | np.asarray(columns["head_i"], dtype=np.int64)
        at = np.minimum(np.searchsorted(place[order], wanted), max(0, self.n - 1))
        head = np.where(place[order][at] == wanted, order[at], -1) if self.n else at
        self.head_pos = np.where(head >= 0, self.pos[head], -1) if self.n else head
        self.cop_child = np.zeros(self.n, dtype=bool)
        self.cop_child[head[(self.dep == D["cop"]) & (head >= 0)]] = True
        self.quoted = np.asarray(columns["quoted"], dtype=bool)

    @cached_property
    def letters(self) -> np.ndarray:
        return self.words.each("letters", lambda w: len(NOT_LETTERS.sub("", w)))[self.lower]

    @cached_property
    def syllables(self) -> np.ndarray:
        return self.words.each("syllables", syllables)[self.lower]

    @cached_property
    def ing(self) -> np.ndarray:
        return self.words.each("ing", lambda w: w.endswith("ing"))[self.lower] > 0

    @cached_property
    def comma(self) -> np.ndarray:
        return self.has_lower([","])

    @cached_property
    def not_end(self) -> np.ndarray:
        return self.words.each("not_end", lambda w: ENDS_NOT.search(w) is not None)[self.lower] > 0

    @cached_property
    def texts(self) -> list[str]:
        """The parts' texts: tokens at their places or after the one before, blanks between."""
        if not self.n:
            return [""] * len(self.first)
        # a token begins at its place or where the one before ends; with the lengths before it taken off, that is a running maximum
        ends = np.cumsum(self.length)
        before = ends - self.length - (ends - self.length)[np.minimum(self.first, self.n - 1)][self.doc]
        blanks = np.maximum(self.idx - before, 0)
        step = self.doc * (int(blanks.max()) + 1)
        begins = np.maximum.accumulate(blanks + step) - step + before
        sizes = np.zeros(len(self.first), dtype=np.int64)
        last = np.flatnonzero(np.r_[self.doc[1:] != self.doc[:-1], True])
        sizes[self.doc[last]] = begins[last] + self.length[last]
        starts = np.cumsum(sizes) - sizes
        out = np.full(int(sizes.sum()), 32, dtype=np.uint32)
        at = np.repeat(begins + starts[self.doc] - (ends - self.length), self.length) + np.arange(int(ends[-1]))
        out[at] = np.frombuffer(str(self.utf8, "utf-8").encode("utf-32-le"), dtype=np.uint32)
        text = str(out.tobytes(), "utf-32-le")
        return [text[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
