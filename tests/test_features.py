"""Feature families over works in parts and over a parser's tokens."""

import random

import pytest

from quillspark.operators import features
from quillspark.operators.annotate import DEPS, FIN, INF, PART, PAST, POS, PRES, Tokens, Words

LINES = [
    "I have not yet seen him, and I had to go. ", "“Where did he go?” she asked. ", "She was taken by them, which was odd!\n", "- I know that you said so.\n", "The very old man is kind of nice… ", "Well, he must try to leave. ",
    "There is 1 house & $5 in the table", "; it looks like rain", "Having lost it, we went on. ", "«Come in.» ", "nobody knew 12 of them? ", "Even if it rains I will die", ", don't you see", "\n\n", "   ", "—", "“ Hello there, my friend ", ".” ", "has ", "have ", "gone ",
]


def made(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(LINES) for _ in range(n))


def rows(df):
    return {(r.work, r.metric): r.value for r in df.collect()}


WORKS = [("a", made(1, 900)), ("b", made(2, 40)), ("c", ""), ("d", None), ("e", "word " * 950), ("f", "...!?"), ("g", made(3, 500) + " end")]


def every(df):
    return {(r.family, r.work, r.metric): r.value for r in df.collect()}


def test_parts_make_the_same_works(spark):
    """All families, annotated once: works as they are, and with the longest in over 40 parts."""
    works = spark.createDataFrame(WORKS, "work string, text string")
    whole, parts = (every(features.stats(works, size=size)) for size in (features.SEGMENT, 400))
    assert len(features.cuts(WORKS[0][1], 400)) > 40
    assert parts.keys() == whole.keys() and {k[0] for k in whole} == set(features.FAMILIES)
    assert {k: (v, parts[k]) for k, v in whole.items() if abs(v - parts[k]) > 1.0001e-4 or k[2].endswith("_total") and v != parts[k]} == {}
    assert whole["tokens1", "c", "token_total"] == whole["dialogue", "d", "chunk_count_used"] == 0 and whole["tokens1", "a", "token_total"] > 1000


def test_tail_left_out_in_parts(spark):
    works = spark.createDataFrame(WORKS, "work string, text string")
    for which in ("readability",):
        assert rows(features.family(works, which, keep_tail=False)) == pytest.approx(rows(features.family(works, which, keep_tail=False, size=300)), abs=1.0001e-4)


TABLE = "work string, sent_id int, tok_i int, idx int, text string, lemma string, pos string, tag string, dep string, head_i int, verbform string, tense string, is_space boolean, is_punct boolean, is_alpha boolean, like_num boolean, quoted boolean"


def as_table(works):
    """The rules' own annotation as a parser's table."""
    out = []
    for work, text in works:
        t = Tokens([text or ""], Words())
        strings = list(t.words.strings)
        flat = [t.texts[0][a : a + n] for a, n in zip(t.idx.tolist(), t.length.tolist(), strict=True)]
        quoted = features.in_speech(t)
        heads = {}
        for k in range(t.n):  # a head of the class that the rules give
            same = [j for j in range(t.n) if t.sent[j] == t.sent[k] and t.pos[j] == t.head_pos[k]]
            heads[k] = same[0] if same else 10**6
        for k in range(t.n):
            out.append((work, int(t.sent[k]), k, int(t.idx[k]), flat[k], strings[t.lemma[k]], POS[t.pos[k]], "", DEPS[t.dep[k]], heads[k], {PART: "Part", INF: "Inf", FIN: "Fin"}.get(int(t.form[k]), ""), {PAST: "Past", PRES: "Pres"}.get(int(t.tense[k]), ""), bool(t.space[k]), bool(t.punct[k]), bool(t.w[3][k]), bool(t.num[k]), bool(quoted[k])))
    return out


@pytest.mark.parametrize("which", ["tokens1", "sentences1", "readability", "richness", "narration"])
def test_a_table_of_the_rules_gives_the_same(spark, which):
    works = [("a", made(5, 120)), ("b", made(6, 30))]
    table = spark.createDataFrame(as_table(works), TABLE).repartition(5)
    want = rows(features.family(spark.createDataFrame(works, "work string, text string"), which))
    got = rows(features.family_of_tokens(table, which, sentences=3))
    assert got.keys() == want.keys()
    assert {k: (v, got[k]) for k, v in want.items() if abs(v - got[k]) > 1.0001e-4} == {}


PARSES = {
    "cop": "There/there/PRON/expl/1 is/be/AUX/cop/1~Fin one/one/NUM/nsubj/1 ././PUNCT/punct/1",
    "advcl": "He/he/PRON/nsubj/1 left/leave/VERB/ROOT/1~Fin the/the/DET/det/3 room/room/NOUN/dobj/1 again/again/ADV/advmod/1 smiling/smile/VERB/advcl/1~Part",
    "no advcl": "He/he/PRON/nsubj/1 left/leave/VERB/ROOT/1~Fin the/the/DET/det/3 room/room/NOUN/dobj/1 again/again/ADV/advmod/1 smiling/smile/VERB/dep/1~Part",
    "acl": "A/a/DET/det/1 man/man/NOUN/nsubj/4 from/from/ADP/prep/1 home/home/NOUN/pobj/2 went/go/VERB/ROOT/4~Fin beaten/beat/VERB/acl/4~Part",
    "cop child": "old/old/ADJ/ROOT/0 he/he/PRON/nsubj/0 is/be/AUX/cop/0~Fin",
    "no cop child": "old/old/ADJ/ROOT/0 he/he/PRON/nsubj/0 is/be/AUX/aux/0~Fin",
    "mod": "He/he/PRON/nsubj/1 is/be/AUX/ROOT/1~Fin rather/rather/X/mod/3 old/old/ADJ/acomp/1",
    "no mod": "He/he/PRON/nsubj/1 is/be/AUX/ROOT/1~Fin rather/rather/X/dep/3 old/old/ADJ/acomp/1",
    "head": "He/he/PRON/nsubj/1 is/be/AUX/ROOT/1~Fin very/very/ADV/x/3 old/old/ADJ/acomp/1",
    "other head": "He/he/PRON/nsubj/1 is/be/AUX/ROOT/1~Fin very/very/ADV/x/0 old/old/ADJ/acomp/1",
    "neg": "He/he/PRON/nsubj/2 never/never/ADV/advmod:neg/2 left/leave/VERB/ROOT/2~Fin",
    "vbn": "It/it/PRON/nsubjpass/2 was/be/AUX/auxpass/2~Fin took/take/VERB/ROOT/2~VBN by/by/ADP/agent/2 him/he/PRON/pobj/3",
    "conj": "tea/tea/NOUN/ROOT/0 and/and/CCONJ/cc/0 cake/cake/NOUN/conj/0 ran/run/VERB/conj/0~Fin",
}
#: What only a parser can tell, by hand: family, feature and the parses in which it is found once (of those named, or not at all).
TOLD = [
    ("sentences1", "copular", {"cop": 1, "head": 1}),  # be is a copula beside there too
    ("sentences1", "existential", {"cop": 1, "head": 0}),
    ("sentences1", "present_participial", {"advcl": 1, "no advcl": 0}),  # the sixth word, and no comma after it
    ("sentences1", "past_participial", {"acl": 1, "advcl": 0}),
    ("tokens1", "predicative_adjs", {"cop child": 1, "no cop child": 0}),
    ("sentences1", "downtoners", {"mod": 1, "no mod": 0}),
    ("sentences1", "amplifiers", {"head": 1, "other head": 0}),
    ("sentences1", "analytic_negation", {"neg": 1, "vbn": 0}),
    ("sentences1", "by_passives", {"vbn": 1, "acl": 0}),
    ("sentences1", "phrasal_coord", {"conj": 1, "acl": 0}),
]


def test_relations_of_a_parser(spark):
    """Each word as text/lemma/pos/dep/head (its place in the sentence) and forms after a tilde."""
    out = []
    for work, parse in PARSES.items():
        at = 0
        for i, word in enumerate(parse.split()):
            word, _, form = word.partition("~")
            text, lemma, pos, dep, head = word.split("/")
            out.append((work, 0, i, at, text, lemma, pos, "VBN" if form == "VBN" else "", dep, int(head), {"VerbForm": [form]} if form in ("Fin", "Inf", "Part") else {}))
            at += len(text) + 1
    table = spark.createDataFrame(out, "work string, sent_id int, tok_i int, idx int, text string, lemma string, pos string, tag string, dep string, head_i int, morph map<string, array<string>>")
    got = {which: rows(features.family_of_tokens(table, which)) for which in ("tokens1", "sentences1")}
    assert [(which, name, {work: got[which][work, f"{name}_total"] for work in want}) for which, name, want in TOLD] == TOLD


def test_parsed_tokens_without_some_columns(spark):
    table = spark.createDataFrame([("w", 0, 0, 0, "Dogs", "dog", "NOUN", 0), ("w", 0, 1, 4, ".", ".", "PUNCT", 0)], "work string, sent_id int, tok_i int, idx int, text string, lemma string, pos string, head_i int")
    got = rows(features.family_of_tokens(table, "tokens2"))
    assert got["w", "nouns_total"] == 1 and got["w", "words_different_from_lemma_total"] == 1 and got["w", "token_total"] == 1
    assert features.family_of_tokens(table.limit(0), "tokens2").count() == 0
    with pytest.raises(ValueError):
        features.family_of_tokens(table, "dialogue")
