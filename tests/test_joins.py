"""Joins by place, running sums and tree walks against plain versions."""

import random
import time

import pytest

from quillspark.operators import prefix, spans, trees

SPANS = "work string, begin int, end int"
WORDS = "work string, idx int, word_ix long"


def made(seed):
    rng = random.Random(seed)
    works = ["a", "b", None, "only spans", "only words"]
    found = [(w, b := rng.randrange(0, 3000), b + rng.randrange(1, 400)) for w in works[:4] for _ in range(60)]
    words = [(w, at, k) for w in [*works[:3], works[4]] for k, at in enumerate(sorted(rng.sample(range(2500), 120)))]
    return found, words


@pytest.mark.parametrize("size", [7, 100, 1 << 14])
def test_next_word(spark, size):
    found, words = made(1)
    got = spans.next_word(spark.createDataFrame(found, SPANS), spark.createDataFrame(words, WORDS), size).collect()
    want = [(w, b, e, min((ix for v, at, ix in words if v == w and at >= b), default=None)) for w, b, e in found]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("size", [7, 100, 1 << 14])
def test_outside(spark, size):
    found, words = made(2)
    found = [(w, *span) for w in {w for w, _, _ in found} for span in spans.merged([(b, e) for v, b, e in found if v == w][:6])] + [("a", 2999, 2999)]
    got = spans.outside(spark.createDataFrame(words, WORDS), spark.createDataFrame(found, SPANS), size).collect()
    want = [x for x in words if not any(w == x[0] and b <= x[1] < e for w, b, e in found)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and 0 < len(want) < len(words)


def test_joins_of_empty_tables(spark):
    none, words = spark.createDataFrame([], SPANS), spark.createDataFrame([("a", 0, 0)], WORDS)
    assert spans.next_word(none, words).count() == 0 and spans.outside(words, none).count() == 1
    assert spans.next_word(spark.createDataFrame([("a", 5, 6)], SPANS), words).first().word_ix is None


def test_literal_joins(spark):
    words = spark.createDataFrame([("a", 0, 0), ("a", 7, 1), ("a", 20, 2)], WORDS)
    found = spark.createDataFrame([("a", 5, 6), ("a", 9, 10), ("a", 30, 31)], SPANS)
    assert sorted((r.begin, r.word_ix) for r in spans.next_word(found, words).collect()) == [(5, 1), (9, 2), (30, None)]
    assert [r.idx for r in spans.outside(words, spark.createDataFrame([("a", 0, 8)], SPANS)).collect()] == [20]
    assert spans.merged([(5, 8), (0, 5), (10, 12)]) == [(0, 8), (10, 12)]


def test_no_window_over_a_whole_work(spark):
    """Ten thousand words of one work and small buckets: partitions of the sorts stay small, the answer the same."""
    words = spark.range(200_000).selectExpr("'a' as work", "cast(id * 5 as int) as idx", "id as word_ix")
    found = spark.range(0, 1_000_000, 997).selectExpr("'a' as work", "cast(id as int) as begin", "cast(id + 3 as int) as `end`")
    got = spans.next_word(found, words, 1000).selectExpr("sum(word_ix - (begin + 4) div 5) as off", "count(word_ix) as n", "count(*) as every").first()
    assert got.off == 0 and got.every - got.n <= 1


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(9)) for k in ("a", "b", None) for i in rng.sample(range(2000), 300)]
    got = prefix.running(spark.createDataFrame(rows, "key string, at int, n int"), "key", "at", "n", 17).collect()
    want = [(k, i, n, sum(m for q, j, m in rows if q == k and j < i), sum(m for q, _, m in rows if q == k)) for k, i, n in rows]
    assert sorted(map(repr, ((r.key, r["at"], r.n, r.n_before, r.n_total) for r in got))) == sorted(map(repr, want))


def below(head, k):
    out = {k}
    while more := {c for c, h in enumerate(head) if h in out and c not in out and h != c}:
        out |= more
    return out


def test_tour_against_climbing():
    rng = random.Random(3)
    for n in [*range(1, 30), 200]:
        head = [k if k == 0 else rng.randrange(0, k) for k in range(n)]
        places = rng.sample(range(n), n)
        head = [places[head[places.index(k)]] for k in range(n)]  # any order of the tokens
        enter, leave, depth = trees.tour(head)
        assert sorted(enter) == list(range(n))
        for k in range(n):
            assert {c for c in range(n) if enter[k] <= enter[c] < leave[k]} == below(head, k)
            assert depth[k] == (0 if head[k] == k else depth[head[k]] + 1)


def test_tour_of_odd_heads():
    assert trees.tour([-1, 5 - 5, 1])[0] == [0, 1, 2]
    enter, leave, depth = trees.tour([1, 2, 0, 0])  # a ring with a tail
    assert sorted(enter) == [0, 1, 2, 3] and depth[0] == 0 and leave[0] == 4
    assert trees.tour([]) == ([], [], [])


def test_long_sentences_in_linear_time():
    for head in ([max(0, k - 1) for k in range(200_000)], [0] * 200_000):
        began = time.time()
        trees.tour(head)
        assert time.time() - began < 5


TOKENS = "work string, sent_id int, tok_i int, lemma string, pos string, dep string, head_i int, verbform string"


def test_clause_features(spark):
    rows = [(0, "he", "PRON", "nsubj", 1, ""), (1, "say", "VERB", "ROOT", 1, "Fin"), (2, "that", "SCONJ", "mark", 4, ""), (3, "she", "PRON", "nsubj", 4, ""), (4, "leave", "VERB", "ccomp", 1, "Fin")]
    sentences = [(1, rows), (2, [(0, "sure", "ADJ", "ROOT", 0, ""), (1, "that", "SCONJ", "mark", 2, ""), (2, "go", "VERB", "ccomp", 0, "Fin")]), (3, [(0, "know", "VERB", "ROOT", 0, "Fin"), (1, "what", "PRON", "dobj", 2, ""), (2, "do", "VERB", "ccomp", 0, "Fin")]), (4, [(0, "what", "PRON", "ROOT", 0, ""), (1, ".", "PUNCT", "punct", 0, "")])]
    t = spark.createDataFrame([("a", s, *r) for s, own in sentences for r in own], TOKENS)
    got = {r.sent_id: (r.that_verb_ccomp, r.that_adj_ccomp, r.wh_free_rel, r.n_words) for r in trees.clause_features(t).collect()}
    assert got == {1: (True, False, False, 5), 2: (False, True, False, 3), 3: (False, False, True, 3), 4: (False, False, False, 1)}
    stats = {r.metric: r.value for r in trees.clause_stats(t, chunk=6, sentences=2).collect()}
    assert stats["token_total"] == 12 and stats["chunk_count_used"] == 2 and stats["that_adj_ccomp_per100_max"] == round(100 / 6, 4) and stats["wh_free_rel_total"] == 1


def test_long_sentence_of_tokens(spark):
    t = spark.range(5000).selectExpr("'a' as work", "0 as sent_id", "cast(id as int) as tok_i", "if(id = 4999, 'that', 'x') as lemma", "'VERB' as pos", "if(id = 4999, 'mark', 'ccomp') as dep", "cast(greatest(id - 1, 0) as int) as head_i", "'Fin' as verbform")
    began = time.time()
    r = trees.clause_features(t).first()
    assert r.that_verb_ccomp and r.n_words == 5000 and time.time() - began < 20


def test_speech_spans_from_sql(spark):
    spans.register_functions(spark)
    works = spark.createDataFrame([("a", "He: “Go on.” «No.» she"), ("b", None)], "work string, text string")
    got = spark.sql("select w.work, s.* from {works} w, lateral speech_spans(w.text, 'dialogue') s order by begin", works=works).collect()
    assert [tuple(r) for r in got] == [("a", 4, 12, "“Go on.”"), ("a", 13, 18, "«No.»")]
    assert spark.sql("select * from speech_spans('“a” “b”', 'quotes')").count() == 2
