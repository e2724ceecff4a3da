"""Collocations against plain counting in one process."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least, longest=5, top=2000, percent=100):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    f = {key: a for key, a in f.items() if a >= least}
    covered = {(lang, ws[i : i + k]) for (lang, ws), a in f.items() for k in range(2, len(ws)) for i in range(len(ws) - k + 1) if 100 * a >= percent * f[lang, ws[i : i + k]]}
    out = {}
    for (lang, ws), a in f.items():
        if len(ws) > 1 and (lang, ws) not in covered:
            cuts = [(f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws))]
            score, _, l, r = min((1000 * a * n[lang] // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))  # noqa: E741
            out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted((lang, k + 1, ws.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for k, (s, a, ws, l, r) in enumerate(sorted(x)[:top]))


def made(seed, n=300):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "The", "of", "naïve", "É", "日本", "x" * 300, "new york", "a\tb", "#", "ß", " ", "und"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b"], p=[0.6, 0.2, 0.05, 0.02, 0.05, 0.04, 0.02, 0.01, 0.01]) for _ in range(rng.integers(0, 40)))
    return [(None if k % 17 == 0 else k // 2, None if k % 23 == 0 else text(), [None, "en", "und", "fr"][k % 4]) for k in range(n)]


@pytest.mark.parametrize("least, longest, percent, bits", [(2, 5, 100, 22), (3, 3, 60, 6), (20, 5, 80, 12), (300, 4, 100, 10)])
def test_against_plain_counting(spark, least, longest, percent, bits):
    rows = made(least)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("phrase", "n", "chunk", "k", "rank", "lang_")})
    got = collocations.collocations(docs, least=least, longest=longest, top=50, percent=percent, bits=bits).collect()
    assert sorted(map(tuple, got)) == plain(rows, least, longest, 50, percent)


def test_equal_hashes_are_still_two_phrases():
    """With all hashes alike the counts are exact."""
    words = collocations.Words([b"a b a b c d a b. c d", b"a b"], np.array([0, 1]), collocations.Powers())
    at = np.flatnonzero(words.runs(2))
    first, n, phrases = words.counted(at, 2, np.zeros(len(at), dtype=np.uint64))
    total = Counter()
    for f, c, p in zip(first, n, phrases.to_pylist(), strict=True):
        total[int(words.lang[f]), p] += int(c)
    assert total == {(0, "a b"): 3, (0, "b a"): 1, (0, "b c"): 1, (0, "c d"): 2, (0, "d a"): 1, (1, "a b"): 1}


def test_long_texts_are_cut_at_breaks(monkeypatch):
    text = ("some words here " * 20 + ". ") * 10_000
    parts = collocations.short([text.encode()])
    assert len(parts) > 2 and b"".join(parts) == text.encode() and all(p.endswith(b".") for p in parts[:-1])
    assert collocations.short([b"", b"x" * 5_000_000]) == [b"", b"x" * 5_000_000]


def test_long_text(spark):
    rows = [(1, "one two three, " * 200_000, "en"), (2, None, None), (3, "", "en")]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert list(map(tuple, got)) == [("en", 1, "one two three", 200_000, 200_000, 200_000, 600_000, 3000)]


def test_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None)], SCHEMA), least=1).count() == 0
