"""The quality classifier: features and updates against plain versions, held-out accuracy, and odd tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import classifier

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int"


def test_shapes():
    assert [classifier.shape(w) for w in (b"Hello", b"WORLD!!", b"a1b22", "É".encode(), b"###", b"")] == [b"Aa", b"A!", b"a0a0", b"a", b"#", b""]


def test_features_against_plain_counting():
    texts = [b"The cat the cat sat sat", b"", b"one", b"A b\tA b\n A b", b"  "]
    memo = classifier.Hashes()
    text, place, value = classifier.features(texts, memo)
    alone = [classifier.features([t], classifier.Hashes()) for t in texts]
    for k, (_, p, v) in enumerate(alone):  # a text's features depend on no other text
        assert place[text == k].tolist() == p.tolist() and np.allclose(value[text == k], v)

    def plain(t):
        ws = t.split()
        forms = [(classifier.shape(w), k > 0 and w == ws[k - 1]) for k, w in enumerate(ws)]
        grams = [(kind, tuple(x[k : k + n])) for kind, (x, n) in enumerate([([w.lower() for w in ws], 1), ([w.lower() for w in ws], 2), (forms, 1), (forms, 2), (forms, 3)]) for k in range(len(ws) - n + 1)]
        return sorted(Counter(grams).values())

    for t, (_, p, v) in zip(texts, alone, strict=True):  # no two of these few share a place
        counts = plain(t)
        assert len(p) == len(counts)
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts)) or 1
        assert np.allclose(sorted(v), [classifier.LENGTH * math.log1p(c) / norm for c in counts])


def test_updates_against_plain_ftrl():
    rng = np.random.default_rng(2)
    z, n = np.zeros(30), np.zeros(30)
    slow = [[0.0, 0.0] for _ in range(30)]

    def weight(zi, ni):
        return 0.0 if abs(zi) <= classifier.L1 else -(zi - math.copysign(classifier.L1, zi)) / ((classifier.BETA + math.sqrt(ni)) / classifier.ALPHA + classifier.L2)

    for _ in range(200):
        place = np.sort(rng.choice(30, 6, replace=False))
        value, label = rng.random(6) * 3, float(rng.integers(0, 2))
        classifier.updated(place, value, label, z, n)
        ws = [weight(*slow[p]) for p in place]
        p_ = 1 / (1 + math.exp(-sum(w * v for w, v in zip(ws, value, strict=True))))
        for p, v, w in zip(place, value, ws, strict=True):
            g = (p_ - label) * v
            sigma = (math.sqrt(slow[p][1] + g * g) - math.sqrt(slow[p][1])) / classifier.ALPHA
            slow[p] = [slow[p][0] + g - sigma * w, slow[p][1] + g * g]
    assert np.allclose(z, [s[0] for s in slow]) and np.allclose(n, [s[1] for s in slow])
    assert np.allclose(classifier.weights(z, n), [weight(*s) for s in slow])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.classify(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert len(held) > 50 and {r.quality for r in held} == {0, 1}
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").where("doc_id < 300") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.expr("if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality)"))
    one, two = ({r.doc_id: r.score for r in classifier.classify(d.repartition(n), x).collect()} for d, x, n in ((docs, labels, 2), (docs, turned, 5)))
    assert one == two


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (None, "a b", "q"), (4, "good words here", "q"), (4, "bad ### here", "q"), (5, "w " * 600_000, "q"), (6, "good words here", None)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 0), (4, 1), (None, 1), (5, 0), (5, 0), (99, 1)], LABELS)
    rows = classifier.classify(docs.withColumns({"turn": F.lit(0), "score": F.lit("x")}), labels).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows) and sum(r.held_out is None for r in rows) == 1
    same = [r.score for r in rows if r.doc_id in (1, 2)]
    assert same[0] == same[1]


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_without_labels(spark, rows):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    out = classifier.classify(docs, spark.createDataFrame(rows, LABELS)).collect()
    assert [(r.score, r.predicted) for r in out] == [(0.5, 1)] * 2
    assert classifier.classify(docs.limit(0), spark.createDataFrame(rows, LABELS)).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 50, f"text {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 50, k % 2) for k in range(200)], LABELS)
    assert classifier.sample(docs, labels, "quality", 10).count() == 10
