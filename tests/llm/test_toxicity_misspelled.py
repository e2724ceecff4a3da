"""Toxic documents whose terms are all misspelled: what the automaton finds that the lexicon alone does not."""

import os

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import toxicity

SF = os.environ.get("TOXIC_SF", "/root/testdata/sf0.01")


def misspelled(word, rng):
    """One letter among the first four left out, doubled by another, or replaced."""
    k = int(rng.integers(0, min(4, len(word) - 1)))
    return [word[:k] + word[k + 1 :], word[:k] + "q" + word[k:], word[:k] + "q" + word[k + 1 :]][int(rng.integers(0, 3))]


def test_misspelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    words, starts, _, _ = toxicity.learn_lexicon(toxicity.sample(docs.select("doc_id", "text"), labels, toxicity.MAX_LABELLED))
    lexicon = toxicity.Lexicon(words, starts)
    rng, made = np.random.default_rng(6), []
    toxic = docs.join(labels.where("toxic = 1"), "doc_id").select("doc_id", "text").orderBy("doc_id").collect()
    for r in toxic:
        out, n = [], 0
        for w in r.text.split(" "):
            hit = w.isascii() and w.isalpha() and len(w) >= 5 and lexicon.look(toxicity.plain(w.encode()))[0] in (1, 2)
            out.append(misspelled(w, rng) if hit else w)
            n += hit
        if n:
            made.append((10**9 + r.doc_id, " ".join(out)))
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    found = {}
    for edits in (True, False):
        got = toxicity.toxicity(rows, labels, misspellings=edits)
        found[edits] = got.where(F.col("doc_id") >= 10**9).agg(F.sum("predicted")).first()[0], got.join(labels.where("toxic = 0"), "doc_id").where("held_out").agg(F.sum("predicted"), F.count("*")).first()[:2]
    print(len(made), "misspelled toxic documents; found, and (false alarms, clean) held out:", found)
    assert found[True][0] > found[False][0] and found[True][0] >= 0.6 * len(made)
    assert found[True][1][0] <= 0.02 * found[True][1][1] + 1
