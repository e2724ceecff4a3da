"""Large buckets of similar lines: exact links, dealt by rare shingles."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, line_dedup

ROWS = "doc_id long, text string"


def shingles(line):
    return {line[i : i + 9] for i in range(len(line) - 8)}


def similar(lines, t=0.8):
    sets = [shingles(x) for x in lines]
    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= t * (len(sets[i]) + len(sets[j]) - both):
                yield i, j


def groups(n, links):
    f = common.Forest()
    for i, j in links:
        f.union(i, j)
    return [f.find(i) for i in range(n)]


def made(seed, n):
    rng = np.random.default_rng(seed)
    makers = [lambda: f"repeated line number {rng.integers(0, 300):06d}", lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 5)), lambda: "x" * int(rng.integers(9, 40)), lambda: f"2024-01-{rng.integers(10, 30)} GET /page/{rng.integers(0, 99)} 200"]
    return sorted({makers[rng.integers(0, 4)]() for _ in range(n)})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forests_against_all_pairs(seed):
    lines = made(seed, 300)
    want = groups(len(lines), similar(lines))
    codes = line_dedup.shingle_codes(lines)
    assert groups(len(lines), line_dedup.few(codes, 0.8)) == want
    assert groups(len(lines), line_dedup.many(codes, 0.8)) == want


def test_similar_lines_share_a_rare_shingle(spark):
    lines = made(7, 400)
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, line_text string").repartition(3)
    keys = {}
    for r in line_dedup.rare_shingles(rows, 0.8).collect():
        keys.setdefault(r.id, set()).add(r.b0)
    assert all(keys[i] & keys[j] for i, j in similar(lines))


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    lines = made(11, 250)
    docs = spark.createDataFrame([(k // 5, x) for k, x in enumerate(lines)], ROWS).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    monkeypatch.setattr(line_dedup, "WHOLE", 1)  # every shared band is crowded
    out = line_dedup.line_dedup(docs).collect()
    kept = [x for r in out for x in r.text.split("\n") if x]
    assert len(kept) == len(set(groups(len(lines), similar(lines))))


def test_numbered_lines_in_time(spark):
    lines = [f"repeated line number {k:06d}" for k in range(20_000)]
    docs = spark.createDataFrame([(k, "\n".join(lines[k * 200 : (k + 1) * 200])) for k in range(100)], ROWS)
    began = time.time()
    r = line_dedup.line_dedup(docs).agg(F.sum("n_removed").alias("n")).first()
    assert r.n == 19_800  # lines of one hundred are one component
    assert time.time() - began < 60


def test_rewrite_in_linear_time(spark):
    rng = np.random.default_rng(4)
    text = "\n".join(f"{rng.integers(0, 10**15)} {rng.integers(0, 10**15)}" for _ in range(50_000))
    began = time.time()
    out = {r.doc_id: r.text for r in line_dedup.rewrite(spark.createDataFrame([(1, text), (2, text + "\nlast line")], ROWS)).collect()}
    assert out == {1: text, 2: "last line"}
    assert time.time() - began < 60
