"""The Merkle manifest against a plain tree in one process."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quillspark.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(s):
    return sha256(s.encode()).hexdigest()


def leaf(fields):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def path(levels, k):
    for level in levels[:-1]:
        start = k - k % 3
        yield level[start:k], level[k + 1 : start + 3]
        k //= 3


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) to the operator's rows."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for rank, s in enumerate(sources):
        for k, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            sides = [*path(trees[s], k), *path(top, rank)]
            lost = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            fold = leaf((*r[:4], r[4].replace("\n", ""))) if lost else own
            for before, after in sides:
                fold = digest("".join([*before, fold, *after]))
            out.append((r[0], own, trees[s][-1][0], top[-1][0], digest("".join(x for b, a in sides for x in [*b, *a])), fold, fold == top[-1][0]))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("tree", "index", "leaf", "found", "place", "root")})
    got = manifest.manifest(docs, found=manifest.without_line_feeds(F.col("doc_id"), F.col("text"))).collect()
    assert in_order(map(tuple, got)) == in_order(plain(rows))
    return got


def test_manifest(spark):
    text = lambda k: None if k % 11 == 0 else "" if k % 7 == 0 else f"line {k}\nnaïve 日本\n"
    rows = [(k, None if k % 13 == 0 else f"s{k % 4}" if k % 3 else "hot", None if k % 5 == 0 else "en", None if k % 6 == 0 else k, text(k)) for k in range(1, 900)]
    rows += [(1, "one", "fr", 2, "alone\n"), (-7, "é", None, None, "x" * 300_000 + "\n"), (None, "hot", "en", 1, "no id\n"), (4, "hot", "en", 1, "again"), (4, "hot", "en", 1, "other\n")]
    got = check(spark, rows)
    assert {r.verified for r in got} == {True, False} and len({r.root for r in got}) == 1


def test_rows_alike_are_leaves_of_their_own(spark):
    check(spark, [(7, "s", "en", 1, "same\n")] * 40 + [(8, "s", "en", 1, "same\n"), (None, None, None, None, None), (None, None, None, None, None)])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes_of_one_source(spark, n):
    got = check(spark, [(k, "s", "en", 0, f"{k}\n") for k in range(n)])
    assert {r.subroot for r in got} == {got[0].root}


def test_several_supersteps(spark):
    n = manifest.ARITY**manifest.LEVELS
    check(spark, [(k, "s", "en", 0, None) for k in range(3 * n + 1)] + [(k, f"t{k}", "en", 0, "x\n") for k in range(n + 5)])


def test_empty_table(spark):
    out = manifest.manifest(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[0] == "doc_id"
