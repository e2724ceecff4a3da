"""Nulls, repeated rows, ties, clashing columns, empty tables and very long texts, where other tests leave them out."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, decontaminate, quality, simhash, substring_dedup, token_counts, toxicity

TURNS = "conv_id long, turn long, role string, text string"


def formatted(rows):
    nodes = chat.conversation_nodes(rows)
    return chat.read_back(chat.format_paths(nodes, chat.paths(nodes))).collect()


def test_chat_rows(spark):
    assert formatted(spark.createDataFrame([], TURNS)) == []
    rows = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, None, "user", "c"), (1, 1, "assistant", "d")], TURNS)
    got = {r.tree: r for r in formatted(rows.withColumns({c: F.lit("clash") for c in ("tree", "node", "parent", "score", "depth")}))}
    assert {k: r.loss for k, r in got.items()} == {None: "b", 1: "d"} and got[None].n_turns == 2


def test_chat_ties(spark):
    """Of leaves with one score the least is the best path."""
    tree = spark.createDataFrame([(1, 1, None, 0.0), (1, 3, 1, 2.0), (1, 2, 1, 2.0), (None, 7, None, 1.0)], "tree long, node long, parent long, score double")
    got = {(r.tree, r.leaf) for r in chat.paths(tree).collect()}
    assert (1, 2) in got and (1, 3) not in got


def test_quality_rows(spark):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (None, text, None, None), (2, None, "en", "s"), (3, "", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("measure", "bin", "fence", "t_lang")})
    got = quality.quality(docs).collect()
    assert len(got) == 5 and [r.base_failed for r in got if r.n_words == 0] == [True, True] and all(r.kept for r in got if r.n_words == 80)


ITEM = "which of these rivers runs through the old town before it reaches the northern sea and why"


def test_decontamination_rows(spark):
    items = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "y"), (None, ITEM + " not", "z"), (2, None, "x"), (3, "", "x")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(10, f"so {ITEM} they asked"), (None, ITEM), (11, None), (12, "nothing of it")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10, 1), (10, None), (None, 1), (None, None)}
    assert len(got) == 4  # an item that the table repeats is one
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    items = [(k, f"question {k} asks " + " ".join(f"part{(k * 7 + j) % 50}" for j in range(18))) for k in range(40)]
    docs = spark.createDataFrame([(k, f"he read: {items[k % 40][1]} and more of it") for k in range(80)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, table).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 7)
    assert sorted(map(tuple, decontaminate.contaminated(docs, table).collect())) == whole and len(whole) >= 80


@pytest.fixture(scope="module")
def long_text():
    return " ".join(f"w{k % 9973}, idiot{k % 7}" for k in range(260_000))  # over 2 MB


def test_long_texts(spark, long_text):
    assert len(long_text) > 3 << 20
    docs = spark.createDataFrame([(1, long_text, "en", "s"), (2, long_text + " end", "en", "s"), (3, "short", "en", "s")], "doc_id long, text string, lang string, source string")
    counts = {r.doc_id: r for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect()}
    assert counts[1].n_bytes == len(long_text) and counts[2].n_tokens == counts[1].n_tokens + 1
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == {1: 0, 2: 520_000, 3: 0}
    assert {r.doc_id: r.n_words for r in quality.quality(docs).collect()} == {1: 520_000, 2: 520_001, 3: 1}
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, labels).collect())
    items = spark.createDataFrame([(5, long_text[2_000_000:2_000_200])], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} == {1, 2}


def test_ties_of_labels(spark):
    docs = spark.createDataFrame([(k % 20, f"text {'vile' if k % 2 else 'kind'} {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 20, k % 2) for k in range(80)], "doc_id long, toxic int")
    train = toxicity.sample(docs, labels, 10)
    assert train.count() == 10 and train.select("doc_id").distinct().count() == 10  # a row for each id, however often it is there
