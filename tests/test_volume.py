"""What queries shuffle and hold is in proportion to their input and small beside it."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from quillspark.operators import annotate, features, overuse, spans, trees
from quillspark.operators.annotate import Words
from quillspark.plans import style


def shuffled(spark, df):
    """Bytes that a query shuffles and spills."""
    def stages():
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() + x.diskBytesSpilled() for x in map(found.apply, range(found.size()))}

    before = stages()
    df().write.format("noop").mode("overwrite").save()
    return sum(n for k, n in stages().items() if k not in before)


def tokens(spark, n):
    """A parser's table of n tokens in works of 2,000."""
    return spark.range(n).selectExpr(
        "id div 2000 as work", "cast(id % 2000 div 14 as int) as sent_id", "cast(id % 14 as int) as tok_i", "cast(id % 2000 * 7 as int) as idx", "concat('w', conv(hash(id) % 5000 + 5000, 10, 36)) as text", "concat('w', conv(hash(id) % 500 + 500, 10, 36)) as lemma",
        "case id % 3 when 0 then 'VERB' when 1 then 'NOUN' else 'ADJ' end as pos", "case id % 5 when 0 then 'nsubj' when 1 then 'ccomp' else 'advcl' end as dep", "cast(id % 14 div 2 as int) as head_i", "case id % 4 when 0 then 'Fin' else 'Part' end as verbform", "'Past' as tense",
    )


def test_parsed_tokens_travel_packed(spark):
    assert shuffled(spark, lambda: features.family_of_tokens(tokens(spark, 200_000), "readability")) < 40 * 200_000
    fragments = features.parsed_fragments(tokens(spark, 200_000), features.SENTENCES)
    assert fragments.agg(F.sum("size"), F.sum(F.length("t") + F.length("head")) < 20 * 200_000).first()[:] == (200_000, True)


def test_tokens_of_one_place_have_a_fixed_order(spark):
    table = tokens(spark, 2000).unionByName(tokens(spark, 2000).withColumns({"text": F.lit("x"), "pos": F.lit("NOUN")}))
    for which in ("tokens1", "readability"):
        got = [sorted(map(tuple, features.family_of_tokens(table.repartition(k), which, sentences=10).collect())) for k in (1, 7)]
        assert got[0] == got[1]


def test_annotation_takes_bounded_memory():
    """A batch of many works, nearly all words different: what a worker holds at a time goes by the step, not by the batch or the words seen."""
    texts = [" ".join(f"w{chr(97 + k % 26)}{'abcdefghij'[j % 10]}{np.base_repr(k * 700 + j, 26)}." if j % 9 == 0 else f"V{np.base_repr(k * 700 + j, 36)}x" for j in range(700)) for k in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["work", "text"])
    assert batch.nbytes > 5 << 19
    words, seen = Words(), 0
    tracemalloc.start()
    for part in features.steps([batch]):
        assert part.num_rows == 1 or part.column("text").nbytes <= features.STEP_BYTES + 4 * part.num_rows + 64
        t = features.part_tokens(part, words)
        for which in ("tokens1", "sentences1"):
            features.rows_of(t, which, False)
        seen += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(texts)
    assert peak < 150e6, peak


def test_clause_tokens_travel_packed(spark):
    assert shuffled(spark, lambda: trees.clause_stats(tokens(spark, 200_000))) < 12 * 200_000


def test_clause_blocks_in_any_order(spark):
    """Sentences of a null work, blocks of any size and tokens in any order make the same features."""
    table = tokens(spark, 6000).withColumns({"lemma": F.expr("if(tok_i = 2, 'that', if(tok_i = 5, 'what', lemma))"), "dep": F.expr("if(tok_i = 2, 'mark', dep)"), "work": F.expr("nullif(work, 1)")})
    got = [sorted(map(repr, trees.clause_stats(table.repartition(k), sentences=n).collect())) for k, n in ((1, 1000), (5, 7))]
    assert got[0] == got[1] and any("that_verb" in x and "total" in x and "value=0.0" not in x for x in got[0])
    rows = [sorted(map(repr, trees.clause_features(x).collect())) for x in (table, table.repartition(5))]
    assert rows[0] == rows[1] and len(rows[0]) == 3 * 143


def test_words_of_no_list_are_not_shuffled(spark, monkeypatch):
    """Few of the words are on the list; with a list too long to broadcast the same comes out."""
    texts = spark.range(2000).selectExpr("nullif(id div 2, 7) as work", "concat(repeat('the Of ', 5 + cast(id % 3 as int)), array_join(transform(sequence(1, 200), k -> conv(id * 200 + k + 1000000, 10, 36)), ' x')) as text")
    ref = spark.createDataFrame([("the", 0.001), ("of", 0.5), ("x", 0.0)], "word string, ref_pct double")
    assert shuffled(spark, lambda: overuse.report(texts, ref)) < 500_000
    got = sorted(map(repr, overuse.report(texts, ref).collect()))
    monkeypatch.setattr(overuse, "BROADCAST_WORDS", 1)
    assert got == sorted(map(repr, overuse.report(texts, ref).collect())) and len(got) == 1000


def test_methods_of_parsed_queries_are_compiled(spark):
    """The virtual machine leaves methods of over 8,000 bytes to its interpreter, which takes many times as long."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan is the last one
    try:
        tokens = style.parsed_documents(spark, "/root/testdata/sf0.001").withColumns({"is_alpha": F.expr("pos <> 'PUNCT'"), "like_num": F.expr("pos = 'NUM'")})
        plan = features.parsed_fragments(tokens, features.SENTENCES)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) < 8000


def test_parsed_tokens_are_asked_only_what_a_family_needs(spark, monkeypatch):
    """Lemmas and classes are the parser's; syllables are counted once for each distinct word."""
    parts = pa.Table.from_batches(features.parsed_parts(tokens(spark, 20_000), features.SENTENCES).toArrow().to_batches()).combine_chunks().to_batches()[0]
    asked = []
    monkeypatch.setattr(annotate, "syllables", lambda w: asked.append(w) or 1)
    for name in ("lemma_of", "pos_of"):
        monkeypatch.setattr(annotate, name, None)
    words = Words()
    for which in ("tokens1", "sentences1", "sentences3"):
        features.rows_of(features.parsed_tokens(parts, words), which, True)
    assert not asked
    for _ in range(2):
        features.rows_of(features.parsed_tokens(parts, words), "readability", True)
    assert 0 < len(asked) == len(set(asked)) <= len(words.strings)


def test_chunks_of_one_part_are_not_added(spark):
    """Chunks that go over the ends of parts add up, those of one part stay; families in one table keep their own counts."""
    schema = "family string, work long, chunk_id long, n_words long, counts array<long>, words array<string>, words2 array<string>"
    part = lambda family, chunk, n, counts, *lists: (family, 1, chunk, n, counts, *(lists or (None, None)))
    rows = [part("tokens2", 0, 100, [1, 2]), part("tokens2", 1, 30, [3, 4]), part("tokens2", 1, 70, [5, 6]), part("tokens2", None, 0, [0, 0]), part("richness", 0, 2, [0, 0], ["a", "b"], ["a", "c"]), part("richness", 0, 2, [0, 0], ["a", "d"], ["c", "c"])]
    got = {(r.family, r.chunk_id): (r.n_words, r.counts) for r in features.added_up(spark.createDataFrame(rows, schema).repartition(3), ["tokens2", "richness"]).collect()}
    assert got == {("tokens2", 0): (100, [1, 2]), ("tokens2", 1): (100, [8, 10]), ("tokens2", None): (0, [0, 0]), ("richness", 0): (4, [3, 2])}
    few = features.added_up(spark.createDataFrame(rows[:4], schema), ["tokens2"])
    assert shuffled(spark, lambda: few) > 0 and sorted(map(repr, few.select("chunk_id", "n_words", "counts").collect())) == sorted(f"Row(chunk_id={k}, n_words={n}, counts={c})" for (f, k), (n, c) in got.items() if f == "tokens2")


def test_words_of_works_cut_anywhere(spark, monkeypatch):
    """Places and numbers of words are those of a plain search, however a long work is cut."""
    texts = ["", None, "ab é𝒳漢. - cd", "x" * 50 + " ǅ “y”1z" * 9, "\n", "a\0b", "end"]
    want = [(k, m.start(), i, m[0]) for k, t in enumerate(texts) for i, m in enumerate(regex.finditer(r"\p{L}+", t or ""))]
    for size in (1, 7, spans.SCAN):
        monkeypatch.setattr(spans, "SCAN", size)
        pieces, got, before = list(spans.slices(pa.array(texts))), [], {}
        for rows, places, found in pieces:
            for of, at, word in zip(*[x.tolist() for x in spans.words_in(found)[:2]], spans.words_in(found)[2].to_pylist(), strict=True):
                k = rows[of]
                got.append((k, places[of] + at, before.get(k, 0), word))
                before[k] = before.get(k, 0) + 1
        assert got == want
        assert size > 50 or len(pieces) > 3
    table = spark.createDataFrame(list(enumerate(texts)), "work long, text string")
    assert sorted(map(tuple, spans.word_places(table).collect())) == want


def test_text_of_tokens_at_odd_places():
    """Tokens lie at their places, or after the one before where places go back or overlap."""
    texts, idx, sizes = ["One", "é𝒳", ".", "a", "bcd", "x"], [5, 7, 20, 3, 1, 3], [3, 2, 1]
    column = pa.array(texts)
    distinct = (texts, np.arange(6))
    zeros = np.zeros(6, dtype=np.int64)
    columns = {"text": distinct, "lemma": distinct, "length": np.array([len(x) for x in texts]), "utf8": "".join(column.to_pylist()).encode(), "sent_id": zeros, "tok_i": np.arange(6), "idx": np.array(idx), "head_i": zeros, **dict.fromkeys(("pos", "dep", "form", "tense", *features.MARKS), zeros)}
    t = annotate.Parsed(np.array(sizes), np.array(sizes), columns, Words(), np.zeros((3, 4), dtype=np.int64), np.zeros((3, 4), dtype=np.int64))
    assert t.texts == ["Oneé𝒳" + " " * 10 + ".", "abcd", "x"]
