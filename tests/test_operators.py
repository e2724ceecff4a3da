import random
import re
import time
import zipfile

import duckdb
import pandas as pd
import pytest

from quillspark.operators import cleaner, features, lexical, overuse, scoring, spans
from quillspark.plans import catalog, cleaner_sql
from quillspark.sources import sinks, texts
from quillspark.streaming import works


def clean(spark, text, **more):
    return cleaner.clean(spark.createDataFrame([(1, text)], "work int, text string"), **more).first().cleaned


CLEANED = [
    ("the cat was here and\n\nsat on the mat.", "the cat was here and sat on the mat."),
    ("for it was a won-\nderful day for all of us.", "for it was a wonderful day for all of us."),
    ("He came 5th and ate 2x of the 3rd kind.", "He came 5th and ate x of the rd kind."),
    ("Please see http://x.com/p for more of it.", "Please see p for more of it."),
    ("He met her there.\n12\n---\nThey left at once.", "He met her there.\nThey left at once."),
    ("", ""),
    (None, ""),
    ("All of this came from example.community halls, and see also.", "All of this came from example.community halls, and see also."),
    ("They wrote to us at name@place.edu. Then all went home.", "They wrote to us at. Then all went home."),
    ("See more of it at http://x.y/z. Then leave for home.", "See more of it at. Then leave for home."),
    ("one_two was here ( 3 of 12 ) and went (Note: not\nthis) away.", "onetwo was here and went away."),
    ("The day was fine.\nChapter 12. The Voyage Out\nThe night was not.", "The day was fine.\nThe night was not."),
    ("The day was fine.\nchapter 1: a start\nThe night was not.", "The day was fine.\nThe night was not."),
    ("The day was fine.\nAnd this is the last book of them.\nThe night was not.", "The day was fine.\nThe night was not."),
    ("The day was fine.\nThe book that he had lost was there on the table.", "The day was fine.\nThe book that he had lost was there on the table."),
    ("The day was fine.\nStave of the first\nThe night was not.", "The day was fine.\nThe night was not."),
    ("The day was fine.\nNotes were taken by all who came.", "The day was fine.\nNotes were taken by all who came."),
    ("The day was fine.\ncs\nScanned with\nThe night was not.", "The day was fine.\nThe night was not."),
    ("The day was fine.\nCamscanner was the name of it.", "The day was fine.\nCamscanner was the name of it."),
    ("The day was fine.\n-12-\n. . .\n* term: of it\n(1) an item\n3. also one\niv. and this\na:\nThe night was not.", "The day was fine.\nThe night was not."),
    ("The day was fine.\nx: y: z\n12; and so on\nindex.html\nfoo |\nof May, 12.\nPrelude.\nintroduction\nThe night was not.", "The day was fine.\nThe night was not."),
    ("The day was fine.\n12 rooms were there, and all of them were empty.", "The day was fine.\nrooms were there, and all of them were empty."),
    ("©  2001 by him.\nThe day was fine.", "The day was fine."),
    ("THE START NOW.\nThe day was fine.", "The start now.\nThe day was fine."),
    ("Some words\nWilliam Blake\nThe day was fine, as all said.", "The day was fine, as all said."),
    ("(all of this goes)\nThe day was fine.", "The day was fine."),
    ("IT WAS the best of times, said he.", "It was the best of times, said he."),
    ("12—The day was fine, as all said.", "The day was fine, as all said."),
    ("The day [see it] was fine • again.3\nAll of it went well.", "The day was fine again.\nAll of it went well."),
    ("He left. \nThe day was fine.", "He left.\nThe day was fine."),
    ("He left.\t \nThe day was fine.", "He left.\nThe day was fine."),
    ("He said “Go now.” \t\nThe day was fine.", "He said “Go now.”\nThe day was fine."),
    ("He went to the far side of “there,”\nand then he came\n“Back again.”", "He went to the far side of “there,” and then he came\n“Back again.”"),
]


@pytest.mark.parametrize("text, out", CLEANED)
def test_cleaner(spark, text, out):
    assert clean(spark, text) == out


def test_cleaner_against_sql(spark):
    rng = random.Random(5)
    pieces = [line for text, _ in CLEANED for line in (text or "").split("\n")] + ["", "", "  ", "and so it went on", "The end came soon, as it must—", "He said “no.”", "in all", "A B stood there.", "JOHN", "JOHN SMITH WAS HERE.", "word9 and 9word", "(12) see [1] there.", "They left… 12", "He left. ", "They Came\t", "He said “Go now.”\t ", "Go on! \t", "A TITLE  ", "We all stayed.\r"]
    rows = [(k, t) for k, (t, _) in enumerate(CLEANED)]
    rows += [(len(rows) + k, "\n".join(rng.choices(pieces, k=rng.randint(1, 40)))) for k in range(400)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = dict(con.execute(cleaner_sql.CLEAN_FULL).fetchall())
    got = {r.work: r.cleaned for r in cleaner.clean(spark.createDataFrame(rows, "work long, text string")).collect()}
    wrong = [(t, got[k], want[k]) for k, t in rows if got[k] != want[k]]
    assert not wrong, (len(wrong), wrong[:3])
    assert sum(map(bool, want.values())) > 300


def long(spark, which, *works):
    rows = features.family(spark.createDataFrame(list(works), "work string, text string"), which).collect()
    return {(r.work, r.metric): r.value for r in rows}


def test_families_in_one_pass(spark):
    works = spark.createDataFrame([("a", "He said “Go on.” I did not go, and I never told her so. " * 12), ("b", None), ("b", "one")], "work string, text string")
    every = sorted(tuple(r) for r in features.stats(works).collect())
    assert every == sorted((f, *r) for f in features.FAMILIES for r in features.family(works, f).collect())


def test_narration_and_dialogue(spark):
    text = "I saw it. “I will go now,” he said. My friend left.\n- I know that\nWe stayed. «Come in.» “no capital.” Then us. " + "word " * 90 + "“Late!”"
    got = long(spark, "narration", ("a", text))
    assert got["a", "first_person_narration_total"] == 4  # I, My, We, us: not those in quotes or the dash-led line
    got = long(spark, "dialogue", ("a", text))
    assert got["a", "dialogue_total"] == 4 and got["a", "chunk_count_used"] == 2
    n = got["a", "token_total"] - 100
    assert got["a", "dialogue_per100_max"] == max(3, round(100 / n, 4)) and long(spark, "dialogue", ("a", "He left. “Go!"))["a", "dialogue_total"] == 0


DIALOGUE = [
    ("“ Hello there. ”", [(0, 16)]),
    ("“Hello,\n”", [(0, 9)]),
    ("“Hello” he said. “No, sir.”", [(0, 27)]),
    ("-- Hello there", [(0, 14)]),
    ("—Hello there", []),
    ("– Hello there", []),
    ("— Hello\n there", [(0, 7)]),
    ("--\n\n  Hello there.\nMore", [(0, 18)]),
    ("“no.” «Yes» “Well.” „Oh, so …”", [(12, 19), (20, 30)]),
    ("\"I.\" \"We.\"", [(0, 4), (5, 10)]),
    ("“A.” “.”", [(0, 4)]),
    ("‘One.’ and ‚Two!’", [(0, 6), (11, 17)]),
]


@pytest.mark.parametrize("text, out", DIALOGUE)
def test_dialogue_spans(spark, text, out):
    found = spans.dialogue_spans(spark.createDataFrame([("a", text)], "work string, text string")).collect()
    plain = [m.span() for a, b in spans.DIALOGUE for m in re.finditer(rf"(?s){a}\s*([A-Z].*?[\.?!…,])\s*{b}", text)] + [m.span() for m in re.finditer(r"(?m)^[ \t]*[-—]{1,2}\s+[A-Z].*$", text)]
    assert sorted((r.begin, r.end) for r in found) == sorted(plain)
    if out:
        assert sorted(plain) == sorted(out)


def test_dialogue_spans_in_linear_time(spark):
    for text in ("“Hello there " * 200_000, "“" * 500_000, "“A. " * 200_000, "“ \n" * 300_000 + "A"):
        began = time.time()
        spans.dialogue_in(text)
        assert time.time() - began < 5


def test_head_rules_in_linear_time(spark):
    began = time.time()
    assert clean(spark, "\n" * 8000 + "The day was fine, as all said.") == "The day was fine, as all said."
    assert time.time() - began < 10


def test_tail_may_be_left_out(spark):
    works = spark.createDataFrame([("a", "table " * 150), ("b", "short")], "work string, text string")
    got = {(r.work, r.metric): r.value for r in features.family(works, "tokens2", keep_tail=False).collect()}
    assert got["a", "chunk_count_used"] == 1 and got["a", "token_total"] == 100 and got["b", "token_total"] == 0


def test_tail_chunk_and_empty_work(spark):
    got = long(spark, "tokens2", ("a", "table " * 120 + "die " + "table " * 29), ("e", ""))
    assert [got["a", f"death_words_per100_{s}"] for s in ("avg", "min", "max", "sd")] == [1.0, 0.0, 2.0, 1.0]
    assert got["a", "token_total"] == 150 and got["e", "token_total"] == 0 and got["e", "death_words_per100_sd"] == 0


def test_sentence_features(spark):
    got = long(spark, "sentences1", ("a", "Even if it rains. What kind of man is he? I do not want nothing. It looks like rain."))
    per = 100 / got["a", "token_total"]
    value = lambda n: round(got["a", n + "_per100_avg"] / per, 3)
    assert value("concessive_subord") == 1 and value("conditional_subord") == 1 and value("direct_wh_questions") == 1
    assert value("analytic_negation") == 1 and value("synthetic_negation") == 0 and value("seem_appear") == 2


def test_syllables(spark):
    for word, n in {"table": 1, "whole": 2, "the": 1, "house": 1, "little": 1, "area": 2, "rhythm": 1}.items():
        assert long(spark, "readability", ("a", word))["a", "syllables_per_word_avg"] == n, word


def test_spans(spark):
    w = spark.createDataFrame([("a", "“Well, Go.” said he")], "work string, text string")
    assert spans.quote_spans(w).count() == 1 and spans.dialogue_spans(w).count() == 1


@pytest.mark.parametrize("text, out", [("What?! No", "What?!"), ('"Stop!" he said. Then.', '"Stop!"'), ("3.5 apples fell. X", "3.5 apples fell."), ("no end\nx", "no end"), ("12. Then he left. More.", ""), ("… … The end.", ""), ("Mr.Smith went. He", "Mr."), ("*** He left.\nMore.", "*** He left."), ("", ""), (None, ""), ("x" * 60_000, "x" * 50_000), ("  — 5.5 to go! ”) He", "— 5.5 to go!")])
def test_first_sentence(spark, text, out):
    assert spans.first_sentence(spark.createDataFrame([("a", text)], "work string, text string")).first().first_sentence == out


def test_lexical(spark):
    words = spark.createDataFrame([("a", 0, "dogs", "dog"), ("a", 0, "zz", "zz")], "work string, chunk_id int, lower string, lemma string")
    r = lexical.coverage(words, spark.createDataFrame([("dogs",)], "word string"), spark.createDataFrame([("dog", 4.0)], "word string, score double")).first()
    assert (r.oov_per100, r.in_list_per100, r.concreteness_coverage_percent, r.concreteness_mean_matched) == (50, 50, 50, 4)


def test_lists_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(w, c, x, x.rstrip("s")) for w in "ab" for c in range(3) for x in ("dogs", "dog", "zz", "zz", "cats")]
    words = spark.createDataFrame(rows, "work string, chunk_id int, lower string, lemma string")
    lists = spark.createDataFrame([("dogs",), ("dogs",), ("cat",)], "word string"), spark.createDataFrame([("dog", 4.0), ("cat", 1.5)], "word string, score double")
    small = sorted(lexical.coverage(words, *lists).collect())
    monkeypatch.setattr(lexical, "BROADCAST_WORDS", 0)
    assert sorted(lexical.coverage(words, *lists).collect()) == small
    assert (small[0].n_words, small[0].in_list_per100, small[0].concreteness_sum_per100) == (5, 20, 190)


HUMOR = [
    ([("LABEL_0", 0.8)], (0.2, 0.8, 0)),
    ([("HUMOR", 0.0), ("NO_HUMOR", 0.3)], (0.7, 0.3, 1)),
    ([("LABEL_1", 0.0)], (0.0, 0.0, 0)),
    ([(" label_1\n", 0.1), ("Label_1 ", 0.6)], (0.6, 0.4, 1)),
    ([("LABEL_1", 0.9), ("humor", 0.2), ("other", 1.0)], (0.2, 0.8, 0)),
    ([], (0.0, 0.0, 0)),
    ([(None, 0.4), ("NO_HUMOR", 1.0)], (0.0, 1.0, 0)),
]


@pytest.mark.parametrize("predictions, out", HUMOR)
def test_humor(spark, predictions, out):
    rows = spark.createDataFrame([(predictions,)], "predictions array<struct<label: string, score: double>>")
    r = scoring.humor(rows).first()
    assert (round(r.humor_prob, 6), round(r.nonhumor_prob, 6), r.humor_label) == out


def test_humor_of_one_label(spark):
    rows = spark.createDataFrame([(("humor ", 0.7),), (("LABEL_0", 1.0),), (("else", 0.25),)], "predictions struct<label: string, score: double>")
    assert [(round(r.humor_prob, 6), round(r.nonhumor_prob, 6)) for r in scoring.humor(rows).collect()] == [(0.7, 0.3), (0.0, 1.0), (0.75, 0.25)]


def test_metaphor(spark):
    r = scoring.metaphor(spark.sql("select array(struct(0 as word_ix, 0.4d as prob), struct(0 as word_ix, 0.8d as prob)) as pieces, 2 as n_words")).first()
    assert (r.metaphor_words_total, r.metaphor_word_percent, round(r.metaphor_prob_mean, 6)) == (1, 50, 0.3)


def test_chunk_words(spark):
    works = spark.createDataFrame([("a", "a1 b, c-d " * 60), ("b", None), ("c", "12 ..."), ("d", "x " * 100)], "work string, text string")
    rows = {(r.work, r.chunk_id): r.words for r in scoring.chunk_words(works).collect()}
    assert {k: len(w) for k, w in rows.items()} == {("a", 0): 100, ("a", 1): 100, ("a", 2): 40, ("d", 0): 100} and rows["a", 0][:4] == ["a", "b", "c", "d"]


class Loud:
    """A scorer that notes how often it is made in its worker."""

    made = 0

    def __init__(self):
        Loud.made += 1

    def labels(self, texts):
        return [[("HUMOR", len(t) / 1000), ("made", float(Loud.made))] for t in texts]

    def pieces(self, words):
        return [[(None, 1.0), *((k, len(w) / 10) for k, w in enumerate(own))] for own in words]


def test_scorer(spark):
    works = spark.createDataFrame([(k, "word longerword " * 230) for k in range(20)], "work int, text string").repartition(5)
    out = scoring.score(scoring.chunk_words(works), "loud", Loud, batch=3)
    rows = scoring.metaphor(scoring.humor(out)).collect()
    assert len(rows) == 100 and {round(r.humor_prob, 6) for r in rows} == {round(50 * 16 / 1000 - 0.001, 6), round(30 * 16 / 1000 - 0.001, 6)}
    assert {r.metaphor_word_percent for r in rows} == {50.0} and {round(r.metaphor_prob_mean, 6) for r in rows} == {0.7}
    assert max(p.score for r in rows for p in r.predictions if p.label == "made") == 1.0  # once in a worker


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "12_title_here.txt").write_bytes(b"a\xff b\nc")
    (tmp_path / "notes.TXT").write_text("x")
    assert [(r.book_no, r.text) for r in texts.read_raw(spark, str(tmp_path)).collect()] == [(12, "a b\nc")]
    assert [r.file_name for r in texts.skipped(spark, str(tmp_path)).collect()] == ["notes.TXT"]
    f = tmp_path / "freq.tsv"
    f.write_text("Rank\t Word\tCount (per billion)\n1\ta\t10\n2\tA\t30\n3\tb\t60\n4\tnull\t5\n5\tc\tx\n")
    assert {r.word: r.ref_pct for r in texts.read_frequency_list(spark, str(f)).collect()} == {"a": 0.3, "b": 0.6}
    v = tmp_path / "voc"
    v.write_text("1 The 5\nx\n2 of 4\n")
    assert {r.word for r in texts.read_vocabulary(spark, str(v)).collect()} == {"the", "of"}
    c = texts.concreteness(spark.createDataFrame([("Dog", "4,5"), ("dog", "3.5"), ("x", "?")], "Word string, `Conc.M` string")).collect()
    assert [(r.word, r.score) for r in c] == [("dog", 4.0)]
    out = cleaner.clean(spark.createDataFrame([("a", "The cat sat.")], "work string, text string"))
    assert sinks.zip_texts(out, str(tmp_path / "z")) == {"files": 1, "n_in": 12, "n_out": 12, "reduction": 0.0}
    with zipfile.ZipFile(next((tmp_path / "z").iterdir())) as z:
        assert z.namelist() == ["a_cleaned.txt"] and z.read("a_cleaned.txt") == b"The cat sat."
    assert sinks.totals(out).first().files == 1


def test_written_works_are_read_again(spark, tmp_path):
    works = spark.createDataFrame([("1_a b=c", "The cat sat on the mat.\nIt slept."), ("2_b", "")], "work string, text string")
    sinks.write_texts(cleaner.clean(works), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1_a b=c_cleaned.txt", "2_b_cleaned.txt"]
    assert {(r.work, r.text.strip()) for r in texts.read_works(spark, str(tmp_path / "out")).collect()} == {("1_a b=c", "The cat sat on the mat.\nIt slept."), ("2_b", "")}
    assert texts.read_works(spark, [str(tmp_path / "out" / "2_b_cleaned.txt")]).count() == 1
    for read in (lambda: texts.read_works(spark, str(tmp_path), "*.none"), lambda: texts.read_raw(spark, str(tmp_path / "out"), 5, 9)):
        with pytest.raises(FileNotFoundError):
            read()


def test_feature_tables(spark, tmp_path):
    works = spark.createDataFrame([("b", "Stop! he said."), ("a", "“Why, then?” Because.")], "work string, text string")
    stats = features.family(works, "richness")
    sinks.write_feature_csv(stats, ["a", "b"], str(tmp_path / "x" / "f.csv"), ["ttr_word_avg", "token_total"])
    assert (tmp_path / "x" / "f.csv").read_text() == "metric,a,b\nttr_word_avg,100.0,100.0\ntoken_total,3.0,3.0\n"
    sinks.write_first_sentences(spans.first_sentence(works), ["a", "b"], str(tmp_path / "n.csv"), str(tmp_path / "t.csv"))
    assert (tmp_path / "n.csv").read_text() == "metric,a,b\nn_words_first_sentence,2.0,1.0\nn_chars_first_sentence,12.0,5.0\n"
    assert [line.split(",")[0] for line in (tmp_path / "t.csv").read_text().splitlines()] == ['"text_name"', '"a"', '"b"']


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1_x.txt").write_bytes(b"The cat\xff sat on the mat.\nAll day it sat.")
    works.clean_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (tmp_path / "in" / "2_y.txt").write_text("It slept all day.")
    works.clean_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {(r.work, r.cleaned) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("1_x", "The cat sat on the mat.\nAll day it sat."), ("2_y", "It slept all day.")}


def test_spreadsheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "r.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Word</t></si><si><t>Conc.M</t></si><si><r><t>do</t></r><r><t>g</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>9</v></c><c r="C2"><v>4.5</v></c></row><row><c r="A3" t="inlineStr"><is><t>Cat</t></is></c></row></sheetData></worksheet>')
    table = texts.read_spreadsheet(spark, str(tmp_path / "r.xlsx"))
    assert table.columns == ["Word", "Conc.M"] and [tuple(r) for r in table.collect()] == [("dog", "4.5"), ("Cat", None)]
    assert [tuple(r) for r in texts.concreteness(table).collect()] == [("dog", 4.5)]


def test_overuse(spark):
    docs = spark.createDataFrame([("a", "the cat the cat the cat the cat the cat dog dog dog dog dog Bob Bob Bob Bob Bob"), ("b", None), ("c", "the")], "work string, text string")
    ref = spark.createDataFrame([("the", 0.5), ("cat", 0.1), ("dog", 0.1), ("bob", 0.1), ("zero", 0.0)], "word string, ref_pct double")
    out = overuse.report(docs, ref)
    assert [(r.work, r.rank, r.word, r.n, round(r.deviation_pct, 6)) for r in out.orderBy("rank").collect()] == [("a", 1, "cat", 5, 150.0), ("a", 2, "dog", 5, 150.0)]
    assert [r.line for r in sinks.overuse_lines(out).collect()][0] == "1. cat 150.0% (text 25.0000% vs ref 10.0000%, count 5, cap_ratio 0.00)"


@pytest.mark.parametrize("name", ["overuse_by_source", "overuse_against_list", "features_richness", "features_tokens1", "features_sentences1_conversations", "features_narration_conversations", "features_dialogue_conversations", "quote_spans_conversations", "dialogue_spans", "clean_line_rules", "clean_text_rules", "clean_full", "clean_report", "clause_features", "first_sentence", "lexical_coverage", "lexical_stats", "model_scores"])
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = con.execute(catalog.ORACLES[name]).df()[list(got.columns)]
    key = lambda f: sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in f.itertuples(index=False))
    assert key(got) == key(want)
