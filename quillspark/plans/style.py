"""Queries of the stylometric families, the overuse report and the line cleaner over `documents`."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.operators import cleaner, features, lexical, overuse, scoring, spans, trees
from quillspark.plans import cleaner_sql, features_sql
from quillspark.functions.dialect import Duck, Spark
from quillspark.plans.registry import ORACLES, QUERIES, register
from quillspark.sources import sinks
from quillspark.sources.tables import read_table, spread


#: SQL of `works` for the checking engine: documents, and conversations written out as speech.
WORKS = {
    "documents": "with works as (select doc_id as work, text from documents),\n",
    "conversations": """with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations),
works as (select conv_id as work, string_agg('“' || upper(substr(t, 1, 1)) || substr(t, 2) || '.” ' || role || ' said. I heard it.', chr(10) order by turn, role, t) as text from turns group by conv_id),\n""",
}


#: English sentences that all features find something in; each takes a word from a row of the tables at the star.
SENTENCES = """Who is the * that she has not yet taken?|The house was taken by *, which was odd.|The old * was never forgotten.|There is nothing behind the * today.
I have to understand * and to go outside.|Having seen it, we stayed with *.|Because it rains, the * is nearly empty.|Although they knew *, nobody could say why.|If you go, the * must stay here.
After that we said that * is absolutely true.|However, he is rather a useful * indeed.|It is about noon and almost generally *.|She is very useful and truly harmless, kind of *.|Well, this is certainly a day for these *.
We may go, and they can see *.|They should try to see *.|He will tell them of *.|I believe that they announce * and suggest a plan.|It seems that it looks like *.|The useful and harmless * came.
And then he said nothing of *.|They neither saw * nor the others.|The murder of * was sexual and the dead said no more.|“I will go,” said my friend *.|I see that he is beautiful, but she does not know *.|He is here, in the kingdom near *.
How many of these * do you know?|A fragment of *.|— Come in, said the *.|She whispered that * was gone; he went for sure.|He met Robert and his * in town, and he has seen them.|He was walking, a * asking for no one.""".replace("\n", "|").split("|")
PER_TURN = 6


def sentence(number: str, word: str) -> str:
    """SQL of a sentence by its number, in both engines."""
    cases = " ".join(f"when {k} then concat('{a}', {word}, '{b}')" for k, (a, b) in enumerate(x.split("*") for x in SENTENCES))
    return f"case ({number}) % {len(SENTENCES)} {cases} end"


WORKS["prose"] = rf"""with turns as (select conv_id, turn, regexp_extract(lower(coalesce(text, '')), '\p{{L}}+') as w, coalesce(length(text), 0) as n from conversations),
lines as (select conv_id, turn, w, n, k, {sentence(f'turn * {PER_TURN} + n + k * 5', 'w')} as line from turns, range({PER_TURN}) r(k)),
works as (select conv_id as work, string_agg(line, ' ' order by turn, w, n, k) as text from lines group by conv_id),
"""


def prose_as_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work for each conversation, of sentences that take a word from each turn."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), r"\p{L}+", 0).alias("w"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    lines = F.expr(f"transform(sequence(0, {PER_TURN - 1}), k -> {sentence(f'turn * {PER_TURN} + n + k * 5', 'w')})")
    rows = turns.select("conv_id", "turn", "w", "n", lines.alias("x")).groupBy(F.col("conv_id").alias("work")).agg(F.array_sort(F.collect_list(F.struct("turn", "w", "n", "x"))).alias("t"))
    return rows.select("work", F.array_join(F.flatten("t.x"), " ").alias("text"))


def table(sf_dir: str, name: str) -> str:
    return f"parquet.`{sf_dir}/{name}.parquet`"


def docs_as_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("work"), "text"))


def speech_as_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as works in which every turn is quoted speech, its speaker and a narrator."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("t"))
    line = lambda x: F.concat(F.lit("“"), F.upper(F.substring(x["t"], 1, 1)), F.substring(x["t"], F.lit(2), F.length(x["t"])), F.lit(".” "), x["role"], F.lit(" said. I heard it."))
    rows = turns.groupBy(F.col("conv_id").alias("work")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "t"))).alias("x"))
    return rows.select("work", F.array_join(F.transform("x", line), "\n").alias("text"))


READERS = {"documents": docs_as_works, "conversations": speech_as_works, "prose": prose_as_works}


def add_family(which: str, table: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features.family(READERS[table](spark, sf_dir), which)

    name = f"features_{which}" if table == "documents" else f"features_{which}_{table}"
    QUERIES[name], ORACLES[name] = run, WORKS[table] + features_sql.family(Duck(), which)


for which in features.FAMILIES:
    for name in READERS:
        add_family(which, name)


@register("clean_line_rules", cleaner_sql.LINE_RULES)
def clean_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaner.line_rules(docs_as_works(spark, sf_dir)).withColumnRenamed("work", "doc_id")


@register("clean_text_rules", cleaner_sql.TEXT_RULES)
def clean_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaner.whole_text_rules(docs_as_works(spark, sf_dir)).withColumnRenamed("work", "doc_id")


@register("clean_full", cleaner_sql.CLEAN_FULL)
def clean_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaner.clean(docs_as_works(spark, sf_dir)).select(F.col("work").alias("doc_id"), "cleaned")


@register("clean_report", cleaner_sql.CLEAN_REPORT)
def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report(cleaner.clean(docs_as_works(spark, sf_dir)))


def spans_sql(table: str, ctes: list[tuple[str, str]], last: str) -> str:
    return WORKS[table] + ",\n".join(f"{n} as ({q})" for n, q in ctes) + f"\nselect work, cast(b as integer) as begin, cast(e as integer) as \"end\" from {last}"


@register("quote_spans", spans_sql("documents", features_sql.quote_ctes(features_sql.QUOTE_PATTERNS) + features_sql.merged_ctes(), "merged"))
def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.quote_spans(docs_as_works(spark, sf_dir))


@register("quote_spans_conversations", spans_sql("conversations", features_sql.quote_ctes(features_sql.QUOTE_PATTERNS) + features_sql.merged_ctes(), "merged"))
def speech_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.quote_spans(speech_as_works(spark, sf_dir))


@register("dialogue_spans", spans_sql("conversations", features_sql.quote_ctes(features_sql.DIALOGUE_PATTERNS), "found"))
def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dialogue_spans(speech_as_works(spark, sf_dir))


def place_ctes(name: str = "words") -> list[tuple[str, str]]:
    """`words`, or a table of another name, (work, idx, word_ix) of the runs of letters of `works`."""
    renamed = lambda x: re.sub(r"\b(pieces|piece|placed_pieces|found)\b", r"\1_w", x)
    return [(renamed(n), renamed(q)) for n, q in features_sql.quote_ctes([r"\p{L}+"])] + [(name, "select work, b as idx, row_number() over (partition by work order by b) - 1 as word_ix from found_w")]


def by_chunk_sql(table: str, ctes: list[tuple[str, str]], rows: str) -> str:
    ctes = place_ctes() + ctes + [("ixs", rows)]
    return WORKS[table] + ",\n".join(f"{n} as ({q})" for n, q in ctes) + "\nselect work, cast(floor(word_ix / 100) as bigint) as chunk_id, count(*) as n from ixs group by all"


SPEECH, QUOTED = features_sql.quote_ctes(features_sql.DIALOGUE_PATTERNS), features_sql.quote_ctes(features_sql.QUOTE_PATTERNS) + features_sql.merged_ctes()
NEXT_WORD = "select f.work, f.k, f.b, min(w.word_ix) as word_ix from found f left join words w on w.work = f.work and w.idx >= f.b group by f.work, f.k, f.b"
NARRATED = "select w.work, w.word_ix from words w where not exists (select 1 from merged m where m.work = w.work and w.idx >= m.b and w.idx < m.e)"


@register("dialogue_by_chunk", by_chunk_sql("conversations", SPEECH, NEXT_WORD))
def dialogue_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join of spans and words as tables."""
    return spans.dialogue_by_chunk(speech_as_works(spark, sf_dir))


@register("narrated_by_chunk", by_chunk_sql("documents", QUOTED, NARRATED))
def narrated_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval anti join of words and spans as tables."""
    return spans.narrated_by_chunk(docs_as_works(spark, sf_dir))


@register("narrated_by_chunk_conversations", by_chunk_sql("conversations", QUOTED, NARRATED))
def speech_narrated_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.narrated_by_chunk(speech_as_works(spark, sf_dir))


def said_sql(kind: str, last: str) -> str:
    ctes = QUOTED if kind == "quotes" else SPEECH
    return ",\n".join(f"{n} as ({q})" for n, q in ctes) + f"\nselect s.work, '{kind}' as kind, cast(b as integer) as begin, cast(e as integer) as \"end\", substr(w.text, cast(b + 1 as integer), cast(e - b as integer)) as said from {last} s join works w on w.work = s.work"


@register("speech_spans", WORKS["conversations"] + f"q as (select * from ({'with ' + said_sql('quotes', 'merged')})),\nd as (select * from ({'with ' + said_sql('dialogue', 'found')}))\nselect * from q union all select * from d")
def speech_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from SQL: a table function beside its rows."""
    spans.register_functions(spark)
    call = "select w.work, {kind} as kind, s.begin, s.`end`, s.said from {works} w, lateral speech_spans(w.text, {kind}) s"
    return reduce(DataFrame.unionByName, [spark.sql(call, works=speech_as_works(spark, sf_dir), kind=kind) for kind in ("quotes", "dialogue")])


OVERUSE = r"""counted as (select work, lower(tok) as word, count(*) as n, count(*) filter (regexp_matches(tok, '^[A-Z]')) as caps, min((part, i)) as first_at from toks group by work, lower(tok)),
shares as (select *, n * 1.0e0 / sum(n) over (partition by work) as book from counted),
ratios as (select work, word, n, caps * 1.0e0 / n as cap_ratio, book, r.ref_pct, book / r.ref_pct as ratio, first_at from shares join ref r using (word) where n >= 5 and caps * 1.0e0 / n < 0.9e0 and r.ref_pct > 0),
ranks as (select *, row_number() over (partition by work order by ratio desc, first_at) as rank from ratios where ratio > 1)
select work, cast(rank as bigint) as rank, word, cast(n as bigint) as n, cap_ratio, book * 100 as book_pct, ref_pct * 100 as ref_pct, (ratio - 1) * 100 as deviation_pct from ranks where rank <= 10"""
OVERUSE_WORDS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z'']+')"


@register(
    "overuse_by_source",
    f"""with toks as (select source as work, doc_id as part, unnest(range(len(w))) as i, unnest(w) as tok from (select source, doc_id, {OVERUSE_WORDS} as w from documents where lang = 'en')),
freq as (select lower(tok) as word, count(*) as n from toks group by lower(tok)), ref as (select word, n * 1.0e0 / (select count(*) from toks) as ref_pct from freq),
{OVERUSE}""",
)
def overuse_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overuse.by_source(spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")))


@register(
    "overuse_against_list",
    f"""with toks as (select doc_id as work, 0 as part, unnest(range(len(w))) as i, unnest(w) as tok from (select doc_id, {OVERUSE_WORDS} as w from documents)),
listed as (select lower(unnest({OVERUSE_WORDS})) as word from benchmark), ref as (select word, count(*) * 1.0e0 / (select count(*) from listed) as ref_pct from listed group by word),
{OVERUSE}""",
)
def overuse_against_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document on its own against a loaded list: here the words of the benchmark."""
    listed = overuse.word_counts(read_table(spark, sf_dir, "benchmark").select(F.lit(0).alias("work"), "text", F.lit(0).alias("part")))
    return overuse.report(docs_as_works(spark, sf_dir), overuse.frequencies(listed))


@register("first_sentence", r"""with t as (select doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as x from documents),
s as (select doc_id, regexp_extract(substr(x, 1, 50000), '(?s)^(.*?[.!?…][\x22»”)\]''›]*)(\s|$)', 1) as scan, regexp_extract(substr(x, 1, 50000), '^([^\n]*)', 1) as line from t),
p as (select doc_id, list_filter(string_split(regexp_replace(case when scan <> '' then scan else line end, '([.!?…][^\p{L}\p{N}]*)(\p{L})', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda c: regexp_matches(c, '\p{L}')) as parts from s),
f as (select doc_id, regexp_replace(coalesce(parts[1], ''), '^\s+|\s+$', '', 'g') as f from p)
select doc_id as text_name, f as first_sentence, cast(len(regexp_extract_all(f, '\p{L}+(?:[''’]\p{L}+)*')) as integer) as n_words_first_sentence, cast(length(f) as integer) as n_chars_first_sentence from f""")
def first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.first_sentence(docs_as_works(spark, sf_dir))


#: The coverage query's lemma: the word without an inflection's ending.
ENDING = "(?:ing|ed|es|en|er|s|e)$"
#: Lists of the coverage query: the words of the benchmark as vocabulary, and a rule-made rating by word length; a word without a rating has its lemma's.
COVERAGE = r"""with w as (select doc_id as work, lower(tok) as lower, i from ({tokens})),
c as (select work, cast(floor(i / 100) as bigint) as chunk_id, lower, regexp_replace(lower, '{ending}', '') as lemma from w),
v as (select distinct lower(tok) as word from ({vocabulary})),
r as (select word, length(word) * 0.25e0 as score from v where length(word) > 4 or length(word) = 3),
j as (select work, chunk_id, v.word as known, coalesce(r.score, m.score) as score from c left join v on c.lower = v.word left join r on c.lower = r.word left join r m on c.lemma = m.word)
select work, chunk_id, count(*) as n_words, sum(case when known is null then 1 else 0 end) * 100.0e0 / count(*) as oov_per100, sum(case when known is not null then 1 else 0 end) * 100.0e0 / count(*) as in_list_per100,
count(score) * 100.0e0 / count(*) as concreteness_coverage_percent, coalesce(avg(score), 0e0) as concreteness_mean_matched, coalesce(sum(score), 0e0) * 100.0e0 / count(*) as concreteness_sum_per100
from j group by work, chunk_id""".replace("{ending}", ENDING)


def list_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work, chunk_id, lower and lemma of the words of documents."""
    words = scoring.chunk_words(docs_as_works(spark, sf_dir)).select("work", "chunk_id", F.explode("words").alias("tok"))
    return words.select("work", "chunk_id", F.lower("tok").alias("lower"), F.regexp_replace(F.lower("tok"), ENDING, "").alias("lemma"))


def tokens(d, name: str, key: str, table: str) -> str:
    return d.exploded(key, d.matches("coalesce(text, '')", r"\p{L}+"), table)


@register("lexical_coverage", COVERAGE.replace("{tokens}", tokens(Duck(), "", "doc_id", "documents")).replace("{vocabulary}", tokens(Duck(), "", "item_id", "benchmark")))
def lexical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = list_words(spark, sf_dir)
    vocabulary = spark.sql(tokens(Spark(), "", "item_id", table(sf_dir, "benchmark"))).select(F.lower("tok").alias("word")).distinct()
    ratings = vocabulary.where("length(word) > 4 or length(word) = 3").select("word", F.expr("length(word) * 0.25d").alias("score"))
    return lexical.coverage(words, vocabulary, ratings)


def long_sql(features: list[str], totals: dict[str, str], chunks: str) -> str:
    """The checking engine's statistics by work: a row per metric."""
    parts = [(f"{f}_{name}", f"floor({how}({f}) * 10000 + 0.5e0 + 1e-9) / 10000") for f in features for name, how in (("avg", "avg"), ("min", "min"), ("max", "max"), ("sd", "stddev_pop"))]
    parts += [*totals.items(), ("token_total", "sum(n_words)"), ("chunk_count_used", "count(*)")]
    return " union all ".join(f"select work, '{name}' as metric, cast({e} as double) as value from {chunks} group by work" for name, e in parts)


COVERAGE_SQL = ORACLES["lexical_coverage"]
COVERAGE_TOTALS = {"oov_total": "sum(n_words - n_in)", "in_list_total": "sum(n_in)", "concreteness_matched_total": "sum(n_rated)"}


@register("lexical_stats", f"with k as ({COVERAGE_SQL}), chunks as (select *, round(in_list_per100 * n_words / 100) as n_in, round(concreteness_coverage_percent * n_words / 100) as n_rated from k) " + long_sql(lexical.COVERAGE_FEATURES, COVERAGE_TOTALS, "chunks"))
def lexical_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.coverage_stats(lexical_coverage(spark, sf_dir))


class Letters:
    """A deterministic scorer: labels by the letters of a text, pieces of four letters by their places, nothing after the 80th word."""

    def labels(self, texts):
        sums = [sum(map(len, t.split(" "))) for t in texts]
        return [[("NO_HUMOR", n % 101 / 100.0)] if n % 2 else [(" label_1", 0.9), ("Label_1 ", n % 101 / 100.0)] for n in sums]

    def pieces(self, words):
        return [[(None, 1.0), *((k, (len(w) + j) % 8 / 8.0) for k, w in enumerate(own[:80]) for j in range(-(-len(w) // 4)))] for own in words]


#: What that scorer and the folding of its output come to.
MODEL_SQL = r"""with w as (select doc_id as work, unnest(range(len(t))) as i, unnest(t) as tok from (select doc_id, regexp_extract_all(coalesce(text, ''), '\p{L}+') as t from documents)),
p as (select work, i, tok, case when i % 100 < 80 then list_avg(list_transform(range((length(tok) + 3) // 4), lambda j: ((length(tok) + j) % 8) / 8.0e0)) else 0e0 end as prob from w),
c as (select work, cast(floor(i / 100) as bigint) as chunk_id, count(*) as n_words, sum(length(tok)) as letters, sum(case when prob >= 0.5e0 then 1 else 0 end) as positive, sum(prob order by i) as mass from p group by work, cast(floor(i / 100) as bigint)),
s as (select *, letters % 101 / 100.0e0 as x, letters % 2 = 0 as even from c),
h as (select *, case when even then x when x > 0 then 1 - x else 0 end as humor_prob, case when not even then x when x > 0 then 1 - x else 0 end as nonhumor_prob from s),
chunks as (select work, chunk_id, n_words, humor_prob, nonhumor_prob, case when humor_prob >= 0.5 then 1 else 0 end as humor_label, 100.0e0 * positive / n_words as metaphor_word_percent, mass / n_words as metaphor_prob_mean, positive as metaphor_words_total from h)
"""
MODEL_FEATURES = ["humor_prob", "nonhumor_prob", "humor_label", "metaphor_word_percent", "metaphor_prob_mean", "metaphor_words_total"]


@register("model_scores", MODEL_SQL + long_sql(MODEL_FEATURES, {"humor_chunks_positive_total": "sum(humor_label)", "metaphor_words_positive_total": "sum(metaphor_words_total)"}, "chunks"))
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a scorer's output over the chunks of documents; any scorer fits, here one that needs no model file."""
    scored = scoring.score(scoring.chunk_words(docs_as_works(spark, sf_dir)), "letters", Letters)
    return lexical.model_stats(scoring.metaphor(scoring.humor(scored)))


#: A stand-in for a parser over the documents' words: sentences of 12 words, each word under the one at half its place.
PARSED = {
    "sent_id": "cast(i {div} 12 as int)",
    "tok_i": "cast(i as int)",
    "lemma": "case when i % 12 in (2, 9) then 'that' when i % 12 = 7 and length(tok) % 2 = 0 then 'what' else tok end",
    "pos": "case when length(tok) % 4 = 0 then 'VERB' when length(tok) % 4 = 1 then 'ADJ' when length(tok) % 4 = 2 then 'NOUN' else 'AUX' end",
    "dep": "case when i % 12 = 0 then 'ROOT' when i % 12 in (2, 9) and length(tok) % 3 > 0 then 'mark' when length(tok) % 3 = 0 then 'ccomp' when length(tok) % 5 = 0 then 'advcl' else 'nsubj' end",
    "head_i": "cast((i {div} 12) * 12 + (i % 12) {div} 2 as int)",
    "verbform": "case when length(tok) % 6 = 0 then 'Fin' else '' end",
}
PARSED_SQL = r"""with recursive w as (select doc_id as work, unnest(range(len(t))) as i, unnest(t) as tok from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') as t from documents)),
""" + f"t as (select work, {', '.join(f'{e.format(div="//")} as {n}' for n, e in PARSED.items())} from w),\n" + """up as (select work, sent_id, tok_i, tok_i as a, 0 as steps from t
  union all select up.work, up.sent_id, up.tok_i, t.head_i, steps + 1 from up join t on t.work = up.work and t.tok_i = up.a where t.head_i <> t.tok_i),
under as (select up.work, up.sent_id, up.a, max(case when t.dep = 'mark' and t.lemma = 'that' then 1 else 0 end) as holds_that, max(case when t.pos in ('AUX', 'VERB') and t.verbform = 'Fin' then 1 else 0 end) as holds_finite from up join t on t.work = up.work and t.tok_i = up.tok_i group by up.work, up.sent_id, up.a),
clause as (select up.work, up.tok_i, min(steps) as steps from up join t on t.work = up.work and t.tok_i = up.a where t.dep in ('acl', 'advcl', 'ccomp', 'relcl', 'xcomp') and t.head_i <> t.tok_i group by up.work, up.tok_i),
tops as (select x.work, x.sent_id, coalesce(up.a, x.tok_i) as a from t x left join clause c on c.work = x.work and c.tok_i = x.tok_i left join up on up.work = x.work and up.tok_i = x.tok_i and up.steps = c.steps where x.lemma in ('how', 'what', 'whatever', 'when', 'where', 'which', 'who', 'whoever', 'whom', 'why')),
free as (select tops.work, tops.sent_id, max(holds_finite) as hit from tops join under u on u.work = tops.work and u.a = tops.a group by tops.work, tops.sent_id),
verb as (select x.work, x.sent_id, max(holds_that) as hit from t x join t h on h.work = x.work and h.tok_i = x.head_i join under u on u.work = x.work and u.a = x.tok_i where x.dep = 'ccomp' and h.pos = 'VERB' group by x.work, x.sent_id),
adj as (select x.work, x.sent_id, max(holds_that * holds_finite) as hit from t x join under u on u.work = x.work and u.a = x.tok_i where x.pos = 'ADJ' group by x.work, x.sent_id),
sents as (select work, sent_id, cast(floor(min(tok_i) / 100) as bigint) as chunk_id from t group by work, sent_id),
flagged as (select s.work, s.chunk_id, sum(coalesce(v.hit, 0)) as h0, sum(coalesce(a.hit, 0)) as h1, sum(coalesce(f.hit, 0)) as h2 from sents s left join verb v on v.work = s.work and v.sent_id = s.sent_id left join adj a on a.work = s.work and a.sent_id = s.sent_id left join free f on f.work = s.work and f.sent_id = s.sent_id group by s.work, s.chunk_id),
sizes as (select work, cast(floor(tok_i / 100) as bigint) as chunk_id, count(*) as n_words from t group by work, cast(floor(tok_i / 100) as bigint)),
chunks as (select sizes.work, n_words, coalesce(h0, 0) as t0, coalesce(h1, 0) as t1, coalesce(h2, 0) as t2, coalesce(h0, 0) * 100.0e0 / n_words as that_verb_ccomp_per100, coalesce(h1, 0) * 100.0e0 / n_words as that_adj_ccomp_per100, coalesce(h2, 0) * 100.0e0 / n_words as wh_free_rel_per100 from sizes left join flagged using (work, chunk_id))
"""


@register("clause_features", PARSED_SQL + long_sql([f"{f}_per100" for f in trees.CLAUSE_FLAGS], {f"{f}_total": f"sum(t{k})" for k, f in enumerate(trees.CLAUSE_FLAGS)}, "chunks"))
def clause_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a parsed token table, over a stand-in parse of the documents."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    words = docs_as_works(spark, sf_dir).select("work", F.posexplode(found).alias("i", "tok"))
    return trees.clause_stats(words.select("work", *[F.expr(e.format(div="div")).alias(n) for n, e in PARSED.items()]))


#: Another stand-in for a parser, with all relations that features ask for: sentences of 14 tokens, a full stop last, each token under the one at half its place.
LEMMAS = "be have not say think very so rather about must go the there this who no house and by it like nothing well seem".split()
RELATIONS = "nsubj cop advcl acl mod advmod:neg amod acomp prep advmod conj neg dep ccomp".split()
CLASSES = "NOUN VERB AUX ADJ ADV DET PRON ADP SCONJ CCONJ PROPN NUM SYM PART INTJ VERB AUX ADV ADJ".split()


def picked(key: str, values: list[str]) -> str:
    return f"case ({key}) % {len(values)} " + " ".join(f"when {k} then '{x}'" for k, x in enumerate(values)) + " end"


def looked_up(key: str, values: list[str]) -> str:
    """The same for Spark, as one look-up: long chains of cases make methods that are never compiled."""
    return f"get(array({', '.join(map(repr, values))}), cast(({key}) % {len(values)} as int))"


def stand_in(pick: Callable[[str, list[str]], str]) -> dict[str, str]:
    return {
        "sent_id": "cast(i {div} 14 as int)",
        "tok_i": "cast(i % 14 as int)",
        "text": "case when i % 14 = 13 then '.' else tok end",
        "lemma": f"case when i % 14 = 13 then '.' when length(tok) % 3 = 0 then lower(tok) else {pick('length(tok) * 5 + i * 7', LEMMAS)} end",
        "pos": f"case when i % 14 = 13 then 'PUNCT' else {pick('length(tok) * 3 + i * 5', CLASSES)} end",
        "dep": pick("length(tok) + i * 3", RELATIONS),
        "tag": "case when length(tok) % 4 = 1 then 'VBN' else 'X' end",
        "verbform": pick("length(tok) + i * 2", ["Fin", "Part", "Inf", "Part", "Fin"]),
        "tense": pick("length(tok) * 2 + i", ["Past", "Pres", ""]),
        "head_i": "cast((i % 14) {div} 2 as int)",
    }


STAND_IN = stand_in(picked)
PARSED_CTES = [
    *place_ctes("runs"),
    ("p0", "select w.work, word_ix as i, idx, regexp_extract(substr(text, cast(idx + 1 as integer)), '^\\p{L}+') as tok from runs w join works t on t.work = w.work"),
    ("p1", "select work, i as n, idx, " + ", ".join(f"{e.format(div='//')} as {n}" for n, e in STAND_IN.items()) + " from p0"),
    ("p2", "select work, n as i, text as tok, lower(text) as lower, * exclude (work, n, text), false as is_space, pos = 'PUNCT' as is_punct, pos <> 'PUNCT' as is_alpha, pos = 'NUM' as like_num from p1"),
    ("p3", "select c.*, h.pos as head_pos, exists (select 1 from p2 x where x.work = c.work and x.sent_id = c.sent_id and x.head_i = c.tok_i and x.dep = 'cop') as cop_child from p2 c join p2 h on h.work = c.work and h.sent_id = c.sent_id and h.tok_i = c.head_i"),
    ("p4", "select *, not is_punct as w1, not is_punct and not like_num and pos <> 'SYM' as w2, is_alpha as w3, is_alpha and not like_num as w4 from p3"),
    ("tokens", "select *, " + ", ".join(f"sum(case when w{k} then 1 else 0 end) over (partition by work order by i rows between unbounded preceding and current row) - 1 as ix{k}" for k in (1, 2, 3, 4)) + " from p4"),
]


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spans.word_places(docs_as_works(spark, sf_dir)).withColumnsRenamed({"word_ix": "i", "word": "tok"})
    return words.select("work", "idx", *[F.expr(e.format(div="div")).alias(n) for n, e in stand_in(looked_up).items()])


def add_parsed(which: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens = parsed_documents(spark, sf_dir)
        return features.family_of_tokens(tokens.withColumns({"is_alpha": F.expr("pos <> 'PUNCT'"), "like_num": F.expr("pos = 'NUM'")}), which)

    QUERIES[f"features_{which}_parsed"] = run
    # works without words have no rows in a table of tokens
    ORACLES[f"features_{which}_parsed"] = WORKS["documents"].replace("from documents", rf"from documents where regexp_matches(coalesce(text, ''), '\p{{L}}')") + features_sql.family(Duck(), which, PARSED_CTES)


for which in ("tokens1", "sentences1", "sentences3", "readability"):
    add_parsed(which)
