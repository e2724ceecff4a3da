"""SQL of the stylometric features for the checking engine: rates per 100 words in 100-word chunks.

Token features are summed in the chunk of the token; sentence features are aggregated per
sentence and counted in the chunk of the sentence's first word. Per work each feature gets
mean, least, greatest and population deviation over its chunks (unweighted, last chunk kept).
"""

from __future__ import annotations

import re

from quillspark.functions import lexicons as L
from quillspark.plans.annotate_sql import annotate
from quillspark.functions.dialect import Spark, rounded, sql_list

CHUNK = 100


def flag(test: str) -> str:
    return f"sum(case when {test} then 1 else 0 end)"


def any_of(test: str) -> str:
    return f"max(case when {test} then 1 else 0 end)"


def bounded(p: str) -> str:
    """Word bounds by explicit classes: the engines disagree on what \\b means beside accented letters."""
    p = re.sub(r"\\b(?=[a-z(])", r"(?:^|[^\\p{L}\\p{N}_])", p)
    return p.replace(r"\b", r"(?:$|[^\p{L}\p{N}_])")


def windows(d: Spark) -> str:
    """Columns that look ahead: within the chunk (perfect aspect) and within the sentence."""
    s = "(partition by work, sent_id, is_space order by i)"
    skip, part = f"(pos in {sql_list(L.PASSIVE_SKIP_POS)} or lemma in {sql_list(L.NEGATIONS)} or {d.like('lower', "n['’]t$")})", "(verbform = 'Part' or tag = 'VBN')"
    c = f"(partition by work, w1, floor(ix1 / {CHUNK}) order by i)"
    skip3, part3 = f"(pos in {sql_list(L.PERFECT_SKIP_POS)} or lemma in {sql_list(L.PERFECT_SKIP)} or {d.like('lower', "n['’]t$")})", "verbform = 'Part'"

    def first(test: str, wanted: str, over: str, most: int) -> str:
        return "coalesce(case " + " ".join(f"when lead(case when {test} then 0 else 1 end, {k}) over {over} = 1 then lead(case when {wanted} then 1 else 0 end, {k}) over {over}" for k in range(1, most + 1)) + " end, 0)"

    inf = "case when pos in ('VERB', 'AUX') and verbform = 'Inf' then 1 else 0 end"
    return (
        f"select *, {first(skip, part, s, 4)} as then_participle, {first(skip3, part3, c, 3)} as then_perfect, "
        f"coalesce(max({inf}) over (partition by work, sent_id, is_space order by i rows between 1 following and 6 following), 0) as inf_right, "
        f"coalesce(lead({inf}) over {s}, 0) as inf_next, coalesce(max(case when tok = ',' then 1 else 0 end) over (partition by work, sent_id, is_space order by i rows between 1 following and 5 following), 0) as comma_right, "
        f"row_number() over {s} as nth, row_number() over (partition by work, sent_id, not is_space and not is_punct order by i) as nth_word from tokens"
    )


def token_features(d: Spark) -> dict[str, dict[str, str]]:
    """By word definition: feature to a test on a token; its number per 100 words of the chunk is the value."""
    verb = "pos in ('VERB', 'AUX')"
    key = f"(case when lemma in {sql_list(L.FIRST_PERSON + L.SECOND_PERSON + L.THIRD_PERSON + L.DEMONSTRATIVES + L.INDEFINITES)} then lemma else lower end)"
    isin = lambda words, x="lemma": f"{x} in {sql_list(words)}"
    groups = {"1p": L.FIRST_PERSON, "2p": L.SECOND_PERSON, "3p": L.THIRD_PERSON, "demonstrative": L.DEMONSTRATIVES, "indefinite": L.INDEFINITES}
    return {
        "1": {
            "past_per100": f"{verb} and tense = 'Past'",
            "present_per100": f"{verb} and tense = 'Pres'",
            "perfect_per100": "pos = 'AUX' and lemma = 'have' and verbform = 'Fin' and then_perfect = 1",
            "place_adverbials_per100": f"pos = 'ADV' and {isin(L.PLACE_ADVERBS)}",
            "time_adverbials_per100": f"pos = 'ADV' and {isin(L.TIME_ADVERBS)}",
            "pronouns_total_per100": isin([w for g in groups.values() for w in g], key),
            **{f"pronouns_{k}_per100": isin(g, key) for k, g in groups.items()},
            "nominal_suffix_per100": f"pos = 'NOUN' and {d.like('lemma', f'(?:{"|".join(L.NOMINAL_SUFFIXES)})$')}",
            "gerund_nominals_ing_per100": f"pos = 'NOUN' and ({d.like('lower', 'ing$')} or {d.like('lemma', 'ing$')})",
            "total_pps_per100": "pos = 'ADP' and dep = 'prep'",
            "attributive_adjs_per100": "pos = 'ADJ' and dep = 'amod' and head_pos in ('NOUN', 'PROPN')",
            "predicative_adjs_per100": "pos = 'ADJ' and (dep = 'acomp' or cop_child)",
            "total_adverbs_per100": "pos = 'ADV'",
        },
        "2": {
            "words_different_from_lemma_per100": "lemma <> lower",
            "verbs_per100": "pos = 'VERB'",
            "nouns_per100": "pos = 'NOUN'",
            "propn_per100": "pos = 'PROPN'",
            "death_words_per100": isin(L.DEATH),
            "sex_words_per100": isin(L.SEX),
            "total_flagged_words_per100": isin(L.DEATH + L.SEX),
        },
    }


def sentence_features(d: Spark) -> dict[str, dict[str, str]]:
    """By word definition: feature to its aggregate over a sentence's tokens; `txt` is the sentence's text."""
    isin = lambda words, x="lemma": f"{x} in {sql_list(words)}"
    verb, fin = "pos in ('VERB', 'AUX')", "pos in ('VERB', 'AUX') and verbform = 'Fin'"
    says = lambda p: f"case when {d.like('max(txt)', '(?i)' + bounded(p))} then 1 else 0 end"
    passive = any_of("pos = 'AUX' and lemma in ('be', 'get') and then_participle = 1")
    by = any_of("pos = 'ADP' and lemma = 'by'")
    analytic = any_of(f"dep = 'neg' or {d.like('dep', ':neg$')} or lower in ('not', 'n’t') or {d.like('lower', "n['’]t$")}")
    neither = f"{any_of("lower = 'neither'")} * {any_of("lower = 'nor'")}"
    synthetic = f"greatest({any_of("lower in ('nobody', 'nothing', 'none', 'nowhere', 'neither', 'without')")}, {says('no one')}, {neither})"
    part = lambda ing: any_of(f"verbform = 'Part' and {'' if ing else 'not '}{d.like('lower', 'ing$')} and (dep in ('advcl', 'acl') or nth <= 3 and comma_right = 1)")
    classed = lambda words, name, more="pos = 'ADV'": f"{flag(f'{isin(words)} and ({more})')} + {says(L.PHRASES[name])}"
    modal = lambda words: any_of(f"{verb} and {isin(words)} and inf_right = 1")
    subord = {f"{k}_subord_per100": says(L.PHRASES[k]) for k in ("causal", "concessive", "conditional", "other")}
    quoted = d.like("max(txt)", "[\\x22'“”‘’«»„‚‹›]")
    return {
        "1": {
            "direct_wh_questions_per100": f"case when {d.like('max(txt)', r'\?\s*$')} then greatest({any_of(isin(L.WH_WORDS, 'lower'))}, {says(r'\bwhat kind of\b|\bhow (?:many|much|long|often|far)\b')}) else 0 end",
            "by_passives_per100": f"{passive} * {by}",
            "agentless_passives_per100": f"{passive} * (1 - {by})",
            "copular_per100": f"greatest({any_of("lemma = 'be' and dep = 'cop'")}, {any_of("lemma = 'be'")} * (1 - {any_of("lemma = 'there'")}))",
            "existential_per100": f"{any_of("lemma = 'there'")} * {any_of("lemma = 'be'")}",
            "infinitive_per100": any_of("verbform = 'Inf'"),
            "present_participial_per100": part(True),
            "past_participial_per100": part(False),
            "rel_sentence_per100": says(r",\s*which\b"),
            **subord,
            "conjuncts_per100": classed(L.CONJUNCTS, "conjuncts", "pos in ('ADV', 'SCONJ', 'CCONJ')"),
            "downtoners_per100": classed(L.DOWNTONERS, "downtoners", "pos = 'ADV' or lemma = 'rather' and dep in ('advmod', 'mod')"),
            "hedges_per100": classed(L.HEDGES, "hedges", "pos = 'ADV' or lemma in ('about', 'around') and pos = 'ADP'"),
            "amplifiers_per100": classed(L.AMPLIFIERS, "amplifiers", "pos = 'ADV' and not (lemma = 'so' and nth_word = 1 and w1) and (dep = 'advmod' or head_pos in ('ADJ', 'ADV', 'VERB'))"),
            "emphatics_per100": classed(L.EMPHATICS, "emphatics"),
            "discourse_particles_per100": f"greatest({says(r'^\s*(?:well|so|anyway|now)\b')}, {any_of(f'w1 and nth_word = 1 and {isin(L.DISCOURSE)}')})",
            "demonstrative_dets_per100": flag(f"pos = 'DET' and {isin(L.DEMONSTRATIVES)}"),
            "demonstrative_prons_per100": flag(f"pos = 'PRON' and {isin(L.DEMONSTRATIVES)}"),
            "possibility_per100": modal(L.POSSIBILITY),
            "necessity_per100": f"greatest({modal(L.NECESSITY)}, {modal(L.NECESSITY_MORE)} * {any_of("lower = 'to' and inf_next = 1")})",
            "predictive_per100": f"greatest({modal(L.PREDICTION)}, {says(r'\b(?:am|is|are|was|were|be|been|being) going to \p{L}')})",
            "public_reporting_per100": flag(f"{verb} and {isin(L.PUBLIC_VERBS)}"),
            "private_cognition_per100": flag(f"{verb} and {isin(L.PRIVATE_VERBS)}"),
            "suasive_directive_per100": flag(f"{verb} and {isin(L.SUASIVE_VERBS)}"),
            "seem_appear_per100": f"{flag(f'{verb} and {isin(L.SEEM_VERBS)}')} + {says(r'\blook(?:s|ed|ing)? like\b')}",
            "phrasal_coord_per100": flag("dep = 'conj' and pos = head_pos and pos in ('ADJ', 'ADV', 'NOUN', 'VERB')"),
            "clause_coord_per100": f"greatest({says(rf'^\s*(?:{"|".join(L.CLAUSE_STARTS)})\b')}, {any_of(f'w1 and nth_word = 1 and {isin(L.CLAUSE_STARTS, "lower")}')}) * {any_of(f'not is_space and nth <= 7 and {fin}')}",
            "analytic_negation_per100": analytic,
            "synthetic_negation_per100": f"(1 - {analytic}) * {synthetic}",
        },
        "3": {
            "no_verb_fragments_per100": f"{any_of('is_alpha')} * (1 - {any_of(verb)})",
            "no_finite_fragments_per100": f"{any_of('is_alpha')} * (1 - {any_of(fin)})",
            "indirect_speech_per100": f"case when {quoted} then 0 else {any_of(f'{verb} and {isin(L.SPEECH_VERBS)}')} end",
        },
    }


def rate(x: str) -> str:
    return f"coalesce({x}, 0) * 100.0e0 / n_words"


def stats(d: Spark, features: dict[str, str], chunks: str, sums: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """From a chunk table to (work, metric, value); works without words have zeros."""
    names = list(features)
    sums = sums or {}
    inner = f"select work, chunk_id, n_words, {''.join(f'{x} as u{k}, ' for k, x in enumerate(sums.values()))}{', '.join(f'{e} as f{k}, coalesce(h{k}, 0) as t{k}' if e == rate(f'h{k}') else f'{e} as f{k}, 0 as t{k}' for k, e in enumerate(features.values()))} from {chunks}"
    parts = [f"avg(f{k}) as a{k}, min(f{k}) as b{k}, max(f{k}) as c{k}, stddev_pop(f{k}) as d{k}, sum(t{k}) as s{k}" for k in range(len(names))]
    parts += [f"sum(u{k}) as v{k}" for k in range(len(sums))]
    pairs = [(f"{n}_{s}", f"coalesce({rounded(f'{x}{k}')}, 0)") for k, n in enumerate(names) for x, s in zip("abcd", ("avg", "min", "max", "sd"), strict=True)]
    pairs += [(f"{n.removesuffix('_per100')}_total", f"coalesce(s{k}, 0)") for k, (n, e) in enumerate(features.items()) if e == rate(f"h{k}")] + [(n, f"coalesce(v{k}, 0)") for k, n in enumerate(sums)]
    pairs += [("token_total", "coalesce(tokens, 0)"), ("chunk_count_used", "coalesce(chunks, 0)"), ("chunk_size_words", str(CHUNK))]
    return [
        ("rated", inner),
        ("summed", f"select work, count(*) as chunks, sum(n_words) as tokens, {', '.join(parts)} from rated group by work"),
        ("every", "select w.work as w_, s.* from (select distinct work from works) w left join summed s on w.work = s.work"),
        ("result", d.long("w_ as work", pairs, "every")),
    ]


#: Patterns of quoted spans and of dialogue, one for each pair of marks and one for dash-led lines.
QUOTE_PATTERNS = [f"(?s){a}.*?{b}" for a, b in ('""', "''", "«»", "“”", "‘’")] + [r"(?m)^[ \t]*[—–-][ \t][^\n]*$"]
#: White space as the texts' readers know it; the engine's own class is of fewer characters.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DIALOGUE_PATTERNS = [f"(?s){a}{WHITE}*[A-Z].*?[.?!…,]{WHITE}*{b}" for a, b in ("«»", "“”", "„”", "‘’", "‚’", "‹›", '""')] + [rf"(?m)^[ \t]*[-—]{{1,2}}{WHITE}+[A-Z][^\n]*$"]


def quote_ctes(patterns: list[str]) -> list[tuple[str, str]]:
    """`found` (work, k, b, e): places of all matches of each pattern over `works`, in the checking engine's SQL.

    Matches are put between two control characters; lengths of the pieces between them add up to places.
    """
    pieces = " union all ".join(f"select work, {k} as k, string_split(regexp_replace(coalesce(text, ''), '{p.replace("'", "''")}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) as parts from works" for k, p in enumerate(patterns))
    return [
        ("pieces", pieces),
        ("piece", "select work, k, unnest(parts) as p, unnest(range(len(parts))) as j from pieces"),
        ("placed_pieces", "select work, k, j, length(split_part(p, chr(2), 1)) as n, coalesce(sum(length(replace(p, chr(2), ''))) over (partition by work, k order by j rows between unbounded preceding and 1 preceding), 0) as b from piece"),
        ("found", "select work, k, cast(b as bigint) as b, cast(b + n as bigint) as e from placed_pieces where j > 0"),
    ]


def merged_ctes() -> list[tuple[str, str]]:
    """`merged` (work, b, e): touching and overlapping spans of `found` as one."""
    return [
        ("fresh", "select *, case when b <= max(e) over (partition by work order by b, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from found"),
        ("islands", "select *, sum(new) over (partition by work order by b, e rows between unbounded preceding and current row) as island from fresh"),
        ("merged", "select work, min(b) as b, max(e) as e from islands group by work, island"),
    ]


def family(d: Spark, which: str, annotated: list[tuple[str, str]] | None = None) -> str:
    """SQL of one feature family over a table `works` (work, text), by the rules or another annotation of it."""
    word = {"tokens1": "1", "tokens2": "2", "sentences1": "1", "sentences3": "3", "readability": "2", "richness": "2", "narration": "2", "dialogue": "3"}[which]
    sums: dict[str, str] = {}
    w, ix, chunk = f"w{word}", f"ix{word}", f"floor(ix{word} / {CHUNK})"
    ctes = list(annotated or annotate(d, "works"))
    # a parser's tokens stand at their places, with blanks between
    blanks = "" if annotated is None else "coalesce(repeat(' ', cast(idx - lag(idx + length(tok)) over (partition by work, sent_id order by i) as integer)), '') || "
    if which.startswith("tokens"):
        tests = token_features(d)[word]
        ctes += [("ahead", windows(d)), ("chunked", f"select work, {chunk} as chunk_id, count(*) as n_words, {', '.join(f'{flag(t)} as h{k}' for k, t in enumerate(tests.values()))} from ahead where {w} group by work, {chunk}")]
        features = {n: rate(f"h{k}") for k, n in enumerate(tests)}
    elif which.startswith("sentences"):
        tests = sentence_features(d)[word]
        ctes += [
            ("ahead", windows(d)),
            ("texts", f"select work as tw, sent_id as ts, string_agg(x, '' order by i) as txt from (select work, sent_id, i, {blanks}tok as x from tokens) group by work, sent_id"),
            ("sents", f"select work, sent_id, min(case when {w} then {ix} end) as first_word, {', '.join(f'{t} as h{k}' for k, t in enumerate(tests.values()))} from ahead join texts on work = tw and sent_id = ts group by work, sent_id"),
            ("hits", f"select work as hw, floor(first_word / {CHUNK}) as hc, {', '.join(f'sum(h{k}) as h{k}' for k in range(len(tests)))} from sents where first_word is not null group by work, floor(first_word / {CHUNK})"),
            ("sizes", f"select work, {chunk} as chunk_id, count(*) as n_words from tokens where {w} group by work, {chunk}"),
            ("chunked", "select * from sizes left join hits on work = hw and chunk_id = hc"),
        ]
        features = {n: rate(f"h{k}") for k, n in enumerate(tests)}
    elif which == "readability":
        letters, groups = d.sub("lower", r"[^\p{L}]"), d.count("lower", "[aeiouy]+")
        syllables = f"case when {letters} = '' then 0 else greatest(1, {groups} - case when {groups} > 1 and {d.like('lower', 'e$')} and not {d.like('lower', '[aeiouy]le$')} then 1 else 0 end) end"
        ctes += [
            ("words", f"select work, {chunk} as chunk_id, sent_id, lemma, pos, length({letters}) as letters, {syllables} as syllables from tokens where {w}"),
            ("per_sent", "select work, chunk_id, sent_id, count(*) as n, sum(syllables) as syl, sum(letters) as let from words group by work, chunk_id, sent_id"),
            ("per_chunk", "select work, chunk_id, sum(n) as n_words, count(*) as sents, avg(n) as wps, avg(syl) as sps, sum(let) as let, sum(syl) as syl from per_sent group by work, chunk_id"),
            ("hapax", "select work as xw, chunk_id as xc, sum(case when n = 1 then 1 else 0 end) as once from (select work, chunk_id, lemma, count(*) as n from words group by work, chunk_id, lemma) g group by work, chunk_id"),
            ("marks", f"select work as mw, chunk_id as mc, count(*) as puncts from (select work, is_punct, {ix} as last_ix, floor({ix} / {CHUNK}) as chunk_id, max({ix}) over (partition by work) as end_ix from tokens) g where is_punct and last_ix >= 0 and last_ix < end_ix and floor((last_ix + 1) / {CHUNK}) = chunk_id group by work, chunk_id"),
            ("kinds", f"select work as kw, chunk_id as kc, {flag(f'pos in {sql_list(L.CONTENT_POS)}')} as content, {flag(f'pos not in {sql_list(L.CONTENT_POS)}')} as functional from words group by work, chunk_id"),
            ("chunked", "select *, puncts as h4, once as h5 from per_chunk left join hapax on work = xw and chunk_id = xc left join marks on work = mw and chunk_id = mc left join kinds on work = kw and chunk_id = kc"),
        ]
        features = {"words_per_sentence": "wps", "syllables_per_sentence": "sps", "letters_per_word": "let * 1.0e0 / n_words", "syllables_per_word": "syl * 1.0e0 / n_words", "punctuation_per100": rate("h4"), "hapax_lemma_per100": rate("h5"), "content_to_function_ratio": "case when functional = 0 then case when content > 0 then 9999.0e0 else 0 end else content * 1.0e0 / functional end"}
        sums = {"content_total": "content", "function_total": "functional", "sentence_total_used": "sents"}
    elif which == "narration":
        ctes += quote_ctes(QUOTE_PATTERNS) + merged_ctes()
        ctes += [
            ("said", "select distinct t.work as sw, t.i as si from tokens t join merged m on t.work = m.work and t.idx >= m.b and t.idx < m.e"),
            ("sents", f"select t.work, sent_id, min(case when {w} then {ix} end) as first_word, {flag(f'pos in {sql_list(["PRON", "DET"])} and lemma in {sql_list(L.NARRATOR)} and si is null')} as h0 from tokens t left join said on t.work = sw and t.i = si group by t.work, sent_id"),
            ("hits", f"select work as hw, floor(first_word / {CHUNK}) as hc, sum(h0) as h0 from sents where first_word is not null group by work, floor(first_word / {CHUNK})"),
            ("sizes", f"select work, {chunk} as chunk_id, count(*) as n_words from tokens where {w} group by work, {chunk}"),
            ("chunked", "select * from sizes left join hits on work = hw and chunk_id = hc"),
        ]
        features = {"first_person_narration_per100": rate("h0")}
    elif which == "dialogue":
        ctes += quote_ctes(DIALOGUE_PATTERNS)
        ctes += [
            ("placed", f"select f.work, f.b, f.e, f.k, min(t.{ix}) as ix from found f left join tokens t on t.work = f.work and t.{w} and t.idx >= f.b group by f.work, f.b, f.e, f.k"),
            ("hits", f"select work as hw, floor(ix / {CHUNK}) as hc, count(*) as h0 from placed where ix is not null group by work, floor(ix / {CHUNK})"),
            ("every_span", "select work as ew, count(*) as n_spans from found group by work"),
            ("sizes", f"select work, {chunk} as chunk_id, count(*) as n_words from tokens where {w} group by work, {chunk}"),
            ("chunked", "select sizes.*, h0, case when chunk_id = 0 then coalesce(n_spans, 0) else 0 end as spans from sizes left join hits on work = hw and chunk_id = hc left join every_span on work = ew"),
        ]
        features, sums = {"dialogue_per100": "coalesce(h0, 0) * 100.0e0 / n_words * 1"}, {"dialogue_total": "spans"}
    else:
        ctes += [("chunked", f"select work, {chunk} as chunk_id, count(*) as n_words, count(distinct lower) as lows, count(distinct lemma) as lemmas from tokens where {w} group by work, {chunk}")]
        features = {"ttr_word": "lows * 100.0e0 / n_words", "ttr_lemma": "lemmas * 100.0e0 / n_words"}
    ctes += stats(d, features, "chunked", sums)
    return ",\n".join(f"{n} as ({q})" for n, q in ctes) + "\nselect work, metric, value from result"
