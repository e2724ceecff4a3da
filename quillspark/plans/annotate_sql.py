"""Rule annotator: a text as a token table, in the checking engine's SQL.

Columns: work, i (token number), idx (character offset), tok, lower, lemma, pos, tag, tense,
verbform, dep and head_pos (null: no parser), is_space, is_punct, is_alpha, like_num, sent_id
and the word predicates w1 to w4 with running word numbers. A table of the same columns from
any other annotator can take its place.
"""

from __future__ import annotations

from quillspark.functions.lexicons import ADPOSITIONS, ADVERBS, DETERMINERS, IRREGULAR, MODALS, PARTICIPLES, PRONOUNS, SUBORDINATORS, VERBS
from quillspark.functions.dialect import TOKEN, Spark, sql_list

def lemma(d: Spark) -> str:
    forms = " ".join(f"when lower in {sql_list(v.split())} then '{k}'" for k, v in IRREGULAR.items())
    verbs = sql_list(VERBS)
    ed, ing = d.sub("lower", "(?:ed|ing)$"), d.sub("lower", "ies$", "y")
    return f"""case {forms}
        when {d.like("lower", "^..+(?:ed|ing)$")} and {ed} in {verbs} then {ed}
        when {d.like("lower", "^..+(?:ed|ing)$")} and {ed} || 'e' in {verbs} then {ed} || 'e'
        when {d.like("lower", "^..+ied$")} and {d.sub("lower", "ied$", "y")} in {verbs} then {d.sub("lower", "ied$", "y")}
        when {d.like("lower", "^..+ies$")} then {ing}
        when {d.like("lower", "(?:ch|sh|ss|x)es$")} then {d.sub("lower", "es$")}
        when {d.like("lower", "[^su]s$")} and not {d.like("lower", "(?:is|’s|'s)$")} and length(lower) > 3 then {d.sub("lower", "s$")}
        else lower end"""


def pos(d: Spark) -> str:
    return f"""case when is_space then 'SPACE' when tok in ('$', '+', '<', '=', '>', '^', '`', '|', '~') then 'SYM' when is_punct then 'PUNCT' when like_num then 'NUM'
        when lemma = 'be' or lower in {sql_list(MODALS)} or lemma in ('have', 'do') then 'AUX'
        when lower in ('to', 'not') or {d.like("lower", "n['’]t$")} then 'PART'
        when lower in ('and', 'or', 'but', 'nor') then 'CCONJ'
        when lower in {sql_list(PRONOUNS)} then 'PRON' when lower in {sql_list(DETERMINERS)} then 'DET'
        when lower in {sql_list(ADVERBS)} or {d.like("lower", "^..+ly$")} then 'ADV'
        when lower in {sql_list(SUBORDINATORS)} then 'SCONJ' when lower in {sql_list(ADPOSITIONS)} then 'ADP'
        when lemma in {sql_list(VERBS)} then 'VERB'
        when {d.like("lower", "(?:tion|sion|ment|ness|ity|ship|hood|ance|ence)$")} then 'NOUN'
        when {d.like("lower", "^...+ed$")} then 'VERB'
        when {d.like("lower", "(?:ous|ful|ive|able|ible|ish|less)$")} then 'ADJ'
        when {d.like("tok", "^[A-Z]")} and not starts then 'PROPN' else 'NOUN' end"""


def annotate(d: Spark, works: str) -> list[tuple[str, str]]:
    """Common table expressions from `works` (work, text) to `tokens`."""
    w = "partition by work order by i"
    n = "(partition by work, sent_id, is_space order by i)"
    before = f"({w} rows between unbounded preceding and 1 preceding)"
    return [
        ("tok0", d.exploded("work", d.matches("coalesce(text, '')", TOKEN), works)),
        (
            "tok1",
            f"select work, i, tok, lower(tok) as lower, coalesce(sum(length(tok)) over {before}, 0) as idx, {d.like('tok', r'^\s')} as is_space, {d.like('tok', r'^\p{L}+$')} as is_alpha, "
            f"{d.like('tok', r'^\p{N}+$')} or lower(tok) in ('zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'hundred', 'thousand', 'million') as like_num, "
            f"{d.like('tok', r'^[^\s\p{L}\p{N}]$')} and tok not in ('$', '+', '<', '=', '>', '^', '`', '|', '~') as is_punct from tok0",
        ),
        ("tok2", f"select *, coalesce(not is_space and not is_punct and max(case when tok in ('.', '!', '?', '…') then i end) over {before} > coalesce(max(case when not is_space and not is_punct then i end) over {before}, -1), false) or (not is_space and not is_punct and max(case when not is_space and not is_punct then i end) over {before} is null) as starts from tok1"),
        ("tok3", f"select *, greatest(sum(case when starts then 1 else 0 end) over ({w} rows between unbounded preceding and current row), 1) as sent_id, {lemma(d)} as lemma from tok2"),
        ("tok4", f"select *, {pos(d)} as pos from tok3"),
        (
            "tok5",
            f"select *, case when pos not in ('VERB', 'AUX') then '' when lower in {sql_list(PARTICIPLES)} or {d.like('lower', '^..+(?:ed|ing)$')} and lemma <> lower then 'Part' "
            f"when lower = lemma and lag(lower) over (partition by work, sent_id order by i) is not null and coalesce(lag(case when is_space then null else lower end) over ({w}), lag(lower, 2) over ({w})) in {sql_list([*MODALS, 'to'])} then 'Inf' else 'Fin' end as verbform, "
            f"case when pos not in ('VERB', 'AUX') then '' when {d.like('lower', 'ed$')} or lower in ('was', 'were', 'had', 'did', 'said', 'went', 'saw', 'knew', 'thought', 'told', 'took') then 'Past' when {d.like('lower', 'ing$')} then 'Pres' when lower in {sql_list(PARTICIPLES)} then 'Past' else 'Pres' end as tense, "
            f"coalesce(lead(pos) over {n}, '') as after, coalesce(lag(pos) over {n}, '') as before, coalesce(lag(pos, 2) over {n}, '') as before2, coalesce(lag(lemma) over {n}, '') = 'be' as be_before from tok4",
        ),
        (
            "tok5d",
            f"select *, case when is_space then '' when lower = 'not' or {d.like('lower', "n['’]t$")} then 'neg' when pos = 'ADJ' and after in ('NOUN', 'PROPN') then 'amod' when pos = 'ADJ' and be_before then 'acomp' "
            "when pos = 'ADP' and after in ('ADJ', 'DET', 'NOUN', 'NUM', 'PRON', 'PROPN') then 'prep' when pos = 'ADV' and after in ('ADJ', 'ADV', 'VERB') then 'advmod' "
            "when pos in ('ADJ', 'ADV', 'NOUN', 'VERB') and before = 'CCONJ' and before2 = pos then 'conj' else '' end as dep from tok5",
        ),
        ("tok5h", "select *, case when dep in ('amod', 'advmod') then after when dep = 'conj' then before2 when dep in ('acomp', 'prep') then before else '' end as head_pos, false as cop_child from tok5d"),
        (
            "tok6",
            f"select *, case when verbform = 'Part' and tense = 'Past' then 'VBN' else '' end as tag, not is_space and not is_punct as w1, not is_space and not is_punct and not like_num and pos <> 'SYM' and {d.like('tok', r'\p{L}')} as w2, is_alpha as w3, is_alpha and not like_num as w4 from tok5h",
        ),
        ("tokens", "select *, " + ", ".join(f"sum(case when w{k} then 1 else 0 end) over ({w} rows between unbounded preceding and current row) - 1 as ix{k}" for k in (1, 2, 3, 4)) + " from tok6"),
    ]
