"""The cleaner's rules in the checking engine's SQL, which has no look-around: written apart from the operators."""

from __future__ import annotations

#: A line without white space at its ends, its words, and whether it ends a sentence.
S = r"regexp_replace(l, '^\s+|\s+$', '', 'g')"
N = r"len(regexp_extract_all(l, '[A-Za-z0-9''’-]+'))"
ENDS = rf"""regexp_matches({S}, '[.!?]["”’''\)\]]*$')"""
KEYWORDS = "CHAPTER CHAP BOOK PART VOLUME PROLOGUE EPILOGUE PREFACE".split()

FIRST = [
    r"regexp_matches(l, '^\s*\d+\s*$')",
    r"regexp_matches(l, '^\s*[-–—]+\s*$')",
    rf"(regexp_matches({S}, '^\d+\.?(?:\s+\S+){{1,3}}$') and not {ENDS})",
    rf"regexp_matches({S}, '(?i)^chapter\s+\d+(?:\s*[.:])?(?:\s+\S+){{0,10}}$')",
    "(" + " or ".join(rf"coalesce({N} - nullif(list_position(regexp_extract_all(upper(l), '[A-Z0-9''’-]+'), '{k}'), 0) <= 3, false)" for k in KEYWORDS) + ")",
    rf"(coalesce(lower(regexp_extract_all(l, '[A-Za-z0-9''’-]+')[1]), '') in ('book', 'chapter', 'epilogue', 'letter', 'part', 'preface', 'prologue', 'stave', 'volume') and ({N} <= 4 or not {ENDS}))",
    r"regexp_matches(l, '^\s*-\d{1,6}-\s*$')",
    rf"lower({S}) in ('scanned with cs camscanner', 'cs camscanner scanned with', 'cs', 'scanned with camscanner', 'scanned with', 'cs camscanner')",
    rf"(regexp_matches(l, '^\s*\(\d+\)\s+.') and regexp_matches({S}, '^\(\d+\)\s+.+[^.!?…]$'))",
    rf"regexp_matches({S}, '^\d+\.\s+.+[^.!?…]$')",
    rf"regexp_matches({S}, '^\d+\.\s+[^:]{{0,40}}:')",
    rf"regexp_matches({S}, '(?i)^[IVXLCM]+\.\s+.+[^.!?…]$')",
    rf"regexp_matches({S}, '^[•·]\s*.+:\s*.+[^.!?…]$')",
    rf"regexp_matches({S}, '^\*\s*.+:\s*.+')",
    rf"regexp_matches({S}, '^.:$')",
    rf"(length({S}) - length(replace({S}, ':', '')) >= 2 and not contains(l, '.') and not {ENDS})",
    r"regexp_matches(l, '^\s*(?:[.…]\s*){2,}$')",
    rf"(regexp_matches({S}, '^\d') and (contains(l, ';') or contains(l, ':') or contains(l, '-')))",
    rf"regexp_matches({S}, '^[a-z][^\s]*\.[a-z]{{1,4}}(?:\s|$)')",
    rf"(ends_with({S}, '|') and {N} < 5)",
    rf"(regexp_matches({S}, ',\s*\d+\.$') and {N} < 8)",
    rf"regexp_matches({S}, '(?i)^(?:Prelude|Introduction)[.:;!?]?$')",
]
CAPS = "(regexp_matches(l, '[A-Z]') and not regexp_matches(l, '[a-z]'))"
SECOND = [
    rf"({S} <> '' and not regexp_matches({S}, '^[A-Z]') and not {ENDS} and 1 - len(regexp_extract_all(l, '[A-Za-z]')) * 1.0e0 / greatest(1, length({S})) > 0.5e0)",
    rf"({N} between 1 and 12 and {CAPS} and not {ENDS})",
    rf"(length({S}) in (1, 2) and not regexp_matches(l, '[A-Za-z0-9]'))",
]
LINE_RULES = f"""with lines as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
one as (select doc_id, list_filter(ls, lambda l: not ({" or ".join(FIRST)})) as ls from lines)
select doc_id, array_to_string(list_filter(ls, lambda l: not ({" or ".join(SECOND)})), chr(10)) as cleaned from one"""

#: In turn: pattern, replacement. What looks behind keeps its letter; ordinals are marked before digits go.
TEXT_STEPS = [
    (r"\r\n?", r"\n"),
    (r"(?i)\b\S+\.(?:com|org|net)\b", ""),
    (r"(?i)\bhttps?://\S+\b", ""),
    (r"(?i)\b\S*\.edu\S*\b", ""),
    ("_", ""),
    (r"(?i)\(\s*\d+\s+of\s+\d+\s*\)", ""),
    (r"(?is)\(\s*note:.*?\)", ""),
    (r"([A-Za-z])-\n\s*([A-Za-z])", r"\1\2"),
    (r"([A-Za-z])\d+\b", r"\1"),
    (r"([A-Za-z])\d+\B", r"\1"),
    (r"(\d)(th|st|nd)\b", "\\1\x01\\2"),
    (r"\d+([A-Za-z])", r"\1"),
    ("\x01", ""),
    (r"\(\d+\)", ""),
    (r"\[[^\]\n]*\]", ""),
    (r"\[[^\]]*\n[^\]]*\]", ""),
    (r"(?m)([.!?…])\s*\b\d{1,2}\b\s*$", r"\1"),
    (r"[·▪※♦•*/]", ""),
    (r"[–—]{2,}", "—"),
    (r"\s+\.", "."),
    (r" {2,}", " "),
    (r"(?m)[ \t]+$", ""),
    (r"\n\s*\n", r"\n"),
    (r"^\s+|\s+$", ""),
]


def _text_rules() -> str:
    x = "coalesce(text, '')"
    for pattern, to in TEXT_STEPS:
        x = f"regexp_replace({x}, '{pattern}', " + (f"'{to}'" if to != r"\n" else "chr(10)") + ", 'g')"
    return f"select doc_id, {x} as cleaned from documents"


TEXT_RULES = _text_rules()


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _ends(x: str) -> str:
    return rf"""regexp_matches({_trim(x)}, '[.!?]["”’''\)\]]*$')"""


def _open(x: str) -> str:
    return rf"""regexp_matches({_trim(x)}, '(?:,|;|:|—|–|-|…|\.\.\.)["”’''\)\]]*$')"""


def _steps(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', " + (f"'{to}'" if to != r"\n" else "chr(10)") + ", 'g')"
    return x


CAPS5 = f"({N} between 1 and 5 and {CAPS})"
SENTENCE_CASE = f"upper(substr(lower({S}), 1, 1)) || substr(lower({S}), 2)"
UPTO = f"sum(case when {S} <> '' then 1 else 0 end) over (partition by doc_id order by k rows between unbounded preceding and current row)"
AROUND = "coalesce(lag(l) over (partition by doc_id order by k), '') as p, coalesce(lead(l) over (partition by doc_id order by k), '') as n"
FIRST_LEFT = f"min(case when {S} <> '' then k end) over (partition by doc_id)"
SHOUTED = "regexp_matches(t, '[A-Z]') and not regexp_matches(t, '[a-z]')"
PARTS = rf"regexp_split_to_array({S}, '\s+')"
PREFIX = f"least(5, coalesce(nullif(list_position(list_transform({PARTS}, lambda t: not ({SHOUTED})), true), 0) - 1, len({PARTS})))"
#: Whether line n goes on with acc's last line c, m being the median length of the block's lines.
C = "string_split(acc, chr(10))[-1]"
GOES_ON = rf"""case when regexp_matches({C}, '["”]$') and regexp_matches(x, '^[a-z]') then true
    when regexp_matches(x, '^--?[a-z]') and not {_ends(C)} then true when regexp_matches(x, '^["“”''‘’–—-]') then false
    when not {_ends(C)} then true when {_open(C)} then true else m >= 35 and length({C}) >= greatest(35, 0.72 * m) end"""

FULL_CTES = [
    ("t0", f"select doc_id, {_steps("coalesce(text, '')", TEXT_STEPS[:7])} as t from documents"),
    ("l0", r"select doc_id, unnest(ls) as l, unnest(range(len(ls))) as k from (select doc_id, regexp_split_to_array(t, '[\n\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') as ls from t0)"),
    # 6
    ("l6", f"select doc_id, l, k from (select *, min(case when k < 5 and not ({S} <> '' and not {ENDS} and {N} <= 3) then k end) over (partition by doc_id) as stop from l0) where k >= coalesce(stop, 5)"),
    # 7 to 10
    ("l7", f"select doc_id, k, case when {S} <> '' and upto <= 8 and {CAPS5} then {SENTENCE_CASE} else l end as l from (select *, {UPTO} as upto from l6)"),
    ("l8", f"select doc_id, k, l from (select *, {UPTO} as upto from l7) where not ({S} <> '' and upto <= 10 and {CAPS5} and {ENDS})"),
    ("l9", f"select doc_id, k, l from (select *, {UPTO} as upto from l8) where not (upto <= 10 and starts_with({S}, '©'))"),
    ("l10a", rf"select *, min(case when upto <= 10 and regexp_matches({S}, '^(?:[-—]\s*)?[A-Z]\S*(?:\s+[A-Z]\S*){{0,2}}$') and not {ENDS} then k end) over (partition by doc_id) as author from (select *, {UPTO} as upto from l9)"),
    ("l10", "select doc_id, k, l from l10a where k > coalesce(author, -1)"),
    # 11 to 26, 27
    ("l13", rf"select doc_id, k, case when regexp_matches({S}, '^\d+\.?\s+') and {N} > 5 and regexp_matches({S}, '[.,;:!?—–-]') then regexp_replace({S}, '^\d+\.?\s+', '') else l end as l from l10"),
    ("l26", f"select * from l13 where not ({" or ".join(FIRST)})"),
    ("l27", rf"select doc_id, k, l from (select *, {AROUND} from l26) where not (regexp_matches({S}, '^\d+\s+\S') and {_trim('p')} <> '' and {_trim('n')} <> '' and not {_ends('p')} and not regexp_matches(n, '^\s*[A-Z]'))"),
    # 28 to 31
    ("l29", f"select * from l27 where not ({SECOND[0]} or {SECOND[1]})"),
    ("l30", f"select doc_id, k, l from (select *, {AROUND} from l29) where not (({N} between 1 and 6 and (regexp_matches({S}, '^[A-Z]') or {CAPS}) and not {ENDS}) or ({_trim('p')} = '' and {_trim('n')} = '' and {N} between 1 and 6 and {CAPS}))"),
    ("l31", f"select * from l30 where not {SECOND[2]}"),
    # 32 to 35: the first line that isn't blank
    ("l32", f"select doc_id, k, l from (select *, {FIRST_LEFT} as f from l31) where not (k = f and regexp_matches({S}, '^\\([^()]*\\)$')) or f is null"),
    ("l33", f"select doc_id, k, f, case when k = f and {CAPS5} then {SENTENCE_CASE} else l end as l from (select *, {FIRST_LEFT} as f from l32)"),
    ("l34", f"select doc_id, k, f, case when k = f and {PREFIX} > 0 then upper(substr(lower(array_to_string({PARTS}[1:{PREFIX}], ' ')), 1, 1)) || substr(lower(array_to_string({PARTS}[1:{PREFIX}], ' ')), 2) || case when len({PARTS}) > {PREFIX} then ' ' || array_to_string({PARTS}[{PREFIX} + 1:], ' ') else '' end else l end as l from l33"),
    ("l35", rf"select doc_id, k, case when k = f then regexp_replace({S}, '^\d+(?:[-—–]|\s+)([A-Z])', '\1') else l end as l from l34"),
    # 36 to 45
    ("t43", f"select doc_id, {_steps("string_agg(l, chr(10) order by k)", TEXT_STEPS[7:19])} as t from l35 group by doc_id"),
    ("t45", f"select doc_id, {_steps('t', [(r'(?m)^([A-Z])[ ' + chr(9) + r']+([A-Z])\b', r'\1\2')] * 3)} as t from t43"),
    # 46
    ("l45", "select doc_id, unnest(ls) as l, unnest(range(len(ls))) as k from (select doc_id, string_split(t, chr(10)) as ls from t45)"),
    ("l46", f"select doc_id, k, l from (select *, {AROUND} from l45) where not ({S} = '' and {_trim('p')} <> '' and {_trim('n')} <> '' and (not {_ends('p')} or {_open('p')}))"),
    # 47: blocks between blank lines, each a fold whose state is the text so far
    ("b", f"select doc_id, k, {S} as l, sum(case when {S} = '' then 1 else 0 end) over (partition by doc_id order by k rows between unbounded preceding and current row) as block from l46"),
    ("g", "select doc_id, block, list(l order by k) as ls, median(length(l)) as m from b where l <> '' group by doc_id, block"),
    ("folded", f"select doc_id, block, list_reduce(ls, lambda acc, x: case when {GOES_ON} then case when ends_with(acc, '-') then substr(acc, 1, length(acc) - 1) || x else acc || ' ' || x end else acc || chr(10) || x end) as t from g"),
    # 48
    ("done", f"select doc_id, {_steps("string_agg(t, chr(10) order by block)", TEXT_STEPS[19:])} as cleaned from folded group by doc_id"),
    ("full_rules", "select d.doc_id, coalesce(d.text, '') as text, coalesce(cleaned, '') as cleaned from documents d left join done using (doc_id)"),
]
FULL = "with " + ",\n".join(f"{n} as ({q})" for n, q in FULL_CTES)
CLEAN_FULL = FULL + "\nselect doc_id, cleaned from full_rules"
FLAT = "replace(cleaned, chr(10), ' ')"
CLEAN_REPORT = FULL + f"\nselect doc_id as work, cast(length(text) as integer) as n_in, cast(length(cleaned) as integer) as n_out, 100 * (1 - length(cleaned) * 1.0e0 / greatest(1, length(text))) as reduction, case when length({FLAT}) > 600 then substr({FLAT}, 1, 600) || '...' else {FLAT} end as preview from full_rules"
