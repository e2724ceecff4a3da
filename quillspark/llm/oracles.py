"""SQL of the training-data queries that a second engine can express."""

from __future__ import annotations

from quillspark.llm.chat import CONTROL, END, TURN
from quillspark.llm.collocations import LEAST, LONGEST, PERCENT, TOP
from quillspark.llm.quality import FENCE, LEAST_DOCS, MEASURES

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRINGS = f"""with d as (select doc_id, {WORDS} as ws from documents),
p as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) as i from d),
w as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') as win from p),
dup as (select doc_id, i from w join (select win, min(doc_id) as m from w group by win) using (win) where doc_id > m),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from dup),
pos as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as x from d),
kept as (select pos.doc_id, count(*) filter (gone.i is not null) as n_removed, string_agg(x, ' ' order by pos.i) filter (gone.i is null) as t from pos left join gone using (doc_id, i) group by pos.doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""


def _quality() -> str:
    bins = ", ".join(f"({e.replace(' div ', ' // ')}) as b{k}" for k, (e, _) in enumerate(MEASURES.values()))
    sketch = " union all ".join(f"select lang, source, {k} as measure, b{k} as bin from base where not base_failed" for k in range(len(MEASURES)))
    slack = "case measure " + " ".join(f"when {k} then {s}" for k, (_, s) in enumerate(MEASURES.values())) + " end"

    def fence(keys: str) -> str:
        by = keys + ", " if keys else ""
        return f"""(select {by}measure, max(docs) as docs, min(bin) filter (4 * upto >= 3 * docs) + {FENCE} * (min(bin) filter (4 * upto >= 3 * docs) - min(bin) filter (4 * upto >= docs)) + {slack} as fence
        from (select *, sum(n) over (partition by {by}measure order by bin) as upto, sum(n) over (partition by {by}measure) as docs from (select {by}measure, bin, count(*) as n from sk group by {by}measure, bin)) group by {by}measure)"""

    limits = ", ".join(f"max(limit_) filter (measure = {k}) as m{k}" for k in range(len(MEASURES)))
    within = " and ".join(f"b{k} <= m{k}" for k in range(len(MEASURES)))
    return rf"""with d as (select doc_id, lang, source, coalesce(text, '') as text, {WORDS} as ws from documents),
tri as (select doc_id, i, array_to_string(ws[i : i + 2], ' ') as win from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) as i from d)),
rep as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from tri join (select doc_id, win from tri group by all having count(*) > 1) using (doc_id, win)) group by doc_id),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
counts as (select d.doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words from d join lines using (doc_id) left join rep using (doc_id)),
base as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {bins} from counts),
sk as ({sketch}),
lim as (select o.lang, o.source, o.measure as measure, case when o.docs >= {LEAST_DOCS} then o.fence when l.docs >= {LEAST_DOCS} then l.fence else a.fence end as limit_ from {fence('lang, source')} o join {fence('lang')} l on l.lang is not distinct from o.lang and l.measure = o.measure join {fence('')} a on a.measure = o.measure),
t as (select lang, source, {limits} from lim group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({within}, false) as kept
from base left join t on base.lang is not distinct from t.lang and base.source is not distinct from t.source"""


def _chat() -> str:
    esc = lambda x: "replace(" * (len(CONTROL) + 1) + f"{x}, '\\', '\\\\')" + "".join(f", '{c}', '{c[0]}\\{c[1:]}')" for c in sorted(CONTROL, key=len, reverse=True))  # noqa: E731
    both = "'</s>[INST] ok [/INST]'"
    return f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', {both} union all select -1, 1, 'assistant', {both}),
t as (select *, length({esc('role')}) + length({esc('text')}) + {len(TURN) + len(END) + 2} as chars from c),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns, coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss, sum(chars) as chars from t group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from g"""


def _collocations() -> str:
    grams = " union all ".join(f"select lang, {k} as k, array_to_string(ws[i : i + {k - 1}], ' ') as phrase, count(*) as a from (select lang, ws, unnest(range(1, len(ws) - {k - 2})) as i from p) group by all having count(*) >= {LEAST}" for k in range(1, LONGEST + 1))
    return rf"""with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') as ws from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?
-]')) as piece from t)),
n as (select lang, cast(sum(len(ws)) as bigint) as n from p group by lang),
f as ({grams}),
c as (select lang, phrase, k, a, unnest(range(1, k)) as cut, string_split(phrase, ' ') as ws from f where k > 1),
s as (select c.lang, c.phrase, c.a, cut, h.a as l, t.a as r, n, cast(1000 * cast(c.a as hugeint) * n // (cast(h.a as hugeint) * t.a) as bigint) as score from c join n on n.lang = c.lang
join f h on h.lang = c.lang and h.phrase = array_to_string(ws[:cut], ' ') join f t on t.lang = c.lang and t.phrase = array_to_string(ws[cut + 1 :], ' ')),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_ as (select lang, array_to_string(ws[b : b + size - 1], ' ') as phrase, max(a) as a from (select *, unnest(range(1, k - size + 2)) as b from (select lang, ws, k, a, unnest(range(2, k)) as size from c where cut = 1)) group by all),
stay as (select best.* from best left join inner_ using (lang, phrase) where inner_.a is null or 100 * inner_.a < {PERCENT} * best.a)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score from stay qualify rank <= {TOP}"""


def _manifest() -> str:
    enc = lambda x: f"coalesce(strlen(cast({x} as varchar)) || ':' || cast({x} as varchar), '-')"  # noqa: E731
    leaf = lambda text: "sha256(" + " || ".join(map(enc, ("doc_id", "source", "lang", "n_chars", text))) + ")"  # noqa: E731
    bits = "list_reduce(list_prepend(xor(c, x), range(8)), lambda v, k: if(v & 1 = 1, xor(v >> 1, 3988292384::bigint), v >> 1))"
    crc = f"list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, x: {bits})"  # its last step, a complement, flips the parity
    tree = lambda name, leaves: f"""{name} as (select tree, 0 as level, i, n, h from {leaves}
union all select tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from {name} where n > 1 group by tree, level, i // 3, n)"""  # noqa: E731
    sides = lambda name: f"""select a.tree, a.level, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as lo, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as hi
from {name} a left join {name} b on b.tree = a.tree and b.level = a.level and b.i // 3 = a.i // 3 and b.i <> a.i where a.n > 1 group by all"""  # noqa: E731
    return f"""with recursive d as (select *, {leaf('text')} as h, {leaf('found')} as at_hand from (select *, if({crc} % 2 = 1, replace(text, chr(10), ''), text) as found from documents)),
l as (select doc_id, h, at_hand, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, h) - 1 as i, count(*) over (partition by source) as n from d),
{tree('up', 'l')},
sub as (select -1 as tree, tree as i, (select count(distinct tree) from l) as n, h from up where n = 1),
{tree('top', 'sub')},
s as ({sides('up')} union all {sides('top')}),
w as (select tree, doc_id, 0 as level, i, i as place, n, at_hand as fold, '' as proof, tree as src from l
union all (select w.tree, doc_id, w.level + 1, w.i // 3, place, (n + 2) // 3, sha256(lo || fold || hi), proof || lo || hi, src from w join s on s.tree = w.tree and s.level = w.level and s.i = w.i
union all select -1, doc_id, 0, src, place, (select count(*) from sub), fold, proof, src from w where n = 1 and tree >= 0)),
f as (select * from w where tree = -1 and n = 1)
select l.doc_id, l.h as leaf, sub.h as subroot, top.h as root, sha256(proof) as proof_sha256, fold as folded_root, fold = top.h as verified
from f join l on l.tree = f.src and l.i = f.place join sub on sub.i = f.src join top on top.n = 1"""


ORACLES: dict[str, str] = {"op11_collocations": _collocations(), "op13_manifest": _manifest(), "op6_chat": _chat(), "op9_substring_dedup": SUBSTRINGS, "op10_quality": _quality()}
