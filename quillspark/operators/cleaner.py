"""Corpus cleaner: ordered rules over a text and its lines, as SQL expressions on arrays.

Rules that look only at their own line (S) are one filter between the rules that need a
neighbour (C), the head of the document (H) or the merged line so far (F).
"""

from __future__ import annotations

import re
import statistics
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.dialect import Spark

WORDS = r"[A-Za-z0-9'’-]+"
TERMINAL = r"""[.!?]["”’'\)\]]*$"""
NONFINAL = r"""(?:,|;|:|—|–|-|…|\.\.\.)["”’'\)\]]*$"""
#: Words that head a label line, chapter words, and scanner lines.
LABELS = "chapter book volume part letter prologue epilogue preface stave".split()
CHAPTER_WORDS = "CHAPTER CHAP BOOK PART VOLUME PROLOGUE EPILOGUE PREFACE".split()
SCANNER_LINES = ["Scanned with CS CamScanner", "CS CamScanner Scanned with", "CS", "Scanned with CamScanner", "Scanned with", "CS CamScanner"]
#: Tokens of web addresses, dropped in this order; bounds and white space are Unicode's.
ADDRESSES = [r"(?iU)\b\S+\.(?:com|org|net)\b", r"(?iU)\bhttps?://\S+\b", r"(?iU)\b\S*\.edu\S*\b"]


def trim(d: Spark, l: str) -> str:
    return f"trim(BOTH ' \t\n\x0b\f\r' FROM {l})"


def terminal(d: Spark, l: str) -> str:
    return d.like(trim(d, l), TERMINAL)


def n_words(d: Spark, l: str) -> str:
    return d.count(l, WORDS)


def all_caps(d: Spark, l: str) -> str:
    return f"(not {d.like(l, '[a-z]')} and {d.like(l, '[A-Z]')})"  # lines without small letters are few: tested first


def few_words_after_keyword(d: Spark, l: str) -> str:
    """Rule 15: at most three words come after the first occurrence of a chapter word."""
    words = d.matches(f"upper({l})", WORDS)
    some = " or ".join(f"({d.position(words, k)} > 0 and {d.size(words)} - {d.position(words, k)} <= 3)" for k in CHAPTER_WORDS)
    return f"({d.like(l, f'(?i){"|".join(CHAPTER_WORDS)}')} and ({some}))"


def dropped_first(d: Spark, l: str) -> str:
    """Rules 11 to 26: a line that any of them drops. (13's other half maps.)"""
    s = trim(d, l)
    tests = [
        d.like(l, r"^\s*\d+\s*$"),
        d.like(l, r"^\s*[-–—]+\s*$"),
        f"({d.like(s, r'^\d+\.?(?:\s+\S+){1,3}$')} and not {terminal(d, l)})",
        d.like(s, r"(?i)^chapter\s+\d+(?:\s*[.:])?(?:\s+\S+){0,10}$"),
        few_words_after_keyword(d, l),
        f"({d.first(l, WORDS)} <> '' and lower({d.first(l, WORDS)}) in ({', '.join(f"'{w}'" for w in LABELS)}) and (not {terminal(d, l)} or {n_words(d, l)} <= 4))",
        d.like(l, r"^\s*-\d{1,6}-\s*$"),
        d.like(l, rf"(?i)^\s*(?:{'|'.join(SCANNER_LINES)})\s*$"),
        d.like(l, r"^\s*\(\d+\)\s+.+[^.!?…]$"),
        d.like(l, r"^\s*\d+\.\s+.+[^.!?…]$"),
        d.like(l, r"^\s*\d+\.\s+[^:]{0,40}:"),
        d.like(l, r"(?i)^\s*[IVXLCM]+\.\s+.+[^.!?…]$"),
        d.like(l, r"^\s*[•·]\s*.+:\s*.+[^.!?…]$"),
        d.like(l, r"^\s*\*\s*.+:\s*.+"),
        d.like(l, r"^\s*.:\s*$"),
        f"(not {d.like(l, r'\.')} and {d.count(l, ':')} >= 2 and not {terminal(d, l)})",
        d.like(l, r"^\s*(?:[.…]\s*){2,}$"),
        d.like(l, r"^\s*\d+\.?\s*.*[;:-]"),
        d.like(l, r"^\s*[a-z][^\s]*\.[a-z]{1,4}(?:\s|$)"),
        f"({d.like(s, r'\|$')} and {n_words(d, l)} < 5)",
        f"({d.like(s, r',\s*\d+\.\s*$')} and {n_words(d, l)} < 8)",
        d.like(l, r"(?i)^\s*(?:Prelude|Introduction)[.:;!?]?\s*$"),
    ]
    return "(" + " or ".join(tests) + ")"


def crumb(d: Spark, l: str) -> str:
    """Rule 31."""
    s = trim(d, l)
    return f"({s} <> '' and length({s}) <= 2 and not {d.like(s, '[A-Za-z0-9]')})"


def dropped_second(d: Spark, l: str) -> str:
    """Rules 28 and 29."""
    s = trim(d, l)
    heavy = f"({s} <> '' and not {d.like(l, r'^\s*[A-Z]')} and not {terminal(d, l)} and 1 - {d.count(s, '[A-Za-z]')} * 1.0e0 / greatest(length({s}), 1) > 0.5e0)"
    caps = f"({all_caps(d, l)} and not {terminal(d, l)} and {n_words(d, l)} between 1 and 12)"
    return f"({heavy} or {caps})"


def text_rules(d: Spark, x: str) -> str:
    """Rules 0 to 4: newlines, addresses, underscores, counters and notes in brackets."""
    x = d.sub(x, r"\r\n?", "\n")
    for p in (*ADDRESSES, "_", r"(?i)\(\s*\d+\s+of\s+\d+\s*\)", r"(?is)\(\s*note:.*?\)"):
        x = d.sub(x, p)
    return x


def late_text_rules(d: Spark, x: str) -> str:
    """Rules 37 to 43: hyphens at line ends, digits beside letters, brackets, small numbers at line ends, symbols."""
    x = d.sub(x, r"([A-Za-z])-\n\s*([A-Za-z])", "$1$2")
    for p in (r"(?<=[A-Za-z])\d+\b", r"(?<=[A-Za-z])\d+(?!\b)", r"\d+(?=(?!th\b|st\b|nd\b)[A-Za-z])", r"\(\d+\)", r"\[[^\]\n]*\]", r"\[[^\]]*\n[^\]]*\]", r"(?m)(?<=[.!?…])\s*\b\d{1,2}\b\s*$", r"[·▪※♦•*/]"):
        x = d.sub(x, p)
    return d.sub(x, "[–—]{2,}", "—")


def final_text_rules(d: Spark, x: str) -> str:
    """Rule 48: spacing, and no blank lines."""
    x = d.sub(d.sub(x, r"\s+\.", "."), " {2,}", " ")
    return f"array_join(filter(transform({d.lines(x)}, l -> {d.sub('l', r'[ \t]+$')}), l -> {trim(d, 'l')} <> ''), '\\n')"


def line_rules(works: DataFrame) -> DataFrame:
    """work and cleaned: rules 11 to 26, then 28, 29 and 31, on the lines of a text."""
    d = Spark()
    first = d.keep(d.lines("coalesce(text, '')"), lambda l: f"not {dropped_first(d, l)}")
    return works.select("work", F.expr(d.glue(d.keep(first, lambda l: f"not ({dropped_second(d, l)} or {crumb(d, l)})"))).alias("cleaned"))


def whole_text_rules(works: DataFrame) -> DataFrame:
    """work and cleaned: rules 0 to 4, 37 to 43 and 48 on a whole text."""
    d = Spark()
    return works.select("work", F.expr(trim(d, final_text_rules(d, late_text_rules(d, text_rules(d, "coalesce(text, '')"))))).alias("cleaned"))


def let(name: str, value: str, body: str) -> str:
    """body with a name for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def clean(raw: DataFrame, long_numbers_off: Column | None = None) -> DataFrame:
    """work, text and cleaned of raw works (work, text): all rules in order.

    long_numbers_off: a condition under which standalone numbers of three digits or more go.
    """
    d = Spark()
    e = F.expr
    line = "l"
    df = raw.select("work", "text").withColumn("_l", e(f"split({text_rules(d, "coalesce(text, '')")}, r'[\\n\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]', -1)"))
    blank = lambda x: f"({trim(d, x)} = '')"
    caps5 = lambda x: f"({all_caps(d, x)} and {n_words(d, x)} between 1 and 5)"
    lowered = lambda x: f"concat(upper(left(lower({trim(d, x)}), 1)), substr(lower({trim(d, x)}), 2))"

    def head() -> str:
        """Each line with its number and, for those up to the tenth that isn't blank, how many lines up to it aren't (for others 99)."""
        places = f"slice(filter(transform(_l, (l, k) -> if({blank('l')}, null, k)), k -> k is not null), 1, 10)"
        return let("places", places, "transform(_l, (l, k) -> struct(l as l, k as k, if(k > coalesce(get(places, 9), size(_l)), 99, size(filter(places, p -> p <= k))) as nb))")

    # 6: leading short lines
    short = f"({trim(d, 'x.l')} <> '' and not {terminal(d, 'x.l')} and {n_words(d, 'x.l')} <= 3)"
    df = df.withColumn("_l", e(f"filter(transform(_l, (l, k) -> struct(l as l, k as k)), x -> x.k >= coalesce(array_min(transform(filter(transform(slice(_l, 1, 5), (l, k) -> struct(l as l, k as k)), x -> not {short}), x -> x.k)), least(5, size(_l)))).l"))
    # 7: head lines in capitals to sentence case; 8 and 9: head lines in capitals with an end mark, and copyright lines
    df = df.withColumn("_l", e(f"transform({head()}, x -> case when x.nb <= 8 and {caps5('x.l')} then {lowered('x.l')} else x.l end)"))
    df = df.withColumn("_l", e(f"transform(filter({head()}, x -> not (x.nb <= 10 and {caps5('x.l')} and {terminal(d, 'x.l')})), x -> x.l)"))
    df = df.withColumn("_l", e(f"transform(filter({head()}, x -> not (x.nb <= 10 and {d.like('x.l', r'^\s*©')})), x -> x.l)"))
    # 10: an author line among the first ten and all before it
    author = rf"^(?:[-—]\s*)?[A-Z]\S*(?:\s+[A-Z]\S*){{0,2}}$"
    df = df.withColumn("_cut", e(f"array_min(transform(filter({head()}, x -> x.nb <= 10 and {d.like(trim(d, 'x.l'), author)} and not {terminal(d, 'x.l')}), x -> x.k))"))
    df = df.withColumn("_l", e("if(_cut is null, _l, slice(_l, _cut + 2, size(_l)))"))
    # 11 to 26
    numbered = f"case when {d.like(trim(d, line), r'^\d+\.?\s+')} and {n_words(d, line)} > 5 and {d.like(line, '[.,;:!?—–-]')} then {d.sub(trim(d, line), r'^\d+\.?\s+')} else {line} end"
    df = df.withColumn("_l", e(f"filter(transform(_l, l -> {numbered}), l -> not {dropped_first(d, line)})"))
    around = "transform(_l, (l, k) -> struct(l as l, coalesce(get(_l, k - 1), '') as p, coalesce(get(_l, k + 1), '') as n))"
    # 27
    df = df.withColumn("_l", e(f"transform(filter({around}, x -> not ({d.like(trim(d, 'x.l'), r'^\d+\s+\S+')} and not {blank('x.p')} and not {blank('x.n')} and not {terminal(d, 'x.p')} and not {d.like('x.n', r'^\s*[A-Z]')})), x -> x.l)"))
    # 28 and 29; 30 and 31
    df = df.withColumn("_l", e(f"filter(_l, l -> not {dropped_second(d, line)})"))
    title = f"(not {terminal(d, 'x.l')} and ({d.like('x.l', r'^\s*[A-Z]')} or {all_caps(d, 'x.l')}) and {n_words(d, 'x.l')} between 1 and 6)"
    alone = f"({blank('x.p')} and {blank('x.n')} and {all_caps(d, 'x.l')} and {n_words(d, 'x.l')} between 1 and 6)"
    df = df.withColumn("_l", e(f"filter(transform(filter({around}, x -> not ({title} or {alone})), x -> x.l), l -> not {crumb(d, line)})"))
    # 32 to 35: the first line that isn't blank
    at = f"(array_min(transform(filter(transform(_l, (l, k) -> struct(l as l, k as k)), x -> not {blank('x.l')}), x -> x.k)))"
    df = df.withColumn("_at", e(at)).withColumn("_l", e(f"case when {d.like(trim(d, 'get(_l, _at)'), r'^\([^()]*\)$')} then transform(filter(transform(_l, (l, k) -> struct(l as l, k as k)), x -> x.k != _at), x -> x.l) else _l end"))
    prefix = r"^\s*((?:[^A-Za-z\s]*[A-Z](?:[^a-z\s])*(?:\s+|$)){1,5})"
    run = d.group1("l", prefix)
    first = f"case when {caps5('l')} then {lowered('l')} when {run} <> '' then concat(upper(left(lower({run}), 1)), substr(lower({run}), 2), {d.sub(trim(d, 'l'), prefix)}) else l end"
    whole = let("l", "get(_l, _at)", d.sub(f"({first})", r"^\s*\d+(?:[-—–]|\s+)(?=[A-Z])"))
    df = df.withColumn("_at", e(at)).withColumn("_l", e(f"if(_at is null, _l, concat(slice(_l, 1, _at), array({whole}), slice(_l, _at + 2, size(_l))))"))
    # 36 to 45: whole text again
    df = df.withColumn("_t", e(late_text_rules(d, "array_join(_l, '\\n')")))
    if long_numbers_off is not None:
        df = df.withColumn("_t", F.when(long_numbers_off, F.regexp_replace("_t", r"\b\d{3,}\b", "")).otherwise(F.col("_t")))
    text = "_t"
    for _ in range(3):
        text = d.sub(text, r"(?m)^([A-Z])[ \t]+([A-Z])\b", "$1$2")
    df = df.withColumn("_l", e(f"split({text}, r'\\n', -1)"))
    # 46: blank lines inside a sentence
    broken = f"(not {terminal(d, 'x.p')} or {d.like(trim(d, 'x.p'), NONFINAL)})"
    df = df.withColumn("_l", e(f"transform(filter({around}, x -> not ({blank('x.l')} and not {blank('x.p')} and not {blank('x.n')} and {broken})), x -> x.l)"))
    return reflow(df).select("work", "text", "cleaned")


#: What TERMINAL and NONFINAL look for before closing marks, for ends of lines that grow.
CLOSING, FINAL, OPEN = "\"”’')]", (".", "!", "?"), (",", ";", ":", "—", "–", "-", "…", "...")
LOWER_START, DASHED_START, DIALOGUE_START = re.compile("[a-z]"), re.compile("--?[a-z]"), re.compile("[\"“”'‘’–—-]")
BLANK_LINES = re.compile(r"\n(?:[ \t]*\n)+")


def continues(line: str, after: str, median: float) -> bool:
    """Rule 47: whether the line after goes on with the merged line so far; only that line's end and length are looked at."""
    k = len(line)
    while k and line[k - 1] in CLOSING:
        k -= 1
    end = line[max(0, k - 3) : k]
    ended = end.endswith(FINAL)
    if line[-1] in "\"”" and LOWER_START.match(after) or DASHED_START.match(after) and not ended:
        return True
    if DIALOGUE_START.match(after):
        return False
    return not ended or end.endswith(OPEN) or median >= 35 and len(line) >= max(35, 0.72 * median)


def reflowed(text: str) -> str:
    """Rule 47: within each block of lines, lines that continue one another are one; a fold, as the merged line's length decides."""
    out: list[str] = []
    for block in BLANK_LINES.split(text):
        lines = [x for x in (line.strip() for line in block.split("\n")) if x]
        if not lines:
            continue
        median, current = statistics.median(map(len, lines)), lines[0]
        for line in lines[1:]:
            if not continues(current, line, median):
                out.append(current)
                current = line
            elif current.endswith("-"):
                current = current[:-1]
                current += line
            else:
                current += " "
                current += line
        out.append(current)
    return "\n".join(out)


def reflow(df: DataFrame) -> DataFrame:
    """Rules 47 and 48 over lines in _l. The fold is the one step that array expressions can't do in linear time, so batches of texts go through Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([reflowed(x or "") for x in batch.column("_o").to_pylist()], pa.string())], batch.schema.names)

    d = Spark()
    rows = df.select("work", "text", F.expr("array_join(_l, '\\n')").alias("_o"))
    rows = rows.mapInArrow(run, rows.schema)
    return rows.withColumn("cleaned", F.expr(trim(d, final_text_rules(d, "_o"))))
