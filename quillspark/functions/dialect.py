"""Expressions of two SQL dialects behind one vocabulary: Spark and the checking engine."""

from __future__ import annotations

#: Covers every character of a text: words, digit runs, white space, single other characters.
TOKEN = r"\p{L}+(?:['’]\p{L}+)*|\p{N}+|\s+|[^\s\p{L}\p{N}]"


class Spark:
    name = "spark"

    def lit(self, p: str) -> str:
        return 'r"' + p.replace('"', r"\x22") + '"' if "'" in p else f"r'{p}'"

    def like(self, x: str, p: str) -> str:
        return f"regexp_like({x}, {self.lit(p)})"

    def count(self, x: str, p: str) -> str:
        return f"regexp_count({x}, {self.lit(p)})"

    def sub(self, x: str, p: str, r: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)})"

    def matches(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)}, 0)"

    def first(self, x: str, p: str) -> str:
        return f"regexp_extract({x}, {self.lit(p)}, 0)"

    def position(self, array: str, x: str) -> str:
        return f"array_position({array}, '{x}')"

    def size(self, array: str) -> str:
        return f"size({array})"

    def group1(self, x: str, p: str) -> str:
        return f"regexp_extract({x}, {self.lit(p)}, 1)"

    def exploded(self, keys: str, array: str, table: str) -> str:
        return f"select {keys}, e.i, e.tok from {table} lateral view posexplode({array}) e as i, tok"

    def joined(self, tok: str, i: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({i} as i, {tok} as t))), x -> x.t), '')"

    def long(self, keys: str, pairs: list[tuple[str, str]], table: str) -> str:
        return f"select {keys}, e.metric, e.value from {table} lateral view stack({len(pairs)}, {', '.join(f"'{m}', cast({v} as double)" for m, v in pairs)}) e as metric, value"

    def keep(self, array: str, test) -> str:
        return f"filter({array}, l -> {test('l')})"

    def lines(self, x: str) -> str:
        return f"split({x}, {self.lit('\\n')}, -1)"

    def glue(self, array: str) -> str:
        return f"array_join({array}, '\\n')"


class Duck(Spark):
    name = "duck"

    def lit(self, p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    def like(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.lit(p)})"

    def count(self, x: str, p: str) -> str:
        return f"len(regexp_extract_all({x}, {self.lit(p)}))"

    def sub(self, x: str, p: str, r: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r.replace('$', chr(92)))}, 'g')"

    def matches(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)})"

    def exploded(self, keys: str, array: str, table: str) -> str:
        return f"select {keys}, unnest(range(len(l_))) as i, unnest(l_) as tok from (select *, {array} as l_ from {table})"

    def joined(self, tok: str, i: str) -> str:
        return f"string_agg({tok}, '' order by {i})"

    def long(self, keys: str, pairs: list[tuple[str, str]], table: str) -> str:
        return f"select {keys}, unnest([{', '.join(f"'{m}'" for m, _ in pairs)}]) as metric, unnest([{', '.join(f'cast({v} as double)' for _, v in pairs)}]) as value from {table}"

    def keep(self, array: str, test) -> str:
        return f"list_filter({array}, lambda l: {test('l')})"

    def lines(self, x: str) -> str:
        return f"string_split({x}, chr(10))"

    def glue(self, array: str) -> str:
        return f"array_to_string({array}, chr(10))"


def rounded(x: str) -> str:
    """Four decimals by the same rule in both engines."""
    return f"floor(({x}) * 10000 + 0.5e0 + 1e-9) / 10000"


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "’") + "'" for w in sorted(words)) + ")"
