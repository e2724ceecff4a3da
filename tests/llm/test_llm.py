"""Every operator against brute force or a round trip, on small tables with nulls, empty and repeated rows."""

import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import chat, common, decontaminate, html_extract, line_dedup, oracles, packing, quality, simhash, substring_dedup, token_counts, toxicity
from quillspark.llm import queries as Q
from quillspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "The quick brown fox jumps over the lazy dog while seven wizards mix strange potions beneath a pale and silent moon tonight."
TEXTS = [BASE, BASE, None, "", BASE + " End.", "a " * 60, " \t\n", "word" * 5000, "naïve café 日本語 <|endoftext|> it's 12 345!\n\n x", "Another line entirely, with some other words in it.\n" + BASE, "one two", BASE.replace("seven", "eight")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else "s", 0) for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def test_trie_against_brute_force():
    rng = np.random.default_rng(3)
    make = lambda n: "".join(rng.choice(list("abcd"), n))
    terms = sorted({make(rng.integers(3, 8)) for _ in range(60)})
    trie = toxicity.Trie(terms, len)
    edits = lambda w: {w[:i] + x + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for x in ["", *"abcd"]}
    for w in [make(rng.integers(1, 9)) for _ in range(1500)]:
        near = [t for t in terms if w in edits(t)]
        assert trie.near(w) == max(near, key=lambda t: (len(t), t), default=None), w


def test_token_counts(docs, empty):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert token_counts.token_counts(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_packing(docs, empty):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.pack_documents(docs, P.path("word_bpe_49k.json"), capacity=64).collect()
    size = Counter()
    for r in rows:
        size[r.doc_id] += r.length
    assert size == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(TEXTS)}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((i, k // 64, k, len(x[k : k + 64]), zlib.crc32(np.array(x[k : k + 64], "<u4").tobytes())) for i, x in ids.items() for k in range(0, len(x), 64))
    assert packing.pack_documents(empty, P.path("word_bpe_49k.json")).count() == 0


def test_tokens_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, BASE, 3), (1, BASE, 4), (1, "x", 5), (None, None, 6), (None, "y", None)], "doc_id long, text string, length long")
    rows = packing.pack_documents(docs, P.path("word_bpe_49k.json"), capacity=64).collect()
    assert len(rows) == 5 and sum(r.doc_id is None for r in rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == 5
    got = token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect()
    assert len(got) == 5 and sorted(r.n_tokens for r in got if r.doc_id is None) == [0, 1]
    got = quality.quality(docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "measure": F.lit(1)})).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 2


def test_packing_rounds(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 400)
    pieces = spark.createDataFrame([(i, 0, int(x)) for i, x in enumerate(sizes)], "doc_id long, piece int, length long")
    rows = packing.pack(pieces, 100, per_task=50).collect()
    assert sorted(r.doc_id for r in rows) == list(range(400))
    load = Counter()
    for r in rows:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= 100 and len(load) <= 1.05 * packing.lower_bound(sizes, 100) + 1


def test_simhash(docs, empty):
    def fp(t):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in sh) > len(sh))

    fps = [fp(t) for t in TEXTS]
    f = common.Forest()
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                f.union(i, j)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", f.find(i)) for i in range(len(fps))}
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(7, BASE, 1), (None, BASE, 2), (7, "x y z", 3), (9, BASE, 4), (None, "alone", 5)], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 7), (7, 7), (7, 7), (9, 7)]


@pytest.mark.parametrize("large", [2048, 4])
def test_simhash_links_lose_none(large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.left_shift(np.int64(1), rng.integers(0, 63, (30, 3))), axis=1) for b in rng.integers(0, 1 << 62, 20)]))
    keys = np.concatenate([(fps & 0xFFFFFFFF) ^ m for m in simhash.masks(4)] + [((fps >> 32) & 0xFFFFFFFF | 1 << 32) ^ m for m in simhash.masks(4)])
    u, v = simhash.verified(keys, np.tile(fps, len(keys) // len(fps)), 4)
    a, b = common.Forest(), common.Forest()
    for x, y in zip(u.tolist(), v.tolist()):
        a.union(x, y)
    for x in fps.tolist():
        for y in fps.tolist():
            if (x ^ y).bit_count() <= 4:
                b.union(x, y)
    assert [a.find(x) for x in fps.tolist()] == [b.find(x) for x in fps.tolist()]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_chat(spark):
    bad = "\\</s>[INST]\\\\ <|turn|> <\\|end|>\n"
    rows = [(1, 0, "user", bad), (1, 1, "assistant", None), (1, 2, "assistant", bad), (2, 0, None, ""), (2, 0, None, "")]
    nodes = chat.conversation_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.tree: r for r in chat.read_back(chat.format_paths(nodes, chat.paths(nodes))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", bad), ("assistant", ""), ("assistant", bad)] and got[1].loss == bad
    assert got[2].n_turns == 2 and got[2].loss == ""
    tree = spark.createDataFrame([(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 2.0), (1, 4, 2, 5.0), (1, 5, 9, 0.5)], "tree long, node long, parent long, score double")
    assert sorted((r.leaf, r.node, r.depth) for r in chat.paths(tree).collect()) == [(4, 1, 1), (4, 2, 2), (4, 4, 3)]
    assert {r.leaf for r in chat.paths(tree, best=2).collect()} == {4, 3}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<nav><a>Home</a></nav><article><h1>T &amp; x</h1><p><b>One  two.<br><p>Three.</p></article><footer>c</footer>", "T & x One two. Three."),
        ("<body><div id='menu'>m</div><div class='story'><p>Long text, with commas, and more of it here.</p><p>Second one, also long enough to count.</p></div><div class='comments'><p>I agree, totally, yes.</p></div></body>", "Long text, with commas, and more of it here. Second one, also long enough to count."),
        ("<article>a<script>var t='</p>';</script><form>f</form> b</article>", "a b"),
        ("", ""),
        ("<p", "<p"),
    ],
)
def test_html(page, text):
    assert html_extract.content(page) == text


@pytest.mark.parametrize("piece", ['<a "', "<a '\"", '<a ">"', "<div><b></i>", "<script", "<!--", "<!", "</p><p", "<article><b><div></b></b>", "<p class='", "<textarea>", '<a "x>', "<ul><li>x", "&amp", "<"])
def test_html_takes_time_by_length(piece):
    began = time.time()
    html_extract.content(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 12, piece


def test_html_rows(spark):
    rows = [(1, "u", "<p>a</p>", "z"), (1, None, None, "z"), (None, "u", "", None), (2, "u", "<article><p>" + "word, " * 500_000 + "</article>", "z")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (1, 1), (2, 6 * 500_000 - 1)]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "Long text, with commas, and more of it here, so that it weighs something."


@pytest.mark.parametrize(
    "page, text",
    [
        ("<main><h1>Title</h1><p>The lead.</p><article><p>Body, one.</p></article></main>", "Title The lead. Body, one."),
        (f"<div><article><p>{LONG}</p></article></div><section><article><p>Second, here.</p></article></section>", f"{LONG} Second, here."),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><ul><li><article><p>Card</p></article><li><article><p>Card 2</p></article></ul>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><div><p>{LONG}</p></div><section><p>{LONG}</p></section><blockquote><p>{LONG}</p></blockquote><ul><li>x</ul></article>", " ".join([LONG] * 4)),
    ],
)
def test_html_containers(page, text):
    assert html_extract.content(page) == text


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = words(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) for j in range(3) if tri[tuple(w[k : k + 3])] > 1}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
    assert not got[5].kept and quality.quality(empty).count() == 0


def test_substrings(docs, empty, monkeypatch):
    first, want = {}, {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        want[i] = (len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    read = lambda: {r.doc_id: (r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs).collect()}
    assert read() == want
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 0)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 0.001)
    assert read() == want and substring_dedup.substring_dedup(empty).count() == 0


def test_lines(docs, empty):
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.line_dedup(docs).collect()}
    assert got[0] == (0, BASE) and got[1] == (1, "") and got[2] == (0, None) and got[4] == (1, "") and got[9][0] == 1
    out = {r.doc_id: r for r in line_dedup.rewrite(docs).collect()}
    assert {i: r.text for i, r in out.items()} == {i: t for i, (_, t) in got.items()} and out[0].lang == "en"
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_banding_recall():
    rng = np.random.default_rng(6)
    make = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    # 90 shingles each, 80 of them shared: Jaccard 0.8; the end differs
    pairs = [(x + make(10), x + make(10)) for x in (make(88) for _ in range(2000))]
    keys = [line_dedup.signatures([p[k] for p in pairs]) for k in (0, 1)]
    assert np.mean((keys[0] == keys[1]).any(axis=1)) >= 0.985


def test_short_lines(spark):
    texts = ["and ornd.\nkept one", " And  ornd. \n\n \n好的。", "好的。\nx\nX\n\nand orne."]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "and ornd.\nkept one", 1: "\n \n好的。", 2: "x\n\nand orne."}


def test_substrings_of_repeated_and_null_ids(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pool = [f"w{k}" for k in range(30)] + ["longest"]
    passages = [list(rng.choice(pool, 20)) for _ in range(6)]
    pick = lambda: " ".join(list(rng.choice(pool, 8)) + passages[rng.integers(6)] + list(rng.choice(pool, 8)) + passages[rng.integers(6)])
    rows = [(int(i), pick()) for i in rng.integers(0, 12, 30)] + [(None, pick()), (None, None), (3, None)]
    rows += [rows[0], rows[5], (None, rows[30][1])]
    first: dict = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12 if i is not None else 0):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12 if i is not None else 0) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        want.append((i is None, i or 0, len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, own string")
    read = lambda: sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs).collect())
    assert read() == sorted(want) and sum(n for _, _, n, _ in want) > 100
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 0)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 0.001)
    assert read() == sorted(want)


def brute_lines(rows):
    """Lines that stay, by row: equal normalised lines and those of 9-character shingle similarity 0.8 or more are one, the first stays."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0))
    places = [(r, k, " ".join(x.lower().split())) for r in order for k, x in enumerate((rows[r][1] or "").split("\n"))]
    places = [p for p in places if p[2]]
    shingles = {x: {x[i : i + 9] for i in range(len(x) - 8)} for _, _, x in places}
    own, forest = list(shingles), common.Forest()
    first = {x: i for i, x in enumerate(own)}
    for i, x in enumerate(own):
        for y in own[:i]:
            a, b = shingles[x], shingles[y]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                forest.union(i, first[y])
    seen, gone = set(), set()
    for r, k, x in places:
        root = forest.find(first[x])
        if root in seen:
            gone.add((r, k))
        seen.add(root)
    return [t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r, k) not in gone) for r, (_, t) in enumerate(rows)]


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(8)
    make = lambda n: "".join(rng.choice(list("abcdefghij klmnopäß日本"), n)).strip()
    base = [make(n) for n in rng.integers(5, 160, 60)]
    pool = base + [x[:-1] + "q" for x in base] + [make(3) + x for x in base] + ["  " + x.upper() for x in base[:20]] + ["ab", "好的。", " ", ""]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(0, 9)))) for i in range(60)]
    rows += [(None, rows[3][1]), (None, "only here once\n" + rows[4][1]), (5, rows[7][1] + "\nonly here twice"), (70, None), (71, "only here once")]
    want = brute_lines(rows)
    docs = spark.createDataFrame([(i, t, f"r{k}", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, own string, gone int")
    got = {r.gone: r for r in line_dedup.rewrite(docs).collect()}
    assert docs.columns == line_dedup.rewrite(docs.limit(0)).columns
    # rows of one id come in the order of a hash: either may be first
    loose = {k for k, (i, _) in enumerate(rows) if i is None or i == 5}
    wrong = [k for k in range(len(rows)) if k not in loose and got[k].text != want[k]]
    assert not wrong and all(r.own == f"r{k}" for k, r in got.items())
    assert sum((r.text or "").count("only here once") for r in got.values()) == 1 and got[64].text == "only here once"


def test_lines_of_rows_alike(spark):
    text = "one line of some length here\nand one more of that length"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in line_dedup.line_dedup(docs).collect())
    assert got == [(False, 0), (False, 2), (True, 2), (True, 2)]


def test_decontamination(spark, docs, empty):
    item = "seven wizards mix strange potions beneath a pale and silent moon tonight"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "not in any of these documents at all today"), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 1): 0, (1, 1): 0, (4, 1): 0, (9, 1): 0, (11, 1): 1}
    assert decontaminate.contaminated(empty, bench).count() == 0


@pytest.mark.parametrize("n", [5, 6, 8, 9, 10, 14, 15, 30])
def test_decontamination_recall_at_the_limit(n):
    rng = np.random.default_rng(5)
    items = [[f"w{x}" for x in rng.integers(0, 10**6, n)] for _ in range(200)]
    keys = decontaminate.Items([(i, " ".join(w)) for i, w in enumerate(items)], 0.8)
    for first in (True, False):
        texts = []
        for w in items:
            at = list(range(n // 5)) if first else rng.choice(n, n // 5, replace=False).tolist()
            texts.append(" ".join(["pre"] * 20 + [f"x{k}" if k in at else x for k, x in enumerate(w)] + ["post"] * 20).encode())
        got = {r[:2] for r in decontaminate.matches(texts, keys, decontaminate.Symbols(keys.vocabulary))}
        assert sum((k, k) in got for k in range(200)) >= 195


def test_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 14))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontaminate.edit_distance(a, b, 99)[0] == min(row)


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("aeioubcdfghklmnprst"), rng.integers(3, 9))) for _ in range(400)]
    rows = []
    for i in range(300):
        w = list(rng.choice(vocab, 40))
        if i % 4 == 0:
            for k in rng.integers(0, 40, 4):
                w[k] = str(rng.choice(["grumplet", "snorkwit"]))
        rows.append((i, " ".join(w)))
    rows += [(1000, "you are a grumplt and a sn0rkwit grumplett"), (1001, None), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[1000].n_hits == 3 and got[1001].predicted == 0 and 0 <= got[1002].score < 0.5
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0 and toxicity.toxicity(docs, labels.where("false")).count() == len(rows)


def test_quotes_pair_within_the_window():
    words = lambda s: s.encode().split()
    for text, at, quoted in [
        ('he said "you grumplet" loudly', 3, True),
        ('a "stray mark and then grumplet', 5, False),
        ("grumplet «one» more", 0, False),
        ('"one" grumplet "two"', 1, False),
        ('"grumplet"', 0, True),
        ('"grumplet,', 0, False),
        ('"' + "x " * 20 + 'grumplet" y', 21, False),
        ("“you silly grumplet!” he wrote", 2, True),
    ]:
        assert toxicity.within_quotes(words(text), at) == quoted, text


def test_toxicity_scores_against_brute_force(spark):
    """The model's hits by a plain search for words one edit apart, on the same lexicon."""
    one_edit = lambda a, b: a == b or any(a[:i] + a[i + 1 :] == b or a[:i] == b[:i] and a[i + 1 :] == b[i + 1 :] and len(a) == len(b) for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    lexicon = toxicity.Lexicon({"grumplet": 2.0, "snork": 1.0}, {"blab": 1.5})
    rng = np.random.default_rng(7)
    pool = ["grumplet", "grumplt", "gr\u00fcmplet", "gumplets", "snork", "snorc", "sn0rk", "blabber", "blab", "bla", "s-n-o-r-k", "snoooork", "plain", "words", "grum"]
    for _ in range(200):
        text = [str(x) for x in rng.choice(pool, 12)]
        got = [h[:3] for h in toxicity.hits([w.encode() for w in text], lexicon)]
        want = []
        for i, w in enumerate(text):
            p = toxicity.plain(w.encode())
            if p in lexicon.words:
                want.append((i, 1, lexicon.words[p]))
            elif any(p[:k] in lexicon.starts for k in toxicity.PREFIXES):
                want.append((i, 2, 1.5))
            elif near := [t for t in lexicon.words if one_edit(p, t)]:
                want.append((i, 3, max(lexicon.words[t] for t in near)))
        assert got == want, text


def test_toxicity_of_repeated_and_null_ids(spark):
    rows = [(i % 50, f"word{i % 7} and grumplet" if i % 2 else f"word{i % 7} and more", i % 2) for i in range(100)] + [(None, "grumplet", 0), (None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, None), (1, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 102 and all(0 <= r.score <= 1 for r in got) and sum(r.doc_id is None for r in got) == 2


def test_automaton():
    trie = toxicity.Trie(["idiot", "stupid"])
    for w, hit in {"idoit": None, "idiott": "idiot", "idit": "idiot", "ideot": "idiot", "stupid": "stupid", "xdiot": "idiot", "stpuid": None, "other": None}.items():
        assert trie.near(w) == hit, w


@pytest.mark.parametrize("name", ["op6_chat", "op9_substring_dedup", "op10_quality"])
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = Q.queries()[name](spark, sf).toPandas()
    want = con.execute(oracles.ORACLES[name]).df()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def held_items(text, items):
    """Whether some part of the text is within a fifth of an item's words, by word edit distance."""
    w = [decontaminate.plain(x.encode()) for x in words(text)]
    for item in items:
        x = [decontaminate.plain(v.encode()) for v in words(item)]
        names = {v: k for k, v in enumerate(dict.fromkeys(x + w))}
        most = int(0.2 * len(x) + 1e-9)
        if x and decontaminate.edit_distance(np.array([names[v] for v in x]), np.array([names[v] for v in w], dtype=np.int64), most)[0] <= most:
            return True
    return False


def test_pipeline_stages(spark):
    """Each stage's rows from its own input, by the checking SQL or brute force."""
    sf = "/root/testdata/sf0.001"
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet")
    apply = lambda name, d: spark.createDataFrame(stages[name](spark, d, sf).collect(), d.schema)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"select doc_id from ({oracles.ORACLES['op10_quality']}) where kept").fetchall()}
    a = apply("quality_rules", docs)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in docs.collect() if r.doc_id in kept}
    b = apply("line_dedup", a)
    rows = sorted((r.doc_id, r.text) for r in a.collect())
    want, got = brute_lines(rows), {r.doc_id: r.text for r in b.collect()}
    count = lambda texts: sum((t or "").count("\n") + 1 for t in texts)
    assert len(got) == len(rows) and sum(got[i] != x for (i, _), x in zip(rows, want)) <= 0.01 * len(rows) and abs(count(got.values()) - count(want)) <= 0.01 * count(want)
    c = apply("simhash_near_dedup", b)
    fps, forest = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(b).collect()}, common.Forest()
    for i, x in fps.items():
        for j, y in fps.items():
            if i < j and (x ^ y).bit_count() <= 4:
                forest.union(i, j)
    assert {tuple(r) for r in c.collect()} == {tuple(r) for r in b.collect() if forest.find(r.doc_id) == r.doc_id}
    d = apply("benchmark_decontamination", c)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {tuple(r) for r in d.collect()} == {tuple(r) for r in c.collect() if not held_items(r.text, items)}
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    e = stages["best_fit_packing"](spark, d, sf).collect()
    sizes = Counter()
    for r in e:
        sizes[r.doc_id] += r.length
    assert sizes == {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in d.collect()}
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect()) == sorted(tuple(r)[:5] for r in e)


def test_stages_on_odd_tables(spark):
    """Nulls in every column, repeated rows and ids, long texts, clashing names, and no rows at all."""
    sf = "/root/testdata/sf0.001"
    long = "one two three four five six seven eight nine ten, and so on. " * 40_000
    rows = [(k % 6, t, None if k % 3 else "en", None if k % 2 else "s", k, f"x{k}", k, None, k) for k, t in enumerate([*TEXTS, *TEXTS, long, BASE * 3])]
    rows += [(None, t, None, None, None, None, None, None, None) for t in (None, "", BASE, BASE)]
    odd = spark.createDataFrame(rows, SCHEMA + ", own string, gone int, left_out string, t_lang int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, sf)
            assert out.columns == odd.columns and out.count() <= docs.count(), name
            if name == "simhash_near_dedup" and out.count():
                texts = [r.text for r in out.collect()]
                assert len(texts) == len(set(texts)) and BASE in texts
            if name == "quality_rules" and out.count():
                assert {r.n_chars for r in out.collect()} == {r.doc_id for r in quality.quality(odd.where("n_chars is not null").withColumn("doc_id", F.col("n_chars"))).where("kept").collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).select("sequence_id", "offset").distinct().count() >= len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), sf).count() == 0
