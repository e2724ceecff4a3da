"""Main text of made pages of several layouts, most of them without an article element."""

import math

import numpy as np
import pytest

from quillspark.llm import html_extract

WORDS = "river stone morning letter garden window silent harbour candle winter market bridge forest copper ribbon".split()
TITLE = "The harbour in the morning"


def paragraph(rng, sentences=4):
    return " ".join(" ".join(rng.choice(WORDS, rng.integers(8, 14))).capitalize() + ", " + " ".join(rng.choice(WORDS, 4)) + "." for _ in range(sentences))


MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS[:8])
LINKS = "".join(f'<a href="/{w}">{w}</a> ' for w in WORDS[:8])
RIGHTS = "© 2024 The Harbour"


def ps(texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


LAYOUTS = {
    "plain divs": lambda t: (f"<div><ul>{MENU}</ul></div><div><h1>{TITLE}</h1>{ps(t)}</div><div>{RIGHTS}</div>", [TITLE, *t]),
    "divs of one line each": lambda t: (f"<div>{LINKS}</div><div>{ps(t)}</div><div>{RIGHTS}</div>", t),
    "deep wrappers": lambda t: (f"<div><div><div>{LINKS}</div><div><h1>{TITLE}</h1>{ps(t)}</div></div><div>{RIGHTS}</div></div>", [TITLE, *t]),
    "classes that say nothing": lambda t: (f'<div class="c1x"><ul>{MENU}</ul></div><div class="post"><h2>{TITLE}</h2>{ps(t)}</div><div class="c3y">{RIGHTS}</div>', [TITLE, *t]),
    "ids that say nothing": lambda t: (f'<div id="top"><ul>{MENU}</ul></div><div id="post17"><h2>{TITLE}</h2>{ps(t)}</div><div id="end">{RIGHTS}</div>', [TITLE, *t]),
    "sections": lambda t: (f"<section><ul>{MENU}</ul></section><section>{ps(t)}</section><section>{LINKS}</section>", t),
    "a table": lambda t: (f"<table><tr><td>{LINKS}</td></tr></table><table><tr><td>{ps(t)}</td></tr></table><table><tr><td>{RIGHTS}</td></tr></table>", t),
    "paragraphs are divs": lambda t: (f'<div class="list">{LINKS}</div><div class="body">{ps(t, "div class=para")}</div><div class="end">{RIGHTS}</div>'.replace("</div class=para>", "</div>"), t),
    "links after the text": lambda t: (f"<div><h1>{TITLE}</h1>{ps(t)}<ul>{MENU}</ul></div>", [TITLE, *t]),
    "headings between": lambda t: (f"<div><ul>{MENU}</ul></div><div>" + "".join(f"<h2>Part {k}</h2><p>{x}</p>" for k, x in enumerate(t)) + "</div>", [y for k, x in enumerate(t) for y in (f"Part {k}", x)]),
    "named parts": lambda t: (f'<div class="nav">{LINKS}</div><div>{ps(t)}</div><div class="comments"><p>{t[0]}</p></div><div class="footer"><p>{t[1]}</p></div>', t),
    "an article": lambda t: (f"<div>{LINKS}</div><article><h1>{TITLE}</h1>{ps(t)}</article><div>{RIGHTS}</div>", [TITLE, *t]),
    "inline classes": lambda t: (f'<div>{LINKS}</div><div><p>The <a class="share">share</a> price rose, and <span class="side">one side</span> won.</p>{ps(t)}</div>', ["The share price rose, and one side won.", *t]),
    "hidden text": lambda t: (f'<div>{LINKS}</div><div>{ps(t)}<p hidden>{t[0]}</p><p>See <span style="display: none">{t[1]}</span>it, there.</p></div>', [*t, "See it, there."]),
}
CASES = [(name, seed) for name in LAYOUTS for seed in (1, 2)]


def made(name, seed):
    rng = np.random.default_rng(seed)
    body, blocks = LAYOUTS[name]([paragraph(rng) for _ in range(int(rng.integers(3, 7)))])
    return f"<html><head><title>{TITLE}</title></head><body>{body}</body></html>", " ".join(blocks)


@pytest.mark.parametrize("name, seed", CASES)
def test_layouts(name, seed):
    page, text = made(name, seed)
    assert html_extract.content(page) == text


def test_the_ratios_decide(monkeypatch):
    """With ratios that are all alike most of these pages come out wrong."""
    pages = [made(*case) for case in CASES]
    monkeypatch.setattr(html_extract, "smooth", lambda x: np.zeros(len(x)))
    assert sum(html_extract.content(page) != text for page, text in pages) >= len(pages) // 2


def test_fused_ratios_against_a_plain_count():
    """The operator's fused ratios by hand: characters and marks per node of each path, smoothed with the neighbours."""
    page = "<body><div class=a><p>One, two.</p><p>Three</p></div><div class=b>Four! Five? Six.</div><ul><li>x</li></ul></body>"
    nodes = {"div.a/p": ["One, two.", "Three"], "div.b": ["Four! Five? Six."], "ul/li": ["x"]}
    length = [sum(map(len, x)) / len(x) for x in nodes.values()]
    marks = [sum(sum(c in ".,!?" for c in y) for y in x) / len(x) for x in nodes.values()]
    near = lambda x: [(x[max(0, k - 1)] * x[k] ** 2 * x[min(len(x) - 1, k + 1)]) ** 0.25 for k in range(len(x))]
    want = [a * b for a, b in zip(near(length), near([1 + m for m in marks]), strict=True)]
    paths, got = html_extract.fused_ratios([(p, t) for p, t, _ in html_extract.blocks(page)])
    assert [p.removeprefix("body/") for p in paths] == list(nodes) and all(math.isclose(a, b) for a, b in zip(got, want, strict=True))
