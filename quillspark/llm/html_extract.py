"""Main text of web pages by tag-path ratios.

A page is cut into text blocks with their root-to-leaf tag paths. A part of a path is the element with its
class (else its id), digits left out; a container without either has its place among its parent's children, near the
page's top, so that a page of plain containers has more than one path. For each path the text
length and the punctuation are aggregated over the page; the length ratio (characters per
node) and the punctuation ratio (and one) are smoothed, as logarithms, over paths that follow each other on the page,
fused as a product, and only paths above a threshold can be content: the geometric mean of the page's
fused ratios over their geometric deviation, which no single heavy path moves far. All article and main elements together are one container, every other parent
is one. If the article and main elements hold the most fused mass, all their paths above the
threshold and their headings, short by nature, are content and paths outside are not; else the paths of the heaviest
parent and headings in it are, and paths anywhere that reach its mean ratio. Subtrees whose element
is a menu, header, footer and so on, or that are hidden, and blocks
whose class, id or role says menu, header, footer, sidebar, notice, advert, form, script,
style or comments are never content; an inline element is part of its text whatever its class.

Cases: a null or empty page, and a page without text, give an empty text; unclosed and
misnested tags are closed by their parents; text outside any element is a path of its own;
a tag that never ends is text; elements more than DEPTH deep are siblings, as in browsers; a page's
time grows with its length. Each row has its result, also of a null or repeated id; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import steps

#: Elements of HTML by their part.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIP = frozenset("nav header footer aside form menu button select option fieldset label input dialog head canvas audio video object map".split()) | RAW
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NAMED = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|aside|ad|ads|advert|adverts|advertisement|advertising|banner|promo|promoted|sponsor|sponsored|cookie|cookies|consent|notice|notices|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|breadcrumb|breadcrumbs|pagination|pager|comment|comments|commentlist|disqus|respond|replies|reviews|widget|copyright|legal|disclaimer|toolbar|search|form)(?:$|[\s_-]|\d)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SEMANTIC = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCT = re.compile(r"[.,;:!?…。、，！？；：¿¡]")
NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
STOP = re.compile("[\"'>]")
DEPTH = 512
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
GLUE = re.compile(r"[\s\xa0]+")


def markup(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(begin, end, tag, attributes, closing) of each piece of markup in turn; comments and declarations have no tag.

    send() moves on to a place of the page. Where a quoted attribute never ends, quotes no
    longer count from there on: so no piece is read more than twice.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            tag, attrs, closing = "", "", False
        elif at > last:
            return
        elif page.startswith(("<!", "<?"), at):
            end, tag, attrs, closing = page.find(">", at) + 1, "", "", False
        elif m := NAME.match(page, at):
            end = m.end()
            while quotes and (stop := STOP.search(page, end)):
                end = stop.end()
                if stop[0] == ">" or not (end := page.find(stop[0], end) + 1):
                    break
            else:
                end = 0
            if not end:
                quotes, end = False, page.find(">", m.end()) + 1
            tag, attrs, closing = m[2].lower(), page[m.end() : end - 1], bool(m[1])
        else:
            at += 1
            continue
        moved = yield at, end, tag, attrs, closing
        at = end if moved is None else moved


def boilerplate(tag: str, attrs: str) -> bool:
    """Whether a subtree is no content by its element, its names or its being hidden; names of inline elements don't count."""
    if tag in SKIP:
        return True
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and tag not in INLINE and NAMED.search(value):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


#: Containers that are told apart by their place, and how deep in the page.
PLACED, NEAR_TOP = frozenset("div section table".split()), 4


def label(tag: str, attrs: str, place: int, depth: int) -> str:
    """A part of a tag path: the element, and its class or id or place."""
    named = {name.lower(): value.strip("\"'").lower() for name, value in ATTR.findall(attrs)} if attrs else {}
    if value := named.get("class") or named.get("id"):
        return f"{tag}.{'.'.join(sorted(NUMBER.sub('', value).split())[:3])}".replace("/", "")
    return f"{tag}:{place}" if tag in PLACED and depth < NEAR_TOP else tag


NUMBER = re.compile(r"\d+")


def blocks(page: str) -> list[tuple[str, str, bool]]:
    """(tag path, text, not boilerplate) of each block in page order; inline elements don't end a block."""
    stack: list[tuple[str, bool, str]] = []
    places: list[int] = [0]  # children so far of each open element
    out: list[tuple[str, str, bool]] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            if t := GLUE.sub(" ", entities.unescape("".join(text))).strip():
                out.append(("/".join(path for x, _, path in stack if x not in INLINE), t, not any(b for _, b, _ in stack)))
            text.clear()

    def close(k: int) -> None:
        if any(x not in INLINE or b for x, b, _ in stack[k:]):
            flush()
        del stack[k:], places[k + 1 :]

    pieces, at, moved = markup(page), 0, None
    while True:
        try:
            begin, end, tag, attrs, closing = pieces.send(moved)
        except StopIteration:
            text.append(page[at:])
            break
        if begin > at:
            text.append(page[at:begin])
        at, moved = end, None
        if not tag:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "body", "table", "td") and tag in INLINE:
                    break
            continue
        if tag in CLOSES_P or tag == "li":
            stop = ("ul", "ol", "menu") if tag == "li" else ("article", "main", "body", "section", "div", "td", "li", "blockquote")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] == ("li" if tag == "li" else "p"):
                    close(k)
                    break
        if tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ") if tag == "br" else flush()
            continue
        skip = boilerplate(tag, attrs)
        if tag not in INLINE or skip:
            flush()
        if tag in RAW:
            m = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = moved = m.end() if m else len(page)
            continue
        if len(stack) >= DEPTH:
            close(DEPTH - 1)
        if tag not in INLINE:
            places[-1] += 1
        stack.append((tag, skip, label(tag, attrs, places[-1], len(stack))))
        places.append(0)
    flush()
    return out


def fused_ratios(found: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """The paths of blocks (path, text) in page order, and their smoothed and fused ratios."""
    nodes, chars, marks = Counter(), Counter(), Counter()
    for path, text in found:
        nodes[path] += 1
        chars[path] += len(text)
        marks[path] += len(PUNCT.findall(text))
    names = list(nodes)
    length = np.array([chars[p] / nodes[p] for p in names])
    punct = np.array([marks[p] / nodes[p] for p in names])
    return names, np.exp(smooth(np.log(length)) + smooth(np.log1p(punct)))


def content(page: str) -> str:
    """Main text of one page."""
    found = [b for b in blocks(page) if b[2]]
    if not found:
        return ""
    names, fused = fused_ratios([(p, t) for p, t, _ in found])
    nodes = Counter(p for p, _, _ in found)
    logs = np.log(fused)
    limit = float(np.exp(logs.mean() - logs.std())) * (1 - 1e-6)
    # the fused mass of all article and main elements' paths above the limit, and of each other parent
    inner, named, mass = set(), 0.0, defaultdict(float)
    tags = {p: {x.partition(".")[0].partition(":")[0] for x in p.split("/")} for p in names}
    for p, f in zip(names, fused, strict=True):
        if not SEMANTIC.isdisjoint(tags[p]):
            if f >= limit or not HEADINGS.isdisjoint(tags[p]):
                inner.add(p)
                named += float(f) * nodes[p]
        else:
            mass[p.rpartition("/")[0]] += float(f) * nodes[p]
    best = max(mass, key=mass.__getitem__, default=None)
    if best is None or inner and named >= mass[best]:
        keep = inner
    else:
        within = lambda p: p not in inner and (p == best or p.startswith(best + "/") or not best)
        own = [float(f) for p, f in zip(names, fused, strict=True) if within(p) and f >= limit]
        high = sum(own) / len(own) if own else limit
        keep = {p for p, f in zip(names, fused, strict=True) if within(p) and (f >= limit or not HEADINGS.isdisjoint(tags[p])) or f >= max(high, limit)}
    return " ".join(t for p, t, _ in found if p in keep)


def smooth(x: np.ndarray) -> np.ndarray:
    """Weighted mean with the paths before and after."""
    padded = np.r_[x[:1], x, x[-1:]]
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pages in steps(batches, "html"):
            text = [content(h.decode("utf-8", "replace")) for h in pages]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string, n_chars long")
