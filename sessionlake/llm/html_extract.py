"""Main-text extraction: the maximum-scoring contiguous region of a page.

A page is read as a sequence of words (positive scores) and tags (negative
scores); one linear scan finds the contiguous region with the largest sum. The
scores come from labelled pages, those whose markup names its own main part
(one <article> or <main>): log-odds of a token inside against outside it, then
corrected by perceptron steps on pages whose best region is not the labelled
one. An element that names itself as no main text (BOILERPLATE elements, class
or id words in BOILERPLATE_NAMES) counts as one tag token with all it holds,
unless it is a frame around the main part.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled pages used for the scores, at most about, and the bytes of the longest of them, so that they fit on the driver.
TRAIN_PAGES = 400
TRAIN_BYTES = 256 << 10

#: Element and attribute names of HTML.
RAW = frozenset(("script", "style", "template", "noscript", "iframe", "svg", "textarea", "title", "object", "math"))
BOILERPLATE = frozenset(("nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
INLINE = frozenset((
    "a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
))
BOILERPLATE_NAMES = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent",
    "disqus", "footer", "header", "login", "menu", "menus", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo",
    "promoted", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
))
#: Of these, names of parts that may hold articles of their own.
OTHER_TEXTS = frozenset(("comment", "comments", "disqus", "related", "promoted", "sponsored"))

#: Parts that a class or id may have beside names and still say the same: nav-wrapper is a nav, no-sidebar is no sidebar.
NEUTRAL_PARTS = frozenset((
    "area", "bar", "block", "bottom", "box", "container", "content", "desktop", "form", "global", "group", "inner", "item", "items", "left", "link", "links", "list",
    "main", "mobile", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "text", "top", "wrap", "wrapper",
))
#: Elements whose end tags do not close a block that is open inside them.
LOOSE = INLINE | {"p", "li", "dt", "dd", "option"}

#: What the start tag of an element ends without an end tag: itself and these (HTML's optional end tags).
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)} | dict.fromkeys((
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
), ("p",))

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z]+")


@dataclass
class Weights:
    """Scores of tag tokens (below zero) and of a word (above zero)."""

    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    unknown: float = -0.5

    def tag(self, token: str) -> float:
        return self.tags.get(token, self.unknown)


def _boilerplate(name: str, attributes: str) -> str:
    """'element' or 'name' if an element is no main text by its kind or its class and id words, 'aside' if those name other texts, else ''."""
    if name in BOILERPLATE:
        return "element"
    if name in ("body", "html", "article", "main") or not attributes:
        return ""
    named = set()
    for m in _NAMED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            parts = {p.lower() for p in _PART.findall(token)}
            if parts - NEUTRAL_PARTS <= BOILERPLATE_NAMES:
                named |= parts
    if named & OTHER_TEXTS:
        return "aside"
    return "name" if named & BOILERPLATE_NAMES else ""


@dataclass
class _Page:
    """A page's tags and texts in order, with the end tag of each element that has one."""

    #: (name, attributes, text, is end tag); name is '' for text
    parts: list[tuple[str, str, str, bool]]
    end: dict[int, int]
    #: words, and outermost <article> and <main>, before each part and in all
    words: list[int]
    mains: list[int]


def _page(page: str) -> _Page:
    parts: list[tuple[str, str, str, bool]] = []
    at, length = 0, len(page)
    while at < length:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(("", "", page[at:], False))
            break
        if m.start() > at:
            parts.append(("", "", page[at : m.start()], False))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        parts.append((name, m[3] or m[6] or "", "", closing))
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else length
    ends: dict[int, int] = {}
    stack: list[int] = []
    opened: Counter = Counter()
    #: open LOOSE elements by name, above each open element that is not LOOSE
    levels: list[Counter] = [Counter()]
    words, mains, inside = [0], [0], 0

    def close(name: str, at: int) -> None:
        """End the innermost open `name` at part `at`; what is still open inside it has no end tag."""
        nonlocal inside
        while True:
            own = parts[j := stack.pop()][0]
            opened[own] -= 1
            inside -= own in ("article", "main")
            if own in LOOSE:
                levels[-1][own] -= 1
            else:
                levels.pop()
            if own == name:
                ends[j] = at
                return

    for i, (name, attributes, text, closing) in enumerate(parts):
        main = False
        if not closing:
            for ended in IMPLIED_END.get(name, ()):
                if levels[-1][ended]:
                    close(ended, i - 1)
        if name in RAW or name in VOID or not name:
            pass
        elif not closing:
            if not attributes.rstrip().endswith("/"):
                stack.append(i)
                opened[name] += 1
                if name in LOOSE:
                    levels[-1][name] += 1
                else:
                    levels.append(Counter())
                if name in ("article", "main"):
                    main = inside == 0
                    inside += 1
        elif levels[-1][name] if name in LOOSE else opened[name]:
            close(name, i)
        words.append(words[-1] + (len(text.split()) if not name else 0))
        mains.append(mains[-1] + main)
    return _Page(parts, ends, words, mains)


def _is_frame(page: _Page, i: int, why: str) -> bool:
    """Whether element `i`, boilerplate by `why`, stands around the main part and is to stay."""
    if (end := page.end.get(i)) is None:
        return True  # no end tag: nothing says how far it reaches
    held = page.mains[end] - page.mains[i]
    if why == "name":
        return held > 0
    if page.mains[-1]:
        return held == 1 == page.mains[-1]
    return page.parts[i][0] == "form" and 2 * (page.words[end] - page.words[i]) > page.words[-1]


def page_tokens(page: str) -> list[tuple[str, str, bool]]:
    """(tag, text, is block tag) in order; tag is '' for text. Boilerplate elements are one tag.

    An element that only its class or id calls boilerplate, but that holds an
    <article> or <main>, is a frame around the page and stays. So do other
    boilerplate elements that hold the page's only one, a form around most of
    the words of a page that has none, and elements without an end tag.
    """
    read = _page(page)
    out: list[tuple[str, str, bool]] = []
    i = 0
    while i < len(read.parts):
        name, attributes, text, closing = read.parts[i]
        i += 1
        if not name:
            out.append(("", text, False))
        elif not closing and name in RAW:
            out.append((f"<{name}>", "", True))
        elif not closing and name not in VOID and (why := _boilerplate(name, attributes)):
            if attributes.rstrip().endswith("/"):
                out.append((f"<{name} boilerplate>", "", True))
            elif _is_frame(read, i - 1, why):
                out.append((f"<{name}>", "", name not in INLINE))
            else:
                out.append((f"<{name} boilerplate>", "", True))
                i = read.end[i - 1] + 1
        else:
            out.append((f"</{name}>" if closing else f"<{name}>", "", name not in INLINE))
    return out


def best_region(tokens: list[tuple[str, str, bool]], weights: Weights) -> tuple[int, int]:
    """[start, end) of the contiguous tokens with the largest sum of scores (the earliest; empty if none is positive)."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, (tag, text, _) in enumerate(tokens):
        total += weights.tag(tag) if tag else weights.word * len(text.split())
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    return found


def region_text(tokens: list[tuple[str, str, bool]]) -> str:
    """Blocks of the tokens joined by two newlines; white space in a block is one space."""
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        if text := " ".join(html_lib.unescape("".join(now)).split()):
            blocks.append(text)
        now.clear()

    for tag, text, block in tokens:
        if not tag:
            now.append(text)
        elif block:
            close()
        elif tag in ("<br>", "</br>"):
            now.append(" ")
    close()
    return "\n\n".join(blocks)


def extract(page: str | None, weights: Weights) -> str:
    """Main text of one page; '' for a null or empty page or one without words."""
    if not page:
        return ""
    tokens = page_tokens(page)
    start, end = best_region(tokens, weights)
    return region_text(tokens[start:end])


def _gold(tokens: list[tuple[str, str, bool]]) -> tuple[int, int] | None:
    for name in ("article", "main"):
        opened = [i for i, t in enumerate(tokens) if t[0] == f"<{name}>"]
        closed = [i for i, t in enumerate(tokens) if t[0] == f"</{name}>"]
        if len(opened) == 1 and len(closed) == 1 and opened[0] < closed[0]:
            return opened[0] + 1, closed[0]
    return None


def train(pages: list[str], rounds: int = 10) -> Weights:
    """Scores from labelled pages; pages without a label are passed over. No page gives default scores."""
    inside, outside, gold = Counter(), Counter(), []
    for page in pages:
        tokens = page_tokens(page)
        if (span := _gold(tokens)) is None:
            continue
        gold.append((tokens, span))
        for i, (tag, text, _) in enumerate(tokens):
            (inside if span[0] <= i < span[1] else outside)[tag] += 1 if tag else len(text.split())
    if not gold:
        return Weights()
    n_in, n_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    odds = {t: math.log((inside[t] + 0.5) / n_in) - math.log((outside[t] + 0.5) / n_out) for t in {*inside, *outside}}
    weights = Weights(1.0, {t: min(-0.01, v) for t, v in odds.items() if t})
    for _ in range(rounds):
        wrong = 0
        for tokens, (a, b) in gold:
            start, end = best_region(tokens, weights)
            if region_text(tokens[start:end]) == region_text(tokens[a:b]):
                continue
            wrong += 1
            right, taken = Counter(t for t, _, _ in tokens[a:b] if t), Counter(t for t, _, _ in tokens[start:end] if t)
            for t in {*right, *taken}:
                weights.tags[t] = min(-0.01, weights.tag(t) + 0.1 * (right[t] - taken[t]))
        if not wrong:
            break
    return weights


def fit(pages: DataFrame, n: int = TRAIN_PAGES) -> Weights:
    """Scores from a bounded sample of labelled pages, the same ones on every run."""
    marked = pages.where((F.octet_length("html") <= TRAIN_BYTES) & F.lower(F.col("html").cast("string")).rlike(r"<(article|main)\b")).select("page_id", F.col("html").cast("string").alias("html"))
    total = marked.count()
    point = F.pmod(F.xxhash64(F.col("page_id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = marked.where(point < n / max(total, 1)).limit(4 * n).collect()
    return train([r.html for r in sorted(rows, key=lambda r: (str(r.page_id), r.html))])


def extract_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """(page_id, url, text) for every row of `pages` (page_id, url, html). Whole pages; text is never null.

    A page's text depends on its html alone: repeated rows are each returned,
    with equal texts; null ids and urls stay null. Of regions with equal sums
    the earliest is taken. Other columns are not read. An empty table gives an
    empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([extract(p.as_py(), w) for p in batch.column(2)], pa.string())], ["page_id", "url", "text"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def code_points(text: Column) -> Column:
    return F.char_length(text).cast("long")
