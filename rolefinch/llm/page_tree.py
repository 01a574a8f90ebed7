"""HTML pages as block elements and blocks of text, for malformed markup too."""

from __future__ import annotations

import html
import re
from functools import lru_cache
from typing import NamedTuple

# Element and class names of HTML pages.
CONTAINERS = frozenset("body main article section div td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CONTAINERS | HEADINGS | frozenset("html head title aside nav header footer form noscript template address blockquote caption dd details dialog dir dl dt fieldset figcaption figure hgroup legend li menu ol optgroup option p pre search summary table tbody tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
IN_HEAD = frozenset("base link meta script style template title noscript".split())
SCOPES = frozenset("table td th caption button object template html".split())
FURNITURE = frozenset("head title nav footer aside form noscript template dialog menu search".split())
MUTE = frozenset("button select svg canvas audio video object datalist iframe".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist respond disqus reply replies discussion".split())
HEADS = frozenset("header masthead".split())
CLASSES = COMMENTS | HEADS | frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended pagination pager toolbar searchform".split()
)
NEGATIONS = frozenset("has with no without free".split())
# What an element of another kind closes, and how far up it looks.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select", "datalist")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}

PLAIN, HEADER, FURNISHED, REMARK = range(4)

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page(NamedTuple):
    tags: list[str]
    labels: list[str]  # of tag and classes, numbers generalised
    parents: list[int]
    kinds: list[int]
    blocks: list[tuple[int, str, int]]  # innermost block element, text, characters of it in links


@lru_cache(8192)
def described(tag: str, attributes: str) -> tuple[str, int]:
    """The label of an element and whether it is page furniture, a header or a place of remarks."""
    kind = FURNISHED if tag in FURNITURE else HEADER if tag == "header" else PLAIN
    label = tag
    if attributes.strip(" /"):
        values = {}
        for m in _ATTRIBUTE.finditer(attributes):
            values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        classes = html.unescape(values.get("class", "")).split()
        label = ".".join([tag, *sorted({re.sub(r"\d+", "#", c.lower()) for c in classes})])
        if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", values.get("style", ""), re.I) or values.get("role", "").lower() in ROLES:
            kind = FURNISHED
        for c in [*classes, *html.unescape(values.get("id", "")).split()] * (tag not in ("html", "body") and kind != FURNISHED):
            words = {x.lower() for x in _PARTS.findall(c)}
            if tag in ("article", "main") and c.lower() not in CLASSES and not words & COMMENTS:
                continue
            if words & CLASSES and not words & NEGATIONS:
                kind = max(kind, REMARK if words & COMMENTS else HEADER if words & CLASSES <= HEADS else FURNISHED)
    return label, kind


def parse(source: str) -> Page:
    """The block elements and blocks of a page. Character references are decoded, white space is one space."""
    tags, labels, parents, kinds, blocks = ["#"], [""], [0], [PLAIN], []
    stack: list[tuple[str, int, bool]] = [("#", 0, False)]  # tag, node or -1, whether what it holds is left out
    run: list[str] = []
    node = linked = mute = links = 0

    def flush():
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append((node, text, linked))
            run.clear()
        linked = 0

    def close(size):
        """Shorten the stack to ``size`` elements."""
        nonlocal node, mute, links
        gone = stack[size:]
        del stack[size:]
        if any(n >= 0 for _, n, _ in gone):
            flush()
            node = next(n for _, n, _ in reversed(stack) if n >= 0)
        mute -= sum(m for _, _, m in gone)
        links -= sum(t == "a" for t, _, _ in gone)

    def upto(wanted, bounds):
        """Where the innermost element of ``wanted`` is on the stack, if no bound stands above it, else 0."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in wanted:
                return k
            if stack[k][0] in bounds:
                return 0
        return 0

    def said(text):
        nonlocal linked
        if not mute and text:
            if stack[-1][0] == "head" and not text.isspace():
                close(len(stack) - 1)
            run.append(html.unescape(text) if "&" in text else text)
            if links:
                linked += len(text)

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            said(source[at:])
            break
        if m.start() > at:
            said(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("body", "html"):
                if size := upto((tag,), ()):
                    close(size + 1)
            elif tag == "br":
                run.append(" ")
            elif tag in BLOCKS or tag in MUTE:
                if size := upto(HEADINGS if tag in HEADINGS else (tag,), SCOPES if tag not in SCOPES else ("table",) if tag != "table" else ()):
                    close(size)
            elif size := upto((tag,), BLOCKS):
                close(size)
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            at = end if stop is None else stop.start()
            if stop is not None:
                closing = source.find(">", at)
                at = end if closing < 0 else closing + 1
            continue
        if tag in EMPTY:
            if tag == "br":
                run.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in ("html", "body") and any(t == tag for t, _, _ in stack):
            continue
        if tag in BLOCKS:
            if tag in CLOSES:
                if size := upto(*CLOSES[tag]):
                    close(size)
            elif tag in HEADINGS and stack[-1][0] in HEADINGS:
                close(len(stack) - 1)
            if size := upto(("p",), SCOPES):
                close(size)
            flush()
            label, kind = described(tag, m[3])
            tags.append(tag)
            labels.append(label)
            parents.append(node)
            kinds.append(FURNISHED if mute else kind)
            node = len(tags) - 1
            stack.append((tag, node, False))
        else:
            left_out = tag in MUTE or (m[3] != "" and described(tag, m[3])[1] != PLAIN)
            if m[3].endswith("/") and tag in MUTE:  # an empty drawing
                continue
            stack.append((tag, -1, left_out))
            mute += left_out
            links += tag == "a"
    close(1)
    flush()
    return Page(tags, labels, parents, kinds, blocks)


@lru_cache(8192)
def _of_article(label: str) -> bool:
    return label.startswith(("article", "main")) or bool(re.search(r"[.\-_](article|post|entry|story)(?![a-z])", label))


def visible(page: Page) -> list[bool]:
    """Which elements hold text of the page itself rather than its furniture.

    A header within an article shows its headings. A form, or an element that only a class marks, is no furniture if it
    holds an article or the main element, nor is one that only a class marks if it holds half of the page's text with a
    first heading or three paragraphs, as wrappers of a whole page do; unless it is a place of remarks.
    """
    n = len(page.tags)
    holds = [t in ("article", "main") and k == PLAIN for t, k in zip(page.tags, page.kinds)]
    weight, signs = [0] * n, [3 * (t == "h1") + (t == "p") for t in page.tags]
    for node, text, linked in page.blocks:
        weight[node] += len(text) - linked
    half = max(1, sum(weight)) / 2
    for k in range(n - 1, 0, -1):
        up = page.parents[k]
        if page.kinds[k] == REMARK or page.tags[k] in ("head", "aside", "nav", "footer"):
            holds[k] = False
            continue
        weight[up] += weight[k]
        signs[up] += signs[k]
        if holds[k]:
            holds[up] = True
        elif page.kinds[k] == FURNISHED and page.tags[k] not in FURNITURE and weight[k] >= half and signs[k] >= 3:
            holds[k] = True
    shown, headed, gone = range(3)
    state, article = [shown] * n, [False] * n
    for k in range(1, n):
        p, tag, kind = page.parents[k], page.tags[k], page.kinds[k]
        kind = PLAIN if kind == HEADER and tag in HEADINGS else kind  # a heading that is called a header is one
        article[k] = article[p] or _of_article(page.labels[k])
        if state[p] == gone:
            state[k] = gone
        elif state[p] == headed:
            state[k] = gone if kind != PLAIN else shown if tag in HEADINGS else headed
        elif kind != PLAIN and not holds[k]:
            state[k] = headed if kind == HEADER and article[k] else gone
    return [x == shown for x in state]
