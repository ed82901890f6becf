"""Main text of HTML pages by scoring the tree of containers."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import numbered_columns, others

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas video audio textarea title".split())
BOILERPLATE = frozenset("nav header footer aside form button select dialog menu head".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary hr center fieldset legend nav header footer aside form dialog menu head".split()
)
CLOSES_P = BLOCK - frozenset("html body td th li dd dt caption figcaption summary legend".split())
#: An element that opens closes open ones of these names, up to the nearest of the second list.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "body": (("head",), ()),
}
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adbox|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumbs?|footer|"
    r"sidebar|widget|related|recommended|share|sharing|social|comments?|disqus|replies|reply|cookie|cookies|consent|notice|gdpr|popup|modal|"
    r"overlay|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|skip|hidden)(?:$|[\s_-])",
    re.I,
)
#: Names that are a page's outside an article, and may be a title's or a picture's inside one.
UNWANTED_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:banner|header|masthead|side|rail|more)(?:$|[\s_-])", re.I)
#: Names that tell what a page has beside an element, not what the element is.
_BESIDE = re.compile(r"\b(?:has|with|no)-[\w-]+", re.I)
WANTED = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|main|story|text|body)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: A whole tag as most are written; all others are scanned attribute by attribute.
_SIMPLE = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\s++[a-zA-Z_:-]++(?:=(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=`/]++))?+)*+)\s*+(/?)>")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:=(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_NO_CONTAINER = _HEADING | frozenset("p pre dt dd summary legend caption figcaption".split())
_P_LIMITS = ("article", "table", "td", "th", "body", "button")
_INLINE_LIMITS = ("table", "td", "article", "body")
_SPACE = re.compile(r"\s+")
_STYLE_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
#: Ancestors that a block gives points to.
LEVELS = 12


class _Node:
    __slots__ = ("container", "doubtful", "drop", "form", "good", "heading", "kept", "linked", "parent", "score", "tag", "total")

    def __init__(self, tag: str, parent: _Node | None, drop: bool, doubtful: bool, good: bool):
        self.tag, self.parent, self.drop, self.doubtful, self.good = tag, parent, drop, doubtful, good
        self.score, self.total, self.linked, self.kept = 0.0, 0, 0, False
        self.form = self if tag == "form" else parent.form if parent is not None else None
        self.heading = tag in _HEADING or (parent is not None and parent.heading)
        self.container = parent.container if parent is not None and (tag not in BLOCK or tag in _NO_CONTAINER) else self


class _Block:
    __slots__ = ("heading", "linked", "node", "text")

    def __init__(self, node: _Node, text: str, linked: int):
        self.node, self.heading, self.text, self.linked = node.container, node.heading, text, linked


def _judged(tag: str, found: dict[str, str], inside: bool) -> tuple[bool, bool, bool]:
    """(whether the element goes, whether its name alone says so, whether its name speaks for content)."""
    names = _BESIDE.sub("", f"{found.get('class', '')} {found.get('id', '')}")
    unwanted = bool(UNWANTED.search(names)) or (not inside and bool(UNWANTED_OUTSIDE.search(names)))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_STYLE_HIDDEN.search(found.get("style", "")))
    return hidden or found.get("role", "").lower() in _ROLES, unwanted and tag not in ("html", "body", "main", "article"), bool(WANTED.search(names))


class _Page:
    """The tags of a page; every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def tag(self, at: int) -> tuple[int, bool, str, dict[str, str], bool] | None:
        """(end, whether it closes, name, attributes, whether it ends in a slash) of the tag after the < before `at`."""
        page = self.page
        if at > self.last[">"]:
            return None
        if m := _SIMPLE.match(page, at):
            found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])} if m[3] else {}
            return m.end(), bool(m[1]), m[2].lower(), found, bool(m[4])
        if not (m := _NAME.match(page, at)):
            return None
        found, k, size = {}, m.end(), len(page)
        while True:
            k, before = _GAP.match(page, k).end(), k
            if k >= size or page[k] == ">":
                return min(k + 1, size), bool(m[1]), m[2].lower(), found, page[before:k].endswith("/")
            key = _KEY.match(page, k)
            k, value = key.end(), ""
            if equals := _EQUALS.match(page, k):
                k = equals.end()
                quote = page[k : k + 1]
                if quote in ("'", '"') and self.last[quote] > k:
                    end = page.index(quote, k + 1)
                    value, k = page[k + 1 : end], end + 1
                else:
                    value = _BARE.match(page, k)[0]
                    k += len(value)
            found.setdefault(key[0].lower(), value)


def blocks(text: str) -> tuple[list[_Block], list[_Node]]:
    """The page's blocks of text in order, each with its container, and its elements in order; dropped parts are left out.

    An element whose name alone speaks against it stays if it holds the page's main element or an article's first heading,
    a form also if it holds more than half of the page's text, as where one wraps the whole page.
    """
    root = _Node("", None, False, False, False)
    stack, nodes, parts, linked, links, insides, out = [root], [root], [], 0, 0, 0, []
    places: dict[str, list[int]] = {}
    nearest = lambda names: max((places[n][-1] for n in names if places.get(n)), default=0)

    def flush() -> None:
        nonlocal linked
        if parts:
            if own := _SPACE.sub(" ", "".join(parts)).strip():
                out.append(_Block(stack[-1], own, linked))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if stack[-1].drop or not raw:
            return
        own = entities.unescape(raw) if "&" in raw else raw
        parts.append(own)
        if links:
            linked += len(own.strip())

    def close_to(k: int) -> None:
        nonlocal links, insides
        if any(x.tag in BLOCK for x in stack[k:]):
            flush()
        for x in stack[k:]:
            places[x.tag].pop()
            links -= x.tag == "a"
            insides -= x.good or x.tag in ("article", "main")
        del stack[k:]

    page = _Page(text)
    at, size = 0, len(text)
    while at < size:
        start = text.find("<", at)
        if start < 0:
            add(text[at:])
            break
        add(text[at:start])
        if text.startswith("<!--", start):
            done = _COMMENT_END.search(text, start + 4)
            at = done.end() if done else size
            continue
        if text[start + 1 : start + 2] in ("!", "?"):
            done = text.find(">", start)
            at = done + 1 if done >= 0 else size
            continue
        read = page.tag(start + 1)
        if read is None:
            add("<")
            at = start + 1
            continue
        at, closes, tag, found, slash = read
        if closes:
            k = nearest((tag,))
            if tag == "p" and not k:
                flush()
            if k and (tag in BLOCK or nearest(_INLINE_LIMITS) <= k):
                close_to(k)
            continue
        if tag in RAW:
            if not slash:
                done = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
                at = done.end() if done else size
            continue
        if tag == "br":
            if not stack[-1].drop:
                parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P and (k := nearest(("p",))) > nearest(_P_LIMITS):
            close_to(k)
        if tag in IMPLIED:
            names, limits = IMPLIED[tag]
            while (k := nearest(names)) > nearest(limits):
                close_to(k)
                if tag != "tr":
                    break
        if tag in BLOCK:
            flush()
        above, inside = stack[-1], insides > 0
        gone, doubtful, good = _judged(tag, found, inside) if found else (False, False, False)
        gone = (above.drop or gone or (tag in BOILERPLATE and tag != "form" and not (tag == "header" and inside))) and tag != "body"
        doubtful = doubtful or tag == "form"
        if slash and tag not in BLOCK:
            continue
        if tag == "main" or (tag == "h1" and nearest(("article", "main"))):
            for x in reversed(stack):  # names above are overruled, once each
                if x.kept:
                    break
                x.doubtful, x.kept = False, True
        node = _Node(tag, above, gone, doubtful, good and not gone and not doubtful)
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        nodes.append(node)
        links += tag == "a"
        insides += node.good or tag in ("article", "main")
    flush()
    within: dict[int, int] = {}
    for b in out:
        if b.node.form is not None:
            within[id(b.node.form)] = within.get(id(b.node.form), 0) + len(b.text)
    whole = sum(len(b.text) for b in out)
    for x in nodes:
        x.kept = False
        x.doubtful = x.doubtful and 2 * within.get(id(x), 0) <= whole
        x.doubtful = x.doubtful or (x.parent is not None and x.parent.doubtful)
    return [b for b in out if not b.node.doubtful], nodes


def _above(node: _Node) -> Iterator[_Node]:
    while node is not None:
        yield node
        node = node.parent


def main_text(page: str | None) -> str:
    """The main text of a page: blocks of the best container, of its siblings that are like it, and what lies beside them.

    Beside them, in their parent, every heading and every block with few links is kept, however short.

    A block gives its container 1 point, 1 for each comma and 1 for each 100 characters (3 at most), the container's
    parent half of that and those above a third, a quarter and so on, LEVELS in all; links discount a block by their
    share of its characters, and a container's points by the share of links in all its text. A page without a block
    gives "". The work is linear in the page's length.
    """
    found, nodes = blocks(page or "")
    if not found:
        return ""
    scored: dict[int, _Node] = {}
    for b in found:
        length = len(b.text)
        b.node.total += length
        b.node.linked += b.linked
        if length >= 25:
            commas = b.text.count(",") + b.text.count("，") + b.text.count("、")
            points = (1 - min(1, b.linked / length)) * (1 + commas + min(length / 100, 3))
            for depth, x in zip(range(LEVELS), _above(b.node)):
                scored[id(x)] = x
                x.score += points / (depth + 1)
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.total += x.total
            x.parent.linked += x.linked
    if not scored:
        nearest: dict[int, _Node | None] = {}
        for x in nodes:  # those above come first
            nearest[id(x)] = x if x.tag in ("article", "main") else nearest.get(id(x.parent))
        best = next((nearest[id(b.node)] for b in found if nearest[id(b.node)] is not None), None)
        if best is not None:
            _mark(nodes, {id(best)})
        return "\n".join(b.text for b in found if (best is None or b.node.kept) and b.linked * 2 <= len(b.text))
    value = lambda x: (x.score + (25 if x.tag in ("article", "main") else 0) + (5 if x.good else 0)) * (1 - x.linked / max(1, x.total)) if x.tag not in ("", "html") else -1.0
    best = max(scored.values(), key=value)
    best = next((x for x in _above(best) if x.tag in ("article", "main")), best)
    top, floor = value(best), 0.2 * value(best)
    chosen = {id(best)}
    if best.tag == "article":
        own = lambda x: x.score * (1 - x.linked / max(1, x.total))
        chosen |= {k for k, x in scored.items() if x.parent is best.parent and x.tag == "article" and own(x) >= 0.2 * own(best) > 0}
    elif best.tag not in ("main", "body"):
        chosen |= {k for k, x in scored.items() if x.parent is best.parent and x.tag not in ("li", "tr", "td") and value(x) >= floor and top > 0}
    _mark(nodes, chosen)
    whole = [b.node.kept for b in found]
    if best.parent is None or best.tag in ("article", "main", "body"):
        return "\n".join(b.text for b, w in zip(found, whole, strict=True) if w)
    # the ancestor that holds all kept siblings, above wrappers of the best container alone
    frame = best.parent
    while frame.total == best.total and frame.parent is not None and frame.parent.tag not in ("", "html", "body"):
        frame = frame.parent
    _mark(nodes, {id(frame)})
    return "\n".join(b.text for b, w in zip(found, whole, strict=True) if w or (b.node.kept and (b.heading or b.linked < 0.25 * len(b.text))))


def _mark(nodes: list[_Node], chosen: set[int]) -> None:
    """kept: whether a node or one above it is among the chosen."""
    for x in nodes:
        x.kept = id(x) in chosen or (x.parent is not None and x.parent.kept)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the column `into`, the main text of each page; null, empty or textless pages give "".

    Every row is kept and treated alone, repeated ones too; an empty table gives none. A column named `into`, in any
    case, is replaced.
    """
    kept = [c for c in others(pages, into) if c != html]
    numbered = numbered_columns(pages, [*kept, html])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema[:-1]), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, found = batch.columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array([main_text(x) for x in found.to_pylist()], pa.string())], names=[*batch.schema.names[:-1], "text"])

    return numbered.mapInArrow(run, schema).toDF(*kept, into)
