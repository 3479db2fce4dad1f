"""A small tree of the block elements of a page, with what a classifier needs to know about each."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape

import numpy as np

# Element names of the HTML standard by their use, and words that authors use in class and id.
SKIPPED = frozenset("script style noscript template svg iframe select textarea button canvas object audio video title annotation annotation-xml".split())
#: Skipped elements whose content is raw text up to the first closing tag, and those that hold others of their kind; the others end where their kind begins again.
RAW, NESTED = frozenset("script style".split()), frozenset("svg template canvas object audio video annotation-xml".split())
#: What the head may hold besides skipped elements; the head itself has no node, and the body begins with whatever else comes.
HEAD = frozenset("head base basefont bgsound link meta".split())
MATHS = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr maction semantics mfenced".split()
)
INLINE = MATHS | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label map mark meter output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
KINDS = {
    **dict.fromkeys(("article", "main"), 1), "nav": 2, "header": 3, "footer": 4, "aside": 5, "form": 6, **dict.fromkeys(("ul", "ol", "dl", "menu"), 7),
    **dict.fromkeys(("li", "dt", "dd"), 8), "p": 9, **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 10), **dict.fromkeys(("div", "section"), 11),
    **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th"), 12), **dict.fromkeys(("pre", "blockquote", "figure", "figcaption"), 13), "#text": 14,
}
#: Borders that text of a skipped element without a closing tag does not reach over.
BORDERS = frozenset(KINDS) - {"#text"} | frozenset("html body address center fieldset details summary dialog hgroup hr search caption".split())
GOOD_WORDS = frozenset("article body content entry main post story text prose page".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs button comment comments cookie consent disclaimer discussion disqus feed footer form header hidden login masthead menu modal nav navbar navigation "
    "newsletter notice pager pagination popup promo promotion recommend recommended related remark reply respond responses search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar top widget alert meta legal copyright".split()
)

_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "depth", "children", "text", "links", "good", "bad", "number")

    def __init__(self, tag: str, parent: Node | None, number: int, attributes: str = ""):
        self.tag, self.parent, self.number = tag, parent, number
        self.depth = 0 if parent is None else parent.depth + 1
        self.children: list[Node] = []
        self.text, self.links = "", 0
        self.good = self.bad = 0
        if attributes:
            words = {w.lower() for m in _ATTRIBUTE.finditer(attributes) for w in _WORD.findall(m[2])}
            self.good, self.bad = len(words & GOOD_WORDS), len(words & BAD_WORDS)
            if "display:none" in attributes.replace(" ", "") or re.search(r"\bhidden\b", attributes):
                self.bad += 1


def _tag_end(page: str, start: int, quotes: dict[str, bool]) -> int:
    """Place of the > that ends a tag; one within quotes does not, unless the quotes never end."""
    at = start
    while True:
        end = page.find(">", at)
        if end < 0:
            return -1
        mark = min((p for p in (page.find(q, at, end) for q in "\"'") if p >= 0), default=-1)
        if mark < 0:
            return end
        close = page.find(page[mark], mark + 1) if quotes[page[mark]] else -1
        if close < 0:
            quotes[page[mark]] = False
            return end
        at = close + 1


def _closings(page: str, tag: str) -> tuple[list[int], list[int]]:
    """Places after the opening tags' names of a skipped element, and the ends of their closing tags, -1 where one is missing."""
    opens, ends, waiting = [], [], []
    last = 0
    for m in re.finditer(rf"<(/?){tag}(?![a-zA-Z0-9:-])", page, re.I):
        if 0 <= last < m.end():
            last = page.find(">", m.end())
        if m[1]:
            for k in waiting if tag in RAW else waiting[-1:]:
                ends[k] = len(page) if last < 0 else last + 1
            del waiting[0 if tag in RAW else -1 :]
        else:
            if tag not in RAW and tag not in NESTED:
                waiting.clear()
            opens.append(m.end())
            ends.append(-1)
            if last < 0 or page[last - 1] != "/":
                waiting.append(len(opens) - 1)
    return opens, ends


def _border(page: str, start: int) -> int:
    """Where the next tag of a block begins, or the page's end."""
    return next((m.start() for m in _TAG.finditer(page, start) if m[1].lower() in BORDERS), len(page))


def parse(page: str) -> list[Node]:
    """All block nodes in page order, the root first. A run of text between block borders is a node ``#text`` of its own."""
    root = Node("#root", None, 0)
    nodes, now = [root], root
    open_by: dict[str, list[Node]] = {}
    run: list[str] = []
    state = {"link": False, "links": 0}
    quotes = {'"': True, "'": True}
    closings: dict[str, tuple[list[int], list[int]]] = {}

    def nearest(tags) -> Node | None:
        """The innermost open node of some tags."""
        return max((open_by[t][-1] for t in tags if open_by.get(t)), key=lambda x: x.depth, default=None)

    def leave(target: Node) -> Node:
        """Close the open nodes up to a node and that itself; its parent is where the page goes on."""
        x = now
        while x.depth >= target.depth:
            open_by[x.tag].pop()
            x = x.parent
        return x

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                leaf = Node("#text", now, len(nodes))
                leaf.text, leaf.links = text, min(state["links"], len(text))
                now.children.append(leaf)
                nodes.append(leaf)
            run.clear()
        state["links"] = 0

    def words(raw: str) -> None:
        raw = unescape(raw) if "&" in raw else raw
        run.append(raw)
        if state["link"]:
            state["links"] += len(raw.strip())

    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            words(page[at:])
            break
        if mark > at:
            words(page[at:mark])
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = size if end < 0 else end + 3
            continue
        if page[mark + 1 : mark + 2] in ("!", "?"):
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
            continue
        name = _NAME.match(page, mark + 1)
        if not name:
            words("<")
            at = mark + 1
            continue
        end = _tag_end(page, name.end(), quotes)
        if end < 0:
            break
        closing, tag, attributes = page[mark + 1] == "/", name[1].lower(), page[name.end() : end]
        at = end + 1
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                if tag not in closings:
                    closings[tag] = _closings(page, tag)
                opens, ends = closings[tag]
                k = bisect_left(opens, name.end())
                close = ends[k] if k < len(opens) and opens[k] == name.end() else -1
                at = close if close >= at else _border(page, at)
                if tag not in ("button", "select", "textarea", "svg", "canvas", "annotation", "annotation-xml"):
                    flush()
            continue
        if tag in HEAD:
            flush()
            continue
        if tag in INLINE:
            if tag == "a":
                state["link"] = not closing
            elif tag == "br":
                run.append(" ")
            continue
        flush()
        if closing:
            target = nearest((tag,))
            if target:
                now = leave(target)
            continue
        if now.tag == "p":
            now = leave(now)
        if tag in CLOSES:
            same, stop = CLOSES[tag]
            target = nearest((*same, *stop))
            if target and target.tag in same:
                now = leave(target)
        if tag in ("html", "body") and any(n.tag == tag for n in nodes[:4]):
            continue
        node = Node(tag, now, len(nodes), attributes)
        now.children.append(node)
        nodes.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            now = node
            open_by.setdefault(tag, []).append(node)
    flush()
    return nodes


FEATURES = 27


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: subtree density, attribute words, depth, siblings, place in the page, own and inherited."""
    n = len(nodes)
    chars, links, tags, runs, points, longest, words = (np.zeros(n) for _ in range(7))
    for x in nodes:
        if x.tag == "#text":
            i = x.number
            chars[i], links[i], runs[i], words[i] = len(x.text), x.links, 1, x.text.count(" ") + 1
            points[i] = sum(map(x.text.count, ".,;!?"))
            longest[i] = len(x.text)
        else:
            tags[x.number] = 1
    for x in reversed(nodes[1:]):
        i, p = x.number, x.parent.number
        for a in (chars, links, tags, runs, points, words):
            a[p] += a[i]
        longest[p] = max(longest[p], longest[i])
    out = np.zeros((n, FEATURES))
    passed, good, bad = 0.0, np.zeros(n), np.zeros(n)
    region = np.zeros((n, 6))
    total, page_points = max(chars[0], 1), max(points[0], 1)
    tags_of: dict[int, Counter] = {}
    for x in nodes:
        i, p = x.number, x.parent.number if x.parent else 0
        kind = KINDS.get(x.tag, 0)
        if x.parent:
            good[i], bad[i] = good[p] + x.good, bad[p] + x.bad
            region[i] = region[p]
        if 1 <= kind <= 6:
            region[i, kind - 1] = 1
        siblings = x.parent.children if x.parent else [x]
        if x.parent and p not in tags_of:
            tags_of[p] = Counter(s.tag for s in siblings)
        alike = tags_of[p][x.tag] if x.parent else 1
        text = max(chars[i], 1)
        out[i, :21] = (
            x.depth, np.log1p(chars[i]), chars[i] / (tags[i] + 1), links[i] / text, runs[i], chars[i] / max(runs[i], 1), points[i] / max(words[i], 1), longest[i], len(x.children), alike, len(siblings),
            chars[i] / max(chars[p], 1), chars[i] / total, passed / total, points[i] / page_points, kind, x.good, x.bad, good[i], bad[i], links[p] / max(chars[p], 1),
        )
        out[i, 21:] = region[i]
        if x.tag == "#text":
            passed += chars[i]
    return out


def decode(nodes: list[Node], share: np.ndarray) -> list[str]:
    """Texts of the runs chosen by the best consistent labels.

    A node is in if main text lies in it, so a node can only be in if its parent is; the two best sums of log shares of each
    subtree, with its root in or out, are added from the leaves upwards, and the choice is read off downwards.
    """
    yes, no = np.log(np.clip(share, 1e-6, 1)), np.log(np.clip(1 - share, 1e-6, 1))
    inside, outside = yes.copy(), no.copy()
    for x in reversed(nodes[1:]):
        i, p = x.number, x.parent.number
        inside[p] += max(inside[i], outside[i])
        outside[p] += outside[i]
    chosen = np.zeros(len(nodes), bool)
    chosen[0] = True
    out = []
    for x in nodes[1:]:
        i = x.number
        chosen[i] = chosen[x.parent.number] and inside[i] > outside[i]
        if chosen[i] and x.tag == "#text":
            out.append(x.text)
    return out
