"""Main text of web pages by scoring their trees.

Every block of text passes points for its length and its commas, discounted by
its link density, to the container it stands in and, in falling shares, to that
one's ancestors.  The container with the most points is kept, and so is all that
stands around it without being mostly links: in the page's main element, or
beside its outermost article, or else anywhere.  The kept blocks, in page order,
are the text.  Parts that are never the article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are cut out first, by
tag, role, or a word of their class or id.

Null, empty and markup-only pages give an empty text.  Pages may be cut off or
badly nested; an unfinished tag at the end is dropped.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame

from swarmframe.llm.annotate import annotate

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CONTAINERS = frozenset("article section main div body td center root".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl td th body html root article section div".split())

#: Tags, roles, and words of a class or id that mark parts beside the article.
DROPPED_TAGS = frozenset("nav header footer aside form button menu dialog fieldset object applet canvas audio video head figcaption".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice alert "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead comment comments commentlist disqus replies "
    "share sharing social related recommended newsletter subscribe subscription popup modal overlay login signup search widget toolbar pagination pager skip".split()
)
#: What a container's own tag is worth.
TAG_POINTS = {"article": 12.0, "main": 10.0, "section": 3.0, "div": 2.0}
SHARES = (1.0, 0.5, 0.25, 0.125)
#: A part around the best container with so large a share of its letters in links is left out.
MOST_LINKED = 0.5


class _Node:
    __slots__ = ("children", "parent", "points", "tag")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[_Node | _Block] = []
        self.points = 0.0


class _Block:
    __slots__ = ("linked", "text")

    def __init__(self, text: str, linked: float):
        self.text, self.linked = text, linked


def _beside(tag: str, attributes: str) -> bool:
    if tag in DROPPED_TAGS:
        return True
    if not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in DROPPED_ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and not DROPPED_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower())):
            return True
    return False


def _tree(page: str) -> _Node:
    """Containers and blocks of a page, without the parts beside the article."""
    root = _Node("root", None)
    stack: list[tuple[str, _Node]] = [("root", root)]  # open tags, each with the node its blocks go to
    text: list[str] = []
    linked: list[str] = []
    skip, skip_at = "", 0  # an open dropped element and the depth of its own name
    in_link = 0

    def flush() -> None:
        words = " ".join("".join(text).split())
        if words:
            link = len("".join("".join(linked).split()))
            stack[-1][1].children.append(_Block(words, link / max(1, len(words.replace(" ", "")))))
        text.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw and not skip:
            plain = entities.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if in_link:
                linked.append(plain)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        closing, tag = bool(m[1]), m[2].lower()
        if not m[4]:
            break  # an unfinished tag
        if not closing and tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if skip:
            if tag == skip and tag not in VOID:
                skip_at += -1 if closing else (0 if m[3].endswith("/") and tag not in ("div", "section") else 1)
                if skip_at == 0:
                    skip = ""
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                text.append(" ")
                if in_link:
                    linked.append(" ")
            elif not closing and tag not in VOID and _beside(tag, m[3]):
                skip, skip_at = tag, 1
            continue
        flush()
        in_link = 0
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "table", "td") and tag in ("p", "li", "div", "span"):
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, {"p"})
        if tag in SAME_CLOSES:
            _close(stack, SAME_CLOSES[tag])
        if tag in VOID:
            continue
        if _beside(tag, m[3]):
            skip, skip_at = tag, 1
            continue
        if tag in CONTAINERS:
            node = _Node(tag, stack[-1][1])
            stack[-1][1].children.append(node)
        else:
            node = stack[-1][1]
        stack.append((tag, node))
    flush()
    return root


def _close(stack: list[tuple[str, _Node]], tags: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in tags:
            del stack[k:]
            return
        if stack[k][0] in SCOPES:
            return


def _score(node: _Node, nodes: list[_Node]) -> None:
    todo = [node]
    while todo:
        at = todo.pop()
        nodes.append(at)
        for child in at.children:
            if isinstance(child, _Node):
                todo.append(child)
                continue
            points = (1 + child.text.count(",") + min(len(child.text) / 100, 3)) * (1 - child.linked)
            up: _Node | None = at
            for share in SHARES:
                if up is None:
                    break
                up.points += points * share
                up = up.parent
    for at in nodes:
        if any(isinstance(c, _Block) for c in at.children) or at.points:
            at.points += TAG_POINTS.get(at.tag, 0)


def _blocks(node: _Node, out: list[_Block]) -> list[_Block]:
    todo: list[_Node | _Block] = [node]
    while todo:
        at = todo.pop()
        if isinstance(at, _Block):
            out.append(at)
        else:
            todo.extend(reversed(at.children))
    return out


def _letters(nodes: list[_Node]) -> dict[_Node, list[float]]:
    """Length of the text below each node, and of that in links; nodes: parents before children."""
    found = {at: [0.0, 0.0] for at in nodes}
    for at in reversed(nodes):
        own = found[at]
        for child in at.children:
            if isinstance(child, _Block):
                own[0] += len(child.text)
                own[1] += len(child.text) * child.linked
        if at.parent is not None:
            up = found[at.parent]
            up[0] += own[0]
            up[1] += own[1]
    return found


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = _tree(page)
    nodes: list[_Node] = []
    _score(root, nodes)
    best = max(nodes, key=lambda n: n.points)
    if best.points <= 0:
        return ""
    around: set[_Node | _Block] = {best}  # the best container and those that it lies in
    top = best if best.tag in ("article", "main") else None
    up = best.parent
    while up is not None:
        around.add(up)
        if up.tag in ("article", "main"):
            top = up
        up = up.parent
    if top is None:
        scope = root
    else:
        scope = top if top.tag == "main" and top is not best else top.parent
    letters = _letters(nodes)
    kept: list[_Block] = []
    todo: list[_Node | _Block] = [scope]
    while todo:
        at = todo.pop()
        if at is best or at not in around:
            _blocks(at, kept)
            continue
        for child in reversed(at.children):
            if child in around:
                good = True
            elif isinstance(child, _Node):
                good = letters[child][1] < MOST_LINKED * letters[child][0]
            else:
                good = child.linked < MOST_LINKED
            if good:
                todo.append(child)
    return "\n".join(b.text for b in kept)


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """keep, text and n_chars (code points) of every row of pages."""

    def run(part):
        texts = [extract(h) for h in part.column(column).to_pylist()]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return annotate(pages, run, "text string, n_chars long", keep, column)
