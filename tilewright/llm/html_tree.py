"""A forgiving HTML reader: block elements and the text runs in them, with the features of each node."""

from __future__ import annotations

import html
import math
import re

import numpy as np

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template noscript iframe svg title textarea select".split())
HEAD = frozenset("html head title base link meta script style noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul caption".split()
)
# A start tag of the key ends an open element of the value, up to the nearest of the last column.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
TAGS = ("article", "main", "section", "div", "p", "heading", "list", "li", "table", "nav", "header", "footer", "aside", "form", "quote", "figure", "text")
_KIND = (
    dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading")
    | dict.fromkeys(("ul", "ol", "menu", "dl"), "list")
    | dict.fromkeys(("dt", "dd"), "li")
    | dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot", "caption"), "table")
    | dict.fromkeys(("pre", "blockquote"), "quote")
    | dict.fromkeys(("figcaption",), "figure")
    | dict.fromkeys(("fieldset", "legend"), "form")
    | {"#text": "text"}
)
# Tokens of class, id and role attributes by what they speak for.
GROUPS = {
    "content": "article content post entry story text body main articlebody maincontent blog single prose",
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs pagination pager toc skip tabs",
    "top": "header top banner masthead logo branding hero topbar",
    "bottom": "footer bottom copyright legal colophon foot imprint",
    "side": "sidebar side aside related widget rail recommended trending popular more complementary links blogroll tags",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion dfp outbrain taboola commercial",
    "reader": "comment comments disqus reply replies respond discussion feedback reviews commentlist",
    "notice": "cookie cookies consent gdpr notice popup modal alert overlay warning paywall dialog toast",
    "share": "share social sharing twitter facebook follow buttons",
    "form": "form newsletter subscribe signup login search contact register email contentinfo",
    "meta": "meta author byline date time timestamp posted credit info",
}
_GROUP_OF = {token: nth for nth, tokens in enumerate(GROUPS.values()) for token in tokens.split()}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.DOTALL,
)
_MARKS = re.compile(r"[.,;:!?]")
_DIGIT = re.compile(r"\d")
LABEL = "data-y"


class Node:
    """A block element, or a text run where text stands beside block elements."""

    __slots__ = ("tag", "parent", "children", "text", "linked", "groups", "label", "number")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node] = []
        self.text, self.linked, self.groups, self.label, self.number = "", 0, 0, None, -1


def _groups(attributes: str) -> tuple[int, str | None]:
    """Groups of an element's attribute tokens as bits, and its label, if it has one."""
    bits, label = 0, None
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            for token in _TOKEN.findall(value):
                nth = _GROUP_OF.get(token.lower())
                if nth is not None:
                    bits |= 1 << nth
        elif name == LABEL:
            label = value
    return bits, label


class _Open:
    """The open elements, with the places of each tag and of all blocks, so that no look-up walks the stack."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, Node]] = [("#root", root)]  # inline elements carry the block they stand in
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    @property
    def block(self) -> Node:
        return self.stack[-1][1]

    def last(self, tag: str) -> int:
        """The place of the innermost open ``tag``, or 0."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def push(self, tag: str, node: Node, is_block: bool) -> None:
        if is_block:
            self.blocks.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node))

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.places[self.stack.pop()[0]].pop()
        while self.blocks[-1] >= depth:
            self.blocks.pop()


def _skip(source: str, tag: str, at: int, unclosed: set[str]) -> int:
    """Where a skipped element that begins before ``at`` ends; one that is never closed ends at the next block element."""
    if tag not in unclosed:
        stop = _END_OF[tag].search(source, at)
        if stop:
            return source.find(">", stop.start()) + 1 or len(source)
        unclosed.add(tag)  # nor is any that begins later
    stop = _BLOCK_TAG.search(source, at)
    return stop.start() if stop else len(source)


def parse(source: str) -> Node:
    """The tree of block elements; each run of text, white space collapsed, is a ``#text`` child of its block.

    The head ends at its end tag or, without one, at the first element or text that no head holds.
    """
    root = Node("#root", None)
    open_ = _Open(root)
    buffer: list[str] = []
    links: list[str] = []
    unclosed: set[str] = set()
    at, end = 0, len(source)
    in_head = False

    def flush() -> None:
        nonlocal buffer, links
        if buffer:
            whole = "".join(buffer)
            text = " ".join((html.unescape(whole) if "&" in whole else whole).split())
            if text:
                run = Node("#text", open_.block)
                run.text = text
                run.linked = min(len(text), len(" ".join("".join(links).split())))
                run.label = run.parent.label
                run.parent.children.append(run)
            buffer, links = [], []

    while at < end:
        m = _MARKUP.search(source, at)
        upto = m.start() if m else end
        if upto > at:
            buffer.append(source[at:upto])
            in_head = in_head and source[at:upto].isspace()
            if open_.last("a"):
                links.append(source[at:upto])
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "head":
            in_head = not closing
            continue
        if in_head and tag not in HEAD:
            in_head = False
        if closing:
            place = open_.last(tag)
            if tag in BLOCK:
                flush()
                if place:
                    open_.close_to(place)
            elif place > open_.blocks[-1]:
                open_.close_to(place)
            elif tag == "br":
                buffer.append(" ")
            continue
        if tag in SKIPPED and not attributes.rstrip().endswith("/"):
            at = _skip(source, tag, at, unclosed)
            continue
        if tag in VOID:
            if tag in ("br", "img", "input"):
                buffer.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            if open_.stack[open_.blocks[-1]][0] == "p":  # a block ends an open paragraph
                open_.close_to(open_.blocks[-1])
            if tag in CLOSES:
                ends, within = CLOSES[tag]
                bound = max(open_.last(t) for t in within)
                places = [p for p in (open_.last(t) for t in ends) if p > bound]
                if places:
                    open_.close_to(min(places) if tag == "tr" else max(places))
            if tag in ("html", "body") and open_.last(tag):
                continue
            node = Node(tag, open_.block)
            node.groups, node.label = _groups(attributes)
            node.label = node.label or node.parent.label
            node.parent.children.append(node)
            open_.push(tag, node, True)
        elif not attributes.rstrip().endswith("/"):
            open_.push(tag, open_.block, False)
    flush()
    return root


_END_OF = {tag: re.compile(rf"</{tag}(?=[\s>/])", re.IGNORECASE) for tag in SKIPPED}
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s>/])", re.IGNORECASE)

N_GROUPS = len(GROUPS)
_ANCESTOR_TAGS = ("article", "main", "nav", "header", "footer", "aside", "form")
NAMES = (
    ["depth", "chars", "words", "link_density", "blocks", "paragraphs", "chars_per_block", "marks", "sentence_end", "sign", "digits"]
    + ["nth", "siblings", "share_of_parent", "before", "after", "place", "share_of_page", "sibling_links"]
    + [f"is_{t}" for t in TAGS]
    + [f"has_{g}" for g in GROUPS]
    + [f"under_{t}" for t in _ANCESTOR_TAGS]
    + [f"under_has_{g}" for g in GROUPS]
    + [f"over_{t}" for t in _ANCESTOR_TAGS]
    + ["over_boilerplate"]
)
_TAG_NUMBER = {t: k for k, t in enumerate(TAGS)}
_BOILERPLATE = sum(1 << k for k, g in enumerate(GROUPS) if g not in ("content", "meta"))


def nodes_of(root: Node) -> list[Node]:
    """All nodes in page order, parents first; a block whose only child is a run takes the run's text as its own."""
    out: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.children) == 1 and node.children[0].tag == "#text" and node.tag != "#root":
            node.text, node.linked = node.children[0].text, node.children[0].linked
            node.children = []
        node.number = len(out)
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row of ``NAMES`` for each node."""
    n = len(nodes)
    chars, words, linked, blocks, paragraphs, marks = (np.zeros(n) for _ in range(6))
    over_tags, over_groups = [0] * n, [0] * n
    for node in nodes:
        k = node.number
        if node.text:
            chars[k], words[k], linked[k] = len(node.text), node.text.count(" ") + 1, node.linked
            marks[k] = len(_MARKS.findall(node.text))
        blocks[k] = 1
        paragraphs[k] = node.tag == "p"
    for node in reversed(nodes[1:]):
        k, up = node.number, node.parent.number
        for v in (chars, words, linked, blocks, paragraphs, marks):
            v[up] += v[k]
        own = 1 << _ANCESTOR_TAGS.index(node.tag) if node.tag in _ANCESTOR_TAGS else 0
        over_tags[up] |= over_tags[k] | own
        over_groups[up] |= over_groups[k] | node.groups
    total = max(1.0, chars[0])
    x = np.zeros((n, len(NAMES)))
    depth, under_tags, under_groups, before = [0] * n, [0] * n, [0] * n, np.zeros(n)
    at_tags, at_groups = 19, 19 + len(TAGS)
    at_under = at_groups + N_GROUPS
    at_under_groups = at_under + len(_ANCESTOR_TAGS)
    at_over = at_under_groups + N_GROUPS
    for node in nodes:
        k = node.number
        up = node.parent
        if up is not None:
            u = up.number
            depth[k] = depth[u] + 1
            own = 1 << _ANCESTOR_TAGS.index(up.tag) if up.tag in _ANCESTOR_TAGS else 0
            under_tags[k], under_groups[k] = under_tags[u] | own, under_groups[u] | up.groups
        row = x[k]
        row[0], row[1], row[2] = depth[k], math.log1p(chars[k]), math.log1p(words[k])
        row[3], row[4], row[5] = linked[k] / max(1.0, chars[k]), math.log1p(blocks[k]), math.log1p(paragraphs[k])
        row[6], row[7] = math.log1p(chars[k] / blocks[k]), marks[k] / max(1.0, words[k])
        if node.text:
            row[8] = node.text[-1] in ".!?\"'»”:"
            row[9] = "©" in node.text or "(c)" in node.text
            row[10] = len(_DIGIT.findall(node.text)) / len(node.text)
        row[16], row[17] = before[k] / total, chars[k] / total
        row[at_tags + _TAG_NUMBER.get(_KIND.get(node.tag, node.tag), 3)] = 1
        _spread(row, at_groups, node.groups, N_GROUPS)
        _spread(row, at_under, under_tags[k], len(_ANCESTOR_TAGS))
        _spread(row, at_under_groups, under_groups[k], N_GROUPS)
        _spread(row, at_over, over_tags[k], len(_ANCESTOR_TAGS))
        row[-1] = bool(over_groups[k] & _BOILERPLATE)
        place, previous = before[k], 0.0
        count = len(node.children)
        mine = chars[k]
        link_rest = linked[k]
        for nth, child in enumerate(node.children):
            c = child.number
            before[c] = place
            place += chars[c]
            row2 = x[c]
            row2[11], row2[12] = nth / max(1, count - 1), math.log1p(count)
            row2[13], row2[14] = chars[c] / max(1.0, mine), math.log1p(previous)
            row2[18] = (link_rest - linked[c]) / max(1.0, mine - chars[c])
            if nth:
                x[node.children[nth - 1].number][15] = math.log1p(chars[c])
            previous = chars[c]
    return x


def _spread(row: np.ndarray, at: int, bits: int, n: int) -> None:
    k = 0
    while bits:
        if bits & 1:
            row[at + k] = 1
        bits >>= 1
        k += 1
