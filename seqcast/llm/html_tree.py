"""A light element tree of a web page: blocks of text, and what a classifier wants to know of each element."""

from __future__ import annotations

import html
import re

import numpy as np

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What is in these is no markup up to their end tag, or to the page's end. What is in the others is not shown where they end at all; one without an
# end tag is an element like any other.
RAW = frozenset("script style iframe textarea title".split())
UNSHOWN = frozenset("template svg canvas audio video head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong "
                   "sub sup time tt u var wbr label".split())
CONTROLS = frozenset("button select option input textarea".split())
# Start tags that end an open paragraph, and those that end an open element of their own kind.
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr main menu nav ol p pre section table ul li dt dd tr td th tbody thead body".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",)}
# An end tag or an implied end does not reach through these.
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"),
         "option": ("select",)}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

KINDS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "heading", "list", "item", "table",
         "quote", "other")
_KIND = {"nav": 0, "header": 1, "footer": 2, "aside": 3, "form": 4, "article": 5, "main": 6, "section": 7, "div": 8, "p": 9,
         **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 10), **dict.fromkeys(("ul", "ol", "dl", "menu"), 11),
         **dict.fromkeys(("li", "dt", "dd"), 12), **dict.fromkeys(("table", "tbody", "thead", "tr", "td", "th"), 13),
         **dict.fromkeys(("blockquote", "pre", "figure"), 14)}
# Words of class, id and role by what they usually mark.
TOKENS = {
    "text": "article content main post story entry body text prose page",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs tabs toc pagination pager topbar",
    "edge": "header head masthead footer foot copyright legal colophon bottom logo branding contentinfo",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular complementary rail teaser more",
    "notice": "cookie cookies consent gdpr notice notices alert banner popup modal overlay dialog toast warning disclaimer message",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted outbrain taboola",
    "form": "form newsletter subscribe subscription signup login search register contact donate",
    "comment": "comment comments reply replies respond discussion disqus thread commenter feedback",
    "share": "share sharing social follow tweet like tags meta byline author",
}
_GROUP = {word: g for g, words in enumerate(TOKENS.values()) for word in words.split()}
FEATURES = (*KINDS, *(f"token_{g}" for g in TOKENS), "bad_above", "good_above", "depth", "log_chars", "page_share", "link_share", "density",
            "block_words", "stops", "siblings", "position", "alike", "before", "after", "start", "paragraphs", "controls")


class Tree:
    """Elements other than inline ones in page order, and the text blocks that each holds directly."""

    def __init__(self) -> None:
        self.tags, self.parents, self.depths, self.tokens = ["#root"], [-1], [0], [[0] * len(TOKENS)]
        self.controls = [0]
        self.owners: list[int] = []
        self.texts: list[str] = []
        self.links: list[int] = []


class Open:
    """Open elements from the root down, and where those of each name are, so that the innermost one is found without a search."""

    def __init__(self) -> None:
        self.nodes, self.names, self.at = [0], ["#root"], {}

    def innermost(self, names: tuple[str, ...]) -> int:
        """Depth of the innermost open element of these names, 0 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def push(self, node: int, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        self.nodes.append(node)
        self.names.append(name)

    def pop_to(self, depth: int) -> None:
        for name in self.names[depth:]:
            self.at[name].pop()
        del self.nodes[depth:], self.names[depth:]


def parse(page: str) -> Tree:
    """Read a page, whatever its faults: comments, scripts and the head hold no text, unclosed elements end where HTML ends them. The time it
    takes grows with the page's length, however deep its elements lie.

    A block is the text between two starts or ends of elements that are not inline. Character
    references are decoded and runs of white space become one space.
    """
    tree = Tree()
    opened = Open()
    endless: set[str] = set()
    pieces: list[str] = []
    in_link, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                tree.owners.append(opened.nodes[-1])
                tree.texts.append(text)
                tree.links.append(linked)
            pieces.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        flush()
        opened.pop_to(depth)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        if m.start() > at:
            piece = page[at: m.start()]
            pieces.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                in_link = 0
            elif name not in INLINE:
                depth = opened.innermost((name,))
                if depth and opened.innermost(SCOPE.get(name, ())) <= depth:
                    pop_to(depth)
                    in_link = 0
            continue
        if (name in RAW or name in UNSHOWN) and not m.group(3).endswith("/"):
            # The head ends with its end tag or, where that is missing, with the body. An end that is not there is looked for once.
            end = None if name in endless else re.compile(r"</head\s*>|(?=<body\b)" if name == "head" else rf"</{name}[^>]*>", re.I).search(page, at)
            if end or name in RAW:
                at = end.end() if end else n
                continue
            endless.add(name)
            if name == "head":
                continue
        if name in CONTROLS:
            tree.controls[opened.nodes[-1]] += 1
        if name in INLINE:
            if name == "a":
                in_link = 1
            elif name == "br":
                pieces.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in ENDS_P and (depth := opened.innermost(("p",))):
            pop_to(depth)
            in_link = 0
        if name in ENDS:
            depth = opened.innermost(ENDS[name])
            if depth > opened.innermost(SCOPE[name]):
                pop_to(depth)
        flush()
        groups = [0] * len(TOKENS)
        if m.group(3):
            for _, *values in ATTRIBUTE.findall(m.group(3)):
                for word in TOKEN.findall("".join(values)):
                    g = _GROUP.get(word.lower())
                    if g is not None:
                        groups[g] += 1
        tree.tags.append(name)
        tree.parents.append(opened.nodes[-1])
        tree.depths.append(len(opened.nodes))
        tree.tokens.append(groups)
        tree.controls.append(0)
        opened.push(len(tree.tags) - 1, name)
    flush()
    return tree


def node_features(tree: Tree) -> np.ndarray:
    """A row of ``FEATURES`` per element: its tag and attribute tokens, what stands above, its depth, text and siblings."""
    n = len(tree.tags)
    parents = tree.parents
    chars, links, words, blocks, stops, paragraphs = ([0] * n for _ in range(6))
    controls, size = list(tree.controls), [1] * n
    starts = [None] * n
    seen = 0
    for owner, text, linked in zip(tree.owners, tree.texts, tree.links, strict=True):
        chars[owner] += len(text)
        links[owner] += min(linked, len(text))
        words[owner] += text.count(" ") + 1
        blocks[owner] += 1
        stops[owner] += text.count(".") + text.count(",")
        if starts[owner] is None:
            starts[owner] = seen
        seen += len(text)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        children[p].append(i)
        if tree.tags[i] == "p" or tree.tags[i] in ("h1", "h2", "h3"):
            paragraphs[i] += 1
        for total in (chars, links, words, blocks, stops, paragraphs, controls, size):
            total[p] += total[i]
        if starts[i] is not None and (starts[p] is None or starts[i] < starts[p]):
            starts[p] = starts[i]
    bad, good = [0] * n, [0] * n
    page = max(1, seen)
    logs = np.log1p(chars).tolist()
    place: list[tuple] = [(1, 0.0, 1.0, 0.0, 0.0)] * n
    for below in children:
        m = len(below)
        alike: dict[str, int] = {}
        for i in below:
            alike[tree.tags[i]] = alike.get(tree.tags[i], 0) + 1
        # Children were met from the last to the first.
        for j, i in enumerate(below):
            place[i] = (m, (m - 1 - j) / m, alike[tree.tags[i]] / m, logs[below[j + 1]] if j + 1 < m else 0.0, logs[below[j - 1]] if j else 0.0)
    rows = []
    for i in range(n):
        p, c, tokens = parents[i], chars[i], tree.tokens[i]
        kind = _KIND.get(tree.tags[i], 15)
        above = (bad[p], good[p]) if p >= 0 else (0, 0)
        bad[i] = above[0] + (kind in (0, 2, 3, 4) or any(tokens[1:]))
        good[i] = above[1] + (kind in (5, 6) or tokens[0] > 0)
        one_hot = [0] * len(KINDS)
        one_hot[kind] = 1
        rows.append((*one_hot, *tokens, *above, tree.depths[i], logs[i], c / page, links[i] / c if c else 0, c / size[i],
                     words[i] / blocks[i] if blocks[i] else 0, stops[i] / words[i] if words[i] else 0, *place[i],
                     (starts[i] or 0) / page, paragraphs[i], controls[i]))
    return np.array(rows, float)
