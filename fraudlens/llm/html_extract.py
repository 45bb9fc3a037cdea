"""Main text of web pages by tag-path ratios.

A page's text leaves are grouped by their tag path from the root. For each path
the text length and the punctuation are set against its number of leaves, the
two ratios are fused, and each leaf takes its path's value. The values are
smoothed over the neighbouring leaves, and those that reach a share of the
page's mean are content. The content leaves choose the page's region: the
deepest container that holds most of their text. Inside it blocks below the
threshold still belong to the article (a headline, a list's items) unless
something speaks against them.

What stands beside articles by its element, role or whole name (``comments``,
``comment-list``, but not ``share-price``) is left out before any ratio is taken, however long it is,
unless it wraps the article itself (an ``article``, ``main`` or ``h1`` that no other such element
round it explains away) or is all the text there is. Of what is left, an ``article`` or
``main`` with any text is where the region is looked for. Parts of names are weak evidence: they
scale a leaf's value down, so among alike paths the one without them wins. A headline before the
region brings the branch that it stands in. Never shown are scripts, styles, controls and the like.

Each page is worked out on its own, in time linear in its length, so Spark deals
pages over tasks, nothing is shuffled and memory is bounded by one page.

Defined cases: null html is the empty page (text ``''``, 0 code points); pages
without content leaves give the empty text; ids and urls are passed through as
they are, repeated or null; repeated rows give equal rows; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Element names and name parts of attributes, from the HTML standard and common practice.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript template head button select option input object svg canvas dialog audio video map annotation annotation-xml".split())
BESIDE = frozenset("nav header footer aside form fieldset label menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("article body center div html main section td".split())
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion promotions banner banners sidebar sidebars "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations trending comment comments disqus reply "
    "replies respond widget widgets toolbar pagination pager copyright".split()
)
NOT_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words that say nothing in a name made of several, and words that turn it round.
LAYOUT = frozenset(
    "list lists area areas wrap wrapper container box section block inner outer top bottom left right post posts article articles page site item items bar panel module link links "
    "form title body group row col column unit slot button buttons icon icons count thread threads stories tree holder region text secondary global side user blog entry entries".split()
)
TURNED = frozenset("no not has have with without is hide show".split())
#: An open element of these ends when one of the second kind begins.
ENDS = {
    "p": BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: The other way round: what a start tag of a name may end; and the elements that it does not look beyond.
ENDED_BY = {name: tuple(e for e, names in ENDS.items() if name in names) for name in frozenset().union(*ENDS.values())}
WALLS = CONTAINERS | {"ul", "ol", "dl", "table"}
PUNCTUATION = re.compile(r"[.,;:!?…。，！？；：、]")
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attributes2>[^>]*+)(?:>|\Z)",
    re.S,
)
_HINTS = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")


#: What evidence leaves of a leaf's value: an element or role that stands beside articles, a whole
#: name in class or id, a part of one, a block that is all links.
BESIDE_FACTOR, NAME_FACTOR, PART_FACTOR, LINK_FACTOR = 0.05, 0.2, 0.4, 0.3
#: Signs that an element stands beside the article: its own name or role, or its class or id.
BY_ELEMENT, BY_NAME = 1, 2
#: Block elements whose own class and id say nothing: headings and paragraphs often carry words of their text.
UNNAMED = frozenset("html body article main h1 h2 h3 h4 h5 h6 p".split())


def _whole_name(token: str) -> bool:
    """Whether a class or id names what stands beside articles, alone or with words that say nothing."""
    parts = [x.lower() for x in _PARTS.findall(token)]
    return token.lower() in NOT_ARTICLE or any(x in NOT_ARTICLE for x in parts) and all(x in NOT_ARTICLE or x in LAYOUT for x in parts) and not any(x.isdigit() for x in token)


@lru_cache(4096)
def _evidence(name: str, attributes: str, in_article: bool) -> tuple[float, int]:
    """The factor of an element on its leaves' values, 0 if it is never shown, and its sign."""
    if name in SKIPPED:
        return 0.0, 0
    heading = in_article and name in ("header", "hgroup")
    factor, sign = (BESIDE_FACTOR, BY_ELEMENT) if name in BESIDE and not heading else (1.0, 0)
    named = name in BLOCKS and name not in UNNAMED and not heading
    for hint in _HINTS.finditer(attributes):
        kind, value = hint[1].lower(), (hint[2] or hint[3] or hint[4] or "")
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
            return 0.0, 0
        if kind == "role" and value.strip().lower() in NOT_ARTICLE_ROLES:
            factor, sign = min(factor, BESIDE_FACTOR), sign or BY_ELEMENT
        elif kind in ("class", "id") and (named or name == "article"):
            if any(map(_whole_name, value.split())):
                factor, sign = min(factor, NAME_FACTOR), sign or BY_NAME
            elif named and any(part.lower() in NOT_ARTICLE for x in value.split() for part in _PARTS.findall(x)) and not any(x.lower() in TURNED for x in _PARTS.findall(value)):
                factor = min(factor, PART_FACTOR)
    return factor, sign


class _Element:
    """An element; ``path`` is the number of its tag path, ``at`` its place in the stack of open elements."""

    __slots__ = ("name", "parent", "factor", "sign", "path", "in_article", "in_link", "at", "number")

    def __init__(self, name: str, parent: _Element | None, factor: float, path: int, number: int, sign: int = 0):
        self.name, self.parent, self.path, self.number, self.sign = name, parent, path, number, sign
        self.factor = factor * (parent.factor if parent else 1.0)
        self.in_article = name in ("article", "main") or bool(parent and parent.in_article)
        self.in_link = name == "a" or bool(parent and parent.in_link)
        self.at = parent.at + 1 if parent else 0


class _Open:
    """The open elements, and for each name those that carry it, so that no tag walks the whole stack."""

    def __init__(self):
        self.paths: dict[tuple[int, str], int] = {}
        self.elements = [_Element("", None, 1.0, 0, 0)]
        self.stack = list(self.elements)
        self.named: dict[str, list[_Element]] = {}
        self.blocks, self.walls = [self.stack[0]], [self.stack[0]]

    @property
    def here(self) -> _Element:
        return self.stack[-1]

    def push(self, name: str, attributes: str) -> None:
        path = self.paths.setdefault((self.here.path, name), len(self.paths) + 1)
        factor, sign = _evidence(name, attributes, self.here.in_article)
        new = _Element(name, self.here, factor, path, len(self.elements), sign)
        self.elements.append(new)
        self.stack.append(new)
        self.named.setdefault(name, []).append(new)
        if name in BLOCKS:
            self.blocks.append(new)
        if name in WALLS:
            self.walls.append(new)

    def close(self, element: _Element) -> None:
        """Close ``element`` and all that is open in it."""
        while len(self.stack) > element.at:
            x = self.stack.pop()
            self.named[x.name].pop()
            for some in (self.blocks, self.walls):
                if some[-1] is x:
                    some.pop()

    def innermost(self, name: str) -> _Element | None:
        some = self.named.get(name)
        return some[-1] if some else None

    def end(self, name: str) -> None:
        """An end tag: it closes the innermost element of its name, an inline one only inside its block."""
        x = self.innermost(name)
        if x and (name in BLOCKS or x.at > self.blocks[-1].at):
            self.close(x)

    def begin(self, name: str) -> None:
        """What a start tag closes by itself."""
        wall = self.walls[-1]
        ended = [x for x in (self.innermost(e) for e in ENDED_BY.get(name, ())) if x and x.at > wall.at]
        if ended:
            self.close(max(ended, key=lambda x: x.at))
        elif wall.name in ("td", "th") and name in ENDS[wall.name]:
            self.close(wall)


def text_leaves(html: str) -> tuple[list[tuple[_Element, int, str]], list[_Element]]:
    """((element, block, text) of the text that may be shown, in page order; all elements, parents first)."""
    leaves, block = [], 0
    tree = _Open()
    at, end = 0, len(html)
    raw = None
    while at <= end:
        if raw:  # all up to the end tag is text of this element
            close = _raw_end(raw).search(html, at)
            at, raw = (close.start() if close else end), None
        tag = _TOKEN.search(html, at)
        text = html[at : tag.start() if tag else end]
        if text and tree.here.factor:
            leaves.append((tree.here, block, text))
        if not tag:
            break
        at = tag.end()
        name = tag["name"] or tag["name2"]
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS:
            block += 1
        if tag["end"] or tag["end2"]:
            tree.end(name)
        elif name == "br":
            if tree.here.factor:
                leaves.append((tree.here, block, "\n"))
        elif name not in VOID:
            tree.begin(name)
            tree.push(name, tag["attributes"] or tag["attributes2"] or "")
            raw = name if name in RAW else None
    return leaves, tree.elements


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?=[\\s/>]|$)", re.I)


def leaf_values(leaves: list[tuple[_Element, int, str]], sizes: np.ndarray, spread: float = 1.0) -> np.ndarray:
    """The value of each leaf: its path's ratios of text and of punctuation to
    leaves, fused, smoothed with a Gaussian over two neighbours at each side and
    scaled by the leaf's evidence; blank leaves have 0."""
    shown = np.flatnonzero(sizes)
    if not len(shown):
        return np.zeros(len(leaves))
    some = [leaves[i] for i in shown]
    marks = np.fromiter((len(PUNCTUATION.findall(text)) for _, _, text in some), float, len(some))
    _, path = np.unique([element.path for element, _, _ in some], return_inverse=True)
    count = np.bincount(path)
    fused = np.bincount(path, sizes[shown]) / count * (1 + np.bincount(path, marks) / count)
    kernel = np.exp(-(np.arange(-2, 3) ** 2) / (2 * spread * spread))
    near = lambda x: np.convolve(x, kernel)[2:-2]
    smooth = near(fused[path]) / near(np.ones(len(some)))
    _, block = np.unique([block for _, block, _ in some], return_inverse=True)
    unlinked = np.bincount(block, [not element.in_link for element, _, _ in some]) > 0
    out = np.zeros(len(leaves))
    out[shown] = smooth * [element.factor for element, _, _ in some] * np.where(unlinked[block], 1.0, LINK_FACTOR)
    return out


def content_leaves(leaves: list[tuple[_Element, int, str]], sizes: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Which leaves are content: their value is at least ``share`` of the
    values' mean over text, in which text counts as far as evidence lets it."""
    values = leaf_values(leaves, sizes)
    weights = sizes * np.fromiter((element.factor for element, _, _ in leaves), float, len(leaves))
    return (sizes > 0) & (values * weights.sum() >= share * (values @ weights))


def _beside(elements: list[_Element]) -> list[bool]:
    """Which elements stand beside the article: those with a sign, and all in them.

    A sign does not count on an element round an ``article`` or ``main``, nor, if a page has none,
    round its ``h1``, unless such an element without a sign round it is elsewhere on the page."""
    signed = [False] * len(elements)
    for x in elements:
        signed[x.number] = bool(x.sign) or x.parent is not None and signed[x.parent.number]
    for names in (("article", "main"), ("h1",)):
        found = [x for x in elements if x.name in names and not x.sign]
        if found:
            if all(signed[x.number] for x in found):
                wrapping = [False] * len(elements)
                for x in found[:1] if names == ("h1",) else found:
                    at = x.parent
                    while at is not None and not wrapping[at.number]:
                        wrapping[at.number] = names != ("h1",) or at.sign == BY_NAME or at.name == "form"
                        at = at.parent
                for x in elements:
                    signed[x.number] = bool(x.sign) and not wrapping[x.number] or x.parent is not None and signed[x.parent.number]
            break
    return signed


def _region(leaves: list[tuple[_Element, int, str]], elements: list[_Element], sizes: np.ndarray, content: np.ndarray, share: float = 0.8) -> _Element | None:
    """The deepest container with at least ``share`` of the content text, looked for in
    the article and main elements if these have any text. An article or main element round
    it, which may hold its headline, breaks the tie between containers of the same content."""
    held = [i for i in np.flatnonzero(sizes).tolist() if leaves[i][0].in_article]
    some = [i for i in held if content[i]] or held or np.flatnonzero(content).tolist()
    weights = [0] * len(elements)
    for i in some:
        weights[leaves[i][0].number] += int(sizes[i])
    for x in reversed(elements[1:]):
        weights[x.parent.number] += weights[x.number]
    if not weights[0]:
        return None
    found = max((x for x in elements if (x.name in CONTAINERS or not x.parent) and weights[x.number] >= share * weights[0]), key=lambda x: (x.at, weights[x.number]))
    x = found
    while x is not None and x.name not in ("article", "main"):
        x = x.parent
    return x or found


def _headline_branch(leaves: list[tuple[_Element, int, str]], elements: list[_Element], region: _Element, sizes: np.ndarray) -> _Element | None:
    """If the region is in no article and has no h1, the branch beside it that holds the last h1 before it."""
    if region.in_article or region.parent is None:
        return None
    on_path, at = set(), region.parent
    while at is not None:
        on_path.add(at.number)
        at = at.parent
    # for each element the branch that leaves the way from the root to the region, and the h1 that it is in
    branch_of: list[_Element | None] = [None] * len(elements)
    heading: list[_Element | None] = [None] * len(elements)
    for x in elements[1:]:
        if x.number not in on_path:
            branch_of[x.number] = branch_of[x.parent.number] or x
            heading[x.number] = x if x.name == "h1" else heading[x.parent.number]
    found = None
    for (x, _, _), size in zip(leaves, sizes.tolist()):
        if branch_of[x.number] is region:
            break
        if size and heading[x.number]:
            found = branch_of[x.number]
    return found


def main_text(html: str | None) -> str:
    leaves, elements = text_leaves(html or "")
    beside = _beside(elements)
    if any(not beside[x.number] and text.strip() for x, _, text in leaves):
        leaves = [leaf for leaf in leaves if not beside[leaf[0].number]]
    sizes = np.fromiter((len("".join(text.split())) for _, _, text in leaves), np.int64, len(leaves))
    content = content_leaves(leaves, sizes)
    region = _region(leaves, elements, sizes, content)
    if region is None:
        return ""
    branch = _headline_branch(leaves, elements, region, sizes)
    inside = [False] * len(elements)
    for x in elements:
        inside[x.number] = x is region or x is branch or x.parent is not None and inside[x.parent.number]
    blocks: list[list[tuple[_Element, bool, str]]] = []
    last = None
    for (element, block, text), is_content in zip(leaves, content.tolist()):
        if inside[element.number]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append((element, is_content, text))
    # a block goes if none of its leaves is content, weak evidence speaks against it and all of it is links
    kept = (b for b in blocks if any(c for _, c, _ in b) or all(x.factor >= region.factor for x, _, _ in b) or any(text.strip() and not x.in_link for x, _, text in b))
    lines = (" ".join("".join(unescape(text) for _, _, text in b).split()) for b in kept)
    return "\n".join(line for line in lines if line)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
