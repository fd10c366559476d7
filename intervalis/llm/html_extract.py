"""Main text of web pages by tag-path ratios.

A tolerant scanner cuts the page into blocks of text, each with its root-to-leaf path of block elements. For every path the
text length and the punctuation of its blocks are summed and divided by the number of blocks. Both ratios are laid out in
page order, smoothed with a Gaussian, multiplied, and compared with a threshold on their spread: blocks on paths above it are
content, inside <article> and <main> and outside alike. Paths that are mostly links, or pass through elements which name
themselves boilerplate (menus, footers, adverts, forms, comments ...), never are. Headings and text elements without a name of
their own that stand beside content and are not mostly links belong to it too, so headings and one-word paragraphs stay; inside
<article> and <main>, beside any element that holds content.

Defined results: a null or empty html gives an empty text. A page without any path above the threshold gives all blocks
outside boilerplate. Damaged markup (unclosed tags, comments or scripts, stray end tags) never raises; a tag that the page
never closes swallows the rest, as in browsers. Very long pages and deep nesting take time in proportion to their length.
Repeated rows give repeated results. Extra columns pass through; result columns replace columns of the same name. An empty
table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, small_batches

# Element names of the HTML standard, by how the scanner treats them.
RAW = "script style template noscript textarea title iframe svg math object select".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split()
)
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
BOILERPLATE_TAGS = "nav footer aside form button menu dialog head fieldset".split()
# Parts of class, id and role names that mark boilerplate.
BOILERPLATE_NAMES = (
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "copyright disclaimer disqus feedback footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification paywall "
    "popup promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget"
).split()
#: End tags that a start tag implies, as in the standard: what may not contain itself.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head", "title"},
}
#: An implied end tag does not reach beyond these.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
BARRIERS = set("article main section div body td th li blockquote".split())
#: Looked through to find what a heading or a list item stands beside; what is not taken in by its neighbours.
WRAPPERS = frozenset("header hgroup ul ol dl table thead tbody tfoot tr li dd blockquote figure".split())
CONTAINERS = frozenset("div section article main body".split())
BLOCKS_THAT_CLOSE_P = set("address article aside blockquote details div dl fieldset figure footer form header hr main nav ol pre section table ul".split() + HEADINGS)
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡\"'()«»„“”–—-]")
SIGMA, RADIUS, SPREAD = 1.0, 2, 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_NAMES, _TAGS = frozenset(BOILERPLATE_NAMES), frozenset(BOILERPLATE_TAGS)


class _Element:
    """path: the number of the root-to-leaf path; label: the last step of it."""

    __slots__ = ("article", "bad", "label", "parent", "path", "tag", "top")

    def __init__(self, parent: _Element | None, tag: str, attrs: str, paths: dict[tuple[int, str], int]):
        label, bad, self.top = tag, tag in _TAGS, False
        self.article = bool(parent and parent.article) or tag in ("article", "main")
        if attrs:
            for name, *values in _NAMED.findall(attrs):
                name, value = name.lower(), next((v for v in values if v), "")
                if name == "hidden" or (name, value.lower()) == ("aria-hidden", "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                    bad = True
                elif name in ("class", "id", "role"):
                    parts = [p.lower() for p in _PART.findall(value)]
                    bad = bad or not _NAMES.isdisjoint(parts)
                    self.top = self.top or "header" in parts
                    if name == "class" and parts:
                        label += "." + ".".join(parts)
        self.top = self.top or tag == "header"
        inside = bool(parent and parent.article)
        self.bad = bool(parent and parent.bad) or (bad and tag not in ("html", "body", "article", "main")) or (self.top and not inside)
        self.top = (self.top and inside) or bool(parent and parent.top)
        self.tag, self.parent = tag, parent
        self.label = label
        self.path = paths.setdefault((parent.path if parent else -1, label), len(paths))


class Block:
    """A run of text between block boundaries."""

    __slots__ = ("element", "linked", "text")

    def __init__(self, element: _Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def blocks(page: str) -> list[Block]:
    """Blocks in page order, entities decoded and white space turned into single spaces; blank ones left out."""
    paths: dict[tuple[int, str], int] = {}
    root = _Element(None, "#", "", paths)
    here, depth_of_link, found = root, 0, []
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html_lib.unescape("".join(pieces))).strip()
            if text:
                found.append(Block(here, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def leave(to: _Element) -> None:
        nonlocal here
        while here is not to:
            open_tags[here.tag] -= 1
            here = here.parent

    at = 0
    for token in _TOKEN.finditer(page + ">"):  # so that each tag has an end, and is scanned once
        start, end = token.span()
        if start > at:
            pieces.append(page[at:start])
            if depth_of_link:
                linked += start - at
        at = end
        tag = token["tag"] or token["tag2"]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(token["end"] or token["end2"])
        if tag in INLINE:
            if tag == "a":
                depth_of_link = 0 if closing else 1
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            elif tag in ("br", "img", "wbr"):
                pieces.append(" " if tag == "br" else "")
            continue
        close_block()
        if closing:
            if open_tags[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                leave(node.parent)
            continue
        implied = CLOSES.get(tag) or ({"p"} if tag in BLOCKS_THAT_CLOSE_P else None)
        if implied and any(open_tags[t] for t in implied):
            node, scope, to = here, SCOPES.get(tag, BARRIERS), here
            while node is not root and node.tag not in scope:
                if node.tag in implied:
                    to = node.parent
                node = node.parent
            leave(to)
        attrs = token["attrs"] or token["attrs2"] or ""
        if not (attrs.endswith("/") and tag not in ("p", "div")):
            here = _Element(here, tag, attrs, paths)
            open_tags[tag] += 1
    pieces.append(page[at:])
    close_block()
    return found


def _smooth(values: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    padded = np.pad(values, RADIUS, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def _allowed(block: Block) -> bool:
    element = block.element
    return not element.bad and (not element.top or element.tag in HEADINGS)


def path_scores(found: list[Block]) -> np.ndarray:
    """Each block's fused score: smoothed text ratio times smoothed punctuation ratio of its path."""
    number: dict[int, int] = {}
    path = np.array([number.setdefault(b.element.path, len(number)) for b in found])
    free = np.array([0 if b.element.bad else max(0, len(b.text) - b.linked) for b in found], dtype=float)
    marks = np.array([0 if b.element.bad else len(PUNCTUATION.findall(b.text)) for b in found], dtype=float)
    nodes = np.bincount(path)
    text_ratio, mark_ratio = (np.bincount(path, v) / nodes for v in (free, marks))
    return _smooth(np.log1p(text_ratio)[path]) * _smooth(np.log1p(mark_ratio)[path])


def extract(page: str | None) -> str:
    """The main text: content blocks in page order, joined by line feeds."""
    found = blocks(page or "")
    if not found:
        return ""
    scores = path_scores(found)
    allowed = np.array([_allowed(b) for b in found])
    chosen = allowed & (scores > 0) & (scores >= SPREAD * scores.std())
    # a path counts as a whole: it is content if most of its text is, and most is not links
    weight: dict[int, list[int]] = {}
    for b, c in zip(found, chosen, strict=True):
        own = weight.setdefault(b.element.path, [0, 0, 0])
        own[int(c)] += len(b.text)
        own[2] += b.linked
    content = {path for path, (out, into, linked) in weight.items() if into > out and linked * 2 <= out + into}
    chosen = np.array([a and b.element.path in content for a, b in zip(allowed, found, strict=True)])
    if not chosen.any():
        return "\n".join(b.text for b, a in zip(found, allowed, strict=True) if a)
    near: set[int] = set()
    lined: set[int] = set()
    for b, c in zip(found, chosen, strict=True):
        if c:
            near |= {id(b.element), id(b.element.parent)}
            node = b.element.parent
            while node is not None and node.article and id(node) not in lined:
                lined.add(id(node))
                node = node.parent
    near |= lined
    anchors: dict[int, _Element | None] = {}

    def anchor(element: _Element) -> _Element | None:
        """The nearest element above that stands beside content or is no mere wrapper."""
        passed, node = [], element.parent
        while node is not None and id(node) not in anchors and node.tag in WRAPPERS and id(node) not in near:
            passed.append(id(node))
            node = node.parent
        found = anchors.get(id(node), node)
        anchors.update((i, found) for i in passed)
        return found

    def belongs(block: Block) -> bool:
        """Whether a block below the threshold stands beside content."""
        element = block.element
        if block.linked * 2 > len(block.text):
            return False
        if id(element) in near:
            return True
        beside = anchor(element)
        if beside is None or id(beside) not in near:
            return False
        if element.tag in HEADINGS:
            return True
        while element is not beside and "." not in element.label:
            element = element.parent
        return element is beside and block.element.tag not in CONTAINERS

    return "\n".join(b.text for b, c, a in zip(found, chosen, allowed, strict=True) if c or (a and belongs(b)))


def with_main_text(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Replaces the html column by the main text and adds n_chars, its code points."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in (html, text, "n_chars")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [extract(page) for page in batch.column(html).to_pylist()]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]  # references to lone surrogates
            columns = [batch.column(n) for n in names] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, text, "n_chars"])

    return df.select(*names, html).mapInArrow(lean(run), schema)
