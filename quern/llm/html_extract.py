"""Main text of web pages: boosted trees over DOM-node features, decoded over the whole tree.

Two sets of trees give each block element the chance to be main text and to be boilerplate as a whole;
what is neither is a mixed container. A dynamic programme over the page picks the likeliest labels of
all nodes at once, under which nothing inside boilerplate is main text and no mixed container is
inside main text. The trees are trained on made pages (html_pages).
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, html_pages, trees

#: A comment, a declaration or a tag, from its first character on: STRICT reads quoted attribute values whole, LOOSE ends a tag at the next >.
OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
STRICT = re.compile(OTHER + r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
LOOSE = re.compile(OTHER + r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
#: Where one of them can begin.
OPENS = re.compile(r"<[!?/a-zA-Z]")
#: Zeros before a numeric character reference's digits, and references to numbers beyond the last character.
ZEROS, BEYOND = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,};?")
ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
TOKEN = re.compile(r"[a-z]+|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text that is never shown as the page's own, or no text at all.
HIDDEN = frozenset("head script style template noscript svg math iframe object canvas audio video select option textarea button title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where the search for an element to close ends.
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "p": ("table", "td", "div", "section", "article", "main", "aside", "li", "blockquote", "body")}
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Groups of class, id and role tokens.
GROUPS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs topnav pagination pager toc tabs sitemap",
    "head": "header masthead branding logo top topbar banner",
    "foot": "footer copyright colophon legal bottom contentinfo",
    "side": "sidebar side aside widget related recommended read trending rail right left tags complementary more",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion adslot adsense",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay disclaimer warning banner privacy",
    "comment": "comment comments disqus reply replies discussion responses response reader respond",
    "form": "newsletter subscribe subscription search login signup signin register contact form",
    "share": "share sharing social follow",
    "content": "content article post entry story main text body page blog news",
}
_GROUP_OF = {w: k for k, words in enumerate(GROUPS.values()) for w in words.split()}
TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "p", "div", "ul", "li", "table", "body")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
N_FEATURES = 22 + len(GROUPS) + len(TAGS)


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    groups: int = 0
    label: int = -1
    own: int = 0
    linked: int = 0
    marks: int = 0
    inside: int = 1
    blocks: int = 0
    paragraphs: int = 0
    links: int = 0
    headings: int = 0
    start: int = 0
    children: list[int] = field(default_factory=list)


def decoded(text: str) -> str:
    """With its character references decoded, numbers of any length included."""
    return html.unescape(BEYOND.sub("\ufffd", ZEROS.sub("&#", text)) if "&#" in text else text)


class Open:
    """The open elements, and for each tag where it is open: the innermost of some tags is found without a walk."""

    def __init__(self) -> None:
        self.items: list[tuple[str, int]] = [("html", 0)]  # tag and block; inline elements keep their block's number
        self.at: dict[str, list[int]] = {}

    def push(self, tag: str, node: int) -> None:
        self.at.setdefault(tag, []).append(len(self.items))
        self.items.append((tag, node))

    def pop(self) -> tuple[str, int]:
        self.at[self.items[-1][0]].pop()
        return self.items.pop()

    def last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of these tags; -1 if none is open."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=-1)


def parse(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order (parents first) and text blocks (node, text), white space made single, character references decoded. The time grows with the page's length alone, whatever is broken in it: a < that no > follows is text, and from the first tag with an unclosed quote on, tags end at the next >."""
    nodes = [Node("html", -1, 0)]
    stack = Open()
    blocks: list[tuple[int, str]] = []
    held: list[tuple[str, bool]] = []
    hidden = anchors = seen = 0

    def flush(node: int) -> None:
        nonlocal seen
        if held:
            text = " ".join(decoded("".join(t for t, _ in held)).split())
            if text:
                n = nodes[node]
                whole = sum(len(t) for t, _ in held) or 1
                n.own += len(text)
                n.linked += len(text) * sum(len(t) for t, a in held if a) // whole
                n.marks += sum(map(text.count, ",.;:"))
                n.blocks += 1
                blocks.append((node, text))
                seen += len(text)
            held.clear()

    def pop(upto: int) -> None:
        nonlocal hidden, anchors
        while len(stack.items) > upto:
            tag, node = stack.items[-1]
            if tag not in INLINE:
                flush(node)
            hidden -= tag in HIDDEN
            anchors -= tag == "a"
            stack.pop()

    def close(tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        at = stack.last(tags)
        if at > 0 and at > stack.last(scope):
            pop(at)

    position, size = 0, len(source)
    end_of_tags = source.rfind(">")
    pattern = STRICT
    while position < size:
        m, begin = None, position
        while first := OPENS.search(source, begin):
            m = pattern.match(source, first.start())
            if m is None and pattern is STRICT and source[first.start() + 1] not in "!?":
                if LOOSE.match(source, first.start()):
                    pattern, m = LOOSE, LOOSE.match(source, first.start())
            if m is not None or first.start() > end_of_tags:
                break
            begin = first.start() + 1
        text = source[position : m.start() if m else size]
        if text and not hidden:
            held.append((text, anchors > 0))
        if not m:
            break
        position = m.end()
        end, tag, attrs = m[1], m[2], m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "html":
            continue
        if end:
            if tag == "br":
                held.append((" ", False))
            else:
                close((tag,), () if tag not in INLINE else ("td", "th", "table", "li", "div", "section", "article"))
            continue
        if tag == "br":
            held.append((" ", False))
            continue
        if tag in ENDS_P:
            close(("p",), SCOPE["p"])
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE[tag])
        if tag == "body":
            close(("head",), ())
        node = stack.items[-1][1]
        if tag in INLINE:
            if tag in VOID or attrs.rstrip().endswith("/") and tag not in ("a",):
                continue
            anchors += tag == "a"
            if tag == "a":
                nodes[node].links += 1
            stack.push(tag, node)
            continue
        flush(node)
        if tag in VOID:
            continue
        if tag in RAW or tag in HIDDEN:
            if tag in RAW:
                found = _raw_end(tag).search(source, position)
                position = found.end() if found else size
                continue
            hidden += 1
            stack.push(tag, node)
            continue
        groups, label = 0, -1
        for name, value in ATTR.findall(attrs):
            name = name.lower()
            if name in ("class", "id", "role"):
                for token in TOKEN.findall(value.lower()):
                    if (g := _GROUP_OF.get(token)) is not None:
                        groups |= 1 << g
            elif name == "data-q" and (value := value.strip("'\"")) in ("0", "1", "2"):
                label = int(value)
        n = Node(tag, node, nodes[node].depth + 1, groups, label, start=seen)
        nodes[node].children.append(len(nodes))
        stack.push(tag, len(nodes))
        nodes.append(n)
    pop(1)
    flush(0)
    for n in nodes:
        n.paragraphs = int(n.tag == "p")
        n.headings = int(n.tag in HEADINGS)
    return nodes, blocks


@lru_cache(maxsize=16)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I)


def features(nodes: list[Node]) -> np.ndarray:
    """Of each node: subtree text, density and links, depth, place, siblings, parent, tag, attribute tokens (own and inherited)."""
    n = len(nodes)
    text, linked, marks, inside, blocks, paras, links, heads = ([getattr(x, k) for x in nodes] for k in ("own", "linked", "marks", "inside", "blocks", "paragraphs", "links", "headings"))
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        text[p] += text[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        inside[p] += inside[i]
        blocks[p] += blocks[i]
        paras[p] += paras[i]
        links[p] += links[i]
        heads[p] += heads[i]
    total = max(text[0], 1)
    out = np.zeros((n, N_FEATURES))
    inherited = [0] * n
    places = [0] * n
    for x in nodes:
        for k, child in enumerate(x.children):
            places[child] = k
    log = math.log1p
    for i, x in enumerate(nodes):
        p = max(x.parent, 0)
        above = inherited[p]
        inherited[i] = above | x.groups | (1 << 20 if x.tag in ("article", "main") else 0)
        siblings = nodes[p].children if i else [0]
        k = places[i]
        row = out[i]
        row[:22] = (
            log(text[i]), linked[i] / max(text[i], 1), log(text[i] / inside[i]), x.depth, log(paras[i]), marks[i] / max(text[i], 1), x.start / total, text[i] / total, len(siblings), k / max(len(siblings) - 1, 1), log(links[i]),
            log(text[p]), text[i] / max(text[p], 1), linked[p] / max(text[p], 1), log(blocks[i]), log(heads[i]), x.own / max(text[i], 1), (x.start + text[i]) / total, x.tag in HEADINGS, bool(above >> 20), bool(above & 0b0111111111), bool(above >> 9 & 1),
        )
        for g in range(len(GROUPS)):
            row[22 + g] = x.groups >> g & 1
        if x.tag in TAGS:
            row[22 + len(GROUPS) + TAGS.index(x.tag)] = 1
    return out


def decode(nodes: list[Node], content: np.ndarray, boiler: np.ndarray) -> list[bool]:
    """Which nodes are main text, by the likeliest labels of the whole tree: K main text (inside it K or D), D boilerplate (inside it D alone), M mixed (inside it all three)."""
    n = len(nodes)
    mixed = np.maximum(1 - content - boiler, 1e-3)
    k, d, m = (np.log(np.maximum(x, 1e-6)).tolist() for x in (content, boiler, mixed))
    empty = [x.own == 0 and not x.children for x in nodes]
    for i in range(n - 1, 0, -1):
        if empty[i]:
            k[i] = d[i] = m[i] = 0.0
        p = nodes[i].parent
        k[p] += max(k[i], d[i])
        d[p] += d[i]
        m[p] += max(k[i], d[i], m[i])
    state = [""] * n
    state[0] = max((m[0], "M"), (k[0], "K"), (d[0], "D"))[1]
    for i in range(1, n):
        above = state[nodes[i].parent]
        state[i] = "D" if above == "D" else ("K" if k[i] >= d[i] else "D") if above == "K" else max((k[i], "K"), (d[i], "D"), (m[i], "M"))[1]
    return [s == "K" for s in state]


def labelled(nodes: list[Node]) -> np.ndarray:
    """1 main text, 0 boilerplate, 2 mixed: the mark of the nearest marked element (2 counts for itself alone)."""
    out = np.zeros(len(nodes), dtype=np.int64)
    out[0] = 2
    for i, x in enumerate(nodes[1:], 1):
        above = out[x.parent]
        out[i] = x.label if x.label >= 0 else above if above != 2 else 0
    return out


@lru_cache(maxsize=2)
def trained(pages: int = 500, seed: int = 5) -> tuple[trees.Forest, trees.Forest]:
    """Trees for main text and for boilerplate, from so many made pages."""
    maker = html_pages.Maker(seed)
    x, y = [], []
    for _ in range(pages):
        nodes, _blocks = parse(maker.page())
        x.append(features(nodes))
        y.append(labelled(nodes))
    x, y = np.concatenate(x), np.concatenate(y)
    return trees.fit(x, y == 1, trees=30, depth=4, bins=32), trees.fit(x, y == 0, trees=30, depth=4, bins=32)


def main_texts(pages: list[str | None], forests: tuple[trees.Forest, trees.Forest]) -> list[str]:
    """Main text of each page; a null or empty page has none."""
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    x = np.concatenate([features(nodes) for nodes, _ in parsed])
    content, boiler = (f.score(x) for f in forests)
    out, at = [], 0
    for nodes, blocks in parsed:
        to = at + len(nodes)
        keep = decode(nodes, content[at:to], boiler[at:to])
        out.append("\n".join(text for node, text in blocks if keep[node]))
        at = to
    return out


def extract(pages: DataFrame, *, html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the html, if none are named), _text and _n_chars: one row per row of pages. Null and empty pages have an empty text; rows that repeat stay and get the same text; an empty table gives none; input columns named like a result give way. No row sees another; nothing is shuffled."""
    pages = common.giving_way(pages, "_text", "_n_chars", "_html_")
    keep = [c for c in pages.columns if c != html_column] if keep is None else keep
    forests = trained()
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("_text", T.StringType()), T.StructField("_n_chars", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100)
                texts = main_texts(part.column(part.num_columns - 1).to_pylist(), forests)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*keep, F.col(html_column).alias("_html_")).mapInArrow(each, schema)


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", F.col("_text").alias("text"), F.col("_n_chars").alias("n_chars"))
