"""Main text of web pages by a tree-structured graphical model.

Nodes are a page's elements (inline ones belong to their parent), each content or not. A node's potential comes from
its tag, the words of its class, id and role (a heading's id names its own words and doesn't count), the share of linked text in it
and, outside articles, in its parent, whether it holds most of the page's text, and the length of its own text; an edge's from the labels of parent and child. Both are trained from labelled pages by smoothed counts. Sum-product messages, up
from the leaves and down from the root, give every node's marginal; text of nodes at 0.5 or more is the main text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from thawline.llm import labelled_pages
from thawline.llm.common import add_columns

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
PLAIN = re.compile(r"""[^"'<>]*+""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd map mark math object picture q rp rt ruby s samp small span strike strong sub sup svg "
    "time tt u var video".split()
)
#: Elements whose text is no markup and isn't shown, and math's second notation.
RAW = frozenset("script style textarea title iframe noembed noframes annotation annotation-xml".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
TABLE_PARTS = frozenset("table caption tbody thead tfoot tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ALIKE = 6
#: An opening tag ends these elements if one is open, up to the named bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
}
WORD_GROUPS = (
    ("ad", "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense"),
    ("menu", "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager"),
    ("edge", "header masthead head footer foot copyright colophon bottom"),
    ("side", "sidebar aside rail related widget widgets links tags share social recommended complementary contentinfo"),
    ("notice", "cookie cookies consent notice notices gdpr popup modal overlay alert legal disclaimer subscribe newsletter signup login search"),
    ("talk", "comment comments commentlist reply replies respond responses discussion disqus feedback"),
    ("main", "content article main post entry story body text"),
    ("frame", "page wrapper container"),
)
_WORDS = {w: g for g, ws in reversed(WORD_GROUPS) for w in ws.split()}


class Tree(NamedTuple):
    """parent, features and label of each node, parents first; pieces of text as (node, block, text)."""

    parent: list[int]
    features: list[tuple[str, ...]]
    label: list[int]
    pieces: list[tuple[int, int, str]]


def _tag_end(page: str, at: int, failed: set[int]) -> int:
    """Place of the ">" that ends a tag, quoted values skipped, or, if quotes don't close, of the first one; -1 if there is none.

    ``failed``: openings of quotes from which no end was found, so that each is tried once a page.
    """
    tried, p = [], at
    while True:
        p = PLAIN.match(page, p).end()
        c = page[p : p + 1]
        if c == ">":
            return p
        to = -1 if c in ("", "<") or p in failed else page.find(c, p + 1)
        if to < 0:
            failed.update(tried, [p])
            return page.find(">", at)
        tried.append(p)
        p = to + 1


def parse(page: str, labelled: bool = False) -> Tree:
    """Elements of a page with the usual implied ends; never fails, in time linear in the page's length.

    References are decoded in pieces of text. ``labelled``: take labels from ``data-y`` attributes of 0 and 1.
    """
    parent, tag, words, label, size, linked, within = [-1], ["#root"], [()], [1], [0], [0], [False]
    stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # open elements, their nodes (inline: the parent's), whether inline
    where: dict[str, list[int]] = {}  # places in the stack by name
    blocks = [0]  # those of elements that aren't inline
    pieces: list[tuple[int, int, str]] = []
    failed: set[int] = set()
    links, foreign, block, at, n = 0, 0, 0, 0, len(page)
    last = page.rfind(">")

    def leave(name: str, inline: bool) -> None:
        nonlocal links, foreign, block
        where[name].pop()
        links -= name == "a"
        foreign -= name in ("math", "svg")
        block += not inline

    def close(names, bounds=()) -> bool:
        """End the innermost open element of one of ``names`` and all in it, unless one of ``bounds`` is open in it."""
        i = max((where[x][-1] for x in names if where.get(x)), default=0)
        if not i or any(where[x][-1] > i for x in bounds if where.get(x)):
            return False
        while len(stack) > i:
            name, _, inline = stack.pop()
            if not inline:
                blocks.pop()
            if name:
                leave(name, inline)
        return True

    def say(raw: str) -> None:
        if raw and not raw.isspace():
            text = entities.unescape(raw) if "&" in raw else raw
            node = stack[-1][1]
            pieces.append((node, block, text))
            size[node] += len(text)
            linked[node] += len(text) * (links > 0)
        elif raw and pieces and pieces[-1][1] == block:
            pieces.append((stack[-1][1], block, " "))

    text_from = 0
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            say(page[text_from:])
            break
        m = NAME.match(page, at + 1)
        if not m and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1  # a "<" of the text
            continue
        say(page[text_from:at])
        if not m:
            end = page.find("-->", at + 4) if page.startswith("<!--", at) else page.find(">", at)
            if end < 0:
                break
            at = text_from = end + (3 if page.startswith("-->", end) and page.startswith("<!--", at) else 1)
            continue
        name, end = m[2].lower(), _tag_end(page, m.end(), failed)
        rest, at = page[m.end() : end], end + 1
        text_from = at
        if name == "head":
            continue
        if m[1]:
            i = where[name][-1] if where.get(name) else 0
            if i and stack[i][2] and blocks[-1] > i:  # an inline element that a block began in: the block goes on
                leave(name, True)
                stack[i] = ("", stack[i][1], True)
            elif name not in TABLE_PARTS:
                close((name,), ("td", "th", "caption"))
            elif not close((name,), () if name == "table" else ("table",)) or name == "p":
                pass
            block += name == "p" and not i
            continue
        if name in RAW:
            if not rest.endswith("/"):
                m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
                end = page.find(">", m.end()) if m else -1
                if end < 0:
                    break
                at = text_from = end + 1
            continue
        if name == "br":
            say(" ") if not pieces else pieces.append((stack[-1][1], block, " "))
            continue
        if name in VOID:
            block += name == "hr"
            continue
        inline = name in INLINE or foreign > 0
        if not foreign:
            if name in CLOSES_P:
                close(("p",), ("td", "th", "caption", "button"))
            if name in ENDS:
                close(*ENDS[name])
        node = stack[-1][1]
        if not inline:
            block += 1
            node, up = len(parent), node
            found, y = set(), label[up]
            if "=" in rest:
                for a in ATTRIBUTE.finditer(rest):
                    value = a[2] or a[3] or a[4] or ""
                    if a[1].lower() == "id" and name in HEADINGS:
                        continue  # names the heading's own words
                    if a[1].lower() != "data-y":
                        found.update(_WORDS[w] for w in re.split(r"[^a-z]+", value.lower()) if w in _WORDS)
                    elif labelled and value in ("0", "1"):
                        y = int(value)
            inside = within[up] or tag[up] in ("article", "main") or "main" in words[up]
            parent.append(up), tag.append(name), words.append(tuple(sorted(found))), label.append(y), size.append(0), linked.append(0), within.append(inside)
        if not rest.endswith("/"):
            links += name == "a"
            foreign += name in ("math", "svg")
            where.setdefault(name, []).append(len(stack))
            if not inline:
                blocks.append(len(stack))
            stack.append((name, node, inline))
    whole, links_below, follows, last_child = size[:], linked[:], [0] * len(parent), [0] * len(parent)
    for i in range(len(parent) - 1, 0, -1):
        whole[parent[i]] += whole[i]
        links_below[parent[i]] += links_below[i]
        follows[i], last_child[parent[i]] = last_child[parent[i]], i
    features = []
    for i in range(len(parent)):
        inside = " inside" if within[i] else ""
        own = [f"tag={tag[i]}{inside if tag[i] in ('header', 'noscript') else ''}", *(f"word={w}" for w in words[i])]
        if tag[i] in HEADINGS and "talk" in words[follows[i]]:
            own.append("next=talk")
        linked_share = lambda k: min(3, 4 * links_below[k] // max(1, whole[k]))
        own += [f"links{inside}={linked_share(i)}", f"own={min(4, size[i].bit_length() // 2)}"]
        if not inside:
            own.append(f"around={linked_share(max(0, parent[i]))}")
            if 2 * whole[i] > whole[0]:
                own.append("next=most")
        features.append(tuple(own))
    return Tree(parent, features, label, pieces)


class Model(NamedTuple):
    """likelihood[f]: of a feature, by (parent's label, own label) as 2 * parent + own; edge: of own label given the parent's."""

    likelihood: dict[str, tuple[float, float, float, float]]
    edge: tuple[float, float, float, float]


def train(pages: list[str], smoothing: float = 0.5) -> Model:
    """From pages whose elements carry ``data-y`` labels; their number bounds what the driver holds.

    Content below what isn't content is so rare that its features count as those of content.
    """
    seen, number = [Counter() for _ in range(4)], [0] * 4
    for page in pages:
        t = parse(page, labelled=True)
        for i in range(1, len(t.parent)):
            k = 2 * t.label[t.parent[i]] + t.label[i]
            number[k] += 1
            seen[k].update(t.features[i])
    edge = tuple((number[k] + smoothing) / (number[k & 2] + number[k | 1] + 2 * smoothing) for k in range(4))
    seen[1], number[1] = seen[3], number[3]
    names = {f for c in seen for f in c}
    values = Counter(f.split("=")[0] for f in names)
    like = {
        f: tuple((seen[k][f] + smoothing) / (number[k] + smoothing * (2 if f.startswith(("word=", "next=")) else values[f.split("=")[0]])) for k in range(4))
        for f in names
    }
    return Model(like, edge)


def marginals(t: Tree, model: Model) -> list[float]:
    """Probability of content of each node: sum-product, leaves to root and back."""
    n, get = len(t.parent), model.likelihood.get
    alike = Counter((t.parent[i], t.features[i][0]) for i in range(1, n))
    own = [(1.0, 1.0, 1.0, 1.0)] * n  # potential of node and edge by 2 * parent + own
    for i in range(1, n):
        q0, q1, q2, q3 = model.edge
        # like siblings say much the same: together as much as ALIKE of them
        w = min(1.0, ALIKE / alike[t.parent[i], t.features[i][0]])
        for f in t.features[i]:
            if g := get(f):
                if w < 1:
                    g = (g[0] ** w, g[1] ** w, g[2] ** w, g[3] ** w)
                q0, q1, q2, q3 = q0 * g[0], q1 * g[1], q2 * g[2], q3 * g[3]
        own[i] = (q0, q1, q2, q3)
    below0, below1 = [1.0] * n, [1.0] * n  # products of messages from children
    below0[0] = 0.01  # the root holds the page
    to0, to1 = [1.0] * n, [1.0] * n
    for i in range(n - 1, 0, -1):
        q0, q1, q2, q3 = own[i]
        m0, m1 = q0 * below0[i] + q1 * below1[i], q2 * below0[i] + q3 * below1[i]
        s = m0 + m1
        m0, m1 = (max(m0 / s, 1e-12), max(m1 / s, 1e-12)) if s > 0 else (0.5, 0.5)
        to0[i], to1[i] = m0, m1
        p = t.parent[i]
        x, y = below0[p] * m0, below1[p] * m1
        s = x + y
        below0[p], below1[p] = (x / s, y / s) if s > 0 else (0.5, 0.5)
    all0, all1 = below0[:], below1[:]
    for i in range(1, n):
        p, (q0, q1, q2, q3) = t.parent[i], own[i]
        a, b = all0[p] / to0[i], all1[p] / to1[i]  # the parent without this child
        x, y = below0[i] * (a * q0 + b * q2), below1[i] * (a * q1 + b * q3)
        s = x + y
        all0[i], all1[i] = (x / s, y / s) if s > 0 else (0.5, 0.5)
    return [y / (x + y) for x, y in zip(all0, all1, strict=True)]


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    t = parse(page)
    keep = [x >= 0.5 for x in marginals(t, model)]
    blocks: list[str] = []
    last, held = -1, []
    for node, block, text in [*t.pieces, (0, -2, "")]:
        if block != last:
            if joined := " ".join("".join(held).split()):
                blocks.append(joined)
            last, held = block, []
        if keep[node]:
            held.append(text)
    return "\n\n".join(blocks)


def extract(pages: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """Add ``text`` (main text, empty if none) and ``n_chars`` (its code points); other columns but ``html`` stay, whatever their names.

    White space inside a block becomes one space, blocks are joined by two line feeds. Null and empty pages have
    empty text; long ones are read whole. Links, captions and noscript text count as text where they stand in the article. Columns of the result that ``pages`` has already are replaced; nodes at a
    probability of exactly 0.5 are content; repeated rows are treated alike; an empty table gives an empty result. The
    default model is trained from this library's labelled pages.
    """
    model = model or train(labelled_pages.pages())

    def make(column: pa.Array) -> list[pa.Array]:
        out = [main_text(x.as_py(), model) for x in column]
        return [pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())]

    return add_columns(pages, html, make, "text string, n_chars long")
