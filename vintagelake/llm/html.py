"""Main text of web pages by wrapper induction over the pages of a host.

Each page becomes a tree of block elements. Runs of equal sibling subtrees count as one node, so pages of one design
have nearly one outline. Every outline of a host is laid over the host's most frequent one by simple tree matching.
What stands in matched nodes then decides: a text that nearly all different pages of the host have in one node is
template; the other texts are what varies. The wrapper's content is the element that holds most of the varying text
which is not links: from the root, the way goes into a child as long as this child alone holds more than half.
Tags, roles and class words add to this: texts in an article weigh more than others, texts in elements that are
menus, headers, footers, sidebars, notices, adverts, forms or comments weigh less, and such elements inside the content go.
A page that does not fit its host's wrapper, or is its host's only one, gets its content in the same way from itself.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagelake.llm.common import steps, written

TAGS = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Fixed values of HTML: elements that break lines, that hold raw text, that have no end, and that an opening tag ends.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}, "body": {"head"}}
FENCES = frozenset("table ul ol dl article section div body html main aside nav header footer form".split())
#: Elements that can be a page's content as a whole; the others are parts of a text.
CONTAINERS = frozenset("html body main article section div center table tbody tr td form fieldset details dialog header footer nav aside".split())
HEADINGS = frozenset("h1 h2 h3 hgroup header".split())
#: Elements, roles and words in class or id that mark what is not main text.
NOISE_TAGS = frozenset("head script style noscript template iframe nav aside footer form button select textarea svg canvas object audio video menu dialog noembed noframes xmp title search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices comment comments reply replies share sharing newsletter subscribe related promo sponsored form".split())
HEADER_WORDS = frozenset("header masthead".split())
#: Parts of a compound class or id that make it a state or layout of something else, as in content-with-sidebar or comments-open.
STATE_WORDS = frozenset("with has have no not without is are open opened closed enabled disabled active free layout".split())
#: Words that say where or in what form something stands: inside an article a compound marks only if it has no other words beside these.
PLACE_WORDS = frozenset("slot box unit container wrapper wrap block section list bar links link buttons button widget area panel inner outer body item items top bottom left right content post posts article articles story stories signup social icons icon group row module overlay popup modal thread count".split())
#: A text is template if the lower bound (one deviation) of the share of the host's different pages that have it reaches this.
SHARE = 0.8
#: Weight of a text inside an article and inside main, and of one that only class words mark; tags and roles that mark leave none.
IN_ARTICLE, IN_MAIN, MARKED = 4, 2, 0.25
#: Cells of the matching's tables that are kept at once; what does not fit is worked out again where it is needed.
CELLS = 1 << 20
#: Outlines longer than this are not kept from page to page.
KEPT_CHARS = 20_000
BROADCAST_BYTES = 16 << 20
#: Parts that a host's pages are dealt to where its wrapper is joined by a shuffle.
SALTS = 64


class Node:
    __slots__ = ("tag", "label", "depth", "marked", "hard", "article", "children", "slot")

    def __init__(self, tag: str, label: str, parent: Node | None, mark: int = 0, article: int = 0):
        self.tag, self.label = tag, label
        self.depth = parent.depth + 1 if parent else 0
        #: Depth of the innermost element here or above that is marked as noise (-1: none), and of one marked by more than class words.
        self.marked = self.depth if mark else parent.marked if parent else -1
        self.hard = self.depth if mark > 1 else parent.hard if parent else -1
        self.article = max(article, parent.article) if parent else 0
        self.children: list[Node] = []
        self.slot = 0


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: float):
        #: linked: the share of the text that is in links.
        self.node, self.text, self.linked = node, text, linked

    def mass(self) -> int:
        """What the text weighs in the choice of the content."""
        n = self.node
        if n.hard >= 0:
            return 0
        kind = IN_ARTICLE if n.article > 1 else IN_MAIN if n.article else 1
        return round(16 * len(self.text) * (1 - self.linked) * kind * (MARKED if n.marked >= 0 else 1))


def node_of(tag: str, attributes: str, parent: Node) -> Node:
    words: list[str] = []
    label, role, hidden, body = tag, "", False, False
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                for name_part in value.split():
                    parts = re.split(r"[^a-z0-9]+", name_part)
                    # inside an article ad-slot is an advert, but share-price or ad-hoc name what they hold
                    plain = not parent.article or all(x in NOISE_WORDS or x in PLACE_WORDS or not x.isalpha() for x in parts)
                    words += parts if plain and not STATE_WORDS.intersection(parts) else ()
                if name == "class" and value:
                    first = value.split()
                    label = f"{tag}.{re.sub('[()]', '', first[0])}" if first else tag
            elif name == "role":
                role = value
            elif name == "itemprop":
                body = value == "articlebody"
            else:
                hidden = name == "hidden" or value == "true"
    article = 2 if tag == "article" or body else 1 if tag == "main" or role == "main" else 0
    mark = 2 if tag in NOISE_TAGS or role in NOISE_ROLES or hidden or tag == "header" and not parent.article else 0
    if not mark and tag not in ("html", "body", "main") and (NOISE_WORDS.intersection(words) or not parent.article and HEADER_WORDS.intersection(words)):
        mark = 1
    return Node(tag, label, parent, mark, article)


def parse(html: str) -> tuple[Node, list[Block]]:
    """The tree of block elements and the blocks of text in page order, each with its node."""
    root = Node("", "", None)
    stack: list[Node] = [root]
    opened: Counter = Counter()
    blocks: list[Block] = []
    pieces: list[str] = []
    links = 0  # characters in links among the pieces
    link_at = 0  # length of the stack where a link began; 0 outside links
    dropped = 0  # depth of inline elements that are noise
    inline: list[str] = []

    def flush() -> None:
        nonlocal links
        if pieces:
            raw = "".join(pieces)
            text = " ".join(unescape(raw).split())
            if text:
                blocks.append(Block(stack[-1], text, min(1.0, links / len(raw.strip() or raw))))
            pieces.clear()
        links = 0

    def end(at: int) -> None:
        nonlocal link_at
        flush()
        if at < link_at:
            link_at = 0
        opened.subtract(n.tag for n in stack[at:])
        del stack[at:]

    def take(part: str) -> None:
        nonlocal links
        pieces.append(part)
        links += len(part) if link_at else 0

    at, size = 0, len(html)
    while at < size:
        m = TAGS.search(html, at)
        if m is None:
            if not dropped:
                take(html[at:])
            break
        if m.start() > at and not dropped:
            take(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if not m[1]:
            if tag == "br":
                pieces.append(" ")
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = close.end() if close else size
                if tag in ("title", "textarea"):
                    flush()
                continue
            if tag in BLOCKS or tag in NOISE_TAGS:
                ends = ENDED_BY.get(tag)
                if (ends and any(opened[t] for t in ends)) or tag in BLOCKS and opened["p"]:
                    for i in range(len(stack) - 1, 0, -1):
                        t = stack[i].tag
                        if ends and t in ends or t == "p" and tag in BLOCKS:
                            end(i)
                            if not ends:
                                break
                        elif t in FENCES and not (tag == "body"):
                            break
                flush()
                inline.clear()
                dropped = 0
                if tag in VOID:
                    continue
                node = node_of(tag, m[3], stack[-1])
                stack[-1].children.append(node)
                if not m[3].rstrip().endswith("/") or tag in BLOCKS:
                    stack.append(node)
                    opened[tag] += 1
            elif tag not in VOID:
                if tag == "a":
                    link_at = len(stack)
                # Inline elements hold no block; one that is marked as noise hides what it holds.
                if dropped or m[3] and node_of(tag, m[3], root).marked >= 0:
                    dropped += 1
                    inline.append(tag)
        elif tag in BLOCKS or tag in NOISE_TAGS:
            if opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        end(i)
                        break
                    if tag == "p" and stack[i].tag in FENCES:
                        break
            flush()
            inline.clear()
            dropped = 0
        else:
            if tag == "a":
                link_at = 0
            if dropped and tag in inline:
                while inline and dropped:
                    dropped -= 1
                    if inline.pop() == tag:
                        break
    flush()
    return root, blocks


def outline(root: Node) -> str:
    """The tree as text, runs of equal sibling subtrees written once; gives each node the number of what it is written as."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    ids: dict[tuple, int] = {}
    sizes: list[int] = []
    shape: dict[Node, int] = {}
    for node in reversed(order):  # children before parents
        own = [shape[c] for c in node.children]
        kids = tuple(s for i, s in enumerate(own) if not i or s != own[i - 1])
        known = shape[node] = ids.setdefault((node.label, kids), len(ids))
        if known == len(sizes):
            sizes.append(1 + sum(sizes[k] for k in kids))
    for node in order:  # numbers in the order of writing; a repeated sibling takes its twin's
        following, last, start = node.slot + 1, None, 0
        for child in node.children:
            s = shape[child]
            if s != last:
                start, following = following, following + sizes[s]
            child.slot, last = start, s
    of = list(ids)
    out, todo = [], [shape[root]]
    while todo:
        s = todo.pop()
        if s < 0:
            out.append(")")
            continue
        label, kids = of[s]
        out.append(f"({label}")
        todo.append(-1)
        todo.extend(reversed(kids))
    return "".join(out)


class Outline:
    """An outline's nodes by number: label, children, and numbers of nodes at and below."""

    __slots__ = ("labels", "children", "sizes")

    def __init__(self, text: str):
        self.labels: list[str] = []
        self.children: list[list[int]] = []
        self.sizes: list[int] = []
        stack: list[int] = []
        for m in re.finditer(r"\(([^()]*)|\)", text):
            if m[0] == ")":
                number = stack.pop()
                self.sizes[number] = len(self.labels) - number
            else:
                if stack:
                    self.children[stack[-1]].append(len(self.labels))
                stack.append(len(self.labels))
                self.labels.append(m[1])
                self.children.append([])
                self.sizes.append(1)

    def tag(self, number: int) -> str:
        return self.labels[number].split(".", 1)[0]


_small = lru_cache(maxsize=256)(Outline)


def read_outline(text: str) -> Outline:
    return _small(text) if len(text) <= KEPT_CHARS else Outline(text)


def shapes_of(a: Outline, b: Outline) -> tuple[list[int], list[int]]:
    """A number for each node, equal for equal subtrees of both."""
    ids: dict[tuple, int] = {}
    made = []
    for o in (a, b):
        shape = [0] * len(o.labels)
        for i in range(len(o.labels) - 1, -1, -1):
            shape[i] = ids.setdefault((o.labels[i], tuple(shape[c] for c in o.children[i])), len(ids))
        made.append(shape)
    return made[0], made[1]


def after(best: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The row of best totals that follows one, by a row of weights."""
    out = np.zeros(len(best), np.int32)
    out[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(w > 0, best[:-1] + w, 0)))
    return out


def heaviest(weights: Callable[[int], np.ndarray], m: int, n: int) -> int:
    """The total weight of the pairs that `aligned` gives."""
    best = np.zeros(n + 1, np.int32)
    for i in range(m):
        best = after(best, weights(i))
    return int(best[n])


def aligned(weights: Callable[[int], np.ndarray], m: int, n: int) -> list[tuple[int, int]]:
    """The order-keeping pairs (i, j) of largest total weight; weights gives the m rows of n.

    Of the table of best totals one row in `step` is kept, and on the way back the rows between are made again.
    """
    step = max(isqrt(m), min(m, CELLS // (n + 1)))
    kept = [np.zeros(n + 1, np.int32)]
    best = kept[0]
    for i in range((m - 1) // step * step):
        best = after(best, weights(i))
        if (i + 1) % step == 0:
            kept.append(best)
    found, i, j = [], m, n
    while kept and j:
        rows = [kept.pop()]
        low = len(kept) * step
        for k in range(low, i):
            rows.append(after(rows[-1], weights(k)))
        while i > low and j:
            here, above = rows[i - low], rows[i - low - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i, j))
    return found[::-1]


def matched(page: str, host: str) -> dict[int, int]:
    """Numbers of the page's nodes to numbers of the host's."""
    return (_matched if len(page) + len(host) <= KEPT_CHARS else matching)(page, host)


def matching(page: str, host: str) -> dict[int, int]:
    """Numbers of the page's nodes to numbers of the host's: the largest simple tree matching, roots first.

    Equal subtrees at both ends of two sibling lists are partners in any case and are set aside first; the weight of
    two subtrees is found once for each pair of shapes. Of pairs of small subtrees, which are the many, only CELLS weights
    are kept; what small means goes by the sizes of both trees, so that memory is bounded at any number of siblings.
    """
    a, b = read_outline(page), read_outline(host)
    if page == host:
        return {i: i for i in range(len(a.labels))}
    sa, sb = shapes_of(a, b)
    small = max(64, len(a.labels) * len(b.labels) // CELLS)
    weight: dict[tuple[int, int], int] = {}

    def split(i: int, j: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
        """Partners among the children that are equal from both ends, and the rest."""
        x, y = a.children[i], b.children[j]
        most, head, tail = min(len(x), len(y)), 0, 0
        while head < most and sa[x[head]] == sb[y[head]]:
            head += 1
        while tail < most - head and sa[x[-1 - tail]] == sb[y[-1 - tail]]:
            tail += 1
        ends = [*zip(x[:head], y[:head], strict=True), *zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)]
        return ends, x[head : len(x) - tail], y[head : len(y) - tail]

    def pairs(x: list[int], y: list[int]) -> Iterator[tuple[int, int]]:
        """One pair of numbers for each pair of different shapes of one label."""
        by: dict[str, dict[int, int]] = {}
        for d in y:
            by.setdefault(b.labels[d], {}).setdefault(sb[d], d)
        first = {sa[c]: c for c in reversed(x)}
        return ((c, d) for c in first.values() for d in by.get(a.labels[c], {}).values())

    def plain(i: int, j: int) -> int:
        """The weight of a pair of one label where it needs no search, else 0."""
        return a.sizes[i] if sa[i] == sb[j] else 0 if a.children[i] and b.children[j] else 1

    def weight_of(c: int, d: int, known: dict[tuple[int, int], int]) -> int:
        w = plain(c, d) or known.get((sa[c], sb[d]))
        if w is None:
            w = weigh(c, d, {}, 0)
            if len(known) < CELLS:
                known[sa[c], sb[d]] = w
        return w

    def best_of(x: list[int], y: list[int], known: dict[tuple[int, int], int]) -> int:
        """The weight of two sibling lists; short ones cell by cell, which is quicker."""
        if len(x) * len(y) > 256:
            return heaviest(rows(x, y, known), len(x), len(y))
        last = [0] * (len(y) + 1)
        for c in x:
            label, row, run = a.labels[c], [0], 0
            for q, d in enumerate(y):
                run = max(run, last[q + 1], last[q] + weight_of(c, d, known) if label == b.labels[d] else 0)
                row.append(run)
            last = row
        return last[-1]

    def rows(x: list[int], y: list[int], known: dict[tuple[int, int], int]) -> Callable[[int], np.ndarray]:
        """The rows of the table of weights of two sibling lists."""
        spots: dict[int, int] = {}
        by: dict[str, dict[int, int]] = {}
        for d in y:
            by.setdefault(b.labels[d], {}).setdefault(spots.setdefault(sb[d], len(spots)), d)
        first: dict[int, int] = {}
        twin = [first.setdefault(sa[c], c) for c in x]
        at = np.array([spots[sb[d]] for d in y])

        @lru_cache(maxsize=max(1, CELLS // len(spots)))
        def by_shape(c: int) -> np.ndarray:
            out = np.zeros(len(spots), np.int32)
            for spot, d in by.get(a.labels[c], {}).items():
                out[spot] = weight_of(c, d, known)
            return out

        return lambda p: by_shape(twin[p])[at]

    def weigh(i: int, j: int, known: dict[tuple[int, int], int], least: int) -> int:
        """The weight of a pair; pairs below it go to known if the product of their sizes is over `least`."""
        todo = [(i, j)]
        while todo:  # from below: a pair waits for those of its children
            c, d = todo[-1]
            key = (sa[c], sb[d])
            if key in known:
                todo.pop()
                continue
            ends, x, y = split(c, d)
            total = 1 + sum(a.sizes[e] for e, _ in ends)
            if x and y:
                need = [(e, f) for e, f in pairs(x, y) if a.sizes[e] * b.sizes[f] > least and not plain(e, f) and (sa[e], sb[f]) not in known]
                if need:
                    todo += need
                    continue
                total += best_of(x, y, known)
            known[key] = total
        return known[sa[i], sb[j]]

    out: dict[int, int] = {}
    walk = [(0, 0)] if a.labels[0] == b.labels[0] else []
    if walk and not plain(0, 0):
        weigh(0, 0, weight, small)
    while walk:
        i, j = walk.pop()
        if sa[i] == sb[j]:
            out.update(zip(range(i, i + a.sizes[i]), range(j, j + b.sizes[j]), strict=True))
            continue
        out[i] = j
        ends, x, y = split(i, j)
        walk += ends
        if x and y:
            walk += [(x[p], y[q]) for p, q in aligned(rows(x, y, weight), len(x), len(y))]
    return out


_matched = lru_cache(maxsize=1024)(matching)


def slots_of(page: str, host: str, slots: list[int]) -> list[int]:
    """The host's numbers of a page's nodes; -1 where a node has no partner."""
    if page == host:
        return slots
    partner = matched(page, host)
    return [partner.get(s, -1) for s in slots]


def content_of(form: str, mass: dict[int, float], varying: set[int]) -> int:
    """The number of the element that is the content, by the mass of the texts at each number.

    From the root into the one container that holds more than half of the mass, but not past a varying heading that
    stands before it, nor where more than a fifth of the mass stands beside containers. If the way passed through
    articles, the innermost of them is the content.
    """
    o = read_outline(form)
    total = [0.0] * len(o.labels)
    for s, x in mass.items():
        if 0 <= s < len(total):
            total[s] += x
    own = total.copy()
    for i in range(len(o.labels) - 1, -1, -1):
        for c in o.children[i]:
            total[i] += total[c]
    at, article = 0, -1
    while True:
        if o.tag(at) == "article":
            article = at
        children = o.children[at]
        heavy = max(children, key=lambda c: total[c], default=-1)
        if heavy < 0 or total[heavy] * 2 <= total[at] or o.tag(heavy) not in CONTAINERS:
            break
        flow = own[at] + sum(total[c] for c in children if o.tag(c) not in CONTAINERS)
        titles = [c for c in children if c < heavy and o.tag(c) in HEADINGS and c in varying and own[c]]
        if flow * 5 > total[at] or titles and o.tag(at) not in ("", "html", "body"):
            break
        at = heavy
    return article if article >= 0 else at


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def own_content(form: str, blocks: list[Block]) -> int:
    """The content of a page by its own texts."""
    mass: dict[int, float] = {}
    for b in blocks:
        mass[b.node.slot] = mass.get(b.node.slot, 0) + b.mass()
    return content_of(form, mass, set(mass))


def inside(form: str, at: int, blocks: list[Block]) -> list[Block]:
    """The blocks at and below an element, without those in elements there that are marked as noise.

    If the element is the whole body, three or more blocks in a row that are links only are a menu and go too."""
    o = read_outline(form)
    within = [b for b in blocks if at <= b.node.slot < at + o.sizes[at]]
    if o.tag(at) in ("", "html", "body"):
        menu = [b.linked > 0.99 for b in within]
        run = [any(all(menu[k : k + 3]) for k in (i - 2, i - 1, i) if 0 <= k <= len(menu) - 3) for i in range(len(menu))]
        within = [b for b, r in zip(within, run, strict=True) if not r]
    depth = depth_of(o, at)
    return [b for b in within if b.node.marked <= depth]


def depth_of(o: Outline, number: int) -> int:
    at, depth = 0, 0
    while at != number:
        at = max(c for c in o.children[at] if c <= number)
        depth += 1
    return depth


def outlines(pages: DataFrame) -> DataFrame:
    """(host, content, outline, slots, texts, mass): one row for each different content of a host; texts are hashes of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "html"):
            rows = []
            for html in texts:
                root, blocks = parse(html)
                form = outline(root)
                found: dict[tuple[int, int], int] = {}
                for b in blocks:
                    if b.node.hard < 0:
                        found[b.node.slot, hashed(b.text)] = b.mass()
                own = inside(form, own_content(form, blocks), blocks)
                rows.append((hashed("\n".join(b.text for b in own)), form, [s for s, _ in found], [t for _, t in found], list(found.values())))
            content, forms, slots, hashes, mass = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(content, pa.int64()), pa.array(forms, pa.string()), pa.array(slots, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())), pa.array(mass, pa.list_(pa.int64()))], names=["host", "content", "outline", "slots", "texts", "mass"])

    made = pages.mapInArrow(run, "host string, content bigint, outline string, slots array<int>, texts array<bigint>, mass array<bigint>")
    return made.groupBy("host", "content").agg(F.min(F.struct("outline", "slots", "texts", "mass")).alias("page")).select("host", "content", "page.*")


def with_host(rows: DataFrame, hosts: DataFrame, salt: Column) -> DataFrame:
    """rows joined to a table with a row for each host: broadcast where its size allows, else by host and a part of its rows."""
    constants = F.size("constants") if "constants" in hosts.columns else F.lit(0)
    size = hosts.agg(F.sum(F.length("host_outline") + 16 * F.greatest(constants, F.lit(0)) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(hosts), "host", "left")
    dealt = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"], "left").drop("salt")


def induce(pages: DataFrame) -> DataFrame:
    """(host, host_outline, content, constants): each host's most frequent outline, the number of its content there, and the (slot, text) pairs that are template."""
    found = written(outlines(pages), "outlines")
    forms = found.groupBy("host", F.xxhash64("outline").alias("form")).agg(F.min("outline").alias("outline"), F.count("*").alias("n"))
    hosts = written(forms.groupBy("host").agg(F.sum("n").alias("pages"), F.max_by("outline", F.struct("n", "outline")).alias("host_outline")), "hosts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [slots_of(p, h, s) for p, h, s in zip(*(batch.column(c).to_pylist() for c in ("outline", "host_outline", "slots")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("pages"), pa.array(slots, pa.list_(pa.int32())), batch.column("texts"), batch.column("mass")], names=["host", "pages", "slots", "texts", "mass"])

    wide = with_host(found.where(F.size("slots") > 0), hosts, F.col("content")).select("host", "pages", "outline", "host_outline", "slots", "texts", "mass")
    laid = wide.mapInArrow(run, "host string, pages bigint, slots array<int>, texts array<bigint>, mass array<bigint>")
    at = laid.select("host", "pages", F.explode(F.arrays_zip("slots", "texts", "mass")).alias("at")).select("host", "pages", "at.*").where("slots >= 0")
    votes = at.groupBy("host", "slots", "texts").agg(F.count("*").alias("n"), F.max("mass").alias("mass"), F.max("pages").alias("pages"))
    # Wilson's lower bound of one deviation for the share n / pages.
    share, pages_ = F.col("n") / F.col("pages"), F.col("pages")
    low = (share + 0.5 / pages_ - F.sqrt(share * (1 - share) / pages_ + 0.25 / (pages_ * pages_))) / (1 + 1 / pages_)
    judged = votes.withColumn("constant", (F.least(share, F.lit(1.0)) >= SHARE) & (low >= SHARE))
    by_slot = judged.groupBy("host", "slots").agg(
        F.sum(F.when(~F.col("constant"), F.col("mass")).otherwise(0)).alias("mass"), F.count("*").alias("texts"), F.sum("n").alias("uses"), F.collect_set(F.when(F.col("constant"), F.col("texts"))).alias("constants")
    )
    by_host = by_slot.groupBy("host").agg(F.collect_list(F.struct("slots", "mass", (F.col("texts") * 2 > F.col("uses")).alias("varies"))).alias("stats"), F.flatten(F.collect_list(F.transform("constants", lambda t: F.struct(F.col("slots").alias("slot"), t.alias("text"))))).alias("constants"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [content_of(form, {s["slots"]: s["mass"] for s in stats or ()}, {s["slots"] for s in stats or () if s["varies"]}) for form, stats in zip(batch.column("host_outline").to_pylist(), batch.column("stats").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("host_outline"), pa.array(content, pa.int32()), batch.column("constants")], names=["host", "host_outline", "content", "constants"])

    kept = hosts.select("host", "host_outline").join(by_host, "host", "left")
    return kept.select("host", "host_outline", "stats", "constants").mapInArrow(choose, "host string, host_outline string, content int, constants array<struct<slot:int,text:bigint>>")


def page_text(html: str, host_outline: str | None, content: int | None, constants: list | None) -> tuple[str, int]:
    """The page's main text by its host's wrapper, and the number of blocks left out as template."""
    root, blocks = parse(html)
    form = outline(root)
    partner = matched(form, host_outline) if host_outline else {}
    at = next((p for p, h in partner.items() if h == content), -1)
    kept = inside(form, at, blocks) if at >= 0 else []
    if not kept:
        kept = inside(form, own_content(form, blocks), blocks)
    if constants:
        template = {(c["slot"], c["text"]) for c in constants}
        varied = [b for b in kept if (partner.get(b.node.slot, -1), hashed(b.text)) not in template]
        if varied:
            return "\n\n".join(b.text for b in varied), len(kept) - len(varied)
    return "\n\n".join(b.text for b in kept), 0


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_template (blocks of the content left out as template) of every row.

    Blocks are joined by two line ends. A null or empty html gives an empty text; a null url is the host "". Equal
    rows stay apart, an empty table gives an empty one, other columns are not read. A content of which the template
    would leave nothing stays whole. Depth and number of elements are not limited.
    """
    own = pages.select("page_id", "url", F.col(html).alias("html"), host_of(F.col("url")).alias("host"))
    wrappers = written(induce(own.select("host", "html")), "wrappers")
    joined = with_host(own, wrappers, F.xxhash64("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "html"):
            made = [page_text(*row) for row in zip(texts, *(part.column(c).to_pylist() for c in ("host_outline", "content", "constants")), strict=True)]
            out = [m[0] for m in made]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64()), pa.array([m[1] for m in made], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_template"])

    return joined.select("page_id", "url", "html", "host_outline", "content", "constants").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_template bigint")


def describe_outline(text: str) -> str:
    """An outline as JSON lists of depth and label, in page order, for reading."""
    depth, out = 0, []
    for m in re.finditer(r"\(([^()]*)|\)", text):
        if m[0] == ")":
            depth -= 1
        else:
            out.append([depth, m[1]])
            depth += 1
    return json.dumps(out)
