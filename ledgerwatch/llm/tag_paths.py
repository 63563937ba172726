"""Main text of web pages by tag-path ratios.

The text of a page is cut at block tags; every block has the path of tags above it. For each
path the lengths of its blocks and their punctuation are added up and divided by the number
of its tags, once for lengths and once for punctuation. The ratios, laid along the page, are
smoothed, fused into one score and compared with a threshold from the page itself; a path
whose blocks score above it on average is content.

The chosen paths show where the article is. If article or main elements hold text of chosen
paths, nothing outside them counts. Elsewhere the same ratios are taken of every container
(the part of the page directly around a block): a container stays if it holds chosen paths and
its own score comes near that of the main one. So a footer or a comment of the same
path as the article, but in another container, does not. In a container that stays, lists,
tables and captions stay too, though their scores are low.

Tags that never hold an article (menus, forms) score nothing, nor do parts named like adverts
or menus; names don't decide between containers.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerwatch.llm.common import text_blocks, text_of
from ledgerwatch.session import require_columns

# Tags of the HTML standard by what they do to a text's blocks.
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html iframe li main menu nav ol optgroup option p pre search section select summary table tbody td
textarea tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp template svg math".split())
SKIPPED = frozenset("""nav footer aside form script style head noscript iframe button select option textarea template svg math object
canvas audio video dialog menu search title noembed noframes xmp fieldset datalist""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A tag that ends an open tag before it, and the tags it may not reach across.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
        "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Parts of class names, ids and roles that name what is not the article.
NAMES = frozenset("""ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion promoted banner nav navbar
navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert
notification popup modal overlay subscribe subscription newsletter signup login search social share sharing related recommended
recommendations widget comment comments disqus reply replies respondlist discussion pagination pager complementary contentinfo dialog
header""".split())
#: Names of what readers wrote, which may be longer than the article.
READERS_NAMES = frozenset("comment comments disqus reply replies respondlist discussion".split())
#: First or last parts of compounds that tell a wrapper's state, as in has-sidebar and comments-open.
STATES = frozenset("has no not with without hide show open closed enabled disabled on off".split())
#: How an element is named: in a compound, by a whole name, or as what readers wrote.
COMPOUND, WHOLE, READERS = 1, 2, 3
#: Length of an article beside a named part that keeps the name, as a share of the part's; the same for a part within the article.
BESIDE, WITHIN = 0.02, 0.5
#: Tags that cut a page into parts.
PARTS = frozenset("body div article section main center".split())
#: What an end tag left out cannot reach across.
LIMITS = ("table", "td", "th", "div", "article", "section", "main", "body", "button")
#: Names that are also used for an article's own parts, where they stand inside the article.
INSIDE = frozenset(("header",))

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>?", re.S)
_attribute = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_hidden = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_name_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+").findall
_spaces = re.compile(r"\s+")
_marks = re.compile(r"[.,;:!?…。，！？、]").findall

#: Share of a main part's chosen text that one article in it must hold to bound it instead.
WITHIN_MAIN = 0.3
#: What article and main elements must hold of the chosen text to bound it, and the share of the main container's
#: score that another must reach.
BOUND, NEAR = 0.1, 0.2
#: Kernel along the blocks, and the share of the page's typical score that content must reach.
KERNEL = np.array([0.25, 0.5, 0.25])
SHARE = 0.1


@dataclass
class Block:
    """A block's text, the numbers of its path and of that path's parent, and whether anything on it rules it out."""

    path: int
    parent: int
    leaf: str
    text: str
    links: int
    barred: bool
    node: int


@dataclass
class Node:
    """An element: the number of the one around it (-1 for none), its tag, and what bars it."""

    parent: int
    tag: str
    barred: bool
    named: int  # 0, or COMPOUND, WHOLE or READERS


def blocks_of(page: str) -> list[Block]:
    """Blocks with text in page order; unclosed and misplaced tags are taken as they come."""
    return parsed(page)[0]


def parsed(page: str) -> tuple[list[Block], list[Node]]:
    """Blocks with text in page order, and the elements in the order they open."""
    out: list[Block] = []
    nodes: list[Node] = []
    stack: list[tuple[str, int, int]] = []  # tag, number of the element, number of the path
    number: dict[tuple[int, str], int] = {}  # paths by the path above and the last step
    above, leaves = [-1], [""]  # of each path; 0 is the empty one
    is_open: Counter = Counter()
    parts: list[str] = []
    links = 0

    def flush():
        nonlocal links
        if parts:
            text = _spaces.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                path = stack[-1][2] if stack else 0
                out.append(Block(path, above[path], leaves[path], text, min(links, len(text)), False, stack[-1][1] if stack else -1))
            parts.clear()
        links = 0

    def put(text: str):
        nonlocal links
        if text:
            parts.append(text)
            if is_open["a"]:
                links += len(text.strip())

    def close(tag: str, limits: tuple = LIMITS) -> None:
        """End the nearest open ``tag`` with all in it, unless a limit lies between."""
        if is_open[tag]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    is_open.subtract(t for t, _, _ in stack[i:])
                    del stack[i:]
                    return
                if stack[i][0] in limits:
                    return

    at, end = 0, len(page)
    while at < end:
        m = _token.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "br" or tag in VOID and tag != "hr":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if closing:
            if is_open[tag]:
                if tag in BLOCK:
                    close(tag, ())
                else:  # an inline tag ends the last of its kind within the block
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            del stack[i]
                            is_open[tag] -= 1
                            break
                        if stack[i][0] in BLOCK:
                            break
            continue
        if tag == "hr":
            continue
        if tag in RAW:  # its content is not markup; up to the end tag, or the end of the page
            ended = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = ended.end() if ended else end
            continue
        if tag in BLOCK:
            if tag not in ("html", "body"):
                close("p")
            if tag in ENDS:
                ends, limits = ENDS[tag]
                for t in ends.split():
                    close(t, limits)
        names, named = set(), 0
        for x in _attribute.findall(attributes):
            for token in "".join(x).split():
                parts_of = [n.lower() for n in _name_parts(token)]
                names.update(parts_of)
                named = max(named, _named(parts_of))
        within = is_open["article"] + is_open["main"] > 0
        if tag in ("html", "body", "article", "main") or within and not names & (NAMES - INSIDE):
            named = 0
        barred = tag in SKIPPED or tag == "header" and not within or bool(_hidden.search(attributes))
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
            nodes.append(Node(stack[-1][1] if stack else -1, tag, barred, named))
            path = stack[-1][2] if stack else 0
            if tag in BLOCK:
                step = (path, tag + "".join(f".{n}" for n in sorted(names)))
                if step not in number:
                    number[step] = len(above)
                    above.append(path)
                    leaves.append(tag)
                path = number[step]
            stack.append((tag, len(nodes) - 1, path))
            is_open[tag] += 1
    flush()
    _bar(out, nodes)
    return out, nodes


def _named(parts: list[str]) -> int:
    """What a class, id or role says: a part that is not the article, by a whole name or one in a compound."""
    if not NAMES.intersection(parts) or len(parts) > 1 and (parts[0] in STATES or parts[-1] in STATES):
        return 0
    return READERS if READERS_NAMES.intersection(parts) else WHOLE if len(parts) == 1 else COMPOUND


def _upwards(nodes: list[Node], of: list[int], values: list) -> list:
    """The sum of the blocks' values beneath each element."""
    out = [0] * len(nodes)
    for n, v in zip(of, values):
        if n >= 0:
            out[n] += v
    for n in range(len(nodes) - 1, -1, -1):
        if nodes[n].parent >= 0:
            out[nodes[n].parent] += out[n]
    return out


def _downwards(nodes: list[Node], marks: list[bool]) -> list[bool]:
    """Whether each element or one around it is marked."""
    out: list[bool] = []
    for node, m in zip(nodes, marks):
        out.append(m or node.parent >= 0 and out[node.parent])
    return out


def _bar(blocks: list[Block], nodes: list[Node]) -> None:
    """Bar blocks by tags and by names, but by no name that stands around the article itself.

    A name does not count on an element that holds the main part or most of the text that is
    not linked: first compound names, measured by the text outside whole names, then whole
    ones, unless an article with enough sentences stands beside them. Readers' words may well
    be much longer than the article.
    """
    of = [b.node for b in blocks]
    hard = _downwards(nodes, [n.barred for n in nodes])
    own = [0 if b.node >= 0 and hard[b.node] else max(0, len(b.text) - b.links) for b in blocks]
    marks = [n.barred for n in nodes]
    if any(n.named for n in nodes):
        holds = [0] * len(nodes)  # 2 with a main part, 1 with an article
        for n in range(len(nodes) - 1, -1, -1):
            node = nodes[n]
            held = 0 if hard[n] else max(holds[n], 2 if node.tag == "main" else 1 if node.tag == "article" else 0)
            if node.parent >= 0:
                holds[node.parent] = max(holds[node.parent], held)
        whole = _downwards(nodes, [n.named >= WHOLE and holds[i] < 2 for i, n in enumerate(nodes)])
        outside = [0 if b.node >= 0 and whole[b.node] else x for b, x in zip(blocks, own)]
        text, total = _upwards(nodes, of, outside), sum(outside)
        everything, most = _upwards(nodes, of, own), sum(own) / 2
        rival = max((everything[i] for i, n in enumerate(nodes) if n.named == WHOLE), default=0)
        freed = [holds[i] == 2 or n.named == COMPOUND and (holds[i] == 1 or 2 * text[i] > max(total, rival)) for i, n in enumerate(nodes)]
        named = _downwards(nodes, [n.named and not f for n, f in zip(nodes, freed)])
        within = _downwards(nodes, [n.tag in ("article", "main") or n.named == COMPOUND and f for n, f in zip(nodes, freed)])
        free = sum(x for b, x in zip(blocks, own) if b.node >= 0 and within[b.node] and not named[b.node] and _marks(b.text))
        for i, n in enumerate(nodes):
            if n.named >= WHOLE and not freed[i] and everything[i] > most:
                freed[i] = free < (WITHIN if n.named == WHOLE and within[i] else BESIDE) * everything[i]
            marks[i] = n.barred or bool(n.named) and not freed[i]
    barred = _downwards(nodes, marks)
    for b in blocks:
        b.barred = b.node >= 0 and barred[b.node]


def content_paths(blocks: list[Block]) -> set[int]:
    """Paths that the ratios choose."""
    free = [b for b in blocks if not b.barred]
    if not free:
        return set()
    number: dict[int, int] = {}
    of = np.array([number.setdefault(b.path, len(number)) for b in blocks])
    own_text = np.array([0 if b.barred else max(0, len(b.text) - b.links) for b in blocks], float)
    marks = np.array([0 if b.barred else len(_marks(b.text)) for b in blocks], float)
    n = np.bincount(of)
    length, points = np.bincount(of, own_text) / n, np.bincount(of, marks) / n
    smooth = lambda x: np.convolve(np.pad(x, 1, "edge"), KERNEL, "valid")
    fused = smooth(length[of]) * (1 + smooth(points[of]))
    fused[np.array([b.barred for b in blocks])] = 0
    typical = (fused * own_text).sum() / max(1.0, own_text.sum())
    mean = np.bincount(of, fused) / n
    least = min(SHARE * typical, mean.max())
    chosen = {p for p, k in number.items() if mean[k] > 0 and mean[k] >= least}
    # Headings are short and bare; they belong to the text that their parent holds.
    parents = {b.parent for b in free if b.path in chosen} | {b.path for b in free if b.path in chosen}
    return chosen | {b.path for b in free if b.leaf in HEADINGS and b.parent in parents}


def content(blocks: list[Block], nodes: list[Node]) -> list[Block]:
    """The blocks of the article: chosen paths decide which containers stay, see the module's text."""
    paths = content_paths(blocks)
    free = [b for b in blocks if not b.barred]
    if not paths:
        return []
    chosen = [b.path in paths for b in free]
    bound = _bounds(free, chosen, nodes)
    if bound:
        inside = _downwards(nodes, [i in bound for i in range(len(nodes))])
        kept = [(b, c) for b, c in zip(free, chosen) if b.node >= 0 and inside[b.node]]
        free, chosen = [b for b, _ in kept], [c for _, c in kept]
    return _containers(free, chosen, nodes)


def _bounds(free: list[Block], chosen: list[bool], nodes: list[Node]) -> set[int]:
    """The article and main elements that hold chosen text; none if they hold too little of it.

    Outermost ones; or the articles in a main part, if one holds enough of its chosen text.
    """
    own = [len(b.text) - b.links if c else 0 for b, c in zip(free, chosen)]
    held = _upwards(nodes, [b.node for b in free], own)
    outer, within = [], [0] * len(nodes)
    for i, n in enumerate(nodes):
        around = outer[n.parent] if n.parent >= 0 else -1
        outer.append(around if around >= 0 else i if n.tag in ("article", "main") else -1)
        if around >= 0 and n.tag == "article" and nodes[around].tag == "main":
            within[around] = max(within[around], held[i])
    found = {i for i in set(outer) if i >= 0 and held[i]}
    if sum(held[i] for i in found) < BOUND * sum(own):
        return set()
    for i in list(found):
        if within[i] > WITHIN_MAIN * held[i]:
            found.remove(i)
            found |= {j for j, n in enumerate(nodes) if n.tag == "article" and outer[j] == i and held[j]}
    return found


def _containers(free: list[Block], chosen: list[bool], nodes: list[Node]) -> list[Block]:
    """The blocks of containers that hold chosen paths and whose own ratios come near the main one's.

    What lies in a container that stays, without chosen paths of its own, stays unless it is
    mostly links, or stands before the first or behind the last chosen block. In a
    whole page or main part that is so of every block, not only of containers.
    """
    nearest: list[int] = []
    for i, n in enumerate(nodes):
        nearest.append(i if n.tag in PARTS else nearest[n.parent] if n.parent >= 0 else -1)
    of = [nearest[b.node] if b.node >= 0 else -1 for b in free]
    groups: dict[int, list[int]] = {}
    for k, g in enumerate(of):
        groups.setdefault(g, []).append(k)

    def text(members):
        return sum(len(free[k].text) - free[k].links for k in members)

    def score(members):
        """Length and marks a block, fused, of the blocks that count in the ratios."""
        marks = sum(len(_marks(free[k].text)) for k in members)
        return text(members) / len(members) * (1 + marks / len(members))

    told = {g: [k for k in members if chosen[k]] for g, members in groups.items()}
    main = max((g for g in told if told[g]), key=lambda g: (text(told[g]), -g), default=None)
    if main is None:
        return []
    least = NEAR * score(told[main])
    article = [*_downwards(nodes, [n.tag == "article" for n in nodes]), False]  # -1 stands for the page
    stays = {g for g in told if told[g] and (g == main or score(told[g]) >= least or article[g])}
    inner: list[int | None] = []  # the container that stays around each element
    for n in nodes:
        inner.append(n.parent if n.parent in stays else inner[n.parent] if n.parent >= 0 else None)
    inner.append(None)
    first, last = {}, {}
    for k, g in enumerate(of):
        if g in stays and chosen[k]:
            first.setdefault(g, k)
            last[g] = k
    out = []
    for k, (b, g) in enumerate(zip(free, of)):
        if g in stays:
            whole = g >= 0 and nodes[g].tag not in ("body", "main")
            if chosen[k] or whole or first[g] <= k <= last[g] or b.leaf in HEADINGS and k < first[g]:
                out.append(b)
        elif inner[g] is not None:
            members, around = groups[g], inner[g]
            links = sum(free[j].links for j in members)
            between = first[around] <= members[0] and members[-1] <= last[around] or article[around]
            if between and 2 * links <= sum(len(free[j].text) for j in members):
                out.append(b)
    return out


def main_text(page: str) -> str:
    """The article of a page, its blocks in page order with an empty line between; empty if there is none."""
    return "\n\n".join(b.text for b in content(*parsed(page)))


def extract(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page_id, url, text`` of every page, from the whole html.

    Null html is empty and gives an empty text; null ids and URLs stay; repeated rows each
    give a row; other columns are ignored; an empty table gives no rows. Each page is worked on by itself, in time and memory
    linear in its length, however long it is and however deep its tags are; of containers with equal text the first is the main one.
    """
    require_columns(pages, id_col, url_col, html_col)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_of(html_col).alias("text"))

    def run(batches):
        for batch in batches:
            urls, at = batch.column(1), 0
            for ids, texts in text_blocks([batch]):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), urls.slice(at, len(ids)), pa.array([main_text(t) for t in texts], pa.string())],
                                                 ["page_id", "url", "text"])
                at += len(ids)

    return rows.mapInArrow(run, "page_id long, url string, text string")
