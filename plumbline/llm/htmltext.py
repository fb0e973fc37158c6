"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one a block element.  Each line weighs its
characters; these are summed over sliding windows of lines.  A run of text goes
from where the sum rises from nothing, by a surge somewhere in it, to where it
dives to nothing again.  The lines between are kept, for the weightiest run and
those that belong to it.

Structure is one weight among others.  What its element or its class names as
furniture (menus, footers, adverts, forms, comments ...) weighs nothing, links
weigh against a line, and in an article or main element outside furniture any
character is enough for a surge, and a run does not leave the element.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML by their part in a page.
RAW = frozenset("script style noscript template iframe textarea title noembed noframes xmp".split())
FURNITURE = frozenset("nav footer aside form menu button select option datalist dialog svg canvas object audio video map header head math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption head".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold a line or a list of lines, and no more of a page.
LEAF = frozenset("html body p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table tbody thead tfoot tr td th caption figure figcaption hgroup address".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
# Classes and ids that name furniture.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets".split()
)
#: Words that may stand beside these in a class or id of several words; with any other word (has-sidebar, category-social, related-work) it names no furniture.
BESIDE = frozenset(
    "area article articles bar block blog body bottom box button buttons col column container count desktop entry first fixed form global google group head header heading here horizontal icon icons info inner item items js label large last latest left link links list main media message meta mobile more msg now on outer page panel pane popular post posts primary read right row secondary section site slot small sticky story stories text this title top trending unit us vertical wrap wrapper x zone".split()
)
COMPOUNDS = frozenset("promoted-content recommended-content related-content sponsored-content".split())
#: Elements whose id is more often a place to link to than a part of the page.
ANCHORS = frozenset("section p li dt dd tr td th pre blockquote figure table".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Blocks:
    """window: lines in a sum.

    surge: the sum that a run reaches, but no more than half of the page's
    greatest.  article: by how much a character in an article or main weighs more
    than one outside.  share: of the weightiest run, for another to be kept.
    """

    window: int = 3
    surge: int = 100
    article: int = 100
    share: float = 0.3


class Line(NamedTuple):
    """linked: characters in links.  bound: the outermost article or main around it, 0 for none, negative inside furniture.  element: the innermost around it, LEAF left out."""

    text: str
    linked: int
    bound: int
    element: int

    @property
    def weight(self) -> int:
        return len(self.text) if self.bound > 0 else max(0, len(self.text) - 2 * self.linked)


def _names(value: str) -> set[str]:
    """The words of the classes or ids that name furniture as a whole."""
    found: set[str] = set()
    for token in value.split():
        words = [w.lower() for w in WORDS.findall(token)]
        if not NAMES.isdisjoint(words) and (all(w in NAMES or w in BESIDE for w in words) or "-".join(words) in COMPOUNDS):
            found.update(words)
    return found & NAMES


def _furniture(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """(whether an element is furniture, whether by more than its names, whether it is named for readers' comments)."""
    names: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes) if attributes and not attributes.isspace() else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, True, False
        if key == "role" and value.lower() in ROLES:
            return True, True, False
        if key == "class":
            names |= _names(value)
        elif key == "id" and name not in HEADING:
            names |= _names(value) & COMMENTS if name in ANCHORS else _names(value)
    talk = not names.isdisjoint(COMMENTS)
    if name in ("body", "html", "main"):
        return False, False, False
    if name == "article":
        return False, False, talk
    return name in FURNITURE or bool(names), name in FURNITURE, talk


def lines_of(page: str, spared: frozenset[int] = frozenset()) -> tuple[list[Line], list[int], dict[int, tuple[int, int]]]:
    """The lines, furniture as empty ones; of each bound (from 1) the element it stands in; of each element, LEAF left out, the one around it and the last one in it.

    Elements that hold most of a page's text are spared if only their names
    make them furniture and no article or main outside furniture has any text.
    """
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, bool, int, bool, bool, int]] = []  # name, skipped, bound, comments, number, furniture, furniture or comments by more than names, innermost element but LEAF
    bounds: list[tuple[int, int, list[int]]] = [(0, 0, [])]  # bound around, element around, furniture around
    closed: set[int] = set()  # furniture that an end tag of its own closes
    skip = comments = firm = False
    linked, depth, inside, number, said = 0, 0, 0, 0, 0
    remarks: set[int] = set()  # bounds named for readers' comments
    tree: dict[int, tuple[int, int]] = {}
    begun: dict[int, int] = {}  # characters before each element that its names make furniture
    held: dict[int, int] = {}  # characters within it
    at, end = 0, len(page)

    def close():
        nonlocal linked
        text = " ".join("".join(parts).split())
        out.append(Line(text, min(linked, len(text)), inside, stack[-1][7] if stack else 0))
        parts.clear()
        linked = 0

    def put(raw: str, heading: bool):
        nonlocal linked, said
        if raw and not firm and not depth:
            said += len(raw.strip())
        if raw and (not skip or heading):
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if depth:
                linked += len(raw.strip())

    def leave(k: int):
        for x in stack[k:]:
            if x[4] in begun:
                held[x[4]] = said - begun[x[4]]
            if x[4] in tree:
                tree[x[4]] = (tree[x[4]][0], number)
        del stack[k:]

    while at < end:
        m = TOKEN.search(page, at)
        heading = skip and _own_heading(stack)
        if m is None:
            put(page[at:], heading)
            break
        put(page[at : m.start()], heading)
        at = m.end()
        if m[1] is not None:
            put(html.escape(m[1]), heading)
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if name == "a":
                depth = max(0, depth - 1)
            if name in BLOCK or name in FURNITURE:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if stack[k][5]:
                        closed.add(stack[k][4])
                    leave(k)
                    break
                if stack[k][0] in ("article", "main") and name not in ("article", "main", "body", "html"):
                    break  # a stray end tag does not close the article around it
            skip, inside, comments = stack[-1][1:4] if stack else (False, 0, False)
            firm = bool(stack) and stack[-1][6]
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in ("br", "wbr"):
            if name == "br":
                put(" ", heading)
            continue
        if name == "a":
            depth += 1
        if name in BLOCK or name in FURNITURE:
            close()
        if name in VOID or m[4].rstrip().endswith("/") and name in ("svg", "path"):
            continue
        if name == "body":
            leave(0)
            skip, inside, comments, firm = False, 0, False, False
        drop, sure, talk = _furniture(name, m[4])
        if name == "article" and talk and (inside or comments):
            drop = True
        number += 1
        if drop and number in spared:
            drop = False
        if name in ("article", "main") and not drop and not comments:
            if skip or not inside:
                bounds.append((inside, stack[-1][4] if stack else 0, [x[4] for x in stack if x[5]]))
                inside = len(bounds) - 1
                if talk:
                    remarks.add(inside)
            skip = firm = False  # what was left open before it ends here; what is closed behind it makes it furniture
        if name in BLOCK or name in FURNITURE:
            skip, comments, firm = skip or drop, comments or talk and drop, firm or drop and (sure or talk)
            if drop and not firm:
                begun[number] = said
            around = stack[-1][7] if stack else 0
            if name not in LEAF:
                tree[number] = (around, number)
            stack.append((name, skip, inside, comments, number, drop, firm, around if name in LEAF else number))
    close()
    leave(0)
    root = [0]
    for k, (around, _, furniture) in enumerate(bounds[1:], 1):
        root.append(-k if not closed.isdisjoint(furniture) else root[around] or k)
    if remarks:  # readers' comments, unless one holds most of the text
        sizes = dict.fromkeys(root, 0)
        for line in out:
            sizes[root[line.bound]] += line.weight
        total = sum(sizes.values())
        root = [-r if r in remarks and 2 * sizes[r] <= total else r for r in root]
    lines = [line._replace(bound=root[line.bound]) for line in out]
    most = frozenset(k for k, size in held.items() if 2 * size > said)
    if most and not spared and not any(line.bound > 0 and line.text for line in lines):
        return lines_of(page, most)
    return lines, [x[1] for x in bounds], tree


def _own_heading(stack: list[tuple]) -> bool:
    """Whether text stands in a heading that only an article's own header sets apart."""
    if len(stack) < 2 or stack[-1][0] not in HEADING or not stack[-1][2]:
        return False
    k = len(stack) - 2
    while k >= 0 and stack[k][1] and stack[k][0] in ("header", "hgroup", "div"):
        k -= 1
    return k >= 0 and not stack[k][1] and any(x[0] == "header" for x in stack[k + 1 :])


class Run(NamedTuple):
    """size: its characters by weight.  lo, hi: the first line and the one after the last.  bound: as in Line, 0 outside articles."""

    size: int
    lo: int
    hi: int
    bound: int


def runs_of(lines: list[Line], blocks: Blocks) -> list[Run]:
    """The runs between surges and dives; furniture breaks them as empty lines do."""
    weight = [0 if line.bound < 0 else line.weight for line in lines]
    sums = [0]
    for w, line in zip(weight, lines):
        sums.append(sums[-1] + w * (blocks.article if line.bound > 0 else 1))
    total = [0]
    for w in weight:
        total.append(total[-1] + w)
    out, n, start = [], len(lines), 0
    regions = []
    for i in range(1, n + 1):  # a window does not look into an article or out of it
        if i == n or lines[i].bound != lines[start].bound:
            regions.append((start, i, [sums[min(k + blocks.window, i)] - sums[k] for k in range(start, i)]))
            start = i
    surge = min(blocks.surge, max((max(block) for *_, block in regions), default=0) / 2)
    for lo, hi, block in regions:
        i = lo
        while i < hi:
            j = i
            while j < hi and block[j - lo]:
                j += 1
            first = next((k for k in range(i, j) if weight[k]), j)  # the sum looks ahead of the first text
            if first < j and max(block[first - lo : j - lo]) >= surge:
                out.append(Run(total[j] - total[first], first, j, max(0, lines[first].bound)))
            i = j + 1
    return out


def _container(elements: set[int], tree: dict[int, tuple[int, int]]) -> int:
    """The innermost element around all of these, 0 for the page."""
    home, last = min(elements), max(elements)
    while home and tree[home][1] < last:
        home = tree[home][0]
    return home


def main_lines(lines: list[Line], parents: list[int], tree: dict[int, tuple[int, int]], blocks: Blocks) -> list[str]:
    """The lines of the weightiest run, of those beside it in its container, and of those of a share of its size.  The runs of one article count as one."""
    runs = runs_of(lines, blocks)
    if not runs:  # nothing but what stands in furniture
        shaded = [line._replace(bound=-line.bound) for line in lines if line.bound < 0]
        return main_lines(shaded, parents, tree, blocks) if any(line.text for line in shaded) else []
    held: dict[int, int] = {}
    for run in runs:
        if run.bound:
            held[run.bound] = held.get(run.bound, 0) + run.size
    size = lambda run: held[run.bound] if run.bound else run.size
    best = max(runs, key=size)
    within = lambda run: {x.element for x in lines[run.lo : run.hi] if x.weight and not x.bound}
    home = 0 if best.bound else _container(within(best), tree)

    def belongs(run: Run) -> bool:
        if size(run) >= blocks.share * size(best):
            return bool(run.bound) or not best.bound
        if run.bound:
            return bool(best.bound) and parents[run.bound] == parents[best.bound]
        return bool(home) and all(home <= e <= tree[home][1] for e in within(run))

    chosen = [run for run in runs if belongs(run)]
    return [line.text for run in chosen for line in lines[run.lo : run.hi] if line.text and (run.bound or not line.bound and line.linked * 2 <= len(line.text))]


def extract_text(page: str | None, blocks: Blocks = Blocks()) -> str:
    """The main text of a page, one line a block; empty if there is none."""
    return "\n".join(main_lines(*lines_of(page), blocks)) if page else ""


def extract(pages: DataFrame, blocks: Blocks = Blocks()) -> DataFrame:
    """pages with text and n_chars (code points) of the main text of `html`; html itself is dropped.

    A null or empty page has an empty text.  Columns of pages named text or
    n_chars are replaced, others pass through; pages are read one by one and
    whole, however long, without a shuffle; repeated rows are read alike and an
    empty table gives no rows.
    """
    others = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    pages = pages.select(F.col("html").cast("string").alias("html"), *[F.col(f"`{c}`") for c in others])

    def run(batches):
        for batch in batches:
            texts = [extract_text(x, blocks) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*others, "text", "n_chars"])

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in pages.schema if f.name != "html"])
    return pages.mapInArrow(run, schema.add("text", "string").add("n_chars", "long"))
