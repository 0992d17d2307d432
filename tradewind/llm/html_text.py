"""Main text of web pages by tag-path ratios.

A page's text nodes are gathered by their path of tags from the root. Each path has two
ratios: characters a node, and punctuation marks a node, both without the text of links.
The ratios are smoothed over neighbouring paths in page order and fused by their product;
article and main elements raise the score of the paths in them, hint words in class, id and
role lower it. Paths over a threshold, a share of the page's weighted mean, are content. Their
container is the deepest element that holds HELD of the selected text, and where an article or
main element is around that, the element whole; all blocks inside it that no menu, notice, form
or comment section encloses make up the main text. Every page goes through the same steps.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import map_arrow, quoted, small_batches

#: Fixed lists from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: What such lists end at.
SCOPE = frozenset("ul ol dl table menu html body article section div main td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold main text; a form is told by what it holds, as some hold the whole page.
BOILERPLATE = frozenset("nav footer aside script style noscript template button select option textarea input iframe object svg canvas audio video menu dialog head title datalist search noembed noframes".split())
#: Words in class, id or role that name menus, notices, adverts and comments.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion promoted outbrain taboola "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar toolbar footer sidebar aside widget widgets related recommended recommendations popular trending "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist disqus respond replies reply discussion reactions "
    "share sharing social hidden skip complementary contentinfo dialog search form".split()
)
#: Hint words that also name subjects or parts of an article; inside one they count as hints only.
SUBJECTS = frozenset(
    "header banner sponsor sponsors sponsored promotion promoted related recommended recommendations popular trending toc "
    "consent notice notices alert overlay subscription signup login respond replies reply discussion reactions "
    "social search form skip dialog widget widgets aside complementary".split()
)
#: Hint words that say what an element is where they end a longer name, and those that do where they begin one.
KINDS = frozenset("ad ads advert adverts banner nav navbar navigation menu breadcrumb breadcrumbs pagination header masthead footer sidebar cookie cookies consent newsletter popup modal".split())
TALK = frozenset("comment comments commentlist disqus respond replies".split())
#: An attribute as HTML reads it: a quote opens a value only right after the equals sign.
_VALUE = r"(?:\s*+=\s*+(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*+)|(?=>|\Z)))?+"
_ATTR = re.compile(rf"([^\s/>][^\s/>=]*+){_VALUE}")
_ATTRS = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+{re.sub(r'\((?!\?)', '(?:', _VALUE)})*+"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})(>|\Z)", re.S)
_MARKS = frozenset("class id role hidden aria-hidden style".split())
_NAME = re.compile(r"[A-Za-z]+")
_PUNCT = re.compile(r"[.,;:!?…。，！？¿¡]")
#: Share of the mean fused ratio that makes a path content.
THRESHOLD = 0.5
#: What a hint leaves of a score, and what article and main elements, which the page's author marks as content, make of it.
LOWERED, RAISED = 0.75, 4.0
#: Share of the selected text that the container holds.
HELD = 0.8
#: Shares of the page's text outside links from which a form, or an element with a telling name, is a wrapper and not boilerplate.
PAGE_FORM, PAGE_NAME = 0.5, 0.8
#: Kinds of marks: boilerplate by name, reader comments, form, hint.
BY_NAME, BY_TALK, BY_FORM, HINTED = range(4)


def _named(tag: str, attrs: str, inside: bool) -> tuple[str, bool, int | None]:
    """(name in paths, whether it is hidden, kind of mark or None) by an element's attributes.

    A class, id or role marks an element by name if all words of one of its names are hint words,
    or if the name ends as KINDS or begins as TALK; inside an article only a name that is one
    such word does. Other hint words are hints. A heading's id is a link's target.
    """
    name, hidden, kind = tag, False, None
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key not in _MARKS:
            continue
        if key == "hidden":
            hidden = hidden or "=" not in m[0] or value.lower() not in ("", "false") or value == ""
        elif key == "aria-hidden":
            hidden = hidden or value.lower() == "true"
        elif key == "style":
            hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            name += "." + value
            if tag in ("html", "body", "article", "main") or inside and key == "id" and tag in HEADINGS:
                continue
            for one in value.split():
                words = [x.lower() for x in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", one))]
                known = HINTS.intersection(words)
                if not known or inside and "header" in known:
                    continue
                if inside:
                    sure = words[0] in HINTS and (key == "role" or words[0] not in SUBJECTS) if len(words) == 1 else False
                else:
                    sure = len(known) == len(set(words)) or words[-1] in KINDS or words[0] in TALK
                new = HINTED if not sure else BY_TALK if words[0] in TALK else BY_NAME
                kind = new if kind is None else min(kind, new) if BY_TALK not in (kind, new) else BY_TALK
    return name, hidden, kind


@dataclass
class Block:
    text: str
    path: int
    boiler: bool  # inside an element that never holds main text
    mark: int  # innermost marked element around it, or -1
    links: int  # characters in links


@dataclass
class Page:
    """Blocks in order; paths as a tree (path 0 is the root, a path's number is above its parent's) and marked elements likewise."""

    blocks: list[Block]
    up: list[int]  # parent of each path
    marked: list[bool]  # whether a path ends in article or main
    marks: list[tuple[int, int]]  # (mark around it or -1, kind)


class Element:
    """An open element; what it takes over from those around it is kept with it, so no step looks through the stack."""

    __slots__ = ("tag", "path", "boiler", "mark", "inside", "link", "block")

    def __init__(self, tag: str, path: int, boiler: bool, mark: int, inside: bool, link: bool, block: Element | None):
        self.tag, self.path, self.boiler, self.mark, self.inside, self.link = tag, path, boiler, mark, inside, link
        self.block = block or self  # the nearest element that isn't inline


#: What ends the search for a start tag: for inline and p and li end tags, and for a p that a block closes.
_WALLS, _P_WALLS = ("article", "main", "body", "td", "table"), tuple(SCOPE | BOILERPLATE | {"form"})
_SAME_WALLS = {tag: tuple(SCOPE - same) for tag, same in SAME.items()}


def parse(page: str) -> Page:
    """The page's blocks by their paths of tags, in time linear in its length however deep it is."""
    stack = [Element("#root", 0, False, -1, False, False, None)]
    open_at: dict[str, list[int]] = {}  # tag: where it stands in the stack
    out = Page([], [-1], [False], [])
    numbers: dict[tuple[int, str], int] = {}
    text: list[str] = []
    links, at, raw, broke = 0, 0, "", (0, False, -1)

    def last(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    def close(k: int) -> None:
        while len(stack) > k:
            open_at[stack.pop().tag].pop()

    def path(parent: int, name: str, marked: bool) -> int:
        n = numbers.setdefault((parent, name), len(out.up))
        if n == len(out.up):
            out.up.append(parent)
            out.marked.append(marked)
        return n

    def flush() -> None:
        nonlocal text, links
        if text:
            s = " ".join(html.unescape("".join(text)).split())
            if s:
                out.blocks.append(Block(s, *broke, links))
            text, links = [], 0

    def add(s: str) -> None:
        nonlocal broke, links
        top = stack[-1]
        here = (top.block.path, top.boiler, top.mark)
        if not text and not s.strip():
            return
        if not text:
            broke = here
        elif here[1:] != broke[1:] and s.strip():
            flush()
            broke = here
        text.append(s)
        if top.link:
            links += len(s)

    size = len(page)
    while at < size:
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = m.start() if m else size
            raw = ""
            continue
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if not m[4]:  # cut off inside a tag: markup
            break
        if tag not in INLINE:
            flush()
        if m[1]:
            k = last((tag,))
            if k > 0 and not (tag in INLINE or tag in ("p", "li")) or k > last(_WALLS):
                close(k)
            continue
        if tag in CLOSES_P and (k := last(("p",))) > last(_P_WALLS):
            close(k)
        if tag in SAME and (k := last(SAME[tag])) > last(_SAME_WALLS[tag]):
            close(k)
            while stack[-1].tag in SAME[tag]:
                close(len(stack) - 1)
        if tag in VOID:
            continue
        up, marked = stack[-1], tag in ("article", "main")
        name, hidden, kind = _named(tag, m[3], up.inside) if m[3] else (tag, False, None)
        if tag == "form" and kind is None:
            kind = BY_FORM
        boiler = up.boiler or hidden or tag in BOILERPLATE or tag == "header" and not up.inside
        mark = up.mark
        if kind is not None and not boiler:
            mark = len(out.marks)
            out.marks.append((up.mark, kind))
        inline = tag in INLINE and not (boiler or mark != up.mark)
        own = up.path if inline else path(up.path, name, marked)
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, own, boiler, mark, up.inside or marked, up.link or tag == "a", up.block if tag in INLINE else None))
        if tag in RAW and not m[3].endswith("/"):
            raw = tag
    flush()
    return out


def path_scores(blocks: list[Block], boiler: list[bool]) -> dict[int, float]:
    """Fused, smoothed ratios of the paths in page order; paths of boilerplate only have none."""
    paths: dict[int, list[float]] = {}
    for b, bad in zip(blocks, boiler, strict=True):
        p = paths.setdefault(b.path, [0, 0, 0])
        if not bad:
            p[0] += 1
            p[1] += max(0, len(b.text) - b.links)
            p[2] += len(_PUNCT.findall(b.text)) * (1 - min(1, b.links / len(b.text)))
    a = np.array(list(paths.values()), float).reshape(-1, 3)
    ratios = a[:, 1:] / np.maximum(a[:, 0], 1)[:, None]
    padded = np.vstack([ratios[:1], ratios, ratios[-1:]])
    smooth = 0.1 * padded[:-2] + 0.8 * padded[1:-1] + 0.1 * padded[2:]
    return dict(zip(paths, (smooth[:, 0] * (1 + smooth[:, 1]) * (a[:, 0] > 0)).tolist(), strict=True))


def boilerplate(page: Page) -> list[bool]:
    """Whether each block is inside an element that tag or name tells to be none of the main text."""
    prose = [0 if b.boiler else max(0, len(b.text) - b.links) for b in page.blocks]
    held = [0] * len(page.marks)
    for b, n in zip(page.blocks, prose, strict=True):
        if b.mark >= 0:
            held[b.mark] += n
    for k in range(len(page.marks) - 1, -1, -1):
        if page.marks[k][0] >= 0:
            held[page.marks[k][0]] += held[k]
    total, out = sum(prose), []
    for n, (up, kind) in zip(held, page.marks, strict=True):
        bad = kind == BY_TALK or kind == BY_NAME and n < PAGE_NAME * total or kind == BY_FORM and n < PAGE_FORM * total
        out.append(bad or up >= 0 and out[up])
    return [b.boiler or b.mark >= 0 and out[b.mark] for b in page.blocks]


def hinted_away(page: Page, good: list[Block], score: dict[int, float], least: float) -> set[int]:
    """Hinted elements whose lowered score, the mean over the text they hold, is under least, and what is marked inside them.

    A hint inside a hinted element says nothing more.
    """
    sums = [[0.0, 0] for _ in page.marks]
    for b in good:
        if b.mark >= 0:
            sums[b.mark][0] += score[b.path] * len(b.text)
            sums[b.mark][1] += len(b.text)
    for k in range(len(page.marks) - 1, -1, -1):
        if (up := page.marks[k][0]) >= 0:
            sums[up][0] += sums[k][0]
            sums[up][1] += sums[k][1]
    out: set[int] = set()
    hinted: list[bool] = []  # whether the element or one around it has a hint
    for k, (up, kind) in enumerate(page.marks):
        around = up >= 0 and hinted[up]
        hinted.append(around or kind == HINTED)
        if up in out or kind == HINTED and not around and sums[k][1] and LOWERED * sums[k][0] / sums[k][1] < least:
            out.add(k)
    return out


def main_text(page: str) -> str:
    """Text of the paths that their ratios select, and of what stands beside it in their container."""
    tree = parse(page)
    boiler = boilerplate(tree)
    good = [b for b, bad in zip(tree.blocks, boiler, strict=True) if not bad]
    if not good:
        return ""
    inside = tree.marked[:]
    for p in range(1, len(inside)):
        inside[p] = inside[p] or inside[tree.up[p]]
    score = {p: x * (RAISED if inside[p] else 1) for p, x in path_scores(tree.blocks, boiler).items()}

    def sizes() -> dict[int, int]:
        out: dict[int, int] = {}
        for b in good:
            out[b.path] = out.get(b.path, 0) + len(b.text)
        return out

    size = sizes()
    least = THRESHOLD * sum(score[p] * n for p, n in size.items()) / sum(size.values())
    if weak := hinted_away(tree, good, score, least):
        kept = [b for b in good if b.mark not in weak]
        good = kept or good
        size = sizes()
    chosen = {p for p in size if score[p] >= least and score[p] > 0}
    if not chosen:
        return " ".join(b.text for b in [b for b in good if inside[b.path]] or good)
    held, depth = [0.0] * len(tree.up), [0] * len(tree.up)
    for p in chosen:
        held[p] = size[p] * (RAISED if inside[p] else 1)
    total = sum(held)
    for p in range(len(held) - 1, 0, -1):
        held[tree.up[p]] += held[p]
    for p in range(1, len(held)):
        depth[p] = depth[tree.up[p]] + 1
    box = max((p for p in range(len(held)) if held[p] >= HELD * total), key=lambda p: (depth[p], held[p]))
    if box in size and box:  # a leaf: its parent holds its headings and lists
        box = box if tree.marked[box] else tree.up[box]
    around = box
    while around > 0 and not tree.marked[around]:
        around = tree.up[around]
    if around > 0:  # the article around it is whole
        box, chosen = around, set()
    within = [False] * len(tree.up)
    for p in range(len(within)):
        within[p] = p == box or p > 0 and within[tree.up[p]]
    return " ".join(b.text for b in good if b.path in chosen or within[b.path])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages, from the whole html.

    Null and empty html give empty text; null ids and urls and repeated rows stay as they are;
    a page cut off inside a tag ends there; other columns are ignored; no rows in, no rows out.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"), F.coalesce(quoted(html_col).cast("string"), F.lit("")).alias("html"))

    def f(b: pa.RecordBatch) -> dict:
        texts = [main_text(x) for x in b.column("html").to_pylist()]
        return {"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}

    return map_arrow(rows, f, "page_id long, url string, text string, n_chars long")
