"""Main text of web pages: streamed parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's event parser walks the page once. Each block of text becomes a line, with its characters and
the tags met on the way to it. The ratios of text to tags, smoothed along the page by a Gaussian, are cut at a threshold
(after Weninger et al., "CETR", WWW 2010); lines above it are dense. The dense lines select the content region, whatever
elements the page has: article elements if they hold most of the dense text, else main elements if these do, else the
smallest element that holds nearly all of it. From the region every block is kept, short or long, full of links or not,
but for what markup declares to be no content: menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, hidden parts, scripts and styles.

A class or id declares that of containers only, never of headings or paragraphs, and only as a whole name or with a
known first or last word. It declares nothing where an id is the title of its own section, as page generators make them,
nor on an element around the content, as in page-with-sidebar.

Elements are numbers with a parent each, so that all sums over elements are one pass, however deep elements nest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import own, packed, unpacked

# Element names of the HTML standard, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("annotation annotation-xml applet audio button canvas datalist embed frameset head iframe noframes noscript object script select style svg template textarea title video".split())
FRAME = frozenset("aside dialog footer menu nav search".split())
REGION = frozenset(("article", "main"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: What opening one of these ends, if it is open in the same container.
ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
CONTAINERS = frozenset("article aside body div dl fieldset figure footer form header html main nav ol section table ul".split())
CELLS = frozenset(("td", "th", "caption"))
TABLE = frozenset("table tbody td tfoot th thead tr caption".split())
#: Elements that a class or id can name a part that is not the article.
NAMED = (CONTAINERS | {"blockquote", "center", "dd", "details", "dt", "figcaption", "iframe", "li", "td"}) - {"body", "html", "main"}
#: Elements of running text: a block of links in one of these is no menu.
PROSE = HEADINGS | frozenset("blockquote caption dd dt figcaption p pre summary th".split())
# Names in class and id by which pages call parts that are not the article, whole or as a first or last word.
PARTS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner banners breadcrumb breadcrumbs byline captcha commentlist cookie "
    "cookies disqus dropdown footer footnav gdpr login masthead menu menubar menus modal nav navbar "
    "navigation newsletter overlay pager pagination paywall popup privacy promo promotion "
    "share sharebar sharing sidebar sidenav signin signup skyscraper social sponsor sponsored sponsors "
    "subscribe subscription tagcloud toolbar topbar trackback".split()
)
# Such names that count as a whole, or with one of FURNITURE beside them.
WEAK = frozenset("comment comments consent discussion feedback foot header notice notices notification rail recommended related replies reply respond search skip trending widget widgets".split())
FURNITURE = frozenset(
    "area articles aside bar block blocks body bottom box button buttons card col column container content entries form global group head inner item items "
    "left link links list main message messages module outer page panel post posts primary right secondary section site slot stories strip text thread "
    "tool tools top user view widget wrap wrapper zone".split()
)
# Words that make a "header" or "widget" of the same name a part of the article, as in post-header.
OWN = frozenset("article body content elementor entry page post story text".split())
NOT_OF_OWN = frozenset(("header", "widget", "widgets"))
# Words that turn such a name around, as in page-with-sidebar.
TURNED = frozenset("closed disabled has hide is no not open with without".split())
# Names of parts that often outweigh the article.
OUTWEIGH = frozenset("captcha comment commentlist comments consent cookie cookies discussion disqus gdpr paywall privacy replies reply respond".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[^\W_]+")
GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Width of the Gaussian in lines, share of the dense text that a region must hold, most words of a name.
SIGMA, SHARE, NAME_WORDS = 1.0, 0.9, 4
#: What an element frames: always; unless it is around the content; and whether its name is one of OUTWEIGH.
HARD, SOFT, HEAVY = 1, 2, 4


class _Page(HTMLParser):
    """Collects elements and lines. Only blocks, silent and hidden elements are elements here; other inline ones are counted."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Of each element, 0 being the page: its parent, name, what it frames (bits), and its title if a class or id is one.
        self.parent, self.name, self.frames = [-1], [""], [0]
        self.ids: dict[int, tuple[str, ...]] = {}
        # Of each line: text, tags before it, characters in links, element.
        self.text: list[str] = []
        self.tags: list[int] = []
        self.links: list[int] = []
        self.at: list[int] = []
        self.open: list[tuple[int, bool]] = []  # numbers of the open elements, and whether each is silent
        self.where: dict[str, list[int]] = {}  # of each name: its places among the open ones
        self.bars: list[int] = []  # places of open containers
        self.cells: list[int] = []  # places of open cells
        self.parts: list[str] = []
        self.silent = self.inside = self.count = self.linked = self.anchor = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCK
        if block:
            self._flush()
        self.count += 1
        if block:
            bar = self.bars[-1] if self.bars else -1
            for name in ENDS.get(tag, ("p",)):
                if (place := self.where.get(name)) and place[-1] > bar:
                    self._close(place[-1])
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        silent, frames = tag in SILENT, HARD if tag in FRAME or tag == "header" and not self.inside else SOFT if tag == "form" else 0
        slug: tuple[str, ...] = ()
        if attrs:
            hidden, marks, slug = _marks(tag, attrs)
            silent, frames = silent or hidden, frames | marks
        if tag == "a":
            self.anchor = 1  # links don't nest
        if block or silent:
            place, number = len(self.open), len(self.parent)
            self.parent.append(self.open[-1][0] if self.open else 0)
            self.name.append(tag)
            self.frames.append(frames)
            if slug and frames & SOFT:
                self.ids[number] = slug
            self.open.append((number, silent))
            self.where.setdefault(tag, []).append(place)
            self.silent += silent
            if tag in CONTAINERS:
                self.bars.append(place)
            if tag in CELLS:
                self.cells.append(place)
            self.inside += tag in REGION

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes void and foreign elements only, in HTML
        if tag == "svg":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        self.count += 1
        if tag == "a" or tag in BLOCK:
            self.anchor = 0
        place = self.where.get(tag)
        if place and (tag in TABLE or not self.cells or place[-1] > self.cells[-1]):
            self._close(place[-1])

    def _close(self, place: int) -> None:
        """Ends the open elements from a place on."""
        while len(self.open) > place:
            number, silent = self.open.pop()
            tag = self.name[number]
            self.where[tag].pop()
            self.silent -= silent
            self.inside -= tag in REGION
            for kind, stack in ((CONTAINERS, self.bars), (CELLS, self.cells)):
                if tag in kind:
                    stack.pop()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.anchor:
                self.linked += len(data)

    def handle_comment(self, data: str) -> None:
        pass

    def unknown_decl(self, data: str) -> None:
        pass

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.text.append(text)
            self.tags.append(max(1, self.count))
            self.links.append(min(self.linked, len(text)))
            self.at.append(self.open[-1][0] if self.open else 0)
            self.count = 0
        self.parts, self.linked = [], 0

    def read(self, html: str) -> None:
        try:
            self.feed(html)
            self.close()
        except AssertionError:  # the parser's word for a declaration it can't read; the rest is text
            self.parts.append(self.rawdata)
        self._flush()


def _marks(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, int, tuple[str, ...]]:
    """Whether attributes hide an element, what they frame, and the words of an id that frames."""
    hidden, frames, slug = False, 0, ()
    for name, value in attrs:
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and value and GONE.search(value):
            hidden = True
        elif name == "role" and value in ROLES:
            frames |= HARD if tag not in REGION else 0
        elif name in ("class", "id") and value:
            for part in value.split():
                hidden = hidden or part == "hidden" and tag not in REGION
                words = tuple(w.lower() for w in SPLIT.split(part) if w)
                if tag in NAMED and (key := _names(words)):
                    if tag == "article" and key not in OUTWEIGH and len(words) > 1:
                        continue  # an article's own labels, as in post sticky related-posts
                    frames |= SOFT | (HEAVY if key in OUTWEIGH else 0)
                    slug = words if name == "id" else slug
    return hidden and tag not in ("html", "body"), frames, slug


def _names(words: tuple[str, ...]) -> str:
    """The word by which a name calls a part that is not the article; "" if it doesn't."""
    if not words or len(words) > NAME_WORDS or not TURNED.isdisjoint(words):
        return ""
    for key in (words[0], words[-1]):
        rest = [w for w in words if w != key and not w.isdigit()]
        if key in NOT_OF_OWN and not OWN.isdisjoint(rest):
            continue
        if key in PARTS or key in WEAK and all(w in FURNITURE or w in PARTS or w in WEAK for w in rest):
            return key
    return ""


def dense(size: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines have a smoothed text-to-tag ratio over the threshold: the middle of the two clusters of ratios."""
    ratio = size / tags
    reach = max(1, round(3 * SIGMA))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    smooth = np.convolve(ratio, weight)[reach : reach + len(ratio)] / np.convolve(np.ones(len(ratio)), weight)[reach : reach + len(ratio)]
    low, high = smooth.min(), smooth.max()
    if high - low <= 1e-9 * abs(high):
        return np.ones(len(ratio), bool)
    for _ in range(100):
        upper = smooth > (low + high) / 2
        if not upper.any() or upper.all():
            break
        new = smooth[~upper].mean(), smooth[upper].mean()
        if new == (low, high):
            break
        low, high = new
    return smooth >= (low + high) / 2


class _Tree:
    """Sums and marks over the elements of a page; an element's parent has a smaller number."""

    def __init__(self, page: _Page):
        self.page, self.parent, self.n = page, page.parent, len(page.parent)

    def sums(self, values: np.ndarray) -> list[float]:
        """For each element, the sum of the values of its lines and those of all elements in it."""
        out = np.bincount(self.page.at, weights=values, minlength=self.n).tolist()
        return self.add(out)

    def add(self, out: list[float]) -> list[float]:
        for i in range(self.n - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def below(self, marked: list[bool]) -> np.ndarray:
        """Which elements are marked or lie in one that is."""
        out = list(marked)
        for i in range(1, self.n):
            out[i] = out[i] or out[self.parent[i]]
        return np.array(out, bool)

    def outermost(self, wanted: list[bool]) -> list[int]:
        """For each element, the outermost wanted one it lies in or is; 0 if none."""
        out = [0] * self.n
        for i in range(1, self.n):
            out[i] = out[self.parent[i]] or (i if wanted[i] else 0)
        return out


def main_text(html: str | None) -> str:
    """The blocks of the content region, white space in a block made one space, joined by two line feeds."""
    page = _Page()
    page.read(html or "")
    if not page.text:
        return ""
    tree, at = _Tree(page), np.array(page.at)
    size, links = np.array([len(x) for x in page.text], float), np.array(page.links, float)
    _clear_titles(page)
    hard = tree.below([bool(f & HARD) for f in page.frames])
    soft = [bool(f & SOFT) for f in page.frames]
    upper = dense(size - links, np.array(page.tags, float))
    framed = tree.below([s and not w for s, w in zip(soft, _wrappers(page, tree, hard, soft, upper, size, links), strict=True)]) | hard
    free = ~framed[at]
    heavy = _heavy(free, upper, size, links)
    region = _region(page, tree, framed, heavy)
    if region is not None:
        kept = free & region[at]
    else:
        kept = free & _densest(page, tree, heavy, size, links)
    return "\n\n".join([x for x, k in zip(page.text, kept.tolist(), strict=True) if k])


def _clear_titles(page: _Page) -> None:
    """An id made from the title of its own section names no part, unless it is one of OUTWEIGH and nothing else."""
    first: dict[int, str] = {}
    for text, i in zip(page.text, page.at, strict=True):
        if page.name[i] in HEADINGS:
            first.setdefault(page.parent[i], text)
    for number, slug in page.ids.items():
        title = tuple(w.lower() for w in WORD.findall(first.get(number, "")))
        if title and title == slug and not (len(slug) == 1 and slug[0] in OUTWEIGH - {"discussion"}):
            page.frames[number] &= ~(SOFT | HEAVY)


def _heavy(free: np.ndarray, upper: np.ndarray, size: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Characters outside links of the dense lines that nothing frames; of all lines where these have none."""
    weight = (size - links) * free
    heavy = weight * upper
    if not heavy.any():
        heavy = weight if weight.any() else size * free
    return heavy


def _wrappers(page: _Page, tree: _Tree, hard: np.ndarray, soft: list[bool], upper: np.ndarray, size: np.ndarray, links: np.ndarray) -> list[bool]:
    """Elements that a class or id names another part, or forms, but that are around the content.

    They hold half of the text of all article and main elements, and as much as lies in none of them. Or they hold most
    of the dense text, and article and main elements elsewhere next to no text; where the name is one of OUTWEIGH, nearly
    all and none.
    """
    if not any(soft):
        return soft
    at, n = np.array(page.at), tree.n
    named = tree.below(soft)
    free = ~hard[at]
    heavy, text = _heavy(free, upper, size, links), (size - links) * free
    top = np.array(tree.outermost([t in REGION and not h and not s for t, h, s in zip(page.name, hard.tolist(), soft, strict=True)]))
    in_region = text * (top[at] > 0)
    # Text of the regions in an element, credited where a region begins: an element in a region has none.
    credit = np.bincount(top[at], weights=in_region, minlength=n)
    credit[0] = 0
    around, held = tree.add(credit.tolist()), tree.sums(heavy)
    for r in set(top[at].tolist()) - {0}:
        around[r] -= credit[r]
    found, outside, total, every = in_region.sum(), (text * ~named[at]).sum(), heavy.sum(), text.sum()
    elsewhere = (in_region * ~named[at]).sum()
    out = []
    for i in range(n):
        if not soft[i] or not total:
            out.append(False)
        elif page.frames[i] & HEAVY:
            out.append(held[i] >= SHARE * total and not elsewhere)
        elif around[i]:
            out.append(2 * around[i] >= found and around[i] >= outside)
        else:
            out.append(2 * held[i] > total and elsewhere <= (1 - SHARE) * every)
    return out


def _region(page: _Page, tree: _Tree, framed: np.ndarray, heavy: np.ndarray) -> np.ndarray | None:
    """Which elements lie in the article elements, or else the main elements, if those hold most of the dense text. Of
    several, all with a dense line and their siblings; the others are teasers."""
    at = np.array(page.at)
    for kind in ("article", "main"):
        top = np.array(tree.outermost([t == kind and not f for t, f in zip(page.name, framed.tolist(), strict=True)]))
        held = np.bincount(top[at], weights=heavy, minlength=tree.n)
        held[0] = 0
        if held.any() and 2 * held.sum() >= heavy.sum():
            own_regions = np.unique(top[top > 0])
            beside = {tree.parent[i] for i in own_regions.tolist() if held[i]}
            chosen = np.zeros(tree.n, bool)
            chosen[[i for i in own_regions.tolist() if held[i] or tree.parent[i] in beside]] = True
            return chosen[top]
    return None


def _densest(page: _Page, tree: _Tree, heavy: np.ndarray, size: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Which lines lie in the smallest element that holds nearly all dense text, with the heading before it; where that
    element is the page itself, without loose menus: runs of links before its first and after its last dense line."""
    held, total, at = tree.sums(heavy), heavy.sum(), np.array(page.at)
    around = list(range(tree.n))  # the container that each element is or lies in
    for i in range(1, tree.n):
        if page.name[i] not in CONTAINERS and page.name[i] not in CELLS:
            around[i] = around[tree.parent[i]]
    root = max(i for i in range(tree.n) if around[i] == i and held[i] >= SHARE * total)  # inner elements have larger numbers
    inside = tree.below([i == root for i in range(tree.n)])[at]
    full = np.flatnonzero((heavy > 0) & inside)
    if len(full) and (page.name[root] in ("", "html", "body") or not (np.array(around)[at[full]] == root).any()):
        menu = (2 * links > size) & ~np.isin(np.array(page.name)[at], list(PROSE))
        place = np.arange(len(at))
        inside &= ~menu | (place > full[0]) & (place < full[-1])
    first = int(np.argmax(inside))
    if inside.any() and not any(page.name[i] in ("h1", "h2") for i in at[inside].tolist()):
        titles = [k for k in range(first) if page.name[at[k]] == "h1" and links[k] == 0]
        if titles:
            inside[titles[-1]] = True
    return inside


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with html_col replaced by text_col, the main text of each whole page, and n_chars, its code points.

    Null and empty pages, and pages without text, have the empty text. Markup that is broken is read as browsers would,
    as far as blocks go. Columns of the two new names are replaced, others pass through; repeated rows give equal texts;
    an empty table stays empty. Nothing is cut short.
    """
    names = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    inner = pages.select(own(html_col).cast("string").alias("html"), packed(names).alias("row"))
    schema = inner.select("row").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["row", "text", "n_chars"])

    out = inner.mapInArrow(run, schema)
    return out.select(*unpacked("row", names), out["text"].alias(text_col), "n_chars")
