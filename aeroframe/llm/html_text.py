"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks, each with its path of block elements from the root. Blocks inside elements that are
never article text (menus, page headers, footers, sidebars, notices, adverts, forms, comments, code) are left out. Of the
others, text outside links and punctuation are summed per path; every block takes its path's two ratios, both series are
smoothed over the page order and fused, and a path is content if its blocks' mean reaches a share of the page's level. These
paths find the element that is the article; its other blocks (lists, tables, code, short paragraphs) are content too, unless linked.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.text import small_batches

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head nav footer aside form button select option optgroup datalist input script style textarea title noscript template iframe object embed svg canvas audio video menu dialog noembed noframes xmp map math".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
            "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "thead": {"tr", "td", "th"}}
SCOPE = frozenset("html body article section main div table ul ol dl td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of a class or id that mark an element as no part of the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation navi menu menus "
                  "breadcrumb breadcrumbs masthead footer sidebar sidebars aside related recommended recommendations share sharing social comment comments commentlist reply replies respond disqus "
                  "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login signin widget widgets pagination pager "
                  "toolbar skip topbar form search copyright disclaimer announcement feedback reactions discussion responses popular trending teaser teasers links linklist tagcloud register poll survey".split())
#: Words that tell that an element has or lacks such a part; words at a name's end that say nothing; heads that belong to the article.
ABOUT, VAGUE, OWN_HEAD = frozenset("has with no without not hide".split()), frozenset("left right top bottom inner outer box block area list item items section region container slot group wrapper".split()), frozenset("entry article post story content".split())
#: Marks that are also words of ordinary titles, and words that such a mark has beside it when it does name a part of the page.
ORDINARY = frozenset("discussion related search share sharing social form poll survey links notice notices register responses reactions replies reply feedback popular trending recommended recommendations "
                     "announcement promotion alert menu navigation subscription advertising sponsors copyright consent".split())
BESIDE = frozenset("post posts article articles story stories news button buttons icon icons bar tools count counts media row field control".split())
#: Elements that group whole parts of a page; lists and tables.
CONTAINERS = frozenset("article main section div center td".split())
LISTS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("form button input select textarea".split())
KEEP, OUT, DOUBTFUL = range(3)
#: Characters outside links that a form control may have beside it in an element whose name is in doubt.
CONTROL_TEXT = 200
MARKUP = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<(?:[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z))", re.S)
ARTICLE = re.compile(r"<(?:article|main)[\s/>]", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？¿¡]")


def name_words(name: str) -> list[str]:
    """Words of a class or id, without vague words and numbers at the end."""
    found = [w.lower() for w in WORDS.findall(name)]
    while len(found) > 1 and (found[-1] in VAGUE or found[-1].isdigit()):
        found.pop()
    return found


def left_out_name(name: str, inside: bool) -> bool:
    """Whether a class or id begins or ends with a mark: ``site-nav`` and ``ad-slot-1`` do, ``content-sidebar-wrap`` and ``has-comments`` don't."""
    found = name_words(name)
    if not found or found[0] in ABOUT:
        return False
    return found[0] in MARKS or found[-1] in MARKS or not inside and found[-1].endswith("header") and found[0] not in OWN_HEAD


def judged_name(name: str, inside: bool, article: bool, is_id: bool) -> int:
    """KEEP, OUT, or DOUBTFUL: what the element holds decides. ``article``: the element may be part of the article.

    There, ids are often slugs of titles (``discussion``, ``related-work``) and classes compounds (``share-price``): an ordinary word
    alone leaves an element out only as a class that has nothing but such words."""
    if not left_out_name(name, inside):
        return KEEP
    found = name_words(name)
    if not article or any(w in MARKS and w not in ORDINARY for w in (found[0], found[-1])):
        return OUT
    if not any(w in MARKS for w in (found[0], found[-1])):
        return OUT
    return OUT if not is_id and all(w in MARKS or w in VAGUE or w in BESIDE for w in found) else DOUBTFUL


@dataclass
class Block:
    """A text, its length in links, and the elements around it as names (``path``) and as numbers on the page (``inside``)."""
    path: str
    text: str
    linked: int
    inside: tuple[int, ...] = ()


@dataclass
class Reader:
    """Open elements as (name, number, left out, in article, blocks and controls before it if its name is in doubt).

    ``bare``: the page has neither article nor main, so that any element may be part of the article."""
    bare: bool = False
    controls: int = 0
    opened: int = 0
    stack: list = field(default_factory=list)
    blocks: list = field(default_factory=list)
    parts: list = field(default_factory=list)
    links: int = 0
    linked: int = 0

    def left_out(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    def add(self, raw: str) -> None:
        if raw and not self.left_out():
            text = html.unescape(raw)
            self.parts.append(text)
            if self.links:
                self.linked += len("".join(text.split()))

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block("/".join(s[0] for s in self.stack), text, self.linked, tuple(s[1] for s in self.stack)))
            self.parts, self.linked = [], 0

    def pop(self, k: int) -> None:
        """Ends the elements from place ``k`` on. One whose name is in doubt goes if it is mostly links, or form controls with little text."""
        for *_, doubt in reversed(self.stack[k:]):
            if doubt:
                own = self.blocks[doubt[0]:]
                linked, text = sum(b.linked for b in own), sum(len(b.text) for b in own)
                if linked * 2 > text or text - linked <= CONTROL_TEXT * (self.controls - doubt[1]):
                    del self.blocks[doubt[0]:]
        del self.stack[k:]

    def open(self, name: str, attributes: str, closed: bool) -> None:
        self.controls += name in CONTROLS
        self.opened += 1
        if name in INLINE:
            if name == "br":
                self.add(" ")
            if name not in VOID and not closed:
                # inline elements that are left out hide their text too; others leave no trace
                judged = KEEP if self.left_out() or not attributes else self._marked(name, attributes, True)
                if judged == OUT or judged == DOUBTFUL and name == "a" and re.search(r"\bhref\b", attributes, re.I):
                    self.stack.append((name, self.opened, True, self.stack[-1][3] if self.stack else False, None))
                elif name == "a":
                    self.links += 1
            return
        self.flush()
        if name in CLOSES_P:
            self._close_in_scope({"p"})
        if name in SIBLINGS:
            self._close_in_scope(SIBLINGS[name], stop={"ul", "ol", "dl", "table", "select"})
        if name in VOID:
            return
        inside = bool(self.stack) and self.stack[-1][3]
        out = self.left_out() or name in NEVER or (name == "header" and not inside)
        judged = self._marked(name, attributes, inside) if attributes and not out else KEEP
        doubt = (len(self.blocks), self.controls) if judged == DOUBTFUL else None
        self.stack.append((name, self.opened, out or judged == OUT, inside or name in ("article", "main"), doubt))
        self.links = 0

    def _marked(self, name: str, attributes: str, inside: bool) -> int:
        judged, article = KEEP, self.bare or bool(self.stack) and self.stack[-1][3]
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return OUT
            if key == "role" and value.lower().strip() in ROLES:
                return OUT
            if key in ("class", "id") and name not in ("html", "body", "article", "main") and not (article and key == "id" and name in HEADINGS):
                found = {judged_name(c, inside, article, key == "id") for c in html.unescape(value).split()}
                if OUT in found:
                    return OUT
                judged = DOUBTFUL if DOUBTFUL in found else judged
        return judged

    def _close_in_scope(self, names: set, stop: frozenset | set = SCOPE) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                self.pop(k)
                return
            if self.stack[k][0] in stop:
                return

    def close(self, name: str) -> None:
        if name in INLINE and not any(s[0] == name for s in self.stack):
            if name == "a" and self.links:
                self.links -= 1
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                if name not in INLINE:
                    self.flush()
                    self.links = 0
                self.pop(k)
                return
        if name == "p":
            self.flush()


def read_blocks(page: str) -> list[Block]:
    """Text blocks in page order, without those of elements that are never article text."""
    r, at, end = Reader(bare=not ARTICLE.search(page)), 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        if m is None:
            r.add(page[at:])
            break
        r.add(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        if m[4] != ">":      # a tag that the page's end cuts off
            break
        name = name.lower()
        if m[1]:
            r.close(name)
            continue
        r.open(name, m[3], m[3].endswith("/"))
        if name in RAW and r.stack and r.stack[-1][0] == name:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else end
    r.flush()
    r.pop(0)
    return r.blocks


def smooth(x: list[float], radius: int = 2, sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing over the page order; at the ends the weights inside the page are scaled up."""
    weights = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(radius + 1)]
    out = []
    for i in range(len(x)):
        total = norm = 0.0
        for j in range(max(0, i - radius), min(len(x), i + radius + 1)):
            total += weights[abs(i - j)] * x[j]
            norm += weights[abs(i - j)]
        out.append(total / norm)
    return out


def region(blocks: list[Block], chosen: list[bool], share: float = 0.8) -> list[bool]:
    """Which blocks lie in the article: below the innermost ``article`` or ``main`` around ``share`` of the chosen text, or below the innermost other element around it.

    If that is the body, or no element at all: the blocks between the first and the last chosen one, and those that no container
    separates from the body."""
    weights: dict[int, int] = {}
    for b, c in zip(blocks, chosen, strict=True):
        for k in b.inside if c else ():
            weights[k] = weights.get(k, 0) + len(b.text)
    least = share * sum(len(b.text) for b, c in zip(blocks, chosen, strict=True) if c)
    names: list[str] = []
    chain: tuple[int, ...] = ()
    for b, c in zip(blocks, chosen, strict=True):
        held = [k for k in b.inside if weights.get(k, 0) >= least] if c else []
        if len(held) > len(chain):
            chain, names = tuple(held), b.path.split("/")[:len(held)]
    while names and names[-1] not in CONTAINERS and names[-1] not in ("html", "body"):      # a text's own paragraph or list is no article
        names.pop()
    own = next((k for k in range(len(names) - 1, -1, -1) if names[k] == "article"), next((k for k in range(len(names) - 1, -1, -1) if names[k] == "main"), len(names) - 1))
    if own >= 0 and names[own] not in ("html", "body"):
        return [chain[own] in b.inside for b in blocks]
    at = [i for i, c in enumerate(chosen) if c]
    return [at[0] <= i <= at[-1] or (CONTAINERS - {"td"}).isdisjoint(b.path.split("/")) for i, b in enumerate(blocks)] if at else chosen


def unlinked(blocks: list[Block]) -> list[bool]:
    """Which blocks are not mostly links; linked ones count as text in a list or table that is mostly other text."""
    groups: dict[int, list[int]] = {}
    own = []
    for b in blocks:
        k = next((k for name, k in zip(reversed(b.path.split("/")), reversed(b.inside), strict=False) if name in LISTS), -1)
        own.append(k)
        g = groups.setdefault(k, [0, 0])
        g[0] += b.linked
        g[1] += len(b.text)
    return [b.linked * 2 <= len(b.text) or k >= 0 and groups[k][0] * 2 <= groups[k][1] for b, k in zip(blocks, own, strict=True)]


def content(blocks: list[Block], share: float = 0.1) -> list[Block]:
    """The blocks on paths whose mean fused ratio is ``share`` of the page's level or more, and the others in the article that are not mostly links.

    Level: the mean of the blocks' fused ratios, weighted by their text. A page whose blocks are all alike keeps them all."""
    sums: dict[str, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        s[0] += max(0, len(b.text) - b.linked)
        s[1] += len(PUNCTUATION.findall(b.text)) if b.linked * 2 <= len(b.text) else 0
        s[2] += 1
    length = smooth([sums[b.path][0] / sums[b.path][2] for b in blocks])
    points = smooth([sums[b.path][1] / sums[b.path][2] for b in blocks])
    fused = [a * (1.0 + p) for a, p in zip(length, points, strict=True)]
    weight = sum(len(b.text) for b in blocks)
    if not weight:
        return []
    level = sum(f * len(b.text) for f, b in zip(fused, blocks, strict=True)) / weight
    mean: dict[str, list[float]] = {}
    for b, f in zip(blocks, fused, strict=True):
        m = mean.setdefault(b.path, [0.0, 0.0])
        m[0] += f
        m[1] += 1
    chosen = [mean[b.path][0] / mean[b.path][1] >= share * level for b in blocks]
    within = region(blocks, chosen)
    return [b for b, c, i, u in zip(blocks, chosen, within, unlinked(blocks), strict=True) if c or i and u]


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in content(read_blocks(page))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(p) for p in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (blocks joined by two line feeds, empty if none) and n_chars (code points).

    Null and empty pages, and pages without an article, have an empty text. Broken markup never fails: a tag or a comment that the
    page's end cuts off is dropped, unclosed elements end with their parent. Repeated rows, null keys and urls pass through;
    extra columns are ignored; an empty table gives no rows. Pages are independent: nothing is shuffled."""
    small_batches(pages.sparkSession, 500)
    kind, url_kind = pages.schema[key].dataType.simpleString(), pages.schema[url].dataType.simpleString()
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return named.mapInArrow(_extract, f"page_id {kind}, url {url_kind}, text string, n_chars long")
