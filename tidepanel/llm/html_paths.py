"""Main-text extraction by tag-path ratios.

A page becomes its text blocks in order, each on the path of block elements, with
their classes, from the root to it.

1. Per path, over the whole page, the text length, the punctuation and the text in
   links are summed and divided by the path's number of blocks.
2. Length and punctuation ratios are measured against the ratios at which the page's
   text typically stands, at most 1, and smoothed over neighbouring blocks.
3. Both are fused into one score, which links lower, and which sinks to a twentieth
   below an element whose classes or ids speak of adverts, notices, sidebars, comments
   and the like. Such a name counts only where the page has its content elsewhere: not
   if an article stands nowhere else and less than ``ELSEWHERE`` of all scores does. A
   name is a whole class or id, or its first or last part; classes that deny or
   describe (``no-sidebar``, ``has-header``, ``category-social``, ``main-header``) are
   none. Paths whose mean score reaches ``REACH`` are content paths; their blocks are
   selected.
4. Short blocks can't reach the threshold by themselves (headings, captions, list
   items, cells): they are kept where they stand in the ``article`` or ``main``, or
   in the innermost box, of selected blocks; a heading also before such a box. Links
   alone are kept in an article only.

What the HTML itself declares to be no article never counts: navigation, headers of
the page, footers, asides, forms, dialogs, scripts, styles, and what is hidden; but the
heading of a ``header`` that stands in the innermost box of selected blocks is kept.

Inside a block white space becomes one space; a ``<br>`` counts as white space.
Blocks are joined in page order by a line end.

Scale: a page is one row and is treated by itself, in linear time and memory; there
is no shuffle.

Cases: a null page, an empty one and one without content give an empty text; bare
text without any tag is one block; unclosed elements, comments, quotes and
references are read as browsers do, near enough; repeated rows stay; an empty
table gives an empty result; only the named columns are read.
"""

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Least score of a content path, what a telling name leaves of a score, and the share of all scores that must stand outside it.
REACH, NAMED, ELSEWHERE = 0.25, 0.05, 0.2
#: Weight of a block itself and of each neighbour in page order.
OWN, BESIDE = 0.7, 0.15

# Elements by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
NEVER = frozenset(
    "script style noscript iframe template svg math head title textarea select button input nav footer aside form menu dialog "
    "object canvas audio video xmp noembed noframes search".split()
)
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsense banner banners sponsor sponsored sponsors promo promos promotion promotions menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer sidebar side aside widget widgets notice notices cookie cookies consent gdpr alert popup modal overlay comment comments disqus replies reply "
    "respond social share sharing related recommend recommended recommendations newsletter subscribe signup login search toolbar pagination pager copyright disclaimer skip".split()
)
# Parts of classes that deny the other parts, or speak of what an article is about or of what holds it.
DENIALS = frozenset("no not non without has with hide hidden free less is category categories cat tag tags topic format type single main content article post entry story".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；！？]")

_MARKUP = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?]")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_GAP = re.compile(r"[\s/]*")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that group blocks.
_BOXES = frozenset("html body article main section div center details fieldset".split())
#: Words that, inside an article, name its own parts.
_OF_ARTICLE = frozenset(("header", "footer", "masthead"))
_PART = re.compile(r"[_-]+")
#: What an opening tag closes, up to the bound given.
_CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",))
}


def telling(names: str, in_article: bool = False) -> bool:
    """Whether a class or id speaks of what is no article."""
    for name in names.lower().split():
        parts = [p for p in _PART.split(name) if p]
        if parts and not DENIALS.intersection(parts) and any(p in NAMES and not (in_article and p in _OF_ARTICLE) for p in (parts[0], parts[-1])):
            return True
    return False


class Element:
    """``named`` is the number of the nearest telling name above or here, 0 for none; ``banner`` the page header it stands in."""

    __slots__ = ("banner", "box", "leaf", "named", "never", "parent", "path", "tag")

    def __init__(self, parent: "Element | None", tag: str, path: int, named: int, never: bool):
        self.parent, self.tag, self.path, self.named, self.never = parent, tag, path, named, never
        self.banner = parent.banner if parent is not None else None
        self.box = self if parent is None or tag in _BOXES else parent.box
        self.leaf = self if parent is None or tag in BLOCKS else parent.leaf


class Block:
    __slots__ = ("at", "marks", "n", "n_linked", "number", "parts", "rescued")

    def __init__(self, number: int, at: Element):
        self.rescued = False
        self.number, self.at, self.parts, self.n, self.n_linked, self.marks = number, at, [], 0, 0, 0


class Page:
    """A page's text blocks, and which of them are its main text."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.paths: dict[tuple[int, str], int] = {}
        #: Of each telling name the one above it; 0 is none.
        self.names = [0]
        self.counts: list[bool] = [False]
        self.of_article: dict[Element, bool] = {}
        self.root = Element(None, "", 0, 0, False)
        self.stack = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.block_places: list[int] = []
        self.number = 0
        at, end = 0, len(source)
        while at < end:
            m = _MARKUP.search(source, at)
            self._text(source[at : m.start() if m else end])
            if not m:
                break
            if m[0] == "<!--":
                stop = source.find("-->", m.end())
                at = end if stop < 0 else stop + 3
            elif not m[2]:
                stop = source.find(">", m.end())
                at = end if stop < 0 else stop + 1
            else:
                found, at = self._attributes(source, m.end())
                if at > end:  # cut off inside a tag
                    break
                tag = m[2].lower()
                if m[1]:
                    self._close(tag)
                    continue
                self._open(tag, found)
                if tag in RAW and source[at - 2] != "/":
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
                    at = stop.start() if stop else end

    @staticmethod
    def _attributes(source: str, at: int) -> tuple[dict[str, str], int]:
        """A tag's attributes and the place behind it; beyond the end if the tag never ends."""
        found: dict[str, str] = {}
        while True:
            at = _GAP.match(source, at).end()
            if at >= len(source):
                return found, len(source) + 1
            if source[at] == ">":
                return found, at + 1
            m = _ATTRIBUTE.match(source, at)
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            at = m.end()

    def _open(self, tag: str, found: dict[str, str]) -> None:
        if tag in BLOCKS:
            self._pop_until("p", ("td", "th", "button", "table"))
        if tag in _CLOSES:
            own, bounds = _CLOSES[tag]
            for name in own.split()[::-1]:
                self._pop_until(name, bounds)
        if tag in BLOCKS:
            self.number += 1
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            return
        up = self.stack[-1]
        names = f"{found.get('class', '')} {found.get('id', '')}" if found and tag not in ("html", "body", "article", "main") else ""
        in_article = bool(self.places["article"])
        banner = tag == "header" and not in_article
        never = up.never or tag in NEVER or banner
        if found and not never:
            never = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES or re.search(
                r"display\s*:\s*none",
                found.get("style", ""),
                re.IGNORECASE
            ) is not None
        named = up.named
        if names.strip() and telling(names, in_article):
            self.names.append(up.named)
            named = len(self.names) - 1
        path = up.path
        if tag in BLOCKS:
            path = self.paths.setdefault((path, f"{tag}.{found.get('class', '')}"), len(self.paths) + 1)
            self.block_places.append(len(self.stack))
        self.places[tag].append(len(self.stack))
        self.stack.append(Element(up, tag, path, named, never))
        if banner and not up.never:
            self.stack[-1].banner = self.stack[-1]

    def _pop_until(self, tag: str, bounds: tuple[str, ...]) -> None:
        if self.places[tag] and not any(self.places[b] and self.places[b][-1] > self.places[tag][-1] for b in bounds):
            self._cut(self.places[tag][-1])

    def _cut(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.block_places.pop()

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.number += 1
        if self.places[tag]:
            k = self.places[tag][-1]
            # An inline end tag closes no block.
            if tag in BLOCKS or tag in RAW or not self.block_places or self.block_places[-1] < k:
                self._cut(k)

    def _text(self, text: str) -> None:
        if not text:
            return
        last = self.blocks[-1] if self.blocks and self.blocks[-1].number == self.number else None
        if last is None:
            if text.isspace():
                return
            last = Block(self.number, self.stack[-1].leaf)
            self.blocks.append(last)
        text, up = html.unescape(text), self.stack[-1]
        n = len(text.strip())
        last.n += n
        last.marks += len(PUNCTUATION.findall(text))
        last.n_linked += n if self.places["a"] else 0
        last.parts.append((text, up.never, up.named))

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """Each block's path score, and the share of its path's text that is in links."""
        path = np.array([b.at.path for b in self.blocks])
        n, marks, linked = (np.array([getattr(b, name) for b in self.blocks], dtype=float) for name in ("n", "marks", "n_linked"))
        fine = np.array([not b.at.never for b in self.blocks])
        count, whole = np.bincount(path), np.bincount(path, n)
        links = np.bincount(path, linked) / np.maximum(whole, 1)

        def fuse(prior: np.ndarray) -> np.ndarray:
            usual = np.where(fine, n * prior, 0.0)
            fused = (1 - links[path]) ** 2 * prior
            for values, least in ((n, 0.0), (marks, 0.5)):
                ratio = (np.bincount(path, values) / np.maximum(count, 1))[path]
                typical = (usual * ratio).sum() / max(usual.sum(), 1)
                x = np.minimum(1, ratio / typical) if typical else np.ones(len(ratio))
                near = np.convolve(x, [BESIDE, OWN, BESIDE])[1:-1] / np.convolve(np.ones(len(x)), [BESIDE, OWN, BESIDE])[1:-1]
                fused *= least + (1 - least) * np.sqrt(x * near)
            return fused

        self._weigh_names(np.where(fine, n * fuse(np.ones(len(n))), 0.0))
        fused = fuse(np.where([self.counts[b.at.named] for b in self.blocks], NAMED, 1.0))
        return (np.bincount(path, fused) / np.maximum(count, 1))[path], links[path]

    def _weigh_names(self, scores: np.ndarray) -> None:
        """Which telling names, with those above them, count: the page's content must stand elsewhere too.

        ``scores`` are the blocks', as if nothing had a name, times their length.
        """
        article = np.array([self._in_article(b.at) for b in self.blocks])
        named = [b.at.named for b in self.blocks]
        inside = np.bincount(named, scores, len(self.names))
        inside_article = np.bincount(named, np.where(article, scores, 0.0), len(self.names))
        for k in range(len(self.names) - 1, 0, -1):
            inside[self.names[k]] += inside[k]
            inside_article[self.names[k]] += inside_article[k]
        self.counts = [False]
        for k in range(1, len(self.names)):
            elsewhere = inside[0] - inside[k] >= ELSEWHERE * inside[0] or inside_article[0] - inside_article[k] > 1e-9 * inside_article[0]
            self.counts.append(bool(elsewhere) or self.counts[self.names[k]])

    def _in_article(self, at: Element) -> bool:
        """Whether an element stands in an ``article`` or ``main``; told once for each box."""
        chain, x = [], at.box
        while x is not None and x not in self.of_article:
            chain.append(x)
            x = x.parent.box if x.parent is not None else None
        own = self.of_article[x] if x is not None else False
        for x in reversed(chain):
            own = self.of_article[x] = own or x.tag in ("article", "main")
        return own

    def kept(self) -> list[bool]:
        """Whether each block is main text."""
        if not self.blocks:
            return []
        scores, links = self.scores()
        usable = [not b.at.never for b in self.blocks]
        selected = [u and s >= REACH for u, s in zip(usable, scores.tolist())]
        boxes, around, articles = set(), set(), {"article": set(), "main": set()}
        for b, own in zip(self.blocks, selected):
            if own and b.at.box not in boxes:
                boxes.add(b.at.box)
                up = b.at.box
                while up is not None and up not in around:
                    around.add(up)
                    if up.tag in articles:
                        articles[up.tag].add(up)
                    up = up.parent
        whole = articles["article"] or articles["main"]
        inside: dict[Element, tuple[bool, bool]] = {}

        def where(e: Element) -> tuple[bool, bool]:
            """Whether an element stands in an article, and whether in a box, of selected blocks."""
            chain = []
            while e is not None and e not in inside:
                chain.append(e)
                e = e.parent
            own = inside[e] if e is not None else (False, False)
            for x in reversed(chain):
                own = inside[x] = (own[0] or x in whole, own[1] or x in boxes and x.tag not in ("", "html", "body"))
            return own

        out = []
        for b, own, fine, link in zip(self.blocks, selected, usable, links.tolist()):
            banner = b.at.banner
            if not own and banner is not None and b.at.tag in _HEADINGS and not banner.parent.never and not self.counts[b.at.named]:
                # The heading of a header beside the text; it is no page's header.
                box = banner.parent.box
                own = b.rescued = box in boxes and box.tag not in ("", "html", "body")
            elif not own and fine and not self.counts[b.at.named]:
                in_article, in_box = where(b.at)
                heading, box = b.at.tag in _HEADINGS, b.at.box
                beside = in_box or box in boxes
                own = in_article or beside and (heading or link < 0.5) or heading and box in around and box.tag not in ("", "html", "body")
            out.append(own)
        return out

    def text(self) -> str:
        lines = []
        for block, own in zip(self.blocks, self.kept()):
            if own:
                own = self.counts[block.at.named]
                parts = "".join(text for text, never, named in block.parts if (not never or block.rescued) and (own or not self.counts[named]))
                lines.append(" ".join(parts.split()))
        return "\n".join(x for x in lines if x)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(df: DataFrame, source: str = "html", to: str = "text") -> DataFrame:
    """``df`` with the main text of ``source`` in column ``to``."""

    text_batches(df.sparkSession)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(x.as_py()) for x in pages], pa.string())

    return df.withColumn(to, F.arrow_udf(of, "string")(F.col(source)))


def extract_report(df: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    out = extract(df.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
