"""Main text of web pages from parser events and smoothed text-to-tag ratios.

The events of the standard library's streaming parser become lines, one per
block. A line's ratio is its characters per tag; the ratios of a page, in page
order, are smoothed by a Gaussian, and lines above the threshold (the standard
deviation of the smoothed ratios) are content. The content region is the article
or main element that holds most of the characters of these lines, taken whole; on pages
without one, it is the deepest layout element that holds most of them and has no
headings, paragraphs, lists or sections of the content beside it. Its other lines come
along, as a short paragraph between long ones has a low ratio, except those of
page furniture: elements whose tag, role or name says menu, header, footer,
sidebar, notice, advert, form or comments, and, on pages without an article, lists made of links.
Inside an article, the names of paragraphs, headings, items and tables do not count. A page that stands
in a form as a whole is read as if the form were none.

Cases: null and empty html, and pages without text, give empty text; character
references are decoded; unclosed and stray tags are closed where HTML closes
them; pages of any length are read whole; rows that repeat stay; empty tables
give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stockweave.llm.batches import slices

# Fixed values of HTML: elements without content, elements that stand in a line, elements whose text is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp"
    " small span strike strong sub sup td th time tt u var wbr".split()
)
HIDDEN = frozenset(
    "script style noscript template iframe object svg math canvas audio video select button textarea option head title".split()
)
FURNITURE = frozenset("nav header footer aside form dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Start tags that end an open paragraph, and those that end an open element of their own kind.
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot tr td th div section article main body nav aside".split())
#: Words of a class or id that mark page furniture.
NAMES = frozenset(
    "nav navbar navigation topnav subnav menu menubar breadcrumb breadcrumbs sidebar aside header masthead footer"
    " ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login search share"
    " sharing social related recommended recommendations comment comments commentlist replies respond disqus widget"
    " widgets toolbar pagination pager skip".split()
)
#: A first word that turns the rest into a remark about the layout, or into a part of the article.
NOT_FURNITURE = frozenset("no has with without article entry post content main page story".split())
KEEP = frozenset("html body article main".split())
ARTICLE = frozenset("article main".split())
#: Elements that place parts of a page; all others are parts of a text.
LAYOUT = frozenset("html body div center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIGMA = 2.0
SHARE = 0.6


def furniture_name(value: str) -> bool:
    """Whether one of the names in a class or id marks furniture by its first or last word."""
    for name in value.split():
        parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)
        words = [p.lower() for p in parts]
        if words and not (len(words) > 1 and words[0] in NOT_FURNITURE and words[-1] not in COMMENTS):
            if words[0] in NAMES or words[-1] in NAMES:
                return True
    return False


#: Elements of a text: inside an article their names say nothing about furniture.
TEXTUAL = HEADINGS | frozenset("p li dl dt dd blockquote pre figure figcaption table tr td th".split())
#: Furniture also as a part of the article.
COMMENTS = frozenset("comment comments replies respond share sharing related".split())


class Lines(HTMLParser):
    """Collects a line per block: text, tags, characters inside links, container, furniture.

    Containers are numbered as they open, so those inside one are the numbers up
    to ``last`` of it; ``parent`` leads outwards.
    """

    def __init__(self, forms: bool = True) -> None:
        """``forms`` says whether forms are furniture."""
        super().__init__(convert_charrefs=True)
        self.furniture = FURNITURE if forms else FURNITURE - {"form", "fieldset"}
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, container, hidden, furniture
        self.open: Counter[str] = Counter()
        self.parent, self.last, self.kind = [0], [0], ["html"]
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.text: list[str] = []
        self.tags = self.links = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, container, _, furniture = self.stack[-1] if self.stack else ("", 0, False, False)
            self.lines.append((text, self.tags, self.links, container, furniture))
            self.tags = 0
        self.text, self.links = [], 0

    def pop(self, at: int) -> None:
        """Closes the elements from ``at`` on."""
        closed = self.stack[at:]
        if any(tag not in INLINE for tag, _, _, _ in closed):
            self.end_line()
        for tag, container, _, _ in closed:
            self.open[tag] -= 1
            self.last[container] = len(self.last) - 1
        del self.stack[at:]

    def close_open(self, kinds: set[str] | frozenset[str], scopes: frozenset[str]) -> None:
        """Closes the innermost open element of ``kinds``, unless one of ``scopes`` stands before it."""
        if not any(self.open[k] for k in kinds):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in kinds:
                return self.pop(at)
            if self.stack[at][0] in scopes:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag in INLINE:
                self.text.append(" ")
            else:
                self.end_line()
            return
        if tag in ENDS_P:
            self.close_open({"p"}, SCOPES)
        if tag in OWN_KIND:
            self.close_open(OWN_KIND[tag], SCOPES - OWN_KIND[tag])
        if tag == "body":
            self.close_open({"head"}, frozenset())
        if tag == "a":
            self.close_open({"a"}, SCOPES)
        if tag in ("article", "main") and self.stack and self.stack[-1][3]:
            # Furniture other than comments holds no article: what is still open there was never closed.
            first = next(i for i, x in enumerate(self.stack) if x[3])
            if self.stack[first][0] not in ("section", "ol", "ul", "li"):
                self.pop(first)
        if tag not in INLINE:
            self.end_line()
        elif tag in ("td", "th"):
            self.text.append(" ")
        _, container, hidden, furniture = self.stack[-1] if self.stack else ("", 0, False, False)
        named = dict(attrs)
        style = (named.get("style") or "").replace(" ", "").lower()
        hidden = hidden or tag in HIDDEN or "hidden" in named or "display:none" in style
        if not furniture and tag not in KEEP:
            furniture = (
                (tag in self.furniture and not (tag == "header" and (self.open["article"] or self.open["main"])))
                or (named.get("role") or "").lower() in ROLES
                or (
                    not (tag in TEXTUAL and (self.open["article"] or self.open["main"]))
                    and furniture_name(f"{named.get('class') or ''} {named.get('id') or ''}")
                )
            )
        if tag not in INLINE:
            self.parent.append(container)
            self.last.append(0)
            self.kind.append(tag)
            container = len(self.parent) - 1
        self.open[tag] += 1
        self.stack.append((tag, container, hidden, furniture))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.open[tag]:
            if tag == "br":
                self.text.append(" ")
            elif tag == "p":
                self.end_line()
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                return self.pop(at)
            if tag in INLINE and self.stack[at][0] not in INLINE:
                return  # a stray end tag in another block

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][2]):
            self.text.append(data)
            if self.open["a"]:
                self.links += len(data.strip())

    def finish(self) -> list[tuple[str, int, int, int, bool]]:
        self.close()
        self.end_line()
        self.pop(0)
        self.last[0] = len(self.last) - 1
        return self.lines


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that are left are scaled to one."""
    radius = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[radius : radius + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]


def content_region(parser: Lines, lines: list, able: list[int], content: set[int], share: float) -> int:
    """The container of the article; nothing of a text is left outside for a part of it."""
    kind, parent = parser.kind, parser.parent
    weight, blocks, beside = ([0] * len(parent) for _ in range(3))
    for i in able:
        text, _, _, container, _ = lines[i]
        weight[container] += len(text) * (i in content)
        if i in content or kind[container] in HEADINGS:
            blocks[container] += 1
            beside[container] += 1
    holds = set()  # containers of other containers with content
    for node in range(len(weight) - 1, 0, -1):
        if weight[node]:
            holds.add(parent[node])
        weight[parent[node]] += weight[node]
        blocks[parent[node]] += blocks[node]
        if kind[node] not in LAYOUT:
            beside[parent[node]] += blocks[node]
    # Numbers rise with depth: the first that holds enough is the outermost, and on the way down parents come first.
    enough = [n for n in range(1, len(weight)) if weight[n] >= share * weight[0]]
    region = next((n for n in enough if kind[n] in ARTICLE), 0)
    if not region:
        for node in enough:
            if node not in holds or parent[node] != region or kind[node] not in LAYOUT or beside[region]:
                break
            region = node
    return region


def main_text(html: str, sigma: float = SIGMA, share: float = SHARE) -> str:
    """The blocks of the content region in page order, joined by an empty line."""
    for forms in (True, False):  # a page that stands in one form as a whole is no form
        parser = Lines(forms)
        parser.feed(html)
        lines = parser.finish()
        able = [i for i, x in enumerate(lines) if not x[4]]
        if able:
            break
    else:
        return ""
    ratios = np.array([len(text) / max(1, tags) for text, tags, _, _, _ in lines])
    # Furniture keeps its place among the lines but has no weight of its own.
    ratios[[i for i, x in enumerate(lines) if x[4]]] = 0
    smoothed = smooth(ratios, sigma)
    threshold = min(float(smoothed.std()), float(smoothed[able].max()))
    content = [i for i in able if smoothed[i] >= threshold]
    region = content_region(parser, lines, able, set(content), share)
    chosen = []
    for i in able:
        text, _, links, container, _ = lines[i]
        # Outside articles, lines of links are menus; a linked heading is none.
        menu = (
            parser.kind[region] not in ARTICLE
            and parser.kind[container] not in HEADINGS
            and links > 0.66 * len(text)
            and smoothed[i] < threshold
        )
        if region <= container <= parser.last[region] and not menu:
            chosen.append(text)
    return "\n\n".join(chosen)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) with the main text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 4_000_000):
                texts = [main_text(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                    names=["page_id", "url", "text"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
