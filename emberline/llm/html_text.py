"""The main text of web pages, from parser events and text-to-tag ratios.

1. The standard library's parser streams events. Text between block boundaries is a line;
   its ratio is its characters outside links over its tags. What is hidden, code, a control, or a menu,
   header, footer or sidebar by its element gives no lines.
2. Roles and names are evidence: within an element that they mark as a notice, an advert, comments and the like, ratios
   count ``MARKED`` times as much; names that only touch such words count ``TOUCHED`` times, article and main ``SAID`` times. A name that
   says nothing but advert or comments counts ``SURE`` times: such text only stays where a page has no other.
3. Ratios are smoothed with a Gaussian over neighbouring lines and parted by a threshold.
   Runs of lines over it are clusters; those that are heavy enough say where the content is.
4. The region is the innermost element that holds most of the clusters' weight, or an element around it while that
   adds dense lines (lists, tables and the like never are regions of their own; main is the widest).
5. Within the region every line stays, in page order, but for marked elements whose ratios, with the evidence, lie well
   under those of the lines that aren't marked. So a name alone drops nothing, unless it is sure: what all text is in, or most of it, stays.

Every step is linear in the page, also for elements nested to any depth.

Defined results: a null or empty page, or one without text, gives an empty text;
pages of any length are read whole; damaged markup is read as the parser reads it, and elements that are
left open end with their parent; a null page_id or url and repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberline.llm.textkit import tidy

# HTML's element classes, and the names by which pages mark what isn't content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre script section"
    " select style summary svg table tbody td template textarea tfoot th thead title tr ul video audio canvas object".split()
)
DROPPED = frozenset(
    "head title nav footer aside script style noscript template iframe svg math button select option textarea dialog canvas object audio video menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status tooltip".split())
NAMES = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar sidebars aside rail widget widgets"
    " notice notices notification cookie cookies consent gdpr banner alert popup modal overlay paywall newsletter subscribe subscription signup login"
    " ad ads adv advert adverts advertisement advertisements advertising advertorial adsense adbox sponsor sponsored sponsors promo promotion promoted"
    " comment comments commentlist disqus reply replies respond share sharing social related recommended pagination pager skip search toolbar form copyright".split()
)
#: Of these the ones that say an advert or readers' comments, if nothing else is said with them but a holder.
SURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsored comment comments commentlist disqus".split()
)
#: Words that turn a name round, words of an article's own parts, and words for a part of what a name says.
TURNED = frozenset("no non not with without has have".split())
OWN_PARTS = frozenset("article post entry story section content chapter main text".split())
HOLDERS = frozenset(
    "area bar block body box btn button buttons card cards container content group holder icons inner item items line link links list message page panel"
    " posts section slot stories text thread unit widget wrap wrapper zone".split()
)
#: An open element that a new one of these ends, and the elements that hide it.
ENDS = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
HIDES = {
    "ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt",), "table": ("tr", "td", "p"), "tr": ("td",), "td": ("p",), "th": ("p",),
    "button": ("p",), "select": ("option",), "article": ("p", "li", "dt", "tr", "td"), "main": ("p", "li", "dt", "tr", "td"),
}
#: Elements that end an open paragraph.
ENDS_P = BLOCK - {"button", "option", "optgroup", "script", "style", "template", "noscript", "iframe", "svg", "select", "textarea", "caption", "legend"}
REGIONS = frozenset(["article", "main"])
#: Elements that may be regions of their own.
WIDE = frozenset("article main body html div section center td form fieldset details".split()) | {""}

#: Lines on either side that the smoothing reaches, and its width.
REACH, SIGMA = 3, 1.5
#: What evidence does to a ratio.
SURE, MARKED, TOUCHED, SAID = 2.0**-20, 1 / 32, 1 / 3, 4.0
#: Parts of the heaviest cluster that one needs to count, and of all clusters that a region holds.
HEAVY, SHARE = 0.05, 0.7
#: Part of the other lines' mean ratio that a marked element needs to stay.
STAYS = 0.5

_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_KERNEL = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / (2 * SIGMA**2))


@lru_cache(maxsize=4096)
def _name_evidence(token: str) -> float:
    """What one class or id says: marked, touched or nothing (1)."""
    parts = [p.lower() for p in _PARTS.findall(token)]
    hits = [k for k, p in enumerate(parts) if p in NAMES]
    if not hits or not TURNED.isdisjoint(parts[: hits[-1]]):
        return 1.0
    last = parts[-1] if not parts[-1].isdigit() or len(parts) == 1 else parts[-2]
    if last == "header" and not OWN_PARTS.isdisjoint(parts):
        return 1.0
    if not SURE_NAMES.isdisjoint(parts) and all(p in SURE_NAMES or p in HOLDERS or p.isdigit() for p in parts):
        return SURE
    if last in NAMES or (last in HOLDERS and hits[-1] >= len(parts) - 2 - parts[-1].isdigit()):
        return MARKED
    return TOUCHED


def _evidence(attrs: list[tuple[str, str | None]]) -> float:
    """What the attributes say; 0 if they hide the element."""
    found, own = 1.0, False
    for name, value in attrs:
        if name == "hidden" or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
            return 0.0
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            found = min(found, MARKED)
        elif name in ("class", "id"):
            found = min([found, *map(_name_evidence, value.split())])
            own = own or not OWN_PARTS.isdisjoint(value.lower().split())
    return max(found, MARKED) if own else found


class _Page(HTMLParser):
    """Collects elements, a number each, and (text, characters in links, tags, element) of each line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Of each element: tag, parent, whether it is left out, evidence with its parents', whether it is marked itself, links around it.
        self.tags, self.parents, self.out, self.evidence, self.marked, self.links = [""], [-1], [False], [1.0], [False], [0]
        self.scopes: list[dict[str, int]] = [{}]  # of each element: the open elements that a new one may end
        self.at = 0
        self.open: list[Counter] = [Counter()]  # open elements by tag, within each open region
        self.lines: list[tuple[str, int, int, int]] = []
        self.text: list[str] = []
        self.linked = self.seen = 0

    def flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text and not self.out[self.at]:
                self.lines.append((text, self.linked, self.seen, self.at))
            self.text = []
            self.linked = self.seen = 0

    def _close(self, element: int) -> None:
        """Ends an open element and what is open in it."""
        parent = self.parents[element]
        while self.at != parent:
            tag = self.tags[self.at]
            self.open[-1][tag] -= 1
            if tag in REGIONS:
                self.open.pop()
            self.at = self.parents[self.at]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.seen += 1
        if tag in BLOCK:
            self.flush()
            if tag in ENDS_P and "p" in self.scopes[self.at]:
                self._close(self.scopes[self.at]["p"])
            if tag in ENDS:
                group = "tr" if tag == "tr" else ENDS[tag]
                if group in self.scopes[self.at]:
                    self._close(self.scopes[self.at][group])
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        at, new = self.at, len(self.tags)
        own = 1.0
        if attrs and tag not in ("html", "body"):
            own = _evidence(attrs)
        if tag == "form":
            own = min(own, MARKED)
        elif tag in REGIONS and own == 1.0 and self.evidence[at] <= 1.0:
            own = SAID
        dropped = tag in DROPPED or own == 0.0 or (tag == "header" and len(self.open) == 1)
        self.tags.append(tag)
        self.parents.append(at)
        self.out.append(self.out[at] or dropped)
        self.evidence.append(max(1e-300, self.evidence[at] * own))
        self.marked.append(own <= MARKED)
        self.links.append(self.links[at] + (tag == "a"))
        scope = self.scopes[at]
        if tag in HIDES or tag in ENDS or tag == "p":
            scope = {k: v for k, v in scope.items() if k not in HIDES.get(tag, ())}
            if tag == "p" or tag in ENDS:
                scope[ENDS.get(tag, tag)] = new
        self.scopes.append(scope)
        if tag in REGIONS:
            self.open.append(Counter())
        self.open[-1][tag] += 1
        self.at = new

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.seen += 1
        if tag in BLOCK:
            self.flush()
        wide = tag in REGIONS or tag in ("body", "html")
        if not any(c[tag] for c in self.open) if wide else not self.open[-1][tag]:
            return
        at = self.at
        while self.tags[at] != tag:
            at = self.parents[at]
        self._close(at)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.links[self.at]:
            self.linked += len(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    weight = np.convolve(np.ones(len(ratios)), _KERNEL, "full")[REACH : REACH + len(ratios)]
    return np.convolve(ratios, _KERNEL, "full")[REACH : REACH + len(ratios)] / weight


def line_ratios(lines: list[tuple[str, int, int, int]], evidence: list[float]) -> np.ndarray:
    """Text-to-tag ratios, with what the markup says."""
    return np.array([max(0, len(text) - linked) / (1 + tags) * evidence[at] for text, linked, tags, at in lines])


def dense_lines(ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines over the threshold that stand in heavy clusters; and lines over half of the threshold."""
    smooth = smoothed(ratios)
    least = min(smooth.mean(), np.median(smooth) + smooth.std())
    over = smooth >= least
    run = np.cumsum(np.r_[True, over[1:] != over[:-1]]) - 1
    weight = np.bincount(run, weights=np.where(over, ratios, 0.0))
    return over & (weight[run] >= HEAVY * weight.max()), smooth >= least / 2


def _held(page: _Page, weight: np.ndarray) -> list[float]:
    """Of each element: the sum of its lines' weights, also of those in elements within."""
    out = [0.0] * len(page.tags)
    for (*_, at), w in zip(page.lines, weight.tolist(), strict=True):
        out[at] += w
    for k in range(len(out) - 1, 0, -1):
        out[page.parents[k]] += out[k]
    return out


def _inside(page: _Page, region: int) -> tuple[list[bool], list[int]]:
    """Of each element: whether it is in the region, and the outermost marked element in there that it belongs to, or -1."""
    inside, group = [False] * len(page.tags), [-1] * len(page.tags)
    inside[region] = True
    for k in range(region + 1, len(page.tags)):
        parent = page.parents[k]
        if inside[parent]:
            inside[k] = True
            group[k] = group[parent] if group[parent] >= 0 else k if page.marked[k] else -1
    return inside, group


def _region(page: _Page, ratios: np.ndarray) -> int:
    dense, near_dense = dense_lines(ratios)
    weight = np.where(dense, ratios, 0.0)
    if not weight.any():
        weight = np.array([float(len(text)) for text, *_ in page.lines])
    held = _held(page, weight)
    region = max(k for k, h in enumerate(held) if h >= SHARE * held[0])  # of a chain the innermost has the highest number
    # Characters of lines that aren't marked, of those that are near the threshold at least, and of those with dense ratios of their own.
    size = np.array([float(len(text)) for text, *_ in page.lines])
    plain = size * np.array([page.evidence[at] >= page.evidence[region] for *_, at in page.lines])
    least = ratios[dense].mean() / 2 if dense.any() else 0.0
    all_, near, own = (_held(page, w) for w in (plain, plain * near_dense, plain * (ratios >= least)))
    at = region
    while page.parents[at] >= 0:
        parent = page.parents[at]
        if page.tags[region] == "main" or (page.tags[region] == "article" and page.tags[parent] in ("body", "html", "")):
            break
        gained = all_[parent] - all_[region]
        told = (own if page.tags[parent] in ("body", "html", "") else near)
        if page.tags[region] not in WIDE or (gained > 0 and told[parent] - told[region] >= gained / 2):
            region = parent
        elif gained > 0:
            break
        at = parent
    return region


def main_text(html: str | None) -> str:
    """The content of one page, a block a line."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    if not page.lines:
        return ""
    ratios = line_ratios(page.lines, page.evidence)
    inside, group = _inside(page, _region(page, ratios))
    own = np.array([inside[at] for *_, at in page.lines])
    groups = np.array([group[at] for *_, at in page.lines])
    plain = own & (groups < 0)
    least = STAYS * ratios[plain].mean() if plain.any() else 0.0
    for g in np.unique(groups[own & (groups >= 0)]).tolist():
        if ratios[own & (groups == g)].mean() < least:
            own &= groups != g
    return "\n".join(text for (text, *_), keep in zip(page.lines, own.tolist(), strict=True) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", "url", "html")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.mapInArrow(tidy(read), f"{kinds}, text string, n_chars long")
