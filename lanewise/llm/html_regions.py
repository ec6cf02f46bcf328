"""Main text of web pages by text-to-tag ratios.

Parser events become lines, one per block of text. A line's ratio is its text
outside links over its tags; the ratios are smoothed with a Gaussian kernel and
split in two clusters by a threshold. The lines above it vote for the region of
the page that holds them. Parts that are furniture by their element, role or
class stay out; where such a name may as well be the topic of the text, as in
"share-price" or "related-work", the cluster of the part's lines decides.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lanewise.llm.common import slices_of

SIGMA = 1.0
SHARE = 0.8  # of the voting text that a region has to hold

# Element names of HTML by their part on a page, and names that sites give to furniture
SKIPPED = set("script style noscript template head title svg math canvas iframe object select option textarea button datalist audio video map".split())
FURNITURE = set("nav footer aside form menu dialog fieldset".split())
BLOCKS = set("""address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}}
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NAMES = set("""ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments
commentlist consent cookie cookies copyright disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter notice
notices notification outbrain pager pagination popup promo promos promotion recommended related replies reply respond share sharing
sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets""".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PHRASES = set("p blockquote figcaption caption pre li dt dd td th".split())  # elements whose names often tell what the text is about
NO, DOUBTFUL, YES = range(3)


def marked(value: str | None, names: set[str]) -> int:
    """What the names in a class or id say: YES where all parts of one are furniture, DOUBTFUL where its first or last part is."""
    out = NO
    for name in (value or "").split():
        parts = [p.lower() for p in PART.findall(name) if not p.isdigit()]
        if parts and (parts[0] in names or parts[-1] in names):
            out = max(out, YES if all(p in names for p in parts) else DOUBTFUL)
    return out


def named_furniture(tag: str, attrs: dict[str, str | None], names: set[str], inside: bool) -> int:
    if (attrs.get("role") or "").strip().lower() in ROLES or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return YES
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.I):
        return YES
    by_class, by_id = marked(attrs.get("class"), names), marked(attrs.get("id"), names)
    if tag in HEADINGS:  # ids are made from their words
        return YES if by_class == YES else NO
    if tag in PHRASES:
        return max(by_class, min(by_id, DOUBTFUL))
    if inside and tag in ("ul", "ol") and not by_id and set((attrs.get("class") or "").lower().split()) in ({"menu"}, {"menus"}):
        return DOUBTFUL  # of links or of meals
    # a class is given by the site, an id of a part of the article may be made from its heading
    return max(YES if by_class else NO, by_id if inside else YES if by_id else NO)


@dataclass
class Node:
    tag: str
    parent: "Node | None"
    furniture: bool
    depth: int
    doubt: "Node | None" = None  # the outermost element around with a doubtful name


@dataclass
class Line:
    text: str
    linked: int
    tags: int
    node: Node


class Lines(HTMLParser):
    """Collects the lines of a page from the event stream."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.node = Node("", None, False, 0)
        self.lines: list[Line] = []
        self.pieces: list[str] = []
        self.linked = self.tags = self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text and not self.node.furniture:
            self.lines.append(Line(text, self.linked, max(1, self.tags), self.node))
        self.pieces, self.linked, self.tags = [], 0, 0

    def leave(self, node: Node) -> None:
        self.flush()
        self.node = node.parent or node

    def find(self, tags: set[str], stop: set[str] = frozenset()) -> Node | None:
        at = self.node
        while at.parent is not None:
            if at.tag in tags:
                return at
            if at.tag in stop:
                return None
            at = at.parent
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.pieces.append("\n")
            return
        if tag == "a":
            self.links += 1
        if tag not in BLOCKS and tag not in SKIPPED and tag not in FURNITURE:
            return
        if tag in BLOCKS and (p := self.find({"p"}, BLOCKS - {"p"} | FURNITURE)):
            self.leave(p)
        if tag in CLOSED_BY and (p := self.find(CLOSED_BY[tag], {"ul", "ol", "dl", "table", "menu"})):
            self.leave(p)
        if tag in ("article", "main"):  # content never stands in furniture that wasn't closed
            while (p := self.find(FURNITURE | SKIPPED)):
                self.leave(p)
        if tag == "body" and (p := self.find({"head", "title"})):
            while (p := self.find({"head", "title"})):
                self.leave(p)
        if tag in VOID:
            self.flush()
            return
        self.flush()
        inside = self.find({"article", "main"}) is not None
        given = dict(attrs)
        names = NAMES if inside else NAMES | {"header"}  # an article's own header holds its title
        by_name = NO if tag in ("html", "body", "main") or tag == "article" and not inside else named_furniture(tag, given, names, inside)
        quoted = tag == "aside" and inside and any("quote" in p for p in PART.findall((given.get("class") or "").lower()))  # a pull quote
        furniture = self.node.furniture or tag in SKIPPED or tag in FURNITURE and not quoted or tag == "header" and not inside or by_name == YES
        self.tags = 1
        self.node = Node(tag, self.node, furniture, self.node.depth + 1, self.node.doubt)
        if self.node.doubt is None and (by_name == DOUBTFUL or quoted):
            self.node.doubt = self.node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag == "p" and self.find({"p"}) is None:
            self.flush()
        elif (tag in BLOCKS or tag in SKIPPED or tag in FURNITURE) and (node := self.find({tag})):
            self.leave(node)

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        if self.links:
            self.linked += len(data.strip())


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian kernel over three deviations; at the ends the first and last value go on."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), "valid")


def threshold(values: np.ndarray) -> float:
    """Midway between the means of two clusters, found by moving it until it rests."""
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values <= cut], values[values > cut]
        if not len(low) or not len(high):
            break
        new = float((low.mean() + high.mean()) / 2)
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def chain(node: Node) -> list[Node]:
    out = []
    while node.parent is not None:
        out.append(node)
        node = node.parent
    return out


def cleared(lines: list[Line], ratio: np.ndarray, own: np.ndarray, cut: float) -> tuple[list[Line], np.ndarray]:
    """The lines without the elements of a doubtful name whose text stands mostly in links or, but for lists, on average in the lower cluster.

    Smoothing shall lift short lines between long ones, not lower a long one between links: the higher of both ratios counts.
    """
    sums: dict[int, np.ndarray] = {}
    for x, r in zip(lines, np.maximum(ratio, own)):
        if x.node.doubt is not None:
            n = len(x.text)
            low = n * (r - cut) if x.node.doubt.tag not in ("ul", "ol") else 0  # items of any list are short
            sums[id(x.node.doubt)] = sums.get(id(x.node.doubt), 0) + np.array([n, low, x.linked])
    out = {k for k, (n, low, linked) in sums.items() if low < 0 or 2 * linked > n}
    stay = [x.node.doubt is None or id(x.node.doubt) not in out for x in lines]
    return [x for x, s in zip(lines, stay) if s], ratio[stay]


def main_text(html: str | None) -> str:
    """The blocks of the main text, one a line; empty for a null or empty page and for one without content."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    own = np.array([max(0, len(x.text) - x.linked) / x.tags for x in lines])
    ratio = smoothed(own)
    cut = float(np.expm1(threshold(np.log1p(ratio))))  # by orders of size: long paragraphs shall not push shorter ones to the links
    lines, ratio = cleared(lines, ratio, own, cut)
    voters = [x for x, r in zip(lines, ratio) if r >= cut] or lines
    # content elements that hold a voter, the outermost of each nest; else the deepest node with most of the votes
    votes: dict[int, list[int]] = {}  # per outermost element its votes in articles and beside them, in characters
    places: dict[int, list[Node]] = {}
    for x in voters:
        content = [n for n in chain(x.node) if n.tag in ("article", "main")]
        if content:
            articles = [n for n in content if n.tag == "article"]
            votes.setdefault(id(content[-1]), [0, 0])[0 if articles else 1] += len(x.text)
            places.setdefault(id(content[-1]), []).append(articles[-1] if articles else content[-1])
    if votes:
        # of a main element the articles are the content, unless more text stands beside them
        regions = {n for k, (within, beside) in votes.items() for n in ([k] if beside > within else map(id, places[k]))}
        return "\n".join(x.text for x in lines if any(id(n) in regions for n in chain(x.node)))
    total, weight, seen = 0, {}, {}
    for x in voters:
        total += len(x.text)
        for n in chain(x.node):
            weight[id(n)] = weight.get(id(n), 0) + len(x.text)
            seen[id(n)] = n
    enough = [n for k, n in seen.items() if weight[k] >= SHARE * total and n.tag in BLOCKS - {"p", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}]
    if not enough:
        return "\n".join(x.text for x in lines)
    best = max(enough, key=lambda n: n.depth)
    return "\n".join(x.text for x in lines if best in chain(x.node) and (best.tag not in ("html", "body") or x.linked < len(x.text.replace(" ", "")) / 2))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row's whole page.

    A null page counts as empty and gives an empty text; broken markup is read as far as the
    parser can; repeated rows are extracted each; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices_of(whole, "html"):
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "url": b.column("url"),
                                                  "text": pa.array(map(main_text, b.column("html").to_pylist()), pa.string())})

    ids, urls = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    out = pages.selectExpr(f"`{id_col}` AS id", f"`{url_col}` AS url", f"CAST(`{html_col}` AS string) AS html").mapInArrow(run, f"id {ids}, url {urls}, text string")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
