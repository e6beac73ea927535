"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

A line is what stands between two block tags, as pages often have no line ends. What an element is called only lowers the
ratio of its lines; the clusters of all ratios of the page decide whether it goes and which elements are the content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markup import LinearParser

# The element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template svg iframe object audio video canvas head title select button textarea input label datalist".split())
LANDMARKS = frozenset("nav footer aside menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in the class or id of an element that say what it is for; the second ones are also said of parts of an article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert "
    "popup modal newsletter subscribe subscription signup login paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social "
    "toolbar pagination pager comment comments commentlist disqus reply replies respond masthead".split()
)
WEAK_HINTS = frozenset("header banner related recommended recommendations widget overlay copyright skip".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: First words of class names that tell what a wrapper has; words that take the weak hints beside them back.
MODIFIERS = frozenset("has with no without".split())
CONTENT_WORDS = frozenset("article post entry story content".split())
#: What an opening tag closes when it is still open, looked for up to the elements that bound it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_BOUNDS = {"div", "article", "section", "main", "td", "th", "li", "blockquote", "button"}
#: Elements that can be a content region of their own.
CONTAINERS = frozenset(["", *"body div section main article td center dialog details form".split()])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCKS - {"html", "body"}
CUT_TAG = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: How far a landmark or a hint lowers a ratio, and a weak hint.
STRONG, WEAK = 0.05, 0.4
#: Regions with this share of the text of the greatest one are content; smaller ones are if their own ratio is high.
LEAST_SHARE = 0.1


def hint_factor(value: str) -> tuple[float, bool]:
    """How far the words of a class or id lower the ratio of an element, and whether they speak of comments."""
    factor, comments = 1.0, False
    for name in value.split():
        words = re.split(r"[^a-z]+", CAMEL.sub("-", name).lower())
        if words[0] in MODIFIERS:
            continue
        if not HINTS.isdisjoint(words):
            factor, comments = STRONG, comments or not COMMENTS.isdisjoint(words)
        elif not WEAK_HINTS.isdisjoint(words) and CONTENT_WORDS.isdisjoint(words):
            factor = min(factor, WEAK)
    return factor, comments


class Lines(LinearParser):
    """Collects the lines of a page with their numbers of tags, and the elements (nodes) that they lie in. All work is
    in proportion to the page: open elements are also held by name, so that nothing walks over them."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, bool, int]] = []  # name, whether it or one around it is not shown, node
        self.places: dict[str, list[int]] = {}  # of each name, the places of the open elements
        self.blocks_open: list[int] = []
        self.parents, self.names, self.factors = [-1], [""], [1.0]
        self.landmark, self.comments = [False], [False]
        self.pieces: list[tuple[int, str]] = []
        self.lines: list[list[tuple[int, str]]] = []
        self.tag_counts: list[int] = []
        self.link_chars: list[int] = []
        self.tags = self.links = 0
        self.title = ""

    def tail(self, rest: str) -> None:
        super().tail(CUT_TAG.sub("", rest))

    def hidden(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def node(self) -> int:
        return self.open[-1][2] if self.open else 0

    def last(self, names: set[str]) -> int:
        """The place of the innermost open element of some names; -1 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def end_line(self) -> None:
        if any(not text.isspace() for _, text in self.pieces):
            self.lines.append(self.pieces)
            self.tag_counts.append(self.tags)
            self.link_chars.append(self.links)
            self.tags = self.links = 0
        self.pieces = []

    def judged(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, float, bool, bool]:
        """Whether an element is not shown, how far its name and attributes lower its ratio, whether it is a landmark,
        and whether it holds comments."""
        if tag in SILENT:
            return True, 1.0, False, False
        within = bool(self.places.get("article") or self.places.get("main"))
        landmark = tag in LANDMARKS or (tag == "header" and not within)
        factor, comments = (STRONG if landmark or tag == "form" else 1.0), False
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or (name == "style" and UNSEEN.search(value)):
                return True, 1.0, False, False
            if tag in ("html", "body", "main"):
                continue
            if (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLES):
                factor = STRONG
            elif name in ("class", "id"):
                own, said = hint_factor(value)
                factor, comments = min(factor, own), comments or said
        return False, factor, landmark, comments

    def pop_to(self, at: int) -> None:
        while len(self.open) > at:
            name = self.open.pop()[0]
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks_open.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.pieces.append((self.node(), " "))
        self.tags += not self.hidden()
        if tag in VOID:
            return
        names, bounds = CLOSES.get(tag, (set(), set()))
        if tag in ENDS_P:
            names, bounds = names | {"p"}, bounds | P_BOUNDS
        if names and (at := self.last(names)) > self.last(bounds - names):
            self.pop_to(at)
        unseen, factor, landmark, comments = self.judged(tag, attrs)
        node = self.node()
        if tag in BLOCKS or factor < 1:
            self.parents.append(node)
            self.names.append(tag)
            self.factors.append(factor)
            self.landmark.append(landmark)
            self.comments.append(comments)
            node = len(self.parents) - 1
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks_open.append(len(self.open))
        self.open.append((tag, self.hidden() or unseen, node))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += not self.hidden()
        at = self.last({tag})
        if at >= 0 and (tag in BLOCKS or not self.blocks_open or at > self.blocks_open[-1]):
            self.pop_to(at)

    def handle_data(self, data: str) -> None:
        if not self.hidden():
            self.pieces.append((self.node(), data))
            if self.places.get("a"):
                self.links += len(data.strip())
        elif self.open[-1][0] == "title":
            self.title += data

    def read(self, page: str) -> None:
        super().read(page)
        self.end_line()


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """The values after a Gaussian filter; at both ends the filter is cut and scaled."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """The middle between the centres of the two clusters of the values; the least value if they are all alike."""
    low, high = values.min(), values.max()
    if high - low < np.log(2):
        return low
    for _ in range(50):
        cut = (low + high) / 2
        moved = values[values <= cut].mean(), values[values > cut].mean()
        if moved == (low, high):
            break
        low, high = moved
    return (low + high) / 2


def sums_below(parents: list[int], own: np.ndarray) -> np.ndarray:
    """Of each node, the sum over it and all nodes in it; nodes follow their parents."""
    total = own.tolist()
    for node in range(len(parents) - 1, 0, -1):
        total[parents[node]] += total[node]
    return np.array(total)


def inherited(parents: list[int], marks: list[bool]) -> list[bool]:
    """Of each node, whether it or one around it is marked."""
    out = list(marks)
    for node in range(1, len(parents)):
        out[node] = out[node] or out[parents[node]]
    return out


class Page:
    """The lines of a page as arrays: of each piece of text its line, node and number of characters."""

    def __init__(self, html: str) -> None:
        parser = Lines()
        parser.read(html)
        self.parser, self.parents, self.names = parser, parser.parents, parser.names
        self.n_lines, self.n_nodes = len(parser.lines), len(parser.parents)
        self.line = np.array([i for i, pieces in enumerate(parser.lines) for _ in pieces], np.int64)
        self.node = np.array([node for pieces in parser.lines for node, _ in pieces], np.int64)
        self.size = np.array([len("".join(text.split())) for pieces in parser.lines for _, text in pieces], float)
        self.line_node = np.zeros(self.n_lines, np.int64)
        filled = np.flatnonzero(self.size)[::-1]
        self.line_node[self.line[filled]] = self.node[filled]  # that of the first piece with text

    def per_line(self, of_pieces: np.ndarray) -> np.ndarray:
        return np.bincount(self.line, weights=of_pieces, minlength=self.n_lines)

    def per_node(self, of_pieces: np.ndarray) -> np.ndarray:
        return sums_below(self.parents, np.bincount(self.node, weights=of_pieces, minlength=self.n_nodes))

    def factors(self) -> np.ndarray:
        """How far the ratio of each node is lowered by all that is said of it and of what is around it. Wrappers of the
        article are not lowered, nor are, on a page without one, elements with most of its text."""
        text = self.per_node(self.size)
        shut = inherited(self.parents, [m or f < 1 for m, f in zip(self.parser.landmark, self.parser.factors)])
        no_place = inherited(self.parents, self.parser.landmark)
        ranked = [(not shut[i], text[i], -i) for i, name in enumerate(self.names) if name in ("article", "main") and not no_place[i] and text[i] >= LEAST_SHARE * text[0] and not self.parser.comments[i]]
        around = set()
        at = -max(ranked)[2] if ranked else -1
        while at >= 0:
            around.add(at)
            at = self.parents[at]
        out = [1.0] * self.n_nodes
        for i in range(1, self.n_nodes):
            own = self.parser.factors[i]
            soft = not self.parser.landmark[i] and (i in around or (not around and not self.parser.comments[i] and 2 * text[i] > text[0]))
            out[i] = out[self.parents[i]] * (1.0 if soft else own)
        return np.array(out)

    def leaves(self) -> np.ndarray:
        """Whether each node has no other node in it: a div that holds words only is a paragraph."""
        out = np.ones(self.n_nodes, bool)
        out[np.array(self.parents[1:], np.int64)] = False
        return out

    def container(self) -> np.ndarray:
        """Of each node, the innermost one around it (or itself) that can be a region and is no leaf."""
        out, leaf = [0] * self.n_nodes, self.leaves()
        for i in range(1, self.n_nodes):
            out[i] = i if self.names[i] in CONTAINERS and not leaf[i] else out[self.parents[i]]
        return np.array(out)

    def within(self, nodes: list[int]) -> np.ndarray:
        """Whether each line lies in one of some nodes."""
        marks = [False] * self.n_nodes
        for i in nodes:
            marks[i] = True
        return np.array(inherited(self.parents, marks))[self.line_node]

    def outermost(self, name: str) -> list[int]:
        marks = [n == name for n in self.names]
        inside = inherited(self.parents, marks)
        return [i for i in range(1, self.n_nodes) if marks[i] and not inside[self.parents[i]]]

    def headline(self, chosen: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Lines before the chosen ones that are their headline: the last h1 among those `left`, or that of a page
        header (with the paragraphs below it) if it begins the title and is the only one; on a page without h1 the
        heading just before."""
        out = np.zeros(self.n_lines, bool)
        first = int(np.flatnonzero(chosen)[0])
        tags = [self.names[i] for i in self.line_node]
        h1 = [i for i in range(self.n_lines) if tags[i] == "h1"]
        if any(chosen[i] for i in h1):
            return out
        before = [i for i in h1 if i < first]
        plain = [i for i in before if left[i]]
        if plain:
            out[plain[-1]] = True
        elif len(h1) == 1 and before:
            at = before[0]
            header = self.parents[self.line_node[at]]
            while header > 0 and not self.parser.landmark[header]:
                header = self.parents[header]
            title, name = (" ".join(x.split()).lower() for x in (self.parser.title, "".join(t for _, t in self.parser.lines[at])))
            if self.names[header] == "header" and (not title or title.startswith(name)):
                shut = inherited(self.parents, [i != header and (m or f < 1) for i, (m, f) in enumerate(zip(self.parser.landmark, self.parser.factors))])
                lead = self.within([header])
                for i in range(at, first):
                    out[i] = lead[i] and not shut[self.line_node[i]] and tags[i] in ("h1", "p")
        elif not h1 and first and tags[first - 1] in HEADINGS and left[first - 1]:
            out[first - 1] = True
        return out

    def content(self, clustered: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Which lines are content, and which pieces of text are left in them. `clustered=False` takes all ratios for
        those of content."""
        per_tag = self.per_line(self.size) / np.maximum(1, self.parser.tag_counts)
        level = np.expm1(smoothed(np.log1p(per_tag)))
        factor = self.factors()
        score = np.log1p(level[self.line] * factor[self.node])  # of each piece
        total = np.maximum(self.per_line(self.size), 1)
        line_score = self.per_line(score * self.size) / total
        cut = threshold(line_score) if clustered else 0.0

        mean = self.per_node(score * self.size) / np.maximum(self.per_node(self.size), 1)
        goes = [self.parser.landmark[i] or (self.parser.factors[i] < 1 and bool(mean[i] < cut)) for i in range(self.n_nodes)]
        stays = ~np.array(inherited(self.parents, goes))[self.node]
        left = self.per_line(self.size * stays)
        if not left.any():
            return left > 0, stays
        weight = np.where(line_score >= cut, left, 0.0)
        if not weight.any():
            weight = left
        of_node = sums_below(self.parents, np.bincount(self.line_node, weights=weight, minlength=self.n_nodes))
        links = 2 * np.array(self.parser.link_chars) > self.per_line(self.size)
        visible, linked = (sums_below(self.parents, np.bincount(self.line_node, weights=w, minlength=self.n_nodes)) for w in (left, left * links))
        for name in ("article", "main"):
            found = [i for i in self.outermost(name) if visible[i] > 0]
            most = max((visible[i] for i in found), default=0.0)
            if found and 2 * sum(of_node[i] for i in found) > of_node[0]:
                chosen = self.within([i for i in found if visible[i] >= LEAST_SHARE * most or (of_node[i] > 0 and 2 * linked[i] <= visible[i])])
                break
        else:
            where = self.container()[self.line_node]
            direct, own, rank = (np.bincount(where, weights=w, minlength=self.n_nodes) for w in (weight, left, line_score * left))
            region = (direct >= LEAST_SHARE * direct.max()) | ((direct > 0) & (rank >= cut * own))
            row_of_links = np.array([self.names[i] in CONTAINERS for i in self.line_node]) & links & (np.log1p(per_tag) < cut)
            chosen = region[where] & ~row_of_links
            between = np.flatnonzero(chosen & (left > 0))
            inner = np.arange(between[0], between[-1] + 1)
            chosen[inner] |= ~links[inner]
        chosen &= left > 0
        lead = self.headline(chosen, left > 0)
        return chosen | lead, stays | lead[self.line]


def main_text(html: str | None, clustered: bool = True) -> str:
    """The text of the content of a page, one line for each block.

    The text-to-tag ratios of the lines are smoothed and split into two clusters. Ratios in elements that are called
    menus, adverts, comments and the like are lowered first, and those elements go whose mean lies in the lower cluster;
    nav, header, footer, aside and dialog elements always go. If articles (or main elements) hold most text of the upper
    cluster, they are the content, short lines too, but for small ones of links or low ratios; otherwise the elements that hold it directly are, with
    the lines between them that are not mostly links. A headline that stands before belongs to it.
    """
    if not html:
        return ""
    page = Page(html)
    if not page.n_lines:
        return ""
    chosen, stays = page.content(clustered)
    out: list[str] = []
    place = 0
    for i, pieces in enumerate(page.parser.lines):
        if chosen[i]:
            text = " ".join("".join(t if stays[place + j] else "" for j, (_, t) in enumerate(pieces)).split())
            if text:
                out.append(text)
        place += len(pieces)
    return "\n".join(out)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`page_id, url, text, n_chars` of each row, from the whole html.

    A null or empty html, and one without visible content, gives an empty text. Broken markup is read as far as it goes:
    an unfinished tag at the end is dropped. Repeated rows give repeated results, an empty table none; other columns are
    not read.
    """
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(html.as_py()) for html in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return read.mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))
