"""HTML by events of the standard parser, in time in proportion to the page, and the visible text of a page."""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

# Elements without content, and elements whose strings are no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style template rt rp".split())
COMMENT_END = re.compile(r"--\s*>")
#: An ampersand, and the reference that it begins if that has its semicolon.
REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")
#: How often a start tag may run unclosed to the end of a page before what follows is no longer tried as a tag.
TRIES = 8


class LinearParser(HTMLParser):
    """The standard parser without its repeated searches for ends that do not come. `read` takes a whole page.

    What stands after the last `>` cannot hold a whole tag, so it is text (`tail`). Where a comment or section has no end,
    none after it has one. A start tag that runs to the end of the page is text up to its first `>`, and after some of
    them others are taken for text as well, so that no page is read more than some times over.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tries = TRIES
        self.open_from: dict[str, int] = {}
        self.fed = 0

    def read(self, page: str) -> None:
        whole = page.rfind(">") + 1
        self.fed = whole
        self.feed(page[:whole])
        super().close()
        if whole < len(page):
            self.tail(page[whole:])

    def tail(self, rest: str) -> None:
        """Text after the last `>`; inside a script or style it belongs to that."""
        self.handle_data(rest if self.cdata_elem else unescape(rest))

    def close(self) -> None:
        """Pages are closed by `read`."""

    def ended(self, kind: str, i: int, end: re.Match | None) -> int:
        """Where a search from `i` ended, counted from the front of the page; remembers that it did not."""
        if end is None:
            self.open_from[kind] = self.fed - len(self.rawdata) + i
            return -1
        return end.end()

    def hopeless(self, kind: str, i: int) -> bool:
        return kind in self.open_from and self.fed - len(self.rawdata) + i >= self.open_from[kind]

    def check_for_whole_start_tag(self, i: int) -> int:
        if self.tries <= 0:
            return -1
        end = super().check_for_whole_start_tag(i)
        self.tries -= end < 0
        return end

    def parse_comment(self, i: int, report: int = 1) -> int:
        if self.hopeless("comment", i):
            return -1
        found = COMMENT_END.search(self.rawdata, i + 4)
        if found and report:
            self.handle_comment(self.rawdata[i + 4 : found.start()])
        return self.ended("comment", i, found)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata[i : i + 9].upper() == "<![CDATA[":
            if self.hopeless("section", i):
                return self.parse_bogus_comment(i)
            found = re.compile("]]>").search(self.rawdata, i + 9)
            if found:
                self.handle_section(self.rawdata[i + 9 : found.start()])
                return found.end()
            self.ended("section", i, None)
        if self.rawdata.startswith("<![", i):  # sections of other dialects are skipped like comments
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def handle_section(self, data: str) -> None:
        """The text of a CDATA section; a comment in HTML, and so skipped unless a subclass reads it."""
        self.handle_comment(data)


class TextNodes(LinearParser):
    """Collects the strings between tags, comments and declarations, but for those in elements that hold no text."""

    def __init__(self) -> None:
        super().__init__()
        self.strings: list[str] = []
        self.pieces: list[str] = []
        self.open: list[str] = []
        self.counts: dict[str, int] = {}

    def end_string(self) -> None:
        text = "".join(self.pieces).strip()
        if text and not any(self.counts.get(name) for name in UNREAD):
            self.strings.append(text)
        self.pieces = []

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.end_string()
        if tag not in VOID:
            self.open.append(tag)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        self.end_string()
        while self.counts.get(tag):
            name = self.open.pop()
            self.counts[name] -= 1
            if name == tag:
                break

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_comment(self, data: str) -> None:
        self.end_string()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_section(self, data: str) -> None:
        self.end_string()
        self.pieces.append(data)
        self.end_string()


def held_back(page: str) -> tuple[str, str]:
    """The page with another character, which it does not have, for ampersands that begin no reference with its
    semicolon; and that character."""
    other = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in page)
    known = lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else other + m[0][1:]
    return REFERENCE.sub(known, page), other


def visible_text(page: str | None, separator: str = " ", open_references: bool = True) -> str | None:
    """The strings of a page, stripped, empty ones left out, joined by `separator`; null for null.

    References are decoded. Strings of scripts, styles, templates, ruby annotations, comments and declarations are left
    out. A quoted `>` does not end a tag, and `<` that begins no tag is text; so is what stands in a tag or comment that
    never ends, up to the next `>`. Without `open_references` those that lack their semicolon (`&amp`) are text; with
    them they are decoded, as browsers do.
    """
    if page is None or ("<" not in page and "&" not in page):
        return page if page is None else page.strip()
    parser, other = TextNodes(), None
    if not open_references and "&" in page:
        page, other = held_back(page)
    parser.read(page)
    parser.end_string()
    text = separator.join(parser.strings)
    return text if other is None else text.replace(other, "&")
