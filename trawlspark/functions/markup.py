"""Links, flags and base of an HTML page in one pass over its tags.

Which text belongs to an element depends on the tags that are open at its end, which no regular
expression or array function can follow; so pages are read by an Arrow function, batch by batch. A pass
keeps a stack of open elements and, by name, where they stand in it, and each tag costs constant time:
hostile pages take time in proportion to their length and to the link texts found. Whole pages are read.

* A closing tag ends its element and all that is open inside it; one without an open element is ignored.
  Cells, captions, tables and embedded objects cannot be closed from inside by tags that are not theirs.
* Elements whose closing tag may be left out end as HTML 5 says (list items, table parts, paragraphs);
  an anchor ends an open anchor; what is still open ends with the page.
* Text is that between the tags, with character references decoded and white space as single spaces;
  the borders of block elements count as white space. Scripts and styles have none.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import BRACKETS, CSS_ELEMENT, PAGE_TYPE, URL_ATTRIBUTES

# Groups of elements in HTML 5.
VOID = frozenset(
    "area base basefont bgsound br col embed frame hr image img input keygen link meta param source track wbr".split()
)
DATA = frozenset(["script", "style"])
DECODED = frozenset(["title", "textarea"])
RAW = DATA | DECODED | frozenset("xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
CELLS = frozenset(["td", "th", "caption"])
BARRIERS = CELLS | frozenset("table object template marquee applet".split())
TABLE_PARTS = CELLS | frozenset("table thead tbody tfoot tr".split())
ENDS_PARAGRAPH = BLOCK - CELLS - frozenset("br caption tr thead tbody tfoot".split())
#: Elements that an opening tag ends if they are open, unless one of the second group was opened since.
ENDED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "optgroup": (("optgroup", "option"), ("select",)),
    "a": (("a",), ()),
    "tr": (("tr", "td", "th", "caption"), ()),
    "td": (("td", "th", "caption"), ()),
    "th": (("td", "th", "caption"), ()),
    "tbody": (("tr", "td", "th", "caption", "thead", "tbody", "tfoot"), ()),
    "thead": (("tr", "td", "th", "caption", "thead", "tbody", "tfoot"), ()),
    "tfoot": (("tr", "td", "th", "caption", "thead", "tbody", "tfoot"), ()),
}

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))", re.ASCII)
_REST = re.compile(r"""((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>=]++|=)*+)>""", re.ASCII)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+)""", re.ASCII)
_OF_INTEREST = re.compile("|".join(URL_ATTRIBUTES), re.IGNORECASE)
_REFERENCE = re.compile(r"&(#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;?)(=?)")
_SPACES = re.compile(r"[ \t\n\f\r]+")
_IMPORT = re.compile(rf"@import\s++url{BRACKETS}", re.IGNORECASE | re.ASCII)
_WORD = {w: re.compile(rf"\b{w}\b", re.IGNORECASE | re.ASCII) for w in ("noindex", "nofollow")}
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE | re.ASCII) for name in RAW}
_LOW = "".join(map(chr, range(33)))


def _decoded(m: re.Match) -> str:
    ref, follows = m.groups()
    if ref[0] == "#":
        digits = ref[1:].rstrip(";")
        digits, base = (digits[1:], 16) if digits[0] in "xX" else (digits, 10)
        number = int(digits.lstrip("0") or "0", base) if len(digits.lstrip("0")) <= 8 else 0
        valid = 0 < number <= 0x10FFFF and not 0xD800 <= number <= 0xDFFF
        return (chr(number) if valid else "�") + follows
    if not ref.endswith(";") and follows:
        return m.group()
    found = html5.get(ref)
    return m.group() if found is None else found + follows


def unescape(text: str) -> str:
    """Decode character references by the rules of HTML 5.

    Numbers have any length; names are those of HTML 5, and the old ones among them need no semicolon
    unless a letter, digit or equals sign follows.
    """
    return _REFERENCE.sub(_decoded, text) if "&" in text else text


def attributes(inside: str) -> dict[str, str]:
    """Values of a tag's attributes that have one; of equal names the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(inside):
        value = m.group(2)
        found.setdefault(m.group(1).lower(), unescape(value[1:-1] if value[:1] in ("'", '"') and len(value) > 1 else value))
    return found


class _Page:
    """State of the pass over one page."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.length = 0
        self.spaced = True  # no text yet, or it ends in white space
        self.stack: list[tuple[str, list | None]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.barriers: list[int] = [0]
        self.tables: list[int] = [0]
        self.links: list[list] = []  # [element, urls, nofollow, start, end]
        self.styles: list[str] = []

    def add(self, piece: str) -> None:
        piece = _SPACES.sub(" ", piece)
        if self.spaced and piece[:1] == " ":
            piece = piece[1:]
        if piece:
            self.text.append(piece)
            self.length += len(piece)
            self.spaced = piece[-1] == " "

    def space(self) -> None:
        if not self.spaced:
            self.add(" ")

    def close_to(self, size: int) -> None:
        while len(self.stack) > size:
            name, link = self.stack.pop()
            self.places[name].pop()
            if link is not None:
                link[4] = self.length
            if name in BARRIERS:
                self.barriers.pop()
                if name not in CELLS:
                    self.tables.pop()
            if name in BLOCK:
                self.space()

    def scope(self, name: str) -> int:
        return self.tables[-1] if name in TABLE_PARTS else self.barriers[-1]

    def close(self, name: str) -> None:
        at = self.places[name]
        if at and at[-1] >= self.scope(name):
            self.close_to(at[-1])

    def open(self, name: str, link: list | None) -> None:
        if name in ENDED_BY:
            ended, limits = ENDED_BY[name]
            since = max([self.scope(name), *(self.places[x][-1] for x in limits if self.places[x])])
            found = [self.places[x][-1] for x in ended if self.places[x] and self.places[x][-1] >= since]
            # of table parts the outermost since the table, else the innermost
            if found:
                self.close_to(min(found) if name in TABLE_PARTS else max(found))
        if name in ENDS_PARAGRAPH:
            self.close("p")
        if name in BLOCK:
            self.space()
        if link is not None:
            link[3] = link[4] = self.length
        if name in VOID:
            return
        if name in BARRIERS:
            self.barriers.append(len(self.stack))
            if name not in CELLS:
                self.tables.append(len(self.stack))
        self.places[name].append(len(self.stack))
        self.stack.append((name, link))


def read(html: str) -> tuple[bool, bool, str | None, list[tuple]]:
    """(no_index, no_follow, base address, distinct links) of a page.

    A link is (element, address, text, nofollow, None), one for each URL attribute with a value and each
    style sheet import. Robots elements count before the body only, the base is the first with an address.
    """
    page, pos, in_head, base = _Page(), 0, True, None
    no_index = no_follow = False
    while (m := _OPEN.search(html, pos)) is not None:
        if m.start() > pos:
            page.add(unescape(html[pos : m.start()]))
        comment, bogus, closing, name = m.groups()
        if comment or bogus:
            end = html.find("-->" if comment else ">", m.end())
            pos = len(html) if end < 0 else end + (3 if comment else 1)
            continue
        rest = _REST.match(html, m.end())
        if rest is None:  # the page ends inside a tag
            pos = len(html)
            break
        pos, name, inside = rest.end(), name.lower(), rest.group(1)
        if closing:
            page.close(name)
            continue
        link = None
        if "=" in inside:
            if name == "base":
                base = attributes(inside).get("href") if base is None else base
            elif name == "meta" and in_head:
                values = attributes(inside)
                if values.get("name", "").strip(" ").lower() == "robots":
                    content = values.get("content", "")
                    no_index |= bool(_WORD["noindex"].search(content))
                    no_follow |= bool(_WORD["nofollow"].search(content))
            if name != "base" and _OF_INTEREST.search(inside):
                values = attributes(inside)
                urls = [u for u in (values.get(a, "").strip(_LOW) for a in URL_ATTRIBUTES) if u]
                if urls:
                    link = [name, urls, values.get("rel", "").lower() == "nofollow", 0, 0]
                    page.links.append(link)
        in_head &= name != "body"
        page.open(name, link)
        if name in RAW:
            end = _END_OF[name].search(html, pos)
            content = html[pos : end.start() if end else len(html)]
            if name == "style":
                page.styles.append(content)
            elif name not in DATA:
                page.add(unescape(content) if name in DECODED else content)
            pos = end.start() if end else len(html)
    if pos < len(html):
        page.add(unescape(html[pos:]))
    page.close_to(0)
    text = "".join(page.text)
    found: dict[tuple, None] = {}
    for name, urls, own, start, end in page.links:
        inner = text[start:end].strip(" ")
        for url in urls:
            found[name, url, inner, no_follow or own, None] = None
    for style in page.styles:
        for m in _IMPORT.finditer(style):
            inside = m.group(1).strip(_LOW)
            url = re.sub(r"^[\"']|[\"']$", "", inside).strip(_LOW)
            if url:
                found[CSS_ELEMENT, url, "", False, None] = None
    return no_index, no_follow, None if base is None else base.strip(_LOW), list(found)


_LINK = pa.struct(
    [("element", pa.string()), ("uri_attribute", pa.string()), ("link_text", pa.string()), ("no_follow", pa.bool_()), ("source", pa.string())]
)


def _read_all(bodies: pa.Array) -> pa.Array:
    """Pages of a batch; a null page has no flags, base or links."""
    flags: tuple[list, list] = ([], [])
    bases, links, ends = [], [], [0]
    for body in bodies:
        html = body.as_py()
        no_index, no_follow, base, found = read(html) if html is not None else (False, False, None, [])
        flags[0].append(no_index)
        flags[1].append(no_follow)
        bases.append(base)
        links += found
        ends.append(len(links))
    columns = zip(*links, strict=True) if links else [()] * 5
    items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINK, strict=True)], fields=list(_LINK))
    return pa.StructArray.from_arrays(
        [pa.array(flags[0], pa.bool_()), pa.array(flags[1], pa.bool_()), pa.array(bases, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)],
        names=["no_index", "no_follow", "base", "links"],
    )


def html_page(body: Column) -> Column:
    """struct<no_index, no_follow, base, links> of an HTML page."""

    def run(bodies: pa.Array) -> pa.Array:
        return _read_all(bodies)

    return F.arrow_udf(run, PAGE_TYPE)(body)
