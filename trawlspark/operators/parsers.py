"""Parsers by media type. Own ones are added to DEFAULT and given to ``links.parse_pages``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import http
from ..functions.css import css_page
from ..functions.html import PAGE_TYPE, distinct_sorted
from ..functions.markup import html_page


@dataclass(frozen=True)
class Parser:
    """media_type: what a content type begins with. parse: from the body (null for rows of other types)
    to struct<no_index, no_follow, base, links>; see functions.html.PAGE_TYPE."""

    media_type: str
    parse: Callable[[Column], Column]


HTML = Parser(http.HTML, html_page)
CSS = Parser(http.CSS, css_page)
DEFAULT = (HTML, CSS)


def page_of(links: Column, no_index: Column | None = None, no_follow: Column | None = None, base: Column | None = None) -> Column:
    """The result of a parser, from links as structs of at least uri_attribute.

    A link without ``element`` or ``link_text`` has an empty one; the flags are off and the base is the
    page itself unless given.
    """
    return F.struct(
        (F.lit(False) if no_index is None else no_index).alias("no_index"),
        (F.lit(False) if no_follow is None else no_follow).alias("no_follow"),
        (F.lit(None).cast("string") if base is None else base).alias("base"),
        distinct_sorted(links).alias("links"),
    ).cast(PAGE_TYPE)


def listed_addresses(body: Column) -> Column:
    """Parser of plain lists: an address on each line, blank lines and lines from # on left out."""
    lines = F.transform(F.split(body, r"\r\n|\n|\r"), lambda line: F.trim(F.regexp_replace(line, r"[\t\f]", " ")))
    return page_of(
        F.transform(
            F.filter(lines, lambda line: (line != "") & ~line.startswith("#")),
            lambda line: F.struct(
                F.lit("line").alias("element"),
                line.alias("uri_attribute"),
                F.lit("").alias("link_text"),
                F.lit(False).alias("no_follow"),
                F.lit(None).cast("string").alias("source"),
            ),
        )
    )


#: Lists of addresses as plain text, such as simple site maps.
LISTED = Parser("text/plain", listed_addresses)


def chosen(parsers: Sequence[Parser], content_type: Column | None) -> Column:
    """Index of the first parser for a content type; null if there is none, or no content type."""
    if content_type is None:
        return F.lit(0)
    out = F.lit(None).cast("int")
    for i, parser in reversed(list(enumerate(parsers))):
        out = F.when(http.media_is(content_type, parser.media_type), F.lit(i)).otherwise(out)
    return out
