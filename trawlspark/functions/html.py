"""Links as found in a page, before and after resolution, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lang import let, squeeze
from .uri import canonical

# Attributes that hold a URL.
URL_ATTRIBUTES = ["href", "src", "cite", "data"]

# Fixed value: element name given to links found in style sheets.
CSS_ELEMENT = "css_url"

# The bracketed address of a URL function in a style sheet, quoted or without brackets and quotes.
# All repeats are possessive and end where the next function begins, so any text is passed once.
BRACKETS = r"""\s*+\(\s*+("[^"]*+"|'[^']*+'|[^()"']*+)\s*+\)"""

# links before resolution; ``source`` is the text reported when the URL is illegal
RAW_LINK_TYPE = (
    "array<struct<element:string,uri_attribute:string,link_text:string,no_follow:boolean,"
    "source:string>>"
)

# what a parser returns of a page
PAGE_TYPE = f"struct<no_index:boolean,no_follow:boolean,base:string,links:{RAW_LINK_TYPE}>"


def address(inside: Column) -> Column:
    """What stands in the brackets, without quotes and white space around it."""
    return squeeze(F.regexp_replace(squeeze(inside), r"^[\"']|[\"']$", ""))


def distinct_sorted(items: Column) -> Column:
    """Distinct elements of an array of structs in n log n (``array_distinct`` is quadratic)."""
    return let(
        F.array_sort(items),
        lambda s: F.filter(s, lambda x, i: (i == 0) | ~F.get(s, i - 1).eqNullSafe(x)),
    )


def resolved_link(raw: Column, base: Column) -> Column:
    return let(
        canonical(raw["uri_attribute"], base),
        lambda c: F.struct(
            raw["element"].alias("element"),
            raw["uri_attribute"].alias("uri_attribute"),
            raw["link_text"].alias("link_text"),
            raw["no_follow"].alias("no_follow"),
            c["uri"].alias("uri"),
            c["scheme"].alias("scheme"),
            c["path"].alias("path"),
            c["site"].alias("site"),
            F.when(
                c["fail_message"].isNotNull(), F.coalesce(raw["source"], c["fail_message"])
            ).alias("fail_message"),
        ),
    )
