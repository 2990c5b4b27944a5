"""Links in style sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import BRACKETS, CSS_ELEMENT, address, distinct_sorted
from .lang import joined, let

CSS_URL = rf"(?i)url{BRACKETS}"


def without_comments(css: Column) -> Column:
    """What is left of each part between comment starts; an unclosed comment reaches to the end."""
    return joined(
        F.transform(
            F.split(css, r"/\*"),
            lambda part, i: F.when(i == 0, part)
            .when(F.locate("*/", part) > 0, F.substring(part, F.locate("*/", part) + 2, F.length(part)))
            .otherwise(""),
        )
    )


def css_links(css: Column) -> Column:
    """Raw links of a style sheet, commented-out ones skipped.

    An illegal URL is reported with its whole ``url(...)`` text.
    """
    return let(
        without_comments(css),
        lambda text: F.zip_with(
            F.regexp_extract_all(text, F.lit(CSS_URL), F.lit(0)),
            F.regexp_extract_all(text, F.lit(CSS_URL), F.lit(1)),
            lambda whole, url: F.struct(
                F.lit(CSS_ELEMENT).alias("element"),
                address(url).alias("uri_attribute"),
                F.lit("").alias("link_text"),
                F.lit(False).alias("no_follow"),
                whole.alias("source"),
            ),
        ),
    )


def css_page(css: Column) -> Column:
    """struct<no_index, no_follow, base, links> of a style sheet: no flags, no base."""
    return F.struct(
        F.lit(False).alias("no_index"),
        F.lit(False).alias("no_follow"),
        F.lit(None).cast("string").alias("base"),
        distinct_sorted(css_links(css)).alias("links"),
    )
