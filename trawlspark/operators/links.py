"""Link extraction and the link graph.

Extraction is narrow: no row leaves its task until links are counted by target.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import PAGE_TYPE, distinct_sorted, resolved_link
from ..functions.lang import let
from ..functions.uri import canonical
from ..session import ship
from .parsers import DEFAULT, Parser, chosen

PAGE_COLUMNS = ["no_index", "no_follow", "page_error", "links"]


@lru_cache(maxsize=16)
def _steps(application: str, uri: str, body: str, content_type: str | None, parsers: tuple[Parser, ...]) -> list[dict[str, Column]]:
    """Column steps of ``parse_pages``, built once per application and set of column names.

    The intermediate structs and arrays are columns of their own: Spark evaluates
    a column used by several later ones once.
    """
    text, which = F.col(body), F.col("_parser")
    read = F.lit(None).cast(PAGE_TYPE)
    for i, parser in reversed(list(enumerate(parsers))):
        # a parser in Python gets null for the rows of other types
        read = F.when(which == i, parser.parse(F.when(which == i, text)).cast(PAGE_TYPE)).otherwise(read)
    href = F.col("_read.base")
    own = F.struct(F.col(uri).alias("uri"), F.lit(None).cast("string").alias("fail_message"))
    based = let(
        canonical(href, F.col(uri)),
        lambda c: F.struct(c["uri"].alias("uri"), c["fail_message"].alias("fail_message")),
    )
    page = F.struct(
        F.coalesce(F.col("_read.no_index"), F.lit(False)).alias("no_index"),
        F.coalesce(F.col("_read.no_follow"), F.lit(False)).alias("no_follow"),
        F.col("_base.fail_message").alias("page_error"),
        F.when(
            F.col("_base.uri").isNotNull(),
            F.transform(
                F.coalesce(F.col("_read.links"), F.array()), lambda r: resolved_link(r, F.col("_base.uri"))
            ),
        ).alias("links"),
    )
    return [
        {"_parser": chosen(parsers, None if content_type is None else F.col(content_type))},
        {"_read": read},
        {"_base": F.when(href.isNull() | (href == ""), own).otherwise(based)},
        # generated columns are computed once, whatever is asked of them further up
        {"": F.inline(F.array(page))},
    ]


def parse_pages(
    pages: DataFrame,
    uri: str = "uri",
    body: str = "html",
    content_type: str | None = None,
    parsers: Sequence[Parser] = DEFAULT,
) -> DataFrame:
    """Replace the body by what was found in it: page flags and distinct links.

    ``uri`` must be canonical. With ``content_type`` each row is read by the first
    of ``parsers`` for its media type, and rows of other types give no links;
    without it all rows are read by the first parser. A page whose base element
    is illegal has ``page_error`` and no links.
    """
    keep = [c for c in pages.columns if c != body]
    application = ship(pages.sparkSession).sparkContext.applicationId
    *steps, last = _steps(application, uri, body, content_type, tuple(parsers))
    staged = pages
    for step in steps:
        staged = staged.withColumns(step)
    return staged.select(*keep, last[""])


def links(parsed: DataFrame, uri: str = "uri") -> DataFrame:
    """One row per distinct link of each parsed page."""
    return parsed.select(F.col(uri).alias("page_uri"), F.inline("links"))


def broken_links(parsed: DataFrame, uri: str = "uri") -> DataFrame:
    """Links whose URL could not be formed, one row per page and message."""
    bad = F.filter("links", lambda x: x["fail_message"].isNotNull())
    messages = F.array_distinct(F.transform(bad, lambda x: x["fail_message"]))
    return parsed.select(F.col(uri).alias("page_uri"), F.explode(messages).alias("fail_message"))


def targets(parsed: DataFrame, *keep: str, follow_all: bool = True) -> DataFrame:
    """Distinct target URIs of each page: the edges of the link graph.

    Distinctness is per page and so needs no shuffle. With ``follow_all`` off,
    links marked nofollow are left out.
    """
    good = F.filter(
        "links",
        lambda x: x["uri"].isNotNull() & (F.lit(follow_all) | ~x["no_follow"]),
    )
    target = distinct_sorted(
        F.transform(
            good,
            lambda x: F.struct(
                x["uri"].alias("uri"),
                x["scheme"].alias("scheme"),
                x["path"].alias("path"),
                x["site"].alias("site"),
            ),
        )
    )
    return parsed.select(*keep, F.inline(target))


def link_counts(parsed: DataFrame, *keep: str) -> DataFrame:
    """Number of links per page, 0 where nothing was parsed."""
    return parsed.select(*keep, F.coalesce(F.size("links"), F.lit(0)).alias("links_extracted"))


def degrees(edges: DataFrame, source: str, target: str, node: str = "node") -> DataFrame:
    """Out- and in-degree of every node of an edge table.

    Each edge becomes two counted rows, added up before the shuffle, so one
    aggregation serves both degrees and hubs cost no more than other nodes.
    """
    ends = F.array(
        F.struct(F.col(source).alias(node), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col(target).alias(node), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return (
        edges.select(F.inline(ends))
        .groupBy(node)
        .agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    )
