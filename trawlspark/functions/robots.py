"""Robots exclusion files: parsing for one user agent and the allow test.

Behaviour to know: an empty ``Disallow:`` blocks the site (every path starts
with the empty text) unless ``ignore_empty``; lines are lower-cased before the
agent compare, the agent is not; the last of stacked ``User-agent`` lines
decides; a blank line ends a record; a directive is found anywhere in a line;
any matching allow beats every disallow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lang import let, squeeze

# Directives that are read.
DIRECTIVES = ["Allow", "Crawl-delay", "Disallow", "Host", "Sitemap", "User-agent"]

_LINE = r"(?i)(" + "|".join(DIRECTIVES) + r")\s*:\s*([^\s]*)"
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?[fd]?$"


def clean_line(line: Column) -> Column:
    return F.replace(F.lower(squeeze(line)), F.lit("%7e"), F.lit("~"))


def parse_line(line: Column) -> Column:
    """struct<directive, value>, null when the line has no directive."""
    return F.when(
        line.rlike(_LINE),
        F.struct(
            F.regexp_extract(line, _LINE, 1).alias("directive"),
            F.regexp_extract(line, _LINE, 2).alias("value"),
        ),
    )


def delay_millis(seconds: Column) -> Column:
    number = F.regexp_replace(seconds, "[fd]$", "").try_cast("double") * 1000.0
    return F.when(
        seconds.rlike(_NUMBER),
        F.greatest(F.least(number, F.lit(2147483647.0)), F.lit(-2147483648.0)).cast("int"),
    )


def parse_robots(body: Column, agent: Column) -> Column:
    """struct<allows, disallows, sitemaps, hosts, crawl_delay_ms> for ``agent``.

    The text is cut into blocks at each blank or ``User-agent`` line, blocks of
    other agents are dropped and the rest is read in order: linear in the file.
    """
    mark, off = "\u0001", "\u0002"

    def tagged(line: Column) -> Column:
        return F.when(line == "", F.lit(mark + off)).otherwise(
            let(
                parse_line(line),
                lambda d: F.when(d.isNull(), F.lit("\n"))
                .when(
                    d["directive"] == "user-agent", F.concat(F.lit(mark), d["value"], F.lit("\n"))
                )
                .otherwise(F.concat(d["directive"], F.lit(":"), d["value"], F.lit("\n"))),
            )
        )

    # the marks below may not come from the file itself
    lines = F.transform(F.split(F.translate(body, mark + off, ""), "\r?\n"), clean_line)
    blocks = F.split(F.array_join(F.transform(lines, tagged), ""), mark)

    def active(block: Column) -> Column:
        who = F.element_at(F.split(block, "\n"), 1)
        return (who == "*") | (who == agent)

    # element 0 of the blocks precedes the first record
    entries = F.flatten(
        F.transform(
            F.filter(blocks, lambda b, i: (i > 0) & active(b)),
            lambda b: F.filter(F.split(b, "\n"), lambda x, i: i > 0),
        )
    )

    def build(es: Column) -> Column:
        def values(name: str) -> Column:
            return F.transform(
                F.filter(es, lambda e: e.startswith(name + ":")),
                lambda e: F.substring(e, len(name) + 2, 2147483647),
            )

        delays = F.filter(values("crawl-delay"), lambda d: d != "")
        return F.struct(
            values("allow").alias("allows"),
            values("disallow").alias("disallows"),
            values("sitemap").alias("sitemaps"),
            values("host").alias("hosts"),
            delay_millis(F.get(delays, F.lit(0))).alias("crawl_delay_ms"),
        )

    return let(entries, build)


def allowed(
    path: Column, allows: Column, disallows: Column, ignore_empty: bool = False
) -> Column:
    """May ``path`` be fetched? Missing rules allow everything."""

    def hit(rule: Column, p: Column) -> Column:
        match = p.startswith(rule)
        return match & (rule != "") if ignore_empty else match

    return let(
        F.when(squeeze(path) == "", F.lit("/")).otherwise(clean_line(path)),
        lambda p: F.coalesce(
            F.exists(allows, lambda a: hit(a, p))
            | ~F.exists(disallows, lambda d: (d == "/") | hit(d, p)),
            F.lit(True),
        ),
    )
