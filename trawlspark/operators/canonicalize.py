"""URL canonicalization as a job over a table of URLs."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.uri import canonical


@lru_cache(maxsize=64)
def _parts(application: str, url: str, base: str | None) -> Column:
    """The expression is large, so it is built once per application and pair of column names."""
    return F.inline(F.array(canonical(F.col(url), None if base is None else F.col(base))))


def canonicalize(df: DataFrame, url: str = "url", base: str | None = None) -> DataFrame:
    """Add ``uri, scheme, authority, path, site, fail_message`` to each row.

    ``inline`` makes the columns outputs of a generator, so that filters and
    join keys on ``uri`` further up do not evaluate the whole expression again.
    """
    return df.select("*", _parts(df.sparkSession.sparkContext.applicationId, url, base))


def duplicate_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Canonical URLs with the number of rows and of spellings that fold into them.

    Spellings are counted in two aggregations, so no group is ever collected.
    """
    spellings = canonicalize(df.select(url), url).groupBy("uri", url).agg(F.count("*").alias("n"))
    return (
        spellings.filter(F.col("uri").isNotNull())
        .groupBy("uri")
        .agg(
            F.sum("n").alias("urls"),
            F.count("*").alias("spellings"),
            F.min(url).alias("first_spelling"),
        )
        .filter(F.col("urls") > 1)
    )
