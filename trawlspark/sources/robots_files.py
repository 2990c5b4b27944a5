"""Robots files as a source: one file for each site, in folders that tell the site.

Layout: ``scheme=<scheme>/host=<host>/<any file>``, as a partitioned text table has it; characters that a
folder name cannot hold are percent-encoded. Sites without a folder have no rules, so everything is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.http import body_text


def read_robots_files(spark: SparkSession, path: str) -> DataFrame:
    """(site, body) of the files below a folder. A site's several files count as one, in order of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # from the path itself: as partition columns, hosts that look like numbers would become numbers
    scheme = F.regexp_extract("path", "/scheme=([^/]+)/host=[^/]+/", 1)
    host = F.url_decode(F.regexp_replace(F.url_decode(F.regexp_extract("path", "/scheme=[^/]+/host=([^/]+)/", 1)), r"\+", "%2B"))
    named = files.select(F.concat(scheme, F.lit("://"), host).alias("site"), "path", body_text(F.col("content")).alias("body"))
    parts = F.sort_array(F.collect_list(F.struct("path", "body")))
    return named.filter(scheme != "").groupBy("site").agg(F.array_join(parts["body"], "\n").alias("body"))


def write_robots_files(robots: DataFrame, path: str, mode: str = "append") -> None:
    """Write (site, body), a row a site, in the layout that ``read_robots_files`` reads."""
    scheme, host = F.split_part("site", F.lit("://"), F.lit(1)), F.split_part("site", F.lit("://"), F.lit(2))
    robots.select(F.col("body").alias("value"), scheme.alias("scheme"), host.alias("host")).write.mode(mode).partitionBy("scheme", "host").text(path)
