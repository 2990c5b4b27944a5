"""Crawl tables derived from the given tables, row by row and over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AGENT = "trawler"
DEFAULT_AGENT = "trawler/1.0"
DOC_KINDS = ["html", "flagged", "css", "text"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan of fewer splits than cores, before parsing.

    A table of ordinary size has more splits than there are cores and is read
    as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*", "")


def site_of(url: Column) -> Column:
    """Site of the given pages, whose URLs have plain hosts without a port."""
    return F.regexp_extract(url, "^https?://[^/?#]*", 0)


def messy_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Eight spellings of each page URL: page_id, variant, url."""
    url = F.col("url")
    bare = _bare(url)
    host = F.regexp_extract(url, "^https?://([^/?#]*)", 1)
    scheme = F.regexp_extract(url, "^(https?)://", 1)
    rest = F.substring(bare, F.length(scheme) + F.length(host) + 4, F.length(bare))
    port = F.when(scheme == "https", ":443").otherwise(":80")
    spellings = [
        url,
        F.concat(scheme, F.lit("://"), F.upper(host), rest),
        F.concat(scheme, F.lit("://"), host, port, rest),
        F.concat(bare, F.lit("?b=2&a=1&b=3")),
        F.concat(bare, F.lit("?jsessionid=abc&z=1")),
        F.concat(scheme, F.lit("://"), host, F.lit("/x/../."), rest),
        F.concat(bare, F.lit("?q=a b&r=%7Ex<y>")),
        F.concat(bare, F.lit("?id===")),
    ]
    rows = F.array(
        *[F.struct(F.lit(i).alias("variant"), s.alias("url")) for i, s in enumerate(spellings)]
    )
    return spread(pages(spark, sf).select("page_id", "url")).select("page_id", F.inline(rows))


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Pages under their canonical URI: page_id, uri, site, path, html."""
    from ..operators.canonicalize import canonicalize

    return canonicalize(spread(pages(spark, sf))).select("page_id", "uri", "site", "path", "html")


def sites(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select(site_of(F.col("url")).alias("site")).distinct()


def crawl_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Four documents per page, made to show base, flags, imports and style sheets."""
    pid = F.col("page_id").cast("string")

    def doc(kind: str, content_type: str, *parts: str | Column) -> Column:
        body = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        uri = F.concat(F.col("site"), F.lit(f"/doc/{kind}/"), pid)
        return F.struct(
            F.lit(kind).alias("kind"),
            uri.alias("uri"),
            F.lit(content_type).alias("content_type"),
            body.alias("body"),
        )

    docs = F.array(
        doc(
            "html",
            "text/html; charset=UTF-8",
            '<html><head><base href="/b/"><meta name="robots" content="NoIndex, follow">'
            "<style>@import url('s",
            pid,
            '.css\');</style></head><body><a href="x',
            pid,
            '.html" rel="nofollow">T <b>x</b></a><img src="i.png">'
            '<!-- <a href="c.html">c</a> --><q cite="q.html?b=1&amp;a=2">one  quote</q></body></html>',
        ),
        doc(
            "flagged",
            "text/html",
            '<html><head><meta content="nofollow" name="ROBOTS"></head><body>'
            '<a href="bad',
            pid,
            '.html?id===">bad</a><a href="../up.html">up</a><a href=" ">none</a></body></html>',
        ),
        doc(
            "css",
            "text/css",
            "a{background:url('p",
            pid,
            '.png\')} /* url(no.png) */ b{background:url( "q.png" )} '
            "c{background:url('r.png?i===')}",
        ),
        doc("text", "text/plain", '<a href="x">', pid, "</a>"),
    )
    return (
        spread(pages(spark, sf).select("page_id", site_of(F.col("url")).alias("site")))
        .select("page_id", F.inline(docs))
    )


def configs(spark: SparkSession, sf: str) -> DataFrame:
    """One crawl configuration per site."""
    site = F.col("site")
    n = F.length(site)
    lit = F.lit
    return sites(spark, sf).select(
        site.alias("crawler_id"),
        site.alias("config_id"),
        F.when(n % 4 == 0, lit(None)).when(n % 4 == 1, lit(" ")).otherwise(lit("bot")).cast(
            "string"
        ).alias("user_agent"),
        F.when(n % 5 == 0, F.expr("cast(array() as array<string>)"))
        .otherwise(F.array(site, F.concat(site, lit("/fr/"))))
        .alias("seeds"),
        F.when(n % 2 == 0, lit("FirstMatchUriFilter"))
        .otherwise(lit("PriorityRejectUriFilter"))
        .alias("filter_class"),
        F.array(
            F.concat(lit("accept: "), site),
            lit("# a comment"),
            lit("reject: .*/fr/"),
            lit(""),
        ).alias("rule_lines"),
        F.array(
            F.concat(lit("should accept: "), site, lit("/en/1")),
            F.concat(lit("should reject: "), site, lit("/fr/1")),
            lit("should accept: http://elsewhere.example.org/"),
        ).alias("tests"),
        F.concat(lit("Crawl of "), F.upper(site)).alias("crawler_name"),
        (n * 10).cast("int").alias("crawl_delay_ms"),
        lit(60000).cast("bigint").alias("crawl_timeout_ms"),
        lit(3).alias("max_depth"),
        (n * 2).cast("int").alias("max_fetches"),
        lit(1000).alias("max_queue_size"),
        lit(0.5).alias("max_request_fails"),
    )


def robots_files(spark: SparkSession, sf: str) -> DataFrame:
    """Robots files of the sites; every fifth kind of site has none."""
    site = F.col("site")
    kind = F.length(site) % 5
    body = (
        F.when(kind == 0, F.lit("User-agent: *\nDisallow: /fr/\nDisallow: /%7Eprivate # x\n"))
        .when(
            kind == 1,
            F.concat(
                F.lit(
                    "User-agent: trawler\r\nDisallow: /en/\r\nAllow: /en/1\r\nCrawl-delay: 1.5\r\n"
                    "Sitemap: "
                ),
                site,
                F.lit("/sitemap.xml\r\nHost: www.example.org\r\n\r\nUser-agent: *\r\nDisallow: /de/"),
            ),
        )
        .when(kind == 2, F.lit("User-agent: *\nUser-agent: other\nDisallow: /\n\nAllow: /x\n"))
        .when(kind == 3, F.lit("User-agent: *\nDisallow:\nCrawl-delay: soon\n"))
    )
    return (
        sites(spark, sf)
        .select("site", body.alias("body"))
        .filter(F.col("body").isNotNull())
    )


def _log_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def fetch_log_of(events: DataFrame) -> DataFrame:
    """Events read as a fetch log; see ``operators.fetchlog`` for the columns."""
    kind = F.col("event_type")
    eid = F.col("event_id")
    return events.select(
        F.col("user_id").alias("job_id"),
        (F.col("user_id") % 10).alias("crawler_id"),
        eid.alias("event_id"),
        F.col("ts").cast("timestamp").alias("log_time"),
        _log_ms(F.col("ts")).alias("log_ms"),
        F.concat(
            F.lit("http://s"), (eid % 7).cast("string"), F.lit(".example.org/p/"),
            F.floor(F.col("value")).cast("string"),
        ).alias("uri"),
        F.concat(F.lit("http://s"), (eid % 7).cast("string"), F.lit(".example.org")).alias("site"),
        (eid % 4).cast("int").alias("depth"),
        F.when(kind == "signup", 301).when(kind == "error", 500).otherwise(200).alias("status"),
        F.when(kind == "view", "text/html; charset=UTF-8")
        .when(kind == "click", "text/css")
        .alias("content_type"),
        F.floor(F.col("value") * 100).cast("int").alias("content_length"),
        (eid % 3).cast("int").alias("links_extracted"),
        (F.floor(F.col("value")) % 900).cast("int").alias("fetch_duration"),
        kind.alias("event_kind"),
    )


def fetch_log(spark: SparkSession, sf: str) -> DataFrame:
    return fetch_log_of(table(spark, sf, "events"))


def snapshots_of(log: DataFrame) -> DataFrame:
    """Job snapshots written at each event; purchases finish the job."""
    finished = F.when(F.col("event_kind") == "purchase", F.col("log_ms"))
    return log.select(
        "job_id",
        "crawler_id",
        F.to_date("log_time").alias("partition_date"),
        (F.col("log_ms") - F.col("log_ms") % 86400000).alias("created_ms"),
        F.col("log_ms").alias("snapshot_ms"),
        finished.alias("finished_ms"),
        F.when(finished.isNotNull(), "Completed").otherwise("Continuing").alias("state"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
        "event_id",
    )


def journal_events_of(events: DataFrame) -> DataFrame:
    """Fetch events as the journal reads them: log and job columns, and a body."""
    log = fetch_log_of(events)
    finished = F.when(F.col("event_kind") == "purchase", F.col("log_ms"))
    return log.withColumns(
        {
            "event_type": F.when(F.col("event_kind") == "purchase", "stopped")
            .when(F.col("event_kind") == "signup", "started")
            .otherwise("fetched"),
            "content": F.encode(F.concat(F.lit("body of "), F.col("uri")), "UTF-8"),
            "partition_date": F.to_date("log_time"),
            "created_ms": F.col("log_ms") - F.col("log_ms") % 86400000,
            "snapshot_ms": F.col("log_ms"),
            "finished_ms": finished,
            "state": F.when(finished.isNotNull(), "Completed").otherwise("Continuing"),
            "message": F.concat(F.lit("event "), F.col("event_id").cast("string")),
        }
    )


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of part files.

    The path is given as a pattern that only the table matches: a stream takes a
    plain path for a folder and would refuse a single file.
    """
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return table_stream(spark, sf, "events")


def site_map(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of a site map: region, nation, customer and supplier, order, part."""

    def uri(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"/{kind}/"), F.col(key).cast("string"))

    def edges(name: str, a: Column, b: Column) -> DataFrame:
        return table(spark, sf, name).select(a.alias("page_uri"), b.alias("uri"))

    nation = edges("nation", uri("region", "n_regionkey"), uri("nation", "n_nationkey"))
    customer = edges("customer", uri("nation", "c_nationkey"), uri("customer", "c_custkey"))
    supplier = edges("supplier", uri("nation", "s_nationkey"), uri("supplier", "s_suppkey"))
    orders = edges("orders", uri("customer", "o_custkey"), uri("order", "o_orderkey"))
    parts = edges("lineitem", uri("order", "l_orderkey"), uri("part", "l_partkey"))
    return (
        nation.unionByName(customer).unionByName(supplier).unionByName(orders).unionByName(parts)
    )


def site_map_status(spark: SparkSession, sf: str) -> DataFrame:
    """Stored responses of the site map. Customers in debt and pending orders are
    missing, so they count as 404; suppliers in debt redirect."""

    def rows(df: DataFrame, kind: str, key: str, status: Column) -> DataFrame:
        return df.select(
            F.concat(F.lit(f"/{kind}/"), F.col(key).cast("string")).alias("uri"),
            status.cast("int").alias("status"),
        )

    ok = F.lit(200)
    customer = table(spark, sf, "customer").filter(F.col("c_acctbal") >= 0)
    orders = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P")
    moved = F.when(F.col("s_acctbal") < 0, 302).otherwise(200)
    return (
        rows(table(spark, sf, "region"), "region", "r_regionkey", ok)
        .unionByName(rows(table(spark, sf, "nation"), "nation", "n_nationkey", ok))
        .unionByName(rows(customer, "customer", "c_custkey", ok))
        .unionByName(rows(table(spark, sf, "supplier"), "supplier", "s_suppkey", moved))
        .unionByName(rows(orders, "order", "o_orderkey", ok))
        .unionByName(rows(table(spark, sf, "part"), "part", "p_partkey", ok))
    )


def site_map_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """One job per region, seeded with the region and one nation of the next region."""
    region = table(spark, sf, "region").select(
        F.col("r_regionkey").cast("bigint").alias("job_id"),
        F.concat(F.lit("/region/"), F.col("r_regionkey").cast("string")).alias("uri"),
    )
    nation = table(spark, sf, "nation").groupBy("n_regionkey").agg(
        F.min("n_nationkey").alias("n")
    ).select(
        ((F.col("n_regionkey") + 4) % 5).cast("bigint").alias("job_id"),
        F.concat(F.lit("/nation/"), F.col("n").cast("string")).alias("uri"),
    )
    return region.unionByName(nation)


def chains(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each page links to the next page of its site: (seeds, edges), a job per site.

    The next page is found with a running maximum over descending ids, which is
    safe when one site holds most pages.
    """
    from ..operators.skew import Running, running

    rows = pages(spark, sf).select(
        site_of(F.col("url")).alias("job_id"), "page_id", (-F.col("page_id")).alias("_desc")
    )
    after = running(
        rows, ["job_id"], ["_desc"], {"_next": Running(F.col("_desc"), "max", before=True)}
    )

    def uri(site: str, key: Column) -> Column:
        return F.concat(F.col(site), F.lit("/page/"), key.cast("string"))

    edges = after.filter(F.col("_next").isNotNull()).select(
        uri("job_id", F.col("page_id")).alias("page_uri"),
        uri("job_id", -F.col("_next")).alias("uri"),
    )
    seeds = rows.groupBy("job_id").agg(F.min("page_id").alias("p")).select(
        "job_id", uri("job_id", F.col("p")).alias("uri")
    )
    return seeds, edges
