"""The crawl frontier: fetch decisions and breadth-first expansion.

A crawl takes URIs from a first-in-first-out queue, so it runs level by level:
the place of a URI in the queue is (depth, place of the page that first linked
to it, uri). Each level is one distributed step; running totals over the places
then tell where the crawl stops.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stop
from ..functions.http import is_fail, is_success
from ..functions.robots import allowed
from ..functions.rules import FIRST_MATCH, Rule, accepts
from .robots import with_rules
from .seen import SeenSet
from .skew import Running, lay_out, running

SEEN = "SeenAlready"
UNSUPPORTED = "UnsupportedScheme"
REJECTED = "UriFilterRejected"
EXCLUDED = "RobotsExcluded"
OKAY = "OkayToFetch"

SCHEMES = ["http", "https"]

# a level of at most this many counted bytes is broadcast to the edges; larger ones
# are shuffled to their buckets
BROADCAST_BYTES = 16 << 20

# places of a job's queue that one task sums up
PLACES = 250_000


def decide(
    candidates: DataFrame,
    rules: list[Rule] | Callable[[Column], Column],
    robots: DataFrame | None = None,
    kind: str = FIRST_MATCH,
    seen: DataFrame | None = None,
    seen_keys: tuple[str, ...] = ("job_id", "uri"),
) -> DataFrame:
    """Add ``decision`` to candidates (uri, scheme, path, site, user_agent).

    ``rules`` are accept/reject rules or any function from the URI column to a
    boolean one. ``seen`` has one row per key; ``robots`` one per (user_agent,
    site). Both joins are plain, so AQE can split a URI or site that many
    candidates share.

    Cheap tests come first: a candidate that is seen, of another scheme or
    rejected by the filter gets a join key that no site has, spread by its URI, and
    never meets the robots rules. Repeated keys of ``seen`` count once.
    """
    uri = F.col("uri")
    accepted = rules(uri) if callable(rules) else accepts(uri, rules, kind)
    early = F.when(~F.col("scheme").isin(*SCHEMES), UNSUPPORTED).when(~accepted, REJECTED)
    out = candidates
    if seen is not None:
        marks = seen.select(*seen_keys).distinct().withColumn("_seen", F.lit(True))
        out = out.join(marks, list(seen_keys), "left")
        early = F.when(F.col("_seen"), SEEN).otherwise(early)
    out = out.select("*", F.inline(F.array(F.struct(early.alias("_early"))))).drop("_seen")
    if robots is None:
        return out.withColumn("decision", F.coalesce("_early", F.lit(OKAY))).drop("_early")
    asked = out.withColumn("_site", F.col("site")).withColumn(
        "site",
        F.when(F.col("_early").isNull(), F.col("site")).otherwise(
            F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("uri"), F.lit(4096)).cast("string"))
        ),
    )
    return (
        with_rules(asked, robots, "allows", "disallows")
        .withColumn(
            "decision",
            F.when(F.col("_early").isNotNull(), F.col("_early"))
            .when(~allowed(F.col("path"), F.col("allows"), F.col("disallows")), EXCLUDED)
            .otherwise(OKAY),
        )
        .withColumn("site", F.col("_site"))
        .drop("_site", "_early", "allows", "disallows")
    )


def seeds_of(configs: DataFrame, job: str = "job_id", seeds: str = "seeds") -> DataFrame:
    """Distinct seed URIs at depth 0."""
    from .canonicalize import canonicalize

    rows = configs.select(job, F.explode(seeds).alias("url"))
    return (
        canonicalize(rows)
        .filter(F.col("uri").isNotNull())
        .dropDuplicates([job, "uri"])
        .withColumn("depth", F.lit(0))
    )


def unseen(candidates: DataFrame, seen: DataFrame, keys=("job_id", "uri")) -> DataFrame:
    """Exact test on the whole URI, where a hash code could drop colliding ones."""
    return candidates.join(seen.select(*keys), list(keys), "left_anti")


def look_up(level: DataFrame, responses: DataFrame) -> DataFrame:
    """Status of each URI from stored responses; missing ones count as 404."""
    return missing_as_404(level.join(one_response(responses), "uri", "left"))


def one_response(responses: DataFrame) -> DataFrame:
    """One status a URI; of several stored ones the smallest counts."""
    return responses.groupBy("uri").agg(F.min("status").alias("status"))


def missing_as_404(looked_up: DataFrame) -> DataFrame:
    return looked_up.withColumn("status", F.coalesce("status", F.lit(404)))


def crawl(
    seeds: DataFrame,
    edges: DataFrame,
    responses: DataFrame | None,
    max_depth: int,
    max_fetches: int | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """All URIs a crawl would fetch, in fetch order.

    ``seeds``: job_id, uri. ``edges``: page_uri, uri. ``responses``: uri, status;
    without it every URI is fetched well. ``keep`` filters newly found
    (job_id, uri) rows, e.g. by ``decide``. Result: job_id, uri, depth,
    parent_pos, pos (from 1 per job) and status.

    Edges and responses are bucketed by page once. Each level joins them with the fetched
    pages, keeps the first finder of each URI with a partial aggregation, drops
    seen URIs, which stay in their buckets, and is checkpointed, so neither plans nor lost executors reach back
    beyond it. Jobs whose fetch budget is spent are not expanded any further.
    """
    # edges and responses move once; level after level then moves only itself
    graph = lay_out(
        edges.select("page_uri", F.col("uri").alias("_to")), "page_uri", "_to", hot_rows
    )
    stored = None if responses is None else lay_out(one_response(responses), "uri")

    def placed(fresh: DataFrame, previous: DataFrame | None, largest: int) -> DataFrame:
        """Queue places: after the job's earlier levels, by (parent_pos, uri)."""
        out = running(
            fresh,
            ["job_id"],
            ["parent_pos", "uri"],
            {"pos": Running(F.lit(1).cast("bigint"))},
            hot_rows,
            largest,
        )
        if previous is None:
            return out
        # a job that goes on had rows in the level before; one row per job
        last = previous.groupBy("job_id").agg(F.max("pos").alias("_last"))
        return (
            out.join(last, "job_id").withColumn("pos", F.col("pos") + F.col("_last")).drop("_last")
        )

    fresh = seeds.select("job_id", "uri").dropDuplicates().withColumn("parent_pos", F.lit(0))
    levels: list[DataFrame] = []
    seen = SeenSet(seeds.sparkSession)
    spent: DataFrame | None = None
    depth = 0
    try:
        while True:
            fresh = (keep(fresh) if keep else fresh).select(
                "job_id",
                "uri",
                F.lit(depth).alias("depth"),
                F.col("parent_pos").cast("bigint").alias("parent_pos"),
            ).checkpoint()
            sizes = fresh.groupBy("job_id").agg(
                F.count("*").alias("n"), F.sum(F.octet_length("uri") + 64).alias("b")
            )
            largest, size = sizes.agg(F.max("n"), F.sum("b")).first()
            if depth > 0 and not largest:
                break
            level = placed(fresh, levels[-1] if levels else None, largest or 0)
            level = (
                level.withColumn("status", F.lit(200))
                if stored is None
                else missing_as_404(stored.join(level, "left"))
            )
            level = level.select("job_id", "uri", "depth", "parent_pos", "pos", "status").checkpoint()
            levels.append(level)
            if depth >= max_depth or not largest:
                break
            seen.add(level)
            parents = level.filter(is_success(F.col("status")))
            if max_fetches is not None:
                fetched_well = parents.groupBy("job_id").agg(F.count("*").alias("_ok"))
                if spent is not None:
                    fetched_well = (
                        fetched_well.unionByName(spent).groupBy("job_id").agg(F.sum("_ok").alias("_ok"))
                    )
                spent = fetched_well.checkpoint()
                open_jobs = spent.filter(F.col("_ok") < max_fetches).select("job_id")
                parents = parents.join(open_jobs, "job_id", "left_semi")
            parents = parents.select(
                "job_id", F.col("uri").alias("page_uri"), F.col("pos").alias("_p")
            )
            found = (
                graph.join(F.broadcast(parents) if size <= BROADCAST_BYTES else parents)
                .groupBy("job_id", F.col("_to").alias("uri"))
                .agg(F.min("_p").alias("parent_pos"))
            )
            fresh = seen.unseen(found)
            depth += 1
    finally:
        for layout in (graph, stored):
            if layout is not None:
                layout.drop()
        seen.drop()
    return reduce(DataFrame.unionByName, levels)


def crawl_chains(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(job_id, uri, depth) of crawls over pages with one link each, to the end of every chain.

    ``seeds``: job_id, uri. ``edges``: page_uri, uri; of several links of a page the
    smallest counts. Round k reaches what lies up to 2^k steps further and then
    doubles the steps, so a chain of n pages takes log n rounds instead of n levels.
    Cycles end by themselves: a URI keeps its smallest depth.
    """
    reached = seeds.select("job_id", "uri", F.lit(0).alias("depth")).dropDuplicates().checkpoint()
    jump = edges.groupBy("page_uri").agg(F.min("uri").alias("_to")).checkpoint()
    step, known = 1, reached.count()
    while True:
        ahead = reached.join(jump, reached["uri"] == jump["page_uri"]).select(
            "job_id", F.col("_to").alias("uri"), (F.col("depth") + step).alias("depth")
        )
        reached = (
            reached.unionByName(ahead)
            .groupBy("job_id", "uri")
            .agg(F.min("depth").alias("depth"))
            .checkpoint()
        )
        now = reached.count()
        if now == known:
            return reached
        known, step = now, 2 * step
        onward = jump.select(F.col("page_uri").alias("_to"), F.col("_to").alias("_next"))
        jump = jump.join(onward, "_to").select("page_uri", F.col("_next").alias("_to")).checkpoint()


def with_progress(crawled: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """State of the crawl just before each fetch, from the rows of ``crawl``.

    Adds ``seeds``, ``attempts``, ``succeeds``, ``fails`` (of earlier fetches),
    ``uris_seen`` and ``pending`` (in the queue, this URI included).
    """
    new_links = (
        crawled.filter(F.col("parent_pos") > 0)
        .groupBy("job_id", F.col("parent_pos").alias("pos"))
        .agg(F.count("*").alias("new_links"))
    )
    rows = crawled.join(new_links, ["job_id", "pos"], "left").withColumn(
        "new_links", F.coalesce("new_links", F.lit(0))
    )
    rows = rows.checkpoint()
    status = F.col("status")
    seed = (F.col("depth") == 0).cast("bigint")
    out = running(
        rows,
        ["job_id"],
        ["pos"],
        {
            "succeeds": Running((is_success(status)).cast("bigint"), before=True),
            "fails": Running((is_fail(status)).cast("bigint"), before=True),
            "_found": Running(F.col("new_links"), before=True),
        },
        # places count from 1 without gaps
        slices=F.floor(F.col("pos") / (hot_rows or PLACES)),
    )
    seeds = crawled.groupBy("job_id").agg(F.sum(seed).alias("seeds"))
    return (
        out.join(seeds, "job_id")
        .withColumn("attempts", F.col("pos") - 1)
        .withColumn("uris_seen", F.col("seeds") + F.col("_found"))
        .withColumn("pending", F.col("uris_seen") - F.col("attempts"))
        .drop("_found")
    )


def limits(
    max_queue: int, max_fetches: int, max_fail: float, timed_out: Column | None = None
) -> Column:
    """The stop rule over the progress columns: struct<state, message>."""
    return stop.stop_outcome(
        F.col("pending"),
        F.col("succeeds"),
        F.col("attempts"),
        F.col("fails"),
        F.col("seeds"),
        F.lit(max_queue),
        F.lit(max_fetches),
        F.lit(max_fail),
        timed_out,
    )


def with_outcome(
    progress: DataFrame,
    max_queue: int,
    max_fetches: int,
    max_fail: float,
    timed_out: Column | None = None,
    rule: Column | None = None,
) -> DataFrame:
    """Add the answer of the stop rule before each fetch: ``state``, ``message``.

    Another ``rule`` is any struct<state, message> column over the progress columns.
    """
    if rule is None:
        rule = limits(max_queue, max_fetches, max_fail, timed_out)
    return progress.select("*", F.inline(F.array(rule)))


def outcomes(judged: DataFrame, keys: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """Where and why each job stops: its first row that does not keep crawling.

    A job without such a row ran its queue empty after the last fetch.
    """
    stopping = F.col("state") != stop.KEEP[0]
    first = F.min(
        F.when(stopping, F.struct(F.col("pos"), F.col("state"), F.col("message")))
    )
    return (
        judged.groupBy(*keys)
        .agg(F.max("pos").alias("_last"), first.alias("_stop"))
        .select(
            *keys,
            F.coalesce(F.col("_stop.pos"), F.col("_last") + 1).alias("stop_pos"),
            F.coalesce(F.col("_stop.state"), F.lit(stop.COMPLETED[0])).alias("state"),
            F.coalesce(F.col("_stop.message"), F.lit(stop.COMPLETED[1])).alias("message"),
        )
    )


def outcomes_by_rule(
    progress: DataFrame, rules: dict[str, Column], keys: tuple[str, ...] = ("job_id",), name: str = "budget"
) -> DataFrame:
    """``outcomes`` under each of several rules, with the rule's name, from one stored table of progress.

    One pass finds the first places that stop, as numbers, so that no row is sorted for an
    aggregate of texts; states and messages are then read at these places only.
    """
    firsts = [
        F.min(F.when(rule["state"] != stop.KEEP[0], F.col("pos"))).alias(f"_{i}")
        for i, rule in enumerate(rules.values())
    ]
    each = [F.struct(F.lit(n).alias(name), F.col(f"_{i}").alias("pos")) for i, n in enumerate(rules)]
    places = (
        progress.groupBy(*keys)
        .agg(F.max("pos").alias("_last"), *firsts)
        .select(*keys, "_last", F.inline(F.array(*each)))
        .checkpoint()
    )
    stopping = places.filter(F.col("pos").isNotNull()).select(*keys, name, "pos")
    if places.count() * 200 <= BROADCAST_BYTES:
        stopping = F.broadcast(stopping)
    chosen = F.coalesce(*[F.when(F.col(name) == n, rule) for n, rule in rules.items()])
    there = (
        progress.join(stopping, [*keys, "pos"])
        .groupBy(*keys, name)
        .agg(F.min(chosen).alias("_stop"))
    )
    return places.join(there, [*keys, name], "left").select(
        *keys,
        F.coalesce("pos", F.col("_last") + 1).alias("stop_pos"),
        F.coalesce(F.col("_stop.state"), F.lit(stop.COMPLETED[0])).alias("state"),
        F.coalesce(F.col("_stop.message"), F.lit(stop.COMPLETED[1])).alias("message"),
        name,
    )


def fetched(judged: DataFrame, stops: DataFrame, keys: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """Rows before the stop point of their job."""
    return judged.join(stops.select(*keys, "stop_pos"), list(keys)).filter(
        F.col("pos") < F.col("stop_pos")
    )
