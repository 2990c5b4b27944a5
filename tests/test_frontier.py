"""Crawls against small sites, and against a plain sequential replay."""

import random
from collections import deque

from pyspark.sql import functions as F

from trawlspark.functions import stop
from trawlspark.operators import fetchlog, frontier, links, robots
from trawlspark.operators.canonicalize import canonicalize

BIG = 1_000_000_000


def crawl_pages(spark, pages, seeds, max_depth=BIG, rules=((True, "http"),), limits=(BIG, BIG, 2.0)):
    """Crawl a small fake site: {uri: (status, content type, body)}."""
    rows = [(u, s, c, b) for u, (s, c, b) in pages.items()]
    df = spark.createDataFrame(rows, "uri string, status int, content_type string, body string")
    parsed = links.parse_pages(df, body="body", content_type="content_type")
    found = links.targets(parsed, F.col("uri").alias("page_uri"))
    edges = frontier.decide(found, list(rules)).filter(F.col("decision") == frontier.OKAY)
    seed_rows = spark.createDataFrame([("j", s) for s in seeds], "job_id string, uri string")
    crawled = frontier.crawl(seed_rows, edges.select("page_uri", "uri"), df, max_depth)
    judged = frontier.with_outcome(frontier.with_progress(crawled), *limits)
    stops = frontier.outcomes(judged)
    return frontier.fetched(judged, stops), stops.first()


def html(*hrefs):
    return (200, "text/html; charset=UTF-8", "".join(f'<a href="{h}">link</a>' for h in hrefs))


def counts(kept):
    return {(r.status, r.depth): r["count"] for r in kept.groupBy("status", "depth").count().collect()}


def test_small_site(spark):
    site = "http://site.net"
    pages = {
        site: html("page1.html", "page2.html", "page3.html", "plain.txt"),
        site + "/page1.html": html("page1.html"),
        site + "/page2.html": (
            200, "text/html", '<link href="styles.css"><a href="page3.html">link</a>'),
        site + "/plain.txt": (200, "text/plain", "some plain text"),
        site + "/styles.css": (200, "text/css", "a{background:url(spacecats.png)}"),
    }
    rules = [(False, site + r"/.+\.txt"), (True, site)]
    kept, outcome = crawl_pages(spark, pages, [site], rules=rules)
    by_status = {r.status: r["count"] for r in kept.groupBy("status").count().collect()}
    assert by_status == {200: 4, 404: 2}
    assert (outcome.state, outcome.message) == stop.COMPLETED


def test_other_schemes_are_ignored(spark):
    pages = {"http://site.net": html("http://site.net", "mailto:someone", "ftp://someplace")}
    kept, outcome = crawl_pages(spark, pages, ["http://site.net"], rules=[(True, ".*")])
    assert counts(kept) == {(200, 0): 1}


def test_depth_limit_with_two_seeds(spark):
    s1, s2 = "http://site1.net", "http://site2.net"
    pages = {
        s1: html("pageA", "pageB"), s2: html(s1 + "/pageD"), s1 + "/pageA": html("pageC", "pageD"),
        s1 + "/pageB": html(), s1 + "/pageC": html(), s1 + "/pageD": html(),
    }
    kept, outcome = crawl_pages(spark, pages, [s1, s2], max_depth=1)
    assert counts(kept) == {(200, 0): 2, (200, 1): 3}
    assert (outcome.state, outcome.message) == stop.COMPLETED


def test_too_many_failures(spark):
    i = "http://site.net"
    pages = {i: html("page1", "page2"), i + "/page1": html(),
             i + "/page2": html("page3", "page4", "page5", "page6")}
    kept, outcome = crawl_pages(spark, pages, [i], limits=(BIG, BIG, 0.5))
    assert kept.count() == 6 and kept.filter("status = 404").count() == 3
    assert (outcome.state, outcome.message) == stop.TOO_MANY_FAILED


def test_chain_budget_and_depth(spark):
    edges = spark.range(9).select(
        F.concat(F.lit("p"), "id").alias("page_uri"), F.concat(F.lit("p"), F.col("id") + 1).alias("uri")
    )
    seeds = spark.createDataFrame([("j", "p0")], "job_id string, uri string")
    assert frontier.crawl(seeds, edges, None, 3).count() == 4
    whole = frontier.crawl(seeds, edges, None, BIG)
    assert whole.count() == 10  # more levels than are kept before compaction
    judged = frontier.with_outcome(frontier.with_progress(whole), BIG, 5, 2.0)
    stops = frontier.outcomes(judged)
    assert frontier.fetched(judged, stops).count() == 5
    assert stops.first().message == stop.TOO_MANY_FETCHES[1]
    cut = frontier.crawl(seeds, edges, None, BIG, max_fetches=5)
    assert frontier.fetched(judged, stops).count() <= cut.count() < 10


def replay(edges, status, seeds, max_depth, max_queue, max_fetches, max_fail):
    """One URI after the other, as a single crawl worker would go."""
    queue = deque((s, 0) for s in sorted(set(seeds)))
    seen = {s for s, _ in queue}
    n_seeds, done, ok, bad = len(seen), [], 0, 0
    while True:
        n = len(done)
        if not queue:
            return done, stop.COMPLETED
        if len(queue) >= max_queue:
            return done, stop.TOO_MANY_QUEUED
        if ok >= max_fetches:
            return done, stop.TOO_MANY_FETCHES
        if n > n_seeds and n >= stop.MIN_ATTEMPTS and bad / n >= max_fail:
            return done, stop.TOO_MANY_FAILED
        uri, depth = queue.popleft()
        done.append(uri)
        code = status.get(uri, 404)
        ok += 200 <= code < 300
        bad += not 200 <= code < 400
        if 200 <= code < 300 and depth < max_depth:
            for to in sorted(set(edges.get(uri, [])) - seen):
                seen.add(to)
                queue.append((to, depth + 1))


def test_levels_equal_sequential_replay(spark):
    rng = random.Random(7)
    graphs, all_edges, all_status, all_seeds = {}, [], [], []
    for g in range(40):
        n = rng.randrange(2, 30)
        name = [f"g{g}/{i:02d}" for i in range(n)]
        edges = {}
        for _ in range(rng.randrange(1, 90)):
            edges.setdefault(rng.choice(name), []).append(rng.choice(name))
        status = {u: rng.choice([200, 200, 200, 301, 500]) for u in name if rng.random() < 0.9}
        seeds = rng.sample(name, rng.randrange(1, 3))
        graphs[g] = (edges, status, seeds)
        all_edges += [(a, b) for a, bs in edges.items() for b in set(bs)]
        all_status += list(status.items())
        all_seeds += [(g, s) for s in seeds]
    edges = spark.createDataFrame(all_edges, "page_uri string, uri string")
    status = spark.createDataFrame(all_status, "uri string, status int")
    seeds = spark.createDataFrame(all_seeds, "job_id int, uri string")
    depth = 4
    for hot_rows in (None, 3):
        progress = frontier.with_progress(
            frontier.crawl(seeds, edges, status, depth, hot_rows=hot_rows), hot_rows
        ).checkpoint()
        for limits in ((BIG, BIG, 2.0), (9, BIG, 2.0), (BIG, 4, 2.0), (BIG, BIG, 0.4)):
            judged = frontier.with_outcome(progress, *limits)
            stops = frontier.outcomes(judged)
            kept = {}
            for r in frontier.fetched(judged, stops).orderBy("job_id", "pos").collect():
                kept.setdefault(r.job_id, []).append(r.uri)
            ends = {r.job_id: (r.state, r.message) for r in stops.collect()}
            for g, (e, s, start) in graphs.items():
                want, why = replay(e, s, start, depth, *limits)
                assert kept.get(g, []) == want, (g, limits, hot_rows)
                assert ends[g] == why


def test_decisions_in_order(spark):
    df = spark.createDataFrame(
        [("http://a.com/x",), ("ftp://a.com/x",), ("http://b.com/x",), ("http://a.com/no",),
         ("http://a.com/ok",)], "url string",
    )
    uris = canonicalize(df).withColumns({"job_id": F.lit(1), "user_agent": F.lit("bot")})
    rules = robots.robots_rules(
        spark.createDataFrame([("http://a.com", "User-agent: *\nDisallow: /no")],
                              "site string, body string"), "bot")
    seen = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.com/ok")], "job_id int, uri string")
    got = frontier.decide(uris, [(True, "http://a"), (True, "ftp")], rules, seen=seen).collect()
    assert {r.uri: r.decision for r in got} == {
        "http://a.com/x": frontier.SEEN, "ftp://a.com/x": frontier.UNSUPPORTED,
        "http://b.com/x": frontier.REJECTED, "http://a.com/no": frontier.EXCLUDED,
        "http://a.com/ok": frontier.OKAY,
    }
    assert {r.site for r in got} == {"http://a.com", "http://b.com", "ftp://a.com"}


def test_failing_crawl_rule(spark):
    cases = [(1, 0.1, 1, 0, False), (10, 0.1, 10, 10, False), (1, 0.6, 2, 1, False),
             (1, 0.5, 10, 4, False), (1, 0.1, 1000, 100, True), (1, 0.2, 1000, 200, True),
             (1, 0.2, 10000, 2000, True)]
    df = spark.createDataFrame(cases, "seeds int, mx double, attempts int, fails int, want boolean")
    got = df.select("want", stop.is_failing(
        F.col("attempts"), F.col("fails"), F.col("seeds"), F.col("mx")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_stop_rule_priority(spark):
    def ask(pending, ok, attempts, fails, timed_out=False, requested=False):
        row = spark.range(1).select(F.inline(F.array(stop.stop_outcome(
            F.lit(pending), F.lit(ok), F.lit(attempts), F.lit(fails), F.lit(1), F.lit(10), F.lit(5),
            F.lit(0.5), F.lit(timed_out), F.lit(requested))))).first()
        return (row.state, row.message)

    assert ask(0, 9, 9, 9, True, True) == stop.STOPPED
    assert ask(0, 9, 9, 9, True) == stop.COMPLETED
    assert ask(10, 9, 9, 9, True) == stop.TOO_MANY_QUEUED
    assert ask(1, 5, 9, 9, True) == stop.TOO_MANY_FETCHES
    assert ask(1, 1, 9, 9, True) == stop.TIMEOUT
    assert ask(1, 1, 9, 8) == stop.TOO_MANY_FAILED
    assert ask(1, 1, 9, 1) == stop.KEEP


def test_log_jobs_do_not_depend_on_the_hot_limit(spark, sf):
    from trawlspark.plans.inputs import fetch_log

    log = fetch_log(spark, sf).withColumn(
        "job_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("job_id"))
    )
    delay = F.lit(100)
    jobs = [
        lambda n: fetchlog.running_log(log, hot_rows=n),
        lambda n: fetchlog.log_progress(log, 5, hot_rows=n),
        lambda n: fetchlog.politeness_schedule(log, delay, hot_rows=n),
        lambda n: fetchlog.politeness_gap(log, delay, hot_rows=n),
    ]
    for job in jobs:
        plain, cut = job(None), job(20)
        assert sorted(map(str, cut.select(plain.columns).collect())) == sorted(
            map(str, plain.collect())
        )


def test_chains_to_the_end_and_cycles(spark):
    links = [(f"a{i}", f"a{i + 1}") for i in range(37)] + [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("x", "a30")]
    edges = spark.createDataFrame(links, "page_uri string, uri string")
    seeds = spark.createDataFrame([("p", "a0"), ("q", "c1"), ("q", "x"), ("r", "lone")], "job_id string, uri string")
    got = {(r.job_id, r.uri): r.depth for r in frontier.crawl_chains(seeds, edges).collect()}
    want = {("p", f"a{i}"): i for i in range(38)} | {("q", "c1"): 0, ("q", "c2"): 1, ("q", "c0"): 2, ("q", "x"): 0, ("r", "lone"): 0}
    assert got == want | {("q", f"a{30 + i}"): i + 1 for i in range(8)}


def test_repeated_responses_and_seen_rows_change_nothing(spark):
    seeds = spark.createDataFrame([(1, "/s")], "job_id bigint, uri string")
    edges = spark.createDataFrame([("/s", "/a"), ("/s", "/b")], "page_uri string, uri string")
    replies = spark.createDataFrame([("/s", 200), ("/s", 200), ("/a", 200), ("/a", 200)], "uri string, status int")
    rows = frontier.crawl(seeds, edges, replies, 2).collect()
    assert sorted((r.uri, r.pos, r.status) for r in rows) == [("/a", 2, 200), ("/b", 3, 404), ("/s", 1, 200)]
    found = spark.createDataFrame([(1, "http://k.example/a", "http", "/a", "http://k.example", "bot")],
                                  "job_id bigint, uri string, scheme string, path string, site string, user_agent string")
    seen = found.select("job_id", "uri").union(found.select("job_id", "uri"))
    assert [r.decision for r in frontier.decide(found, [(True, "http")], seen=seen).collect()] == [frontier.SEEN]


def test_rules_over_one_stored_table(spark):
    rows = [(j, p, max(0, 9 - p), p - 1, p - 1, 0, 1) for j in (1, 2) for p in range(1, 8 + j)]
    progress = spark.createDataFrame(
        rows, "job_id bigint, pos bigint, pending bigint, succeeds bigint, attempts bigint, fails bigint, seeds bigint"
    )
    budgets = {"fetches": (100, 4, 2.0), "queue": (3, 100, 2.0), "none": (100, 100, 2.0)}
    got = frontier.outcomes_by_rule(progress, {n: frontier.limits(*b) for n, b in budgets.items()})
    want = set()
    for name, limits in budgets.items():
        stops = frontier.outcomes(frontier.with_outcome(progress, *limits))
        want |= {(*r, name) for r in stops.collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 6
