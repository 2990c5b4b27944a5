import pytest
from pyspark.sql import functions as F

from trawlspark.functions.robots import allowed, parse_line
from trawlspark.operators import robots



def record(agent, *lines):
    return "\n".join([f"User-agent: {agent}", *lines]) + "\n"


# records of three agents; those of the asking agent and of everyone count, in file order
MIXED = "\n".join([
    record("finch", "Allow: /seed", "Disallow: /nest"),
    record("heron", "Disallow: /pond"),
    record("*", "Disallow: /moor", "Sitemap: https://birds.example/map", "Host: birds.example"),
])
GENERAL_FIRST = "\n".join([record("*", "Disallow: /moor", "Allow: /reed"), record("finch", "Disallow: /moor")])

PARSED = [
    ("finch", MIXED, ["/seed"], ["/nest", "/moor"], ["https://birds.example/map"], ["birds.example"], None),
    ("heron", MIXED, [], ["/pond", "/moor"], ["https://birds.example/map"], ["birds.example"], None),
    ("finch", GENERAL_FIRST, ["/reed"], ["/moor", "/moor"], [], [], None),
    # control characters inside a line start no record
    ("bot", "User-agent: other\nDisallow: /a\x01*\nDisallow: /", [], [], [], [], None),
    ("bot", "User-agent: bot\nDisallow: /a\x02b\x01", [], ["/ab"], [], [], None),
    ("nobody", "User-agent: a\nDisallow: x\n", [], [], [], [], None),
    ("a", "User-agent: a\r\nCrawl-delay: 2\r\nDisallow: x", [], ["x"], [], [], 2000),
    ("a", "User-agent: a\nCrawl-delay: 1.5\nCrawl-delay: 9", [], [], [], [], 1500),
    ("a", "User-agent: a\nCrawl-delay: soon", [], [], [], [], None),
    ("a", "User-agent: *\nDisallow: %7e/page", [], ["~/page"], [], [], None),
    # capitals in the agent never match a lower-cased line
    ("Agent", "User-agent: Agent\nDisallow: /x\n\nUser-agent: *\nAllow: /y", ["/y"], [], [], [], None),
    # the last of stacked agents decides
    ("a", "User-agent: a\nUser-agent: b\nDisallow: /x", [], [], [], [], None),
    # directives are found inside comments too
    ("a", "User-agent: *\n# disallow: /x", [], ["/x"], [], [], None),
    ("a", "User-agent: *\nDisallow:", [], [""], [], [], None),
    ("a", "Disallow: /early\nUser-agent: a\nAllow: /z", ["/z"], [], [], [], None),
    ("a", "", [], [], [], [], None),
]


def test_parse_table(spark):
    df = spark.createDataFrame([(i, p[1], p[0]) for i, p in enumerate(PARSED)],
                               "i int, body string, agent string")
    rows = robots.robots_rules(df, F.col("agent")).orderBy("i").collect()
    for r, want in zip(rows, PARSED):
        assert (r.allows, r.disallows, r.sitemaps, r.hosts, r.crawl_delay_ms) == want[2:], want


@pytest.mark.parametrize(
    "line,want",
    [
        ("User-agent: *", ("User-agent", "*")),
        ("disallow:/x y", ("disallow", "/x")),
        ("Allow : /a  # c", ("Allow", "/a")),
        ("# a comment", None),
        ("", None),
    ],
)
def test_lines(spark, line, want):
    got = spark.createDataFrame([(line,)], "l string").select(parse_line(F.col("l"))).first()[0]
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "path,allows,disallows,want",
    [
        ("/foo/bar", ["/foo/bar"], ["/foo"], True),
        ("/foo/baz", ["/foo/bar"], ["/foo"], False),
        ("/foo", ["/foo/bar"], ["/foo"], False),
        ("", [], ["/"], False),
        ("/any", [], ["/"], False),
        ("/FOO", [], ["/foo"], False),
        ("/%7Euser", [], ["/~user"], False),
        ("/x", [], [""], False),
        ("/x", [""], ["/"], True),
        ("/x", [], [], True),
        ("/x", None, None, True),
    ],
)
def test_allow(spark, path, allows, disallows, want):
    df = spark.createDataFrame(
        [(path, allows, disallows)], "p string, a array<string>, d array<string>"
    )
    got = df.select(allowed(F.col("p"), F.col("a"), F.col("d"))).first()[0]
    assert got is want


def test_empty_directives_can_be_ignored(spark):
    df = spark.createDataFrame([([], [""])], "a array<string>, d array<string>")
    assert df.select(allowed(F.lit("/x"), F.col("a"), F.col("d"), True)).first()[0] is True


def test_batch_allow_and_delay(spark):
    files = spark.createDataFrame(
        [("http://s1", "User-agent: *\nDisallow: /p1"),
         ("http://s2", "User-agent: *\nAllow: /p1\nDisallow: /\nCrawl-delay: 0.03"),
         ("http://s3", "")],
        "site string, body string",
    )
    rules = robots.robots_rules(files, "bot")
    uris = spark.createDataFrame(
        [(f"http://s{s}", f"/p{p}", "bot") for s in (1, 2, 3, 4) for p in (1, 2)],
        "site string, path string, user_agent string",
    )
    got = {(r.site[-1], r.path[-1]): r.allowed for r in robots.robots_allow(uris, rules).collect()}
    assert got == {
        ("1", "1"): False, ("1", "2"): True, ("2", "1"): True, ("2", "2"): False,
        ("3", "1"): True, ("3", "2"): True, ("4", "1"): True, ("4", "2"): True,
    }
    delays = {r.site[-1]: r.delay_ms for r in robots.robots_delay(uris, rules, F.lit(20)).collect()}
    assert delays == {"1": 20, "2": 30, "3": 20, "4": 20}


def test_stale_sites(spark):
    rules = spark.createDataFrame(
        [("bot", "a", 10), ("bot", "b", 5)], "user_agent string, site string, expires_ms int"
    )
    needed = spark.createDataFrame(
        [("bot", "a"), ("bot", "b"), ("bot", "c"), ("bot", "c")], "user_agent string, site string"
    )
    got = robots.stale_sites(needed, rules, F.lit(7)).collect()
    assert sorted(r.site for r in got) == ["b", "c"]
