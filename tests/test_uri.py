import pytest
from pyspark.sql import functions as F

from trawlspark.operators.canonicalize import canonicalize, duplicate_urls

# One small group for each rule of the normal form; hosts and names are of this file only.
RULES = {
    "scheme and host are lower case, user and path are not": [
        ("HtTp://Kiwi.Example/Seeds", "http://kiwi.example/Seeds"),
        ("https://Ann:Pw@KIWI.example/Q", "https://Ann:Pw@kiwi.example/Q"),
    ],
    "the scheme's own port is left out": [
        ("http://kiwi.example:80/r", "http://kiwi.example/r"),
        ("https://kiwi.example:443/r", "https://kiwi.example/r"),
        ("http://kiwi.example:443/r", "http://kiwi.example:443/r"),
        ("http://kiwi.example:0080/r", "http://kiwi.example/r"),
        ("http://[2001:db8::7]:80/r", "http://[2001:db8::7]/r"),
    ],
    "line ends are cut, blanks are encoded": [
        ("\nhttp://kiwi.example/r\r", "http://kiwi.example/r"),
        ("http://kiwi.example/green kiwi", "http://kiwi.example/green%20kiwi"),
        ("http://kiwi.example/r?tag=green kiwi", "http://kiwi.example/r?tag=green+kiwi"),
        ("/ripe fruit", "/ripe%20fruit"),
    ],
    "unreserved octets are decoded, others get capital digits": [
        ("http://kiwi.example/%7Eann/%41%2d", "http://kiwi.example/~ann/A-"),
        ("http://kiwi.example/%2fx%3f", "http://kiwi.example/%2Fx%3F"),
        ("http://kiwi.example/caf%c3%a9", "http://kiwi.example/caf%C3%A9"),
        ("http://kiwi.example/café", "http://kiwi.example/caf%C3%A9"),
    ],
    "dot segments go, empty segments stay": [
        ("http://kiwi.example/m/./n/../o", "http://kiwi.example/m/o"),
        ("http://kiwi.example/../../o", "http://kiwi.example/o"),
        ("http://kiwi.example/m/n/..", "http://kiwi.example/m/"),
        ("http://kiwi.example/m/.", "http://kiwi.example/m/"),
        ("http://kiwi.example/m///o", "http://kiwi.example/m///o"),
    ],
    "fragments go": [
        ("http://kiwi.example/m#top", "http://kiwi.example/m"),
        ("http://kiwi.example/m?z=9#y?x", "http://kiwi.example/m?z=9"),
    ],
    "parameters are sorted, the last of a name counts": [
        ("http://kiwi.example/m?zest=2&acid=7&mass=1", "http://kiwi.example/m?acid=7&mass=1&zest=2"),
        ("http://kiwi.example/m?acid=7&acid=8", "http://kiwi.example/m?acid=8"),
        ("http://kiwi.example/m?flag&acid=", "http://kiwi.example/m?acid=&flag"),
    ],
    "session ids go": [
        ("http://kiwi.example/m?jsessionid=5F", "http://kiwi.example/m"),
        ("http://kiwi.example/m?acid=7&jsessionid=5F", "http://kiwi.example/m?acid=7"),
    ],
    "other schemes stay": [("mailto:ann@kiwi.example", "mailto:ann@kiwi.example")],
    "illegal": [
        ("http://kiwi.example/m?acid=7=8", None),
        ("http://kiwi.example/%q4", None),
        ("http://kiwi.example:70000/", None),
        ("http://kiwi.example:9x/", None),
        ("http://kiwi.example/m\tn", None),
        ("", None),
        (None, None),
    ],
}
CANONICAL = [case for cases in RULES.values() for case in cases]

RESOLVED = [
    ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"),
    ("/g", "http://a/g"), ("//g", "http://g"), ("g?y", "http://a/b/c/g?y"),
    ("g?y/./x", "http://a/b/c/g?y/./x"), ("?y", "http://a/b/c/d;p?y"), ("g;x", "http://a/b/c/g;x"),
    (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"),
    ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../g", "http://a/g"),
    ("#s", "http://a/b/c/d;p?q"), ("g#s", "http://a/b/c/g"), ("g#s/./x", "http://a/b/c/g"),
    ("g?y#s", "http://a/b/c/g?y"), ("g;x?y#s", "http://a/b/c/g;x?y"),
    ("http://X.com:80/q", "http://x.com/q"), ("/a/../b", "http://a/b"),
    ("?jsessionid=1", "http://a/b/c/d;p?q"), ("skin?k==", None),
]


def test_canonical_table(spark):
    df = spark.createDataFrame(CANONICAL, "url string, want string")
    wrong = [r for r in canonicalize(df).collect() if r.uri != r.want]
    assert not wrong


def test_canonical_is_idempotent(spark):
    df = spark.createDataFrame([(w,) for _, w in CANONICAL if w], "url string")
    assert [r for r in canonicalize(df).collect() if r.uri != r.url] == []


def test_resolution_table(spark):
    df = spark.createDataFrame(RESOLVED, "url string, want string").withColumn(
        "base", F.lit("http://a/b/c/d;p?q")
    )
    rows = canonicalize(df, "url", "base").collect()
    assert [r for r in rows if r.uri != r.want] == []
    bad = next(r for r in rows if r.want is None)
    assert bad.fail_message == "base[http://a/b/c/d;p?q] relative[skin?k==]"


def test_base_without_path(spark):
    df = spark.createDataFrame([("pip", "http://kiwi.example")], "url string, base string")
    assert canonicalize(df, "url", "base").first().uri == "http://kiwi.example/pip"


def test_parts(spark):
    url = "http://ann@Shop.Kiwi.example:8321/crate/7;ripe=yes?mass=3&acid=7#label"
    r = canonicalize(spark.createDataFrame([(url,)], "url string")).first()
    assert (r.scheme, r.authority, r.path) == (
        "http", "ann@shop.kiwi.example:8321", "/crate/7;ripe=yes",
    )
    assert r.site == "http://shop.kiwi.example:8321"


@pytest.mark.parametrize("n", [500])
def test_equal_normal_forms_fold(spark, n):
    df = spark.range(n).select(
        F.explode(
            F.array(
                F.concat(F.lit("http://kiwi.example/page-"), "id"),
                F.concat(F.lit("http://kiwi.example:80/page-"), "id"),
                F.concat(F.lit("http://kiwi.example/page-"), "id"),
            )
        ).alias("url")
    )
    rows = duplicate_urls(df)
    assert rows.count() == n
    assert {(r.urls, r.spellings) for r in rows.collect()} == {(3, 2)}


def test_filter_on_uri_does_not_repeat_the_expression(spark):
    df = spark.createDataFrame([("http://a.com/x",)], "url string").coalesce(1)
    plan = canonicalize(df).filter("uri like '%x'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1
    assert "Filter (isnotnull(uri" in plan
