import pytest
from pyspark.sql import functions as F

from trawlspark.functions import rules as R
from trawlspark.operators import filtering

SITE = "http://site.com"
CASES = [
    # rules, uri, first match, priority reject
    ([], SITE, False, False),
    ([(True, SITE)], SITE + "/page", True, True),
    ([(True, SITE)], "http://other.com", False, False),
    ([(True, "site.com")], SITE, False, False),  # a prefix must match
    ([(True, ".*site.com")], SITE, True, True),
    ([(False, SITE + "/page2"), (True, SITE)], SITE + "/page2etc", False, False),
    ([(False, SITE + "/page2"), (True, SITE)], SITE + "/page1", True, True),
    ([(True, SITE), (False, SITE + "/page2")], SITE + "/page2", True, False),
    ([(True, "(?i)HTTP://SITE")], SITE, True, True),
    ([(True, "http://a|http://site")], SITE, True, True),
    ([(False, "http://")], SITE, False, False),
]


def test_truth_table_of_both_filters(spark):
    for rules, uri, first, priority in CASES:
        df = spark.createDataFrame([(uri,)], "uri string")
        got = [
            filtering.with_filter(df, rules, kind).first().accepted
            for kind in (R.FIRST_MATCH, R.PRIORITY_REJECT)
        ]
        assert got == [first, priority], (rules, uri)


def test_rules_in_a_column_agree_with_unrolled_rules(spark):
    rows = [
        (i, [f"{'accept' if a else 'reject'}: {r}" for a, r in rules], uri, kind, want)
        for i, (rules, uri, first, priority) in enumerate(CASES)
        for kind, want in (
            (R.FIRST_MATCH, first), (R.PRIORITY_REJECT, priority),
            ("some.package." + R.PRIORITY_REJECT, priority),
        )
    ]
    df = spark.createDataFrame(
        rows, "i int, lines array<string>, uri string, kind string, want boolean"
    ).withColumn("rules", R.rules_column(F.col("lines")))
    out = df.select(
        "*", R.matched_rule_of(F.col("uri"), F.col("rules"), F.col("kind")).alias("rule")
    ).collect()
    assert [r for r in out if bool(r.rule and r.rule.accept) != r.want] == []


def test_explanations(spark):
    df = spark.createDataFrame([("http://site.com/a",), ("http://x.com",)], "uri string")
    rows = filtering.explanation(df, [(True, "http://site")], R.FIRST_MATCH).collect()
    assert [r.explanation for r in rows] == [
        "The URI [http://site.com/a] is accepted by pattern [http://site]",
        "The URI [http://x.com] is rejected because no accept pattern accepted it",
    ]


@pytest.mark.parametrize(
    "line,key,value",
    [
        ("accept: http://site1  ", "accept", "http://site1"),
        ("reject:http://site1", "reject", "http://site1"),
        (" accept: x", None, None),
        ("reject :  x", None, None),
        ("keep: x", None, None),
        ("accept x", None, None),
    ],
)
def test_rule_lines(spark, line, key, value):
    d = (
        spark.createDataFrame([(line,)], "line string")
        .select(F.inline(F.array(R.parse_directive(F.col("line"), ["accept", "reject"]))))
        .first()
    )
    assert (d.key, d.value, d.error is None) == (key, value, key is not None)


def test_bad_rule_line_fails_the_query(spark):
    df = spark.createDataFrame([(["accept: x", "oops"],)], "lines array<string>")
    with pytest.raises(Exception, match="Unrecognised directive"):
        df.select(R.rules_column(F.col("lines"))).collect()
    with pytest.raises(ValueError):
        R.parse_rules(["oops"])


def test_config_cases(spark):
    rows = [
        ("c", ["http://www.site.com"], R.PRIORITY_REJECT,
         ["accept: http://www.site.com", "reject: .*(rss|login)"],
         ["should accept: http://www.site.com/page", "should accept: http://www.site.com/rss",
          "# note", "", "should reject: http://www.site.com/rss", "should reject: http://www.site.com"]),
    ]
    df = spark.createDataFrame(
        rows,
        "config_id string, seeds array<string>, filter_class string, rule_lines array<string>,"
        "tests array<string>",
    )
    got = [(r.kind, r.passed) for r in filtering.config_cases(df).orderBy("kind", "pos").collect()]
    assert got == [
        ("seed", True), ("test", True), ("test", False), ("test", True), ("test", False),
    ]
    result = filtering.config_results(df).first()
    assert (result.all_passed, result.cases, result.failures) == (False, 5, 2)


def test_config_validation_order(spark):
    schema = (
        "config_id string, user_agent string, seeds array<string>, filter_class string,"
        "rule_lines array<string>"
    )
    rules = ["accept: http://ok"]
    df = spark.createDataFrame(
        [
            ("agent", " ", [], R.FIRST_MATCH, rules),
            ("seeds", "bot", [], R.FIRST_MATCH, rules),
            ("reject", "bot", ["http://ok", "http://no"], R.FIRST_MATCH, rules),
            ("fine", "bot", ["http://ok"], R.FIRST_MATCH, rules),
            ("default", None, ["http://ok"], R.FIRST_MATCH, rules),
        ],
        schema,
    )
    got = {
        r.config_id: (r.valid, r.reason)
        for r in filtering.validate_configs(filtering.with_agent(df, "bot/1")).collect()
    }
    assert got["agent"] == (False, filtering.AGENT_MISSING)
    assert got["seeds"] == (False, filtering.SEEDS_MISSING)
    assert got["fine"] == got["default"] == (True, None)
    assert got["reject"][1] == (
        "The crawler URI filter rejected the seeds: "
        "The URI [http://ok] is accepted by pattern [http://ok] and "
        "The URI [http://no] is rejected because no accept pattern accepted it"
    )
