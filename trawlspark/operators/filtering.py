"""URI filters, crawl configuration tests and validation over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.lang import squeeze
from .canonicalize import canonicalize

# Messages of configuration checks.
PASSED = "passed"
AGENT_MISSING = (
    "Please set a sensible userAgent value in your crawler configuration."
    "This is used to form a User-agent header during HTTP fetch requests "
    "to help identify your crawler to the web server. Some web servers will "
    "block requests if a user agent is not defined. "
    "The user agent is also used when evaluating Robots Exclusion rules."
)
SEEDS_MISSING = "seed URIs are required to start a crawler"
SEEDS_REJECTED = "The crawler URI filter rejected the seeds: %s"

TEST_DIRECTIVES = ["should accept", "should reject"]


def with_filter(
    df: DataFrame, rules: list[R.Rule], kind: str = R.FIRST_MATCH, uri: str = "uri"
) -> DataFrame:
    """Add ``accepted`` and the deciding ``pattern`` (null when none matched)."""
    rule = R.matched_rule(F.col(uri), rules, kind)
    return (
        df.select("*", F.inline(F.array(F.struct(rule.alias("_rule")))))
        .withColumns(
            {
                "accepted": F.coalesce(F.col("_rule.accept"), F.lit(False)),
                "pattern": F.col("_rule.regex"),
            }
        )
        .drop("_rule")
    )


def explanation(df: DataFrame, rules: list[R.Rule], kind: str, uri: str = "uri") -> DataFrame:
    """Add the text that names the deciding pattern."""
    rule = R.matched_rule(F.col(uri), rules, kind)
    return (
        df.select("*", F.inline(F.array(F.struct(rule.alias("_rule")))))
        .withColumn("explanation", R.explain(F.col(uri), F.col("_rule")))
        .drop("_rule")
    )


def with_agent(configs: DataFrame, default: str) -> DataFrame:
    """Use the default user agent where a configuration names none."""
    return configs.withColumn("user_agent", F.coalesce(F.col("user_agent"), F.lit(default)))


def config_cases(configs: DataFrame) -> DataFrame:
    """Seeds and test lines of every configuration, one row each, with the verdict.

    ``configs``: config_id, seeds, filter_class, rule_lines, tests (arrays of text).
    """
    seeds = F.transform(
        F.coalesce("seeds", F.array()),
        lambda s, i: F.struct(
            F.lit("seed").alias("kind"), i.alias("pos"), s.alias("url"), F.lit(True).alias("want")
        ),
    )

    def case(line: Column, i: Column) -> Column:
        d = R.parse_directive(line, TEST_DIRECTIVES)
        return F.struct(
            F.lit("test").alias("kind"),
            i.alias("pos"),
            F.when(d["error"].isNull(), d["value"]).otherwise(
                F.raise_error(d["error"]).cast("string")
            ).alias("url"),
            (d["key"] == "should accept").alias("want"),
        )

    tests = F.transform(F.filter(F.coalesce("tests", F.array()), R.is_rule_line), case)
    rows = configs.select(
        "config_id",
        "filter_class",
        R.rules_column(F.col("rule_lines")).alias("rules"),
        F.explode(F.concat(seeds, tests)).alias("c"),
    ).select("config_id", "filter_class", "rules", "c.*")
    rule = R.matched_rule_of(F.col("uri"), F.col("rules"), F.col("filter_class"))
    judged = canonicalize(rows).select(
        "config_id", "kind", "pos", "uri", "want",
        F.inline(F.array(F.struct(rule.alias("rule")))),
    )
    ok = F.coalesce(F.col("rule.accept"), F.lit(False))
    return judged.select(
        "config_id",
        "kind",
        "pos",
        "uri",
        (ok == F.col("want")).alias("passed"),
        F.when(ok == F.col("want"), F.lit(PASSED))
        .otherwise(R.explain(F.col("uri"), F.col("rule")))
        .alias("message"),
    )


def config_results(configs: DataFrame) -> DataFrame:
    """Whether all seeds and tests of each configuration pass."""
    return config_cases(configs).groupBy("config_id").agg(
        F.bool_and("passed").alias("all_passed"),
        F.count("*").alias("cases"),
        F.count_if(~F.col("passed")).alias("failures"),
    )


def validate_configs(configs: DataFrame) -> DataFrame:
    """``valid`` and the ``reason`` of refusal: agent, then seeds, then the filter.

    Seeds are judged inside the row of their configuration, in order.
    """
    from ..functions.uri import canonical

    seeds = F.transform(
        F.coalesce("seeds", F.array()), lambda s: canonical(s)["uri"]
    )
    judged = F.transform(
        F.col("_uris"),
        lambda u: F.struct(
            u.alias("uri"),
            R.matched_rule_of(u, F.col("_rules"), F.col("filter_class")).alias("rule"),
        ),
    )
    reasons = F.array_join(F.transform("_judged", lambda j: R.explain(j["uri"], j["rule"])), " and ")
    all_ok = F.forall("_judged", lambda j: F.coalesce(j["rule"]["accept"], F.lit(False)))
    reason = (
        F.when(squeeze(F.coalesce("user_agent", F.lit(""))) == "", F.lit(AGENT_MISSING))
        .when(F.size("_judged") == 0, F.lit(SEEDS_MISSING))
        .when(~all_ok, F.format_string(SEEDS_REJECTED, reasons))
    )
    return (
        configs.withColumns(
            {"_uris": seeds, "_rules": R.rules_column(F.col("rule_lines"))}
        )
        .withColumn("_judged", judged)
        .select("config_id", F.inline(F.array(F.struct(reason.alias("reason")))))
        .select("config_id", F.col("reason").isNull().alias("valid"), "reason")
    )
