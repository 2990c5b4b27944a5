"""Accept/reject URI rules: parsing, matching and explanation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lang import squeeze

# Texts of the explanations.
ACCEPT_TEXT = "The URI [%s] is accepted by pattern [%s]"
REJECT_TEXT = "The URI [%s] is rejected by pattern [%s]"
DEFAULT_TEXT = "The URI [%s] is rejected because no accept pattern accepted it"

FIRST_MATCH = "FirstMatchUriFilter"
PRIORITY_REJECT = "PriorityRejectUriFilter"

# a name of letters, hyphens and blanks before the first colon, then the value
_KEY_VALUE = r"^([-A-Za-z \t]++):(.*)$"

Rule = tuple[bool, str]


def is_rule_line(line: Column) -> Column:
    """Blank lines and lines starting with ``#`` carry no rule."""
    return (squeeze(line) != "") & ~line.startswith("#")


def parse_directive(line: Column, directives: list[str]) -> Column:
    """struct<key, value, error> of a ``key: value`` line."""
    key = F.regexp_extract(line, _KEY_VALUE, 1)
    known = key.isin(*directives)
    return F.struct(
        F.when(known, key).alias("key"),
        F.when(known, squeeze(F.regexp_extract(line, _KEY_VALUE, 2))).alias("value"),
        F.when(
            ~known,
            F.format_string(
                "Unrecognised directive on line [%s]. Directives should be one of ["
                + ",".join(directives)
                + "]",
                line,
            ),
        ).alias("error"),
    )


def rules_column(lines: Column) -> Column:
    """array<struct<accept, regex>> of an array of rule lines; bad lines raise."""

    def rule(line: Column) -> Column:
        d = parse_directive(line, ["accept", "reject"])
        return F.struct(
            F.when(d["error"].isNull(), d["key"] == "accept")
            .otherwise(F.raise_error(d["error"]).cast("boolean"))
            .alias("accept"),
            d["value"].alias("regex"),
        )

    return F.transform(F.filter(lines, is_rule_line), rule)


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules of a configuration known when the query is written."""
    out = []
    for line in lines:
        if not line.strip() or line.startswith("#"):
            continue
        m = re.match(r"(accept|reject):\s*(.*)", line)
        if not m:
            raise ValueError(f"Unrecognised directive on line [{line}]")
        out.append((m.group(1) == "accept", m.group(2).strip()))
    return out


def _matches(uri: Column, regex: Column) -> Column:
    return F.rlike(uri, F.concat(F.lit("^(?:"), regex, F.lit(")")))


def ordered_rules(rules: list[Rule], kind: str) -> list[Rule]:
    """Order of trial: as written, or all rejects before all accepts."""
    return sorted(rules, key=lambda r: r[0]) if kind == PRIORITY_REJECT else list(rules)


def matched_rule(uri: Column, rules: list[Rule], kind: str = FIRST_MATCH) -> Column:
    """struct<accept, regex> of the deciding rule, null when none matches.

    The few rules of a configuration are unrolled to one CASE, so each pattern
    is compiled once per task and no join is needed.
    """
    out = None
    for accept, regex in ordered_rules(rules, kind):
        hit = uri.rlike("^(?:" + regex + ")")
        value = F.struct(F.lit(accept).alias("accept"), F.lit(regex).alias("regex"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(None).cast("struct<accept:boolean,regex:string>") if out is None else out


def accepts(uri: Column, rules: list[Rule], kind: str = FIRST_MATCH) -> Column:
    """Is ``uri`` accepted? What no rule matches is rejected."""
    out = None
    for accept, regex in ordered_rules(rules, kind):
        hit = uri.rlike("^(?:" + regex + ")")
        out = F.when(hit, F.lit(accept)) if out is None else out.when(hit, F.lit(accept))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def matched_rule_of(uri: Column, rules: Column, kind: Column) -> Column:
    """As ``matched_rule`` for rules held in a column (one configuration per row).

    ``kind`` may carry a package name before the filter's name.
    """
    kind = F.substring_index(kind, ".", -1)
    hits = F.filter(rules, lambda r: _matches(uri, r["regex"]))
    rejects = F.filter(hits, lambda r: ~r["accept"])
    return F.when(
        (kind == PRIORITY_REJECT) & (F.size(rejects) > 0), F.get(rejects, F.lit(0))
    ).otherwise(F.get(hits, F.lit(0)))


def explain(uri: Column, rule: Column) -> Column:
    return (
        F.when(rule["accept"], F.format_string(ACCEPT_TEXT, uri, rule["regex"]))
        .when(~rule["accept"], F.format_string(REJECT_TEXT, uri, rule["regex"]))
        .otherwise(F.format_string(DEFAULT_TEXT, uri))
    )
