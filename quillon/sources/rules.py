"""Rules as data: read, validate, keep the active ones."""

from __future__ import annotations

import json
from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = (
    "rule_id string, rule_version string, active boolean, field string, source_citation string, description string, check_type string, "
    "pattern string, severity_if_fail string, confidence_floor double, on_field_missing string, applicability string, ordinal int"
)
REQUIRED = ("rule_id", "rule_version", "active", "field", "source_citation", "description", "check_type", "severity_if_fail", "confidence_floor", "on_field_missing")
CHECKS = ("presence_and_pattern", "all_present")
#: Check types that a caller has added: from a normalised value to whether it passes.
CUSTOM: dict[str, Callable[[Column], Column]] = {}
#: What a rule set may hold: it is broadcast to every task.
RULES_MAX = 10_000


def register_check_type(name: str, passes: Callable[[Column], Column]) -> None:
    """Rules may then have this check type; passes() takes the normalised value's Column and gives a boolean one."""
    if name in CHECKS:
        raise ValueError(f"{name} is a check type already")
    CUSTOM[name] = passes


class RuleError(ValueError):
    """A rule set that can't be used."""


def validate(rules: list[dict]) -> list[dict]:
    """The rules, or RuleError naming what is wrong with the first bad one."""
    if len(rules) > RULES_MAX:
        raise RuleError(f"{len(rules)} rules; {RULES_MAX} at most")
    seen = set()
    for rule in rules:
        name = rule.get("rule_id")
        if missing := sorted(set(REQUIRED) - set(rule)):
            raise RuleError(f"rule {name}: missing {', '.join(missing)}")
        if name in seen:
            raise RuleError(f"rule {name}: duplicate rule_id")
        seen.add(name)
        if rule["on_field_missing"] != "UNCERTAIN":
            raise RuleError(f"rule {name}: on_field_missing must be UNCERTAIN")
        if not 0 <= float(rule["confidence_floor"]) <= 1:
            raise RuleError(f"rule {name}: confidence_floor must lie in 0..1")
        if rule["check_type"] not in (*CHECKS, *CUSTOM):
            raise RuleError(f"rule {name}: unknown check_type {rule['check_type']}")
        if rule["check_type"] == "presence_and_pattern" and not rule.get("pattern"):
            raise RuleError(f"rule {name}: a pattern check needs a pattern")
    return rules


def default_rules() -> list[dict]:
    return json.loads(resources.files(__package__).joinpath("rules.json").read_text(encoding="utf-8"))


def to_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    names = [x.split()[0] for x in RULE.split(", ")]
    rows = [tuple((r | {"ordinal": i, "confidence_floor": float(r["confidence_floor"])}).get(n) for n in names) for i, r in enumerate(validate(rules))]
    return spark.createDataFrame(rows, RULE)


def load_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Active rules in order of file name and place; without a path, the ones that come with the package."""
    if path is None:
        return to_frame(spark, default_rules()).where("active")
    # Values stay strings where they are read, so that a missing key is told from a null.
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.input_file_name().alias("file"), "value")
    found = []
    # All files, as some may hold no rule; reading ends once there are too many rules, which validate() refuses.
    for row in files.orderBy("file").toLocalIterator():
        told = json.loads(row["value"])
        found += told if isinstance(told, list) else [told]
        if len(found) > RULES_MAX:
            break
    return to_frame(spark, found).where("active")


def catalogue(rules: DataFrame) -> DataFrame:
    """What a rule list shows."""
    from ..functions.canonical import severity

    return rules.select(
        "rule_id",
        "rule_version",
        "field",
        "description",
        "source_citation",
        severity(F.col("severity_if_fail")).alias("severity"),
        "check_type",
        F.coalesce("applicability", F.lit("all")).alias("applicability"),
        "confidence_floor",
        "ordinal",
    )
