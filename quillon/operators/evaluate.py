"""Rules over evidence: findings and the overall verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.canonical import severity
from ..functions.text import normalised
from ..schemas import RESPONSIBLE, ROLES
from ..sources.rules import CUSTOM


def _matches(value: Column, check_types: list[tuple[str, str | None]]) -> Column:
    """A pattern is a literal of the plan, so each is compiled once; Unicode classes as in the rules' dialect."""
    out = F.lit(False)
    for rule_id, pattern in check_types:
        if pattern:
            out = F.when(F.col("rule_id") == rule_id, value.rlike("(?iuU)" + pattern)).otherwise(out)
    return out


def _passes_custom(value: Column) -> Column:
    out = F.lit(False)
    for name, passes in CUSTOM.items():
        out = F.when(F.col("check_type") == name, F.coalesce(passes(value), F.lit(False))).otherwise(out)
    return out


def evaluate(evidence: DataFrame, contexts: DataFrame, rules: DataFrame) -> DataFrame:
    """A finding for each inspection and each rule that applies to it.

    evidence: inspection_id, field, value, confidence, box; contexts: inspection_id, package_scope, ...
    The order of tests is: not applicable (no row), scope unknown, missing, below the confidence floor, pattern.
    """
    patterns = [(r["rule_id"], r["pattern"] if r["check_type"] == "presence_and_pattern" else None) for r in rules.collect()]  # RULES_MAX rows at most
    scope = F.lower(F.col("package_scope"))
    scope = F.when(scope.isin("domestic", "imported"), scope).otherwise("unknown")
    pairs = contexts.select("inspection_id", scope.alias("scope")).crossJoin(F.broadcast(rules))  # a row for each rule: RULES_MAX at most
    told = evidence.select("inspection_id", "field", "value", F.col("confidence").alias("read"), "box")
    rows = pairs.join(told, ["inspection_id", "field"], "left")
    imported = F.coalesce(F.col("applicability") == "imported_goods_only", F.lit(False))
    missing = F.coalesce(normalised(F.col("value")) == "", F.lit(True))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("read", F.lit(0.0))))
    unknown = imported & (F.col("scope") == "unknown") & missing
    status = (
        F.when(missing | (sure < F.col("confidence_floor")), "UNCERTAIN")
        .when(F.col("check_type") == "all_present", "PASS")
        .when(_matches(normalised(F.col("value")), patterns) | _passes_custom(normalised(F.col("value"))), "PASS")
        .otherwise("FAIL")
    )
    note = (
        F.when(unknown, F.concat(F.lit("Package scope is unknown, so it is open whether this applies: "), F.col("description")))
        .when(missing, F.concat(F.lit("No readable evidence: "), F.col("description")))
        .when(sure < F.col("confidence_floor"), F.concat(F.lit("Evidence is below the confidence floor: "), F.col("description")))
        .otherwise(F.col("description"))
    )
    return rows.where(~(imported & (F.col("scope") == "domestic"))).select(
        "inspection_id",
        "rule_id",
        "field",
        status.alias("status"),
        severity(F.col("severity_if_fail")).alias("severity"),
        F.round(sure, 3).alias("confidence"),
        geometry.or_zero(F.col("box")).alias("box"),
        note.alias("description"),
        "source_citation",
        "rule_version",
        F.when(unknown, "unknown").when(imported, "imported").otherwise("all").alias("applicability"),
        "ordinal",
    )


def verdicts(findings: DataFrame, contexts: DataFrame) -> DataFrame:
    """inspection_id, overall_status and counts.  contexts: inspection_id, quality_status, line_count."""
    counted = findings.groupBy("inspection_id").agg(
        F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status") == "UNCERTAIN").alias("uncertain"), F.count_if(F.col("status") == "PASS").alias("passed")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    unclear = (zero("uncertain") > 0) | ~F.coalesce(F.col("quality_status") == "good", F.lit(False)) | (zero("line_count") == 0)
    status = F.when(zero("failed") > 0, "potential_non_compliance").when(unclear, "manual_review_required").otherwise("compliant")
    return contexts.join(counted, "inspection_id", "left").select(
        "inspection_id", status.alias("overall_status"), zero("failed").alias("failed"), zero("uncertain").alias("uncertain"), zero("passed").alias("passed")
    )


def responsible_party(evidence: DataFrame) -> DataFrame:
    """The derived field: of the roles whose name and address are both there, the surest pair (the first role on ties);
    else what there is of the manufacturer.  A pair is as sure as its less sure part."""
    roles = F.create_map(*(F.lit(v) for i, r in enumerate(ROLES) for v in (r, i)))
    role = F.regexp_extract("field", "^(.*)_(?:name|address)$", 1)
    rows = evidence.where(F.col("field").isin([f"{r}_{p}" for r in ROLES for p in ("name", "address")])).select(
        "inspection_id", role.alias("role"), F.col("field").endswith("_name").alias("is_name"), "value", "confidence", "box"
    )
    has = F.coalesce(F.trim("value") != "", F.lit(False))
    part = lambda c, name: F.max(F.when((F.col("is_name") == name) & has, F.col(c)))
    box = lambda name: F.max(F.when((F.col("is_name") == name) & has, F.col("box")))
    pairs = rows.groupBy("inspection_id", "role").agg(
        part("value", True).alias("name"), part("value", False).alias("address"), part("confidence", True).alias("c1"), part("confidence", False).alias("c2"), box(True).alias("b1"), box(False).alias("b2")
    )
    whole = F.col("name").isNotNull() & F.col("address").isNotNull()
    some = F.concat_ws(", ", "name", "address")
    usable = whole | ((F.col("role") == "manufacturer") & (some != ""))
    chosen = F.struct(
        whole.alias("whole"),
        F.when(whole, F.least("c1", "c2")).otherwise(F.coalesce("c1", "c2")).alias("confidence"),
        (-F.element_at(roles, F.col("role"))).alias("order"),
        some.alias("value"),
        geometry.union_array(F.array("b1", "b2")).alias("box"),
    )
    best = pairs.where(usable).groupBy("inspection_id").agg(F.max(chosen).alias("p"))
    sure = F.when(F.col("p.whole"), F.col("p.confidence")).otherwise(F.lit(0.0))
    return best.select("inspection_id", F.lit(RESPONSIBLE).alias("field"), F.when(F.col("p.whole"), F.col("p.value")).alias("value"), sure.alias("confidence"), F.col("p.box").alias("box"))


def screen(evidence: DataFrame, contexts: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and verdicts of evidence with its derived field."""
    findings = evaluate(evidence.unionByName(responsible_party(evidence)), contexts, rules)
    return findings, verdicts(findings, contexts)


def explanations(findings: DataFrame, status: DataFrame) -> DataFrame:
    """One sentence and three recommendations for each verdict, from its findings alone."""
    fields = lambda s: F.array_distinct(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("ordinal", "field")))), lambda x: x["field"])
    )
    told = findings.groupBy("inspection_id").agg(fields("FAIL").alias("failed_fields"), fields("UNCERTAIN").alias("open_fields"))
    names = lambda c: F.replace(F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", "), F.lit("_"), F.lit(" "))
    v = F.col("overall_status")
    text = (
        F.when(v == "potential_non_compliance", F.concat(F.lit("Declarations failed their format check: "), names("failed_fields"), F.lit(".")))
        .when(v == "manual_review_required", F.concat(F.lit("Evidence is missing or uncertain: "), F.coalesce(F.nullif(names("open_fields"), F.lit("")), F.lit("image quality")), F.lit(".")))
        .otherwise(F.lit("All checked declarations are present in a recognised form."))
    )
    advice = lambda *lines: F.array(*map(F.lit, lines))
    steps = (
        F.when(v == "potential_non_compliance", advice("Compare the failed declarations with the package.", "Record a correction where the reading is wrong.", "Refer the package to an officer."))
        .when(v == "manual_review_required", advice("Inspect the open declarations by eye.", "Take another image if the text is not readable.", "Record what the package declares."))
        .otherwise(advice("Keep the record for audit.", "Confirm category-specific exceptions.", "No further action is proposed."))
    )
    return status.join(told, "inspection_id", "left").select("inspection_id", "overall_status", text.alias("explanation"), steps.alias("recommendation"))
