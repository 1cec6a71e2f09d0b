"""Reader candidates to field evidence: validate, canonicalise, group, accept or refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical, geometry
from ..functions.text import comparable, normalised
from ..schemas import FIELDS, READER_FIELDS, ROLES
from .panel.spark import extract_texts

PROVENANCE = "reader-validation"

# Wordings that name a role, and words of an address.
ROLE_WORDS = {r: rf"(?iU)\b(?:{v}\s+by|{n})\b" for r, v, n in (("manufacturer", "manufactured", "manufacturer"), ("packer", "packed", "packer"), ("marketer", "marketed", "marketer"), ("importer", "imported", "importer"))}
ADDRESS_WORDS = r"(?iU)\b(?:plot|road|street|lane|estate|area|sector|phase|floor|building|village|district|city|state|india|pin|pincode)\b"

REJECTED_VALUE = "rejected_by_deterministic_field_validator"
REJECTED_PLACE = "missing_or_invalid_evidence_bbox"


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), key)


def _address(role: Column, evidence: Column, claimed: Column) -> Column:
    """A claimed address, if its role is named and the evidence holds it and it looks like one."""
    named = F.lit(False)
    for r in ROLES:
        named = F.when(role == r, evidence.rlike(ROLE_WORDS[r])).otherwise(named)
    key = comparable(claimed)
    ok = named & (key != "") & comparable(evidence).contains(key) & claimed.rlike("[0-9]") & claimed.rlike(ADDRESS_WORDS)
    return F.when(ok, claimed)


def validated(candidates: DataFrame, provenance: str | None = PROVENANCE) -> DataFrame:
    """Candidates of used fields with `active` (the declared field) and `value` (null: refused).

    A reader's own normalised value is never taken as evidence: the visible text goes through the panel extractor,
    and the claim must agree with what that finds.
    """
    used = {k: v for k, v in READER_FIELDS.items() if v}
    claimed = F.coalesce(F.nullif("normalized_value", F.lit("")), "raw_text")
    shown = normalised(F.coalesce(F.nullif("evidence_text", F.lit("")), "raw_text", F.lit("")))
    rows = candidates.withColumn("active", _lookup(used, F.col("field"))).where("active is not null")
    rows = rows.withColumn("shown", shown).withColumn("usable", F.coalesce("readable", F.lit(False)) & (F.col("shown") != ""))
    is_address = F.col("active").endswith("_address")
    rows = rows.withColumn("parse", F.when(F.col("usable") & ~is_address, F.col("shown")))
    rows = extract_texts(rows, "parse", "model_score", "active", provenance, "found")
    agrees = claimed.isNull() | (claimed == "") | canonical.equivalent(F.col("active"), F.col("found"), claimed)
    role = F.regexp_extract("active", "^(.*)_address$", 1)
    address = _address(role, F.col("shown"), F.regexp_replace(normalised(F.coalesce(claimed, F.lit(""))), r"^[ ,;:-]+|[ ,;:-]+$", ""))
    value = F.when(F.col("usable"), F.when(is_address, address).when(agrees, F.col("found")))
    return rows.withColumn("value", F.nullif(value, F.lit(""))).drop("parse", "found", "shown", "usable")


def accept(candidates: DataFrame, responses: DataFrame, provenance: str | None = PROVENANCE) -> DataFrame:
    """A row for each response and declared field: value, confidence, box, state, review_required and what was refused.

    responses: inspection_id, image_readability, image_width, image_height.  Everything that follows the extractor
    is grouped aggregation by (inspection, field); a response holds at most some dozens of candidates.
    """
    spark = candidates.sparkSession
    sizes = responses.select("inspection_id", "image_readability", "image_width", "image_height")
    rows = validated(candidates, provenance).join(sizes, "inspection_id")
    n = F.col("nbox")
    ok = (n["xmax"] > n["xmin"]) & (n["ymax"] > n["ymin"])
    box = F.when(ok, geometry.to_pixels(n["ymin"], n["xmin"], n["ymax"], n["xmax"], F.col("image_width"), F.col("image_height")))
    rows = rows.withColumn("box", box)
    # A manufacture date is more specific than a packing date.
    made = F.max(((F.col("field") == "manufacture_date") & F.col("value").isNotNull()).cast("int")).over(Window.partitionBy("inspection_id", "active"))
    rows = rows.withColumn("passed_over", F.col("value").isNotNull() & (F.col("active") == "date_of_manufacture") & (made == 1) & (F.col("field") != "manufacture_date"))
    c = F.col
    located = c("value").isNotNull() & c("box").isNotNull() & ~c("passed_over")
    key = F.coalesce(canonical.value(c("active"), c("value")), comparable(c("value")))
    reason = F.when(c("value").isNull(), REJECTED_VALUE).when(c("box").isNull() & ~c("passed_over"), REJECTED_PLACE)
    rows = rows.withColumn("key", F.when(located, key)).withColumn("reason", reason).withColumn("located", located)

    # Contacts: the best of each canonical channel, in order of its first appearance.
    channel = (
        rows.where(located & (c("active") == "consumer_care_contact"))
        .groupBy("inspection_id", "key")
        .agg(F.min("cand_idx").alias("at"), F.max(F.struct("model_score", (-c("cand_idx")).alias("o"), "value", "box")).alias("b"))
        .groupBy("inspection_id")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", c("b.value").alias("v")))), lambda x: x["v"]), ", ").alias("merged"),
            F.min("b.model_score").alias("least"),
            geometry.union_of(c("b.box")).alias("merged_box"),
        )
    )
    refusal = F.struct("cand_idx", c("field").alias("source_field"), "raw_text", "reason")
    groups = rows.groupBy("inspection_id", c("active").alias("field")).agg(
        F.count_if(located).alias("located"),
        F.count_distinct("key").alias("keys"),
        F.max(F.when(located, F.struct("model_score", (-c("cand_idx")).alias("o"), "value", "box"))).alias("best"),
        geometry.union_of(F.when(located, c("box"))).alias("all_box"),
        F.transform(F.array_sort(F.collect_list(F.when(located, F.struct("cand_idx", "value")))), lambda x: x["value"]).alias("model_values"),
        F.array_sort(F.collect_list(F.when(c("reason").isNotNull(), refusal))).alias("rejected"),
    )
    dimension = spark.createDataFrame(list(enumerate(FIELDS)), "ordinal int, field string")
    out = sizes.crossJoin(F.broadcast(dimension)).join(groups, ["inspection_id", "field"], "left").join(channel, "inspection_id", "left")  # 14 fields
    any_ = F.coalesce(c("located"), F.lit(0)) > 0
    merged = any_ & (c("field") == "consumer_care_contact")
    conflict = any_ & ~merged & (c("keys") > 1)
    single = any_ & ~merged & ~conflict
    sure = lambda x: F.round(F.least(F.lit(0.95), x), 3)
    refused = F.coalesce(F.size("rejected"), F.lit(0)) > 0
    return out.select(
        "inspection_id",
        "field",
        "ordinal",
        F.when(merged, c("merged")).when(single, c("best.value")).alias("value"),
        F.when(merged, sure(c("least"))).when(single, sure(c("best.model_score"))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(merged, c("merged_box")).when(single, c("best.box")).when(conflict, c("all_box")).alias("box"),
        F.when(merged | single, "VALIDATED").when(conflict, "CONFLICT").when(c("image_readability") == "unreadable", "UNREADABLE").otherwise("MISSING").alias("state"),
        (refused | conflict).alias("review_required"),
        F.coalesce("model_values", F.array().cast("array<string>")).alias("model_values"),
        F.coalesce("rejected", F.array().cast("array<struct<cand_idx:int,source_field:string,raw_text:string,reason:string>>")).alias("rejected"),
    )


# ---------------------------------------------------------------- the same grouping over any keyed values


def conflicts(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """Groups with their number of different canonical values."""
    return rows.groupBy(*group).agg(F.count_distinct(key).alias("n_values"), F.count("*").alias("n_rows")).withColumn("state", F.when(F.col("n_values") > 1, "CONFLICT").otherwise("ACCEPTED"))


def best(rows: DataFrame, group: list[str], score: str, ordinal: str) -> DataFrame:
    """The row of each group with the greatest score, the first of equals."""
    rest = [c for c in rows.columns if c not in (*group, score)]
    return rows.groupBy(*group).agg(F.max(F.struct(F.col(score), (-F.col(ordinal)).alias("_o"), *rest)).alias("_b")).select(*group, f"_b.{score}", *(f"_b.{c}" for c in rest))


def merge_channels(rows: DataFrame, group: list[str], key: str, value: str, score: str, ordinal: str) -> DataFrame:
    """The best row of each key, joined in order of first appearance; as sure as the least sure."""
    per_key = rows.groupBy(*group, key).agg(F.min(ordinal).alias("_at"), F.max(F.struct(F.col(score), (-F.col(ordinal)).alias("_o"), F.col(value).alias("_v"))).alias("_b"))
    return per_key.groupBy(*group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col("_b._v").alias("v")))), lambda x: x["v"]), ", ").alias(value),
        F.min(f"_b.{score}").alias(score),
    )
