"""Projections of inspection records: history rows, responses, details, and small views of their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..schemas import FIELDS, RESPONSIBLE, ROLES
from .ledger import nested, with_latest

UNKNOWN = "unknown"
SOURCES = ("ocr", "gemini", "human_correction")


def history_item(rows: DataFrame) -> DataFrame:
    """What a history list shows of an inspection with its latest review."""
    return rows.select(
        "inspection_id",
        "original_filename",
        "created_at",
        "overall_status",
        F.coalesce("quality.status", F.lit(UNKNOWN)).alias("quality_status"),
        F.coalesce("context.package_scope", F.lit(UNKNOWN)).alias("package_scope"),
        "review_status",
        "rule_engine_version",
    )


def fields_long(rows: DataFrame) -> DataFrame:
    """A row for each declared field of each inspection, in field order; what is missing is empty and unsure."""
    names = F.array(*map(F.lit, FIELDS))
    each = rows.select("inspection_id", "extracted_fields", F.posexplode(names).alias("ordinal", "field"))
    v = F.try_element_at("extracted_fields", F.col("field"))
    return each.select("inspection_id", "ordinal", "field", formatted(v).alias("v")).select("inspection_id", "ordinal", "field", "v.*")


def formatted(v: Column) -> Column:
    """Text, confidence (0 for an empty text), a valid box or null, and a known source (else ocr)."""
    text = F.coalesce(v["text"], F.lit(""))
    return F.struct(
        text.alias("text"),
        F.when(text == "", F.lit(0.0)).otherwise(F.round(F.coalesce(v["confidence"], F.lit(0.0)), 3)).alias("confidence"),
        F.when(geometry.valid(v["box"]), v["box"]).alias("box"),
        F.when(v["source"].isin(*SOURCES), v["source"]).otherwise(F.lit("ocr")).alias("source"),
    )


def values_only(evidence: DataFrame) -> DataFrame:
    """A row for each inspection, a column for each field; known columns spare the pivot a pass for its values."""
    return evidence.groupBy("inspection_id").pivot("field", [*FIELDS, RESPONSIBLE]).agg(F.first("value"))


def filled(evidence: DataFrame, most: int = 8) -> DataFrame:
    """The first fields of each inspection that have a text, in field order."""
    order = F.array_position(F.array(*map(F.lit, (*FIELDS, RESPONSIBLE))), F.col("field"))
    w = Window.partitionBy("inspection_id").orderBy("ordinal")
    rows = evidence.where(F.coalesce(F.trim("value") != "", F.lit(False))).withColumn("ordinal", order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def localised(findings: DataFrame) -> DataFrame:
    """How many findings of each inspection have a place on the image."""
    return findings.groupBy("inspection_id").agg(F.count_if(geometry.valid(F.col("box"))).alias("localised"), F.count("*").alias("findings"))


def detail(inspections: DataFrame, reviews: DataFrame, corrections: DataFrame, audit: DataFrame) -> DataFrame:
    """An inspection with its latest review, its corrections and its audit trail as arrays."""
    latest = with_latest(inspections, reviews.select("inspection_id", "seq", "review_status", "reviewed_by", "reviewed_at"), "inspection_id", "seq", "review_status").drop("seq")
    return nested(nested(latest, corrections, "inspection_id", ["seq"], "corrections"), audit, "inspection_id", ["seq"], "audit")


def with_provenance(fields: DataFrame, provenance: DataFrame) -> DataFrame:
    """Fields with how they were verified; MISSING where nothing is known."""
    told = provenance.select("inspection_id", "field", "state", "review_required")
    return fields.join(told, ["inspection_id", "field"], "left").withColumn("state", F.coalesce("state", F.lit("MISSING")))


def coverage(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings with the text they rest on; for the derived field the first role that has a name and an address."""
    text = evidence.where(F.coalesce(F.trim("value") != "", F.lit(False))).select("inspection_id", "field", "value")
    role = F.regexp_extract("field", "^(.*)_(?:name|address)$", 1)
    order = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    parts = text.withColumn("role", role).where(F.col("role").isin(*ROLES)).groupBy("inspection_id", "role").agg(
        F.max(F.when(F.col("field").endswith("_name"), F.col("value"))).alias("name"), F.max(F.when(F.col("field").endswith("_address"), F.col("value"))).alias("address")
    )
    pairs = parts.where("name is not null and address is not null").groupBy("inspection_id").agg(F.min_by(F.concat_ws(", ", "name", "address"), order).alias("value"))
    known = text.where(F.col("field") != RESPONSIBLE).unionByName(pairs.withColumn("field", F.lit(RESPONSIBLE)))
    return findings.join(known.withColumnRenamed("value", "evidence_text"), ["inspection_id", "field"], "left")


def rule_search(rules: DataFrame, query: str) -> DataFrame:
    """Rules that hold a text in id, field, description or citation."""
    said = F.lower(F.concat_ws(" ", "rule_id", "field", "description", "source_citation"))
    return rules.where(said.contains(query.strip().lower()))
