"""Exports: CSV with formula-guarded names, JSON lines, and the report's sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clamped, valid
from ..functions.text import field_label, guarded_cell
from .records import with_provenance

HISTORY = ("inspection_id", "original_filename", "created_at", "overall_status", "quality_status", "package_scope", "review_status")


def history_rows(rows: DataFrame) -> DataFrame:
    """The exported columns; only the file name comes from outside and is guarded."""
    return rows.select(*(guarded_cell(F.col(c)).alias(c) if c == "original_filename" else F.col(c) for c in HISTORY))


def write_csv(rows: DataFrame, path: str) -> None:
    history_rows(rows).write.option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(*HISTORY).write.json(path)


def report_sections(inspections: DataFrame, findings: DataFrame, rules: DataFrame, reviews: DataFrame, corrections: DataFrame, audit: DataFrame, provenance: DataFrame | None = None) -> dict[str, DataFrame]:
    """One DataFrame for each section of a report, keyed by inspection_id; events carry seq, which orders them within a report.

    provenance: inspection_id, field, state, review_required; with it there is a section on how each field was verified.
    """
    base = inspections.select("inspection_id", "uuid", "original_filename", "created_at", "overall_status", "rule_engine_version")
    quality = inspections.select("inspection_id", "quality.*").withColumn("warnings", F.array_join("warnings", "; "))
    fields = inspections.select("inspection_id", F.explode("extracted_fields").alias("field", "v")).select(
        "inspection_id", "field", field_label(F.col("field")).alias("label"), "v.text", "v.confidence", "v.source"
    )
    told = rules.select("rule_id", F.col("description").alias("rule_description"))
    checked = findings.join(F.broadcast(told), "rule_id", "left")  # rules: bounded when read
    advice = inspections.select("inspection_id", F.posexplode(F.slice("recommendation", 1, 4)).alias("place", "line"))
    verified = {"verification": with_provenance(fields.select("inspection_id", "field", "label", "text"), provenance)} if provenance is not None else {}
    return verified | {
        "metadata": base,
        "quality": quality,
        "fields": fields,
        "findings": checked,
        "summary": inspections.select("inspection_id", "ai_summary"),
        "recommendation": advice,
        "reviews": reviews,
        "corrections": corrections,
        "audit": audit,
    }


def evidence_marks(findings: DataFrame, width: int, height: int) -> DataFrame:
    """What is drawn on an image: clamped boxes with colour and label, for findings that have a place."""
    box = clamped(F.col("box"), F.lit(width), F.lit(height))
    colour = F.when(F.col("status") == "PASS", "green").when(F.col("status") == "FAIL", "red").otherwise("amber")
    label = F.concat_ws(" ", "rule_id", "status")
    return findings.where(valid(F.col("box"))).select("inspection_id", "rule_id", box.alias("box"), colour.alias("colour"), label.alias("label")).where("box is not null")


def verdict_reasons(findings: DataFrame) -> DataFrame:
    """Failures (place 0), then open points (1); by place and ordinal they are in rule order."""
    place = F.when(F.col("status") == "FAIL", 0).when(F.col("status") == "UNCERTAIN", 1)
    return findings.withColumn("place", place).where("place is not null")
