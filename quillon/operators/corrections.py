"""Human corrections as events over base records: overlay, originals kept, rules run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FIELDS
from .evaluate import screen
from .ledger import latest_per_key


def accepted(corrections: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Corrections of known fields with a text."""
    return corrections.where(F.col("field").isin(*fields) & (F.trim("corrected_text") != ""))


def overlay(evidence: DataFrame, corrections: DataFrame) -> DataFrame:
    """Evidence with each field's latest correction: confidence 1, the old box kept, source human_correction.

    A correction of a field without evidence adds it.  original_value keeps what was read at first.
    """
    keyed = accepted(corrections).withColumn("_key", F.struct("inspection_id", "field"))
    last = latest_per_key(keyed.select("_key", "seq", "corrected_text"), "_key", "seq").select("_key.*", F.trim("corrected_text").alias("fixed"))
    rows = evidence.join(last, ["inspection_id", "field"], "full")
    fixed = F.col("fixed").isNotNull()
    return rows.select(
        "inspection_id",
        "field",
        F.coalesce("fixed", "value").alias("value"),
        F.when(fixed, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        "box",
        F.when(fixed, "human_correction").otherwise("reader").alias("source"),
        F.col("value").alias("original_value"),
    )


def reevaluate(evidence: DataFrame, corrections: DataFrame, contexts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each corrected inspection: status before and after."""
    touched = accepted(corrections).select("inspection_id").distinct()
    mine = evidence.join(touched, "inspection_id", "left_semi")
    here = contexts.join(touched, "inspection_id", "left_semi")
    _, before = screen(mine, here, rules)
    _, after = screen(overlay(mine, corrections).select("inspection_id", "field", "value", "confidence", "box"), here, rules)
    return after.select("inspection_id", "overall_status").join(before.select("inspection_id", F.col("overall_status").alias("original_overall_status")), "inspection_id")
