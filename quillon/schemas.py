"""Schemas of the screening tables, and additive schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The declared fields in report order.
FIELDS = (
    "common_or_generic_name",
    "manufacturer_name",
    "manufacturer_address",
    "packer_name",
    "packer_address",
    "importer_name",
    "importer_address",
    "marketer_name",
    "marketer_address",
    "net_quantity",
    "mrp",
    "date_of_manufacture",
    "consumer_care_contact",
    "country_of_origin",
)
RESPONSIBLE = "responsible_party_name_and_address"
ROLES = ("manufacturer", "packer", "importer", "marketer")

# What a reader may call a field, and the declared field it feeds (None: not used).
READER_FIELDS = {
    "common_name": "common_or_generic_name",
    "manufacturer_name": "manufacturer_name",
    "manufacturer_address": "manufacturer_address",
    "packer_name": "packer_name",
    "packer_address": "packer_address",
    "marketer_name": "marketer_name",
    "marketer_address": "marketer_address",
    "importer_name": "importer_name",
    "importer_address": "importer_address",
    "net_quantity": "net_quantity",
    "mrp": "mrp",
    "manufacture_date": "date_of_manufacture",
    "packing_date": "date_of_manufacture",
    "best_before": None,
    "use_by": None,
    "expiry_date": None,
    "consumer_phone": "consumer_care_contact",
    "consumer_email": "consumer_care_contact",
    "consumer_website": "consumer_care_contact",
    "consumer_address": "consumer_care_contact",
    "country_of_origin": "country_of_origin",
}

STATUSES = ("compliant", "potential_non_compliance", "manual_review_required")
REVIEW_STATES = ("NOT_REVIEWED", "REVIEWED", "APPROVED", "CORRECTION_REQUIRED", "REINSPECTION_REQUIRED")
PENDING_REVIEW = ("NOT_REVIEWED", "CORRECTION_REQUIRED", "REINSPECTION_REQUIRED")
DEFAULT_REVIEW = "NOT_REVIEWED"
DEFAULT_ENGINE_VERSION = "LMPC-ENGINE-1.1"

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
FIELD_VALUE = f"struct<text:string,confidence:double,box:{BOX},source:string>"
FINDING = (
    f"struct<rule_id:string,field:string,status:string,severity:string,confidence:double,box:{BOX},"
    "description:string,source_citation:string,rule_version:string,applicability:string>"
)
QUALITY = "struct<status:string,width:int,height:int,sharpness:double,glare:double,contrast:double,warnings:array<string>>"
CONTEXT = "struct<package_scope:string,commodity_category:string>"

TABLES = {
    "inspections": (
        "inspection_id bigint, uuid string, original_filename string, stored_filename string, mime_type string, file_size_bytes bigint, "
        f"created_at string, overall_status string, extracted_fields map<string,{FIELD_VALUE}>, findings array<{FINDING}>, quality {QUALITY}, "
        "ocr_engine string, ocr_text string, evidence_filename string, processing_error string, rule_engine_version string, "
        f"context {CONTEXT}, orientation_degrees int, ai_summary string, recommendation array<string>, performance map<string,double>, "
        f"original_extracted_fields map<string,{FIELD_VALUE}>, original_overall_status string"
    ),
    "reviews": "seq bigint, inspection_id bigint, review_status string, reviewed_by string, review_notes string, reviewed_at string",
    "corrections": "seq bigint, inspection_id bigint, field string, original_text string, corrected_text string, reason string, actor string, created_at string",
    "audit_events": "seq bigint, inspection_id bigint, event_type string, description string, actor string, created_at string",
    "visual_cache": "image_sha256 string, model string, schema_version string, created_at string, status string, result string, safe_error string, duration_ms double",
    "panel_lines": (
        f"panel_id bigint, line_idx int, text string, confidence double, box {BOX}, "
        f"tokens array<struct<text:string,confidence:double,box:{BOX}>>, block_id string, line_id string, source_pass string"
    ),
    "candidates": (
        "inspection_id bigint, cand_idx int, field string, raw_text string, normalized_value string, readable boolean, model_score double, "
        "nbox struct<ymin:int,xmin:int,ymax:int,xmax:int>, evidence_text string, notes string"
    ),
    "evidence": f"inspection_id bigint, field string, value string, confidence double, box {BOX}",
    "contexts": "inspection_id bigint, package_scope string, commodity_category string, quality_status string, line_count int",
}

DEFAULTS = {"rule_engine_version": DEFAULT_ENGINE_VERSION, "orientation_degrees": 0, "ocr_engine": "unknown"}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order; a column that an older file lacks takes its default or null."""
    have = {c.lower() for c in df.columns}
    return df.select(
        *(
            (F.col(f.name) if f.name.lower() in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name)
            for f in schema(table)
        )
    )


def fields_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(FIELDS)), "ordinal int, field string").select("field", "ordinal")
