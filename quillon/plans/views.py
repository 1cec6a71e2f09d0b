"""Queries of what a user sees of inspections: history rows, details, counts by state, exports, reports, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, export, image_quality, ledger, lines, records
from ..schemas import RESPONSIBLE, REVIEW_STATES
from ..sources.tables import decode, read
from .screening import _FINDINGS, _STATE, query
from .standins import EVIDENCE, frame, plain

# An order becomes an inspection, its customer's events become reviews and audit entries.  JSON columns arrive as text.
_RAW = """
SELECT o_orderkey AS inspection_id, CASE o_orderkey % 5 WHEN 0 THEN '=sum.png' ELSE o_clerk_file END AS original_filename, date_format(o_orderdate, 'yyyy-MM-dd') AS created_at, o_orderstatus AS overall_status,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'no json' ELSE concat('{{"status": "', CASE o_orderkey % 3 WHEN 0 THEN 'good' ELSE 'review' END, '", "width": 10}}') END AS quality,
  CASE o_orderkey % 3 WHEN 0 THEN '{{"package_scope": "imported"}}' ELSE NULL END AS context,
  concat('{{"mrp": {{"text": "', CAST(o_orderkey AS STRING), '", "confidence": 0.9}}}}') AS extracted_fields,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '{{broken' ELSE concat('{{"mrp": {{"text": "was ', CAST(o_custkey AS STRING), '", "confidence": 0.5}}}}') END AS original_extracted_fields, o_custkey
FROM (SELECT *, concat('file', CAST(o_orderkey AS STRING), '.png') AS o_clerk_file FROM {orders})
"""
_QUALITY = "CASE WHEN o_orderkey % 4 < 2 THEN 'unknown' WHEN o_orderkey % 3 = 0 THEN 'good' ELSE 'review' END"
_SEEN = f"(SELECT user_id, arg_max({_STATE}, event_id) AS st FROM events GROUP BY 1)"


def _inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded inspections with their latest review."""
    raw = frame(spark, sf_dir, _RAW, "orders")
    reviews = read(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"), F.col("event_id").alias("seq"), F.expr(_STATE).alias("review_status"))
    mine = raw.select("inspection_id", "o_custkey")
    return ledger.with_latest(decode(raw).join(mine, "inspection_id"), reviews, "o_custkey", "seq", "review_status")


@query(
    f"SELECT o_orderkey AS inspection_id, CASE WHEN o_orderkey % 5 = 0 THEN '''=sum.png' ELSE 'file' || o_orderkey || '.png' END AS original_filename, strftime(o_orderdate, '%Y-%m-%d') AS created_at, o_orderstatus AS overall_status, "
    f"{_QUALITY} AS quality_status, CASE WHEN o_orderkey % 3 = 0 THEN 'imported' ELSE 'unknown' END AS package_scope, coalesce(st, 'NOT_REVIEWED') AS review_status FROM orders LEFT JOIN {_SEEN} ON user_id = o_custkey"
)
def export_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows as they are exported, file names guarded."""
    return export.history_rows(records.history_item(_inspections(spark, sf_dir)))


@query(f"SELECT {_QUALITY} AS quality_status, count(*) AS n FROM orders GROUP BY 1")
def counts_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.counts_zero_filled(records.history_item(_inspections(spark, sf_dir)), "quality_status", ("good", "review", "unknown"))


@query(
    "SELECT k AS review_status, sum(n)::BIGINT AS n FROM (SELECT coalesce(st, 'NOT_REVIEWED') AS k, count(*) AS n FROM orders "
    f"LEFT JOIN {_SEEN} ON user_id = o_custkey GROUP BY 1 UNION ALL SELECT v, 0 FROM (VALUES ('NOT_REVIEWED'), ('REVIEWED'), ('APPROVED'), ('CORRECTION_REQUIRED'), ('REINSPECTION_REQUIRED')) AS d(v)) GROUP BY 1"
)
def counts_by_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.counts_zero_filled(_inspections(spark, sf_dir), "review_status", REVIEW_STATES)


@query(
    "SELECT o_orderkey AS inspection_id, o_orderkey::VARCHAR AS shown, CASE WHEN o_orderkey % 4 > 1 THEN 'was ' || o_custkey END AS original FROM orders"
)
def decoded_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON columns decoded; broken or missing original fields are null."""
    rows = decode(frame(spark, sf_dir, _RAW, "orders"))
    at = lambda c: F.try_element_at(c, F.lit("mrp"))["text"]
    return rows.select("inspection_id", at(F.col("extracted_fields")).alias("shown"), at(F.col("original_extracted_fields")).alias("original"))


@query(
    "WITH c AS (SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (WHERE event_type IN ('click', 'view')) AS fixes, string_agg(event_id || ':' || event_type, ',' ORDER BY event_id) AS trail, "
    f"arg_max({_STATE}, event_id) AS st FROM events GROUP BY 1) SELECT c_custkey AS inspection_id, coalesce(st, 'NOT_REVIEWED') AS review_status, coalesce(fixes, '') AS corrections, coalesce(trail, '') AS audit FROM customer LEFT JOIN c ON user_id = c_custkey"
)
def inspection_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each inspection with its latest review, its corrections and its audit trail."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("inspection_id"), F.col("event_id").alias("seq"), "event_type")
    reviews = events.select("inspection_id", "seq", F.expr(_STATE).alias("review_status"), F.lit("someone").alias("reviewed_by"), F.lit("").alias("reviewed_at"))
    fixes = events.where(F.col("event_type").isin("click", "view")).select("inspection_id", "seq")
    rows = records.detail(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("inspection_id")), reviews, fixes, events)
    told = lambda c, f: F.array_join(F.transform(c, f), ",")
    return rows.select(
        "inspection_id",
        "review_status",
        told("corrections", lambda x: x["seq"].cast("string")).alias("corrections"),
        told("audit", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["event_type"])).alias("audit"),
    )


# Roles of a part: some have a name, some an address, some both.
_PARTIES = """
SELECT p_partkey AS inspection_id, 'manufacturer_name' AS field, p_brand AS value, 0.9 AS confidence FROM {part}
UNION ALL SELECT p_partkey, 'manufacturer_address', CASE WHEN p_partkey % 3 = 0 THEN 'Plot 1' ELSE ' ' END, 0.7 FROM {part} WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'importer_name', p_type, 0.8 FROM {part} WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 'importer_address', 'Dock 2', CASE WHEN p_partkey % 7 = 0 THEN 0.95 ELSE 0.75 END FROM {part} WHERE p_partkey % 4 <> 1
UNION ALL SELECT p_partkey, 'marketer_address', 'Lane 3', 0.99 FROM {part}
"""


@query(
    f"WITH e AS ({plain(_PARTIES)}), r AS (SELECT inspection_id, regexp_extract(field, '^(.*)_(name|address)$', 1) AS role, max(value) FILTER (field LIKE '%_name') AS name, max(value) FILTER (field LIKE '%_address') AS address, min(confidence) AS sure "
    "FROM e WHERE trim(value) <> '' GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY inspection_id ORDER BY sure DESC, CASE role WHEN 'manufacturer' THEN 0 WHEN 'packer' THEN 1 WHEN 'importer' THEN 2 ELSE 3 END) AS k "
    "FROM r WHERE name IS NOT NULL AND address IS NOT NULL) "
    f"SELECT p_partkey AS inspection_id, '{RESPONSIBLE}' AS field, name || ', ' || address AS value, CAST(coalesce(sure, 0) AS DECIMAL(6,3)) AS confidence FROM part LEFT JOIN b ON inspection_id = p_partkey AND k = 1"
)
def responsible_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = frame(spark, sf_dir, _PARTIES, "part").withColumn("confidence", F.col("confidence").cast("double")).withColumn("box", F.expr("CAST(NULL AS STRUCT<x1:INT,y1:INT,x2:INT,y2:INT>)"))
    return evaluate.responsible_party(told).select("inspection_id", "field", "value", F.col("confidence").cast("decimal(6,3)").alias("confidence"))


@query(
    f"WITH e AS ({plain(_PARTIES)}), r AS (SELECT inspection_id, regexp_extract(field, '^(.*)_(name|address)$', 1) AS role, "
    "max(value) FILTER (field LIKE '%_name') AS name, max(value) FILTER (field LIKE '%_address') AS address FROM e WHERE trim(value) <> '' GROUP BY 1, 2), "
    "b AS (SELECT inspection_id, arg_min(name || ', ' || address, CASE role WHEN 'manufacturer' THEN 0 WHEN 'packer' THEN 1 WHEN 'importer' THEN 2 ELSE 3 END) AS value FROM r WHERE name IS NOT NULL AND address IS NOT NULL GROUP BY 1) "
    f"SELECT p_partkey AS inspection_id, value AS evidence_text FROM part LEFT JOIN b ON inspection_id = p_partkey"
)
def coverage_of_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that the derived field rests on: the first role with a name and an address."""
    told = frame(spark, sf_dir, _PARTIES, "part")
    findings = told.select("inspection_id").distinct().withColumns({"field": F.lit(RESPONSIBLE), "rule_id": F.lit("any")})
    return records.coverage(findings, told).select("inspection_id", "evidence_text")


@query(
    _FINDINGS + ", told AS (SELECT inspection_id, field, CASE WHEN inspection_id % 2 = 0 THEN 'VALIDATED' ELSE 'CONFLICT' END AS state FROM evidence WHERE field = 'mrp' AND inspection_id % 3 <> 0) "
    "SELECT e.inspection_id, e.field, coalesce(state, 'MISSING') AS state FROM evidence e LEFT JOIN told t ON t.inspection_id = e.inspection_id AND t.field = e.field"
)
def verified_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's section on verification."""
    told = frame(spark, sf_dir, EVIDENCE, "part").select("inspection_id", "field", "value")
    state = F.when(F.col("inspection_id") % 2 == 0, "VALIDATED").otherwise("CONFLICT")
    known = told.where("field = 'mrp' AND inspection_id % 3 <> 0").select("inspection_id", "field", state.alias("state"), F.lit(False).alias("review_required"))
    return records.with_provenance(told, known).select("inspection_id", "field", "state")


@query(
    "WITH w AS (SELECT l_orderkey, l_linenumber, l_comment_text AS text, string_split(l_comment_text, ' ') AS words, l_partkey % 900 AS x1, l_partkey % 900 + 20 + l_linenumber * 7 AS x2 FROM "
    "(SELECT *, l_returnflag || ' ' || l_linestatus || l_partkey || ' ' || l_suppkey AS l_comment_text FROM lineitem)), "
    "u AS (SELECT l_orderkey, l_linenumber, text, x1, x2, words, unnest(range(1, len(words) + 1)) AS k FROM w), "
    "p AS (SELECT *, coalesce(list_sum(list_transform(words[1:k - 1], lambda x: length(x) + 1)), 0) AS off FROM u) "
    "SELECT l_orderkey, l_linenumber, k::INT AS place, words[k] AS word, (x1 + floor((x2 - x1) * off / length(text)))::INT AS x1, (x1 + floor((x2 - x1) * (off + length(words[k])) / length(text)))::INT AS x2 FROM p"
)
def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a line that came with one box, each with its share of it."""
    text = F.concat("l_returnflag", F.lit(" "), "l_linestatus", F.col("l_partkey").cast("string"), F.lit(" "), F.col("l_suppkey").cast("string"))
    left = (F.col("l_partkey") % 900).cast("int")
    box = F.struct(left.alias("x1"), F.lit(0).alias("y1"), (left + 20 + F.col("l_linenumber") * 7).cast("int").alias("x2"), F.lit(9).alias("y2"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"), box.alias("box"))
    told = rows.select("l_orderkey", "l_linenumber", F.posexplode(lines.tokens_of(F.col("text"), F.lit(0.9), F.col("box"))).alias("place", "t"))
    return told.select("l_orderkey", "l_linenumber", (F.col("place") + 1).alias("place"), F.col("t.text").alias("word"), "t.box.x1", "t.box.x2")


@query(
    "SELECT p_partkey::VARCHAR AS path, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'BMP' ELSE 'PNG' END AS format, CASE WHEN p_partkey % 6 IN (0, 5) THEN NULL ELSE p_partkey * 11 END AS width, CASE WHEN p_partkey % 6 IN (0, 5) THEN NULL ELSE 2000 END AS height, "
    "CASE WHEN p_partkey % 6 = 0 THEN 'not_an_image' WHEN p_partkey % 6 = 5 OR p_partkey = 0 THEN 'undecodable' WHEN p_partkey * 11 * 2000 > 40000000 THEN 'too_many_pixels' END AS reject_reason FROM part WHERE p_partkey > 0"
)
def image_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads by their first bytes, and by the size that their headers tell."""
    number = F.lpad(F.hex(F.col("p_partkey") * 11), 8, "0")
    turned = F.concat(*(F.substring(number, i, 2) for i in (7, 5, 3, 1)))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number, F.lit("000007D00802000000"))
    bmp = F.concat(F.lit("424D0000000000000000360000002800" + "0000"), turned, F.lit("D0070000010018"))
    k = F.col("p_partkey") % 6
    content = F.unhex(F.when(k == 0, "0102030405060708").when(k == 1, bmp).when(k == 5, "89504E470D0A1A0A00").otherwise(png))
    files = read(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"))
    out = image_quality.admitted(files.withColumn("length", F.length("content").cast("long")))
    return out.select("path", "format", F.col("width").cast("long").alias("width"), F.col("height").alias("height"), "reject_reason")
