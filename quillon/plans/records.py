"""Queries of record views, readings at one place, and reader answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import evaluate, export, lines, records
from ..schemas import FIELDS, RESPONSIBLE
from ..sources import readers
from ..sources import rules as rule_source
from ..sources.tables import read
from .screening import _FINDINGS, _rules_values, _screened, query
from .standins import BOXES, EVIDENCE, frame, plain


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluate(*_screened(spark, sf_dir))


@query(_FINDINGS + " SELECT inspection_id, row_number() OVER (PARTITION BY inspection_id ORDER BY status, ordinal) AS place, rule_id, status FROM findings WHERE status <> 'PASS'")
def verdict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.verdict_reasons(_findings(spark, sf_dir))
    nth = F.row_number().over(Window.partitionBy("inspection_id").orderBy("place", "ordinal"))
    return rows.select("inspection_id", nth.alias("place"), "rule_id", "status")


_ORDER = ", ".join(f"('{f}', {i})" for i, f in enumerate((*FIELDS, RESPONSIBLE)))


@query(
    f"WITH f(field, ordinal) AS (VALUES {_ORDER}) SELECT inspection_id, row_number() OVER (PARTITION BY inspection_id ORDER BY ordinal) AS place, field, value FROM ({plain(EVIDENCE)}) JOIN f USING (field) "
    "WHERE trim(value) <> '' QUALIFY place <= 3"
)
def filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.filled(frame(spark, sf_dir, EVIDENCE, "part"), 3).select("inspection_id", "place", "field", "value")


@query(
    f"SELECT inspection_id, max(value) FILTER (field = 'mrp') AS mrp, max(value) FILTER (field = 'net_quantity') AS net_quantity, max(value) FILTER (field = 'country_of_origin') AS country FROM ({plain(EVIDENCE)}) GROUP BY 1"
)
def values_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.values_only(frame(spark, sf_dir, EVIDENCE, "part")).select("inspection_id", "mrp", "net_quantity", F.col("country_of_origin").alias("country"))


@query(f"WITH rules(ordinal, rule_id, field, pattern, floor, applicability, rule_version) AS (VALUES {_rules_values()}) SELECT rule_id FROM rules WHERE rule_id IN ('LMPC-MRP-001')")
def rule_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.rule_search(rule_source.load_rules(spark), " Retail PRICE ").select("rule_id")


@query(_FINDINGS + f" SELECT f.inspection_id, f.rule_id, CASE WHEN trim(e.value) <> '' THEN e.value END AS evidence_text FROM findings f LEFT JOIN ({plain(EVIDENCE)}) e ON e.inspection_id = f.inspection_id AND e.field = f.field AND f.field <> '{RESPONSIBLE}'")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, _, _ = _screened(spark, sf_dir)
    return records.coverage(_findings(spark, sf_dir), told).select("inspection_id", "rule_id", "evidence_text")


@query(f"SELECT panel, line, CASE WHEN x2 > x1 AND y2 > y1 THEN least(x2, 500) END AS x2, line || ' FAIL' AS label FROM ({plain(BOXES)}) WHERE x1 < 500 AND y1 < 400")
def evidence_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, BOXES, "lineitem").select(
        F.col("panel").alias("inspection_id"), F.col("line").cast("string").alias("rule_id"), F.lit("FAIL").alias("status"), F.struct("x1", "y1", "x2", "y2").alias("box")
    )
    marks = export.evidence_marks(rows, 500, 400)
    return marks.select(F.col("inspection_id").alias("panel"), F.col("rule_id").cast("int").alias("line"), F.col("box.x2").alias("x2"), "label")


@query(f"SELECT panel, line, greatest(x1, x1 + (x2 - x1) * 2 // 10 - 4) AS x1, least(x2, x1 + (x2 - x1) * 6 // 10 + 4) AS x2 FROM ({plain(BOXES)})")
def span_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, BOXES, "lineitem")
    # Shares that binary fractions hold exactly enough: floor of width * k / 10.
    box = geometry.span_box(F.struct("x1", "y1", "x2", "y2"), F.lit(2) + 1e-9, F.lit(6) + 1e-9, F.lit(10.0))
    return rows.select("panel", "line", box.alias("b")).select("panel", "line", "b.x1", "b.x2")


_SCORE = {"same_row": (0.68, 0.96, 0.65), "same_column": (0.60, 0.88, 0.75), "same_block": (0.54, 0.78, 0.70), "nearby": (0.18, 0.62, 0.80)}
_CASES = " ".join(f"WHEN '{k}' THEN greatest({a}, {b} - share * {c})" for k, (a, b, c) in _SCORE.items())


@query(
    "WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN 'same_row' WHEN l_linenumber % 4 = 1 THEN 'same_column' WHEN l_linenumber % 4 = 2 THEN 'same_block' ELSE 'nearby' END AS relation, "
    f"l_partkey % 100 / 100.0 AS share FROM lineitem) SELECT l_orderkey, l_linenumber, relation, CAST(CASE relation {_CASES} END AS DECIMAL(10,6)) AS score FROM r"
)
def relation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    kind = geometry.relation(k == 0, k == 1, k == 2)
    score = geometry.relation_score(kind, F.col("l_partkey") % 100 / 100.0)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("relation"), score.cast("decimal(10,6)").alias("score"))


@query(
    "WITH a AS (SELECT l_orderkey, l_partkey % 3 AS value, count(DISTINCT l_linenumber % 2) AS passes, count(*) AS readings, max(l_quantity) AS confidence FROM lineitem GROUP BY 1, 2) SELECT * FROM a"
)
def pass_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3).alias("value"), (F.col("l_linenumber") % 2).alias("pass"), F.col("l_quantity").alias("confidence"))
    return lines.pass_support(rows, ["l_orderkey"], "value", "pass")


@query(
    "WITH t AS (SELECT user_id, max(value) AS top FROM events GROUP BY 1) SELECT user_id, event_id FROM events e JOIN t USING (user_id) "
    "WHERE e.value >= t.top - 5 AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type <> e.event_type AND r.value >= e.value - 1)"
)
def uncontradicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows near their group's best value that no row of another kind rivals."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    top = F.max("value").over(Window.partitionBy("user_id"))
    rows = events.withColumn("top", top).where("value >= top - 5")
    # A rival of a row near the top lies within 6 of the top: the join needs no more than those rows.
    rivals = events.withColumn("top", top).where("value >= top - 6").select(F.col("user_id").alias("u"), F.col("event_type").alias("t"), F.col("value").alias("v"))
    fights = (F.col("u") == F.col("user_id")) & (F.col("t") != F.col("event_type")) & (F.col("v") >= F.col("value") - 1)
    return rows.join(rivals, fights, "left_anti").select("user_id", "event_id")


@query("SELECT o_custkey, arg_max(o_orderpriority, ROW(o_orderstatus, least(o_orderkey % 900, 500), -o_orderkey)) AS angle FROM orders GROUP BY 1")
def orientation_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    score = F.struct("o_orderstatus", F.least(F.col("o_orderkey") % 900, F.lit(500)).alias("chars"), (-F.col("o_orderkey")).alias("o"))
    return rows.groupBy("o_custkey").agg(F.max_by("o_orderpriority", score).alias("angle"))


@query(
    "WITH a AS (SELECT user_id AS request_id, event_id AS ordinal, event_type AS model, CASE WHEN value >= 200 THEN 'ok' WHEN value < 1 THEN 'stop' WHEN event_type = 'view' THEN 'malformed' ELSE 'transient' END AS outcome FROM events), "
    "o AS (SELECT *, coalesce(sum(CASE WHEN outcome IN ('ok', 'stop') THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM a) "
    "SELECT request_id, arg_max(CASE WHEN outcome IN ('ok', 'stop') THEN outcome ELSE 'exhausted' END, ordinal) AS state, arg_max(model, ordinal) AS model, count(*) AS attempts FROM o WHERE done = 0 GROUP BY 1"
)
def routed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes follow from value, so that each state occurs."""
    outcome = F.expr("CASE WHEN value >= 200 THEN 'ok' WHEN value < 1 THEN 'stop' WHEN event_type = 'view' THEN 'malformed' ELSE 'transient' END")
    rows = read(spark, sf_dir, "events")
    return readers.routed(rows.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("model"), outcome.alias("outcome")))


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 80)")
def uncached_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("image_sha256"), F.col("event_type").alias("model"), F.lit("v1").alias("schema_version"), F.when(F.col("value") > 80, "ok").otherwise("error").alias("status"))
    return readers.uncached(events.select("image_sha256").distinct(), events, "purchase", "v1").select(F.col("image_sha256").cast("long").alias("user_id"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey < 1024 THEN s_suppkey || ' B' ELSE CAST(CAST(s_suppkey / 1024 AS DECIMAL(18,1)) AS VARCHAR) || ' KB' END AS size, 'Net Quantity' AS label, 'INR 5 &lt;b&gt;' AS shown FROM supplier")
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.file_size(F.col("s_suppkey")).alias("size"), text.field_label(F.lit("net_quantity")).alias("label"), text.pdf_text(F.lit("₹5 <b>")).alias("shown"))
