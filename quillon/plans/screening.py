"""Queries of the screening engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, geometry, text
from ..operators import corrections as fixes
from ..operators import evaluate, ledger, limiter, lines, reconcile
from ..operators.panel import shapes
from ..schemas import FIELDS
from ..sources import rules as rule_source
from ..sources.tables import read
from .standins import BOXES, CONTEXTS, CORRECTIONS, EVIDENCE, frame, plain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _iso(ts: str) -> F.Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


# ---------------------------------------------------------------- counts and latest state


@query("SELECT k AS o_orderstatus, sum(n)::BIGINT AS n FROM (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT v, 0 FROM (VALUES ('F'), ('O'), ('X')) AS d(v)) GROUP BY 1")
def status_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.counts_zero_filled(read(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O", "X"))


@query("SELECT day, n FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14) ORDER BY 1")
def daily_counts_last14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.daily_counts(read(spark, sf_dir, "events").select(_iso("ts").alias("created_at")), "created_at")


@query(
    "WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14) "
    "SELECT day, n, max(n) OVER () AS top, CAST(round(n::DECIMAL(20,6) / sum(n) OVER (), 4) AS DECIMAL(10,4)) AS share FROM d"
)
def daily_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.shares(daily_counts_last14(spark, sf_dir))


@query("SELECT least(count(*), 500) AS total_inspections, 500 AS sample_limit, count(*) < 500 AS is_complete_history FROM orders")
def analytics_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.totals(read(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT count(*) AS n_rows FROM orders")
def health_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").agg(F.count("*").alias("n_rows"))


@query(
    "SELECT c_custkey, coalesce(e.event_type, 'NOT_REVIEWED') AS state, e.event_id AS seq FROM customer "
    "LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1) e ON e.user_id = c_custkey"
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return ledger.with_latest(read(spark, sf_dir, "customer").select("c_custkey"), events, "c_custkey", "seq", "state")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 77 OR 'ORD-' || o_orderkey = '77'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("ORD-"), "o_orderkey").alias("uuid"))
    return ledger.point_lookup(rows, "77", "o_orderkey").drop("uuid")


# ---------------------------------------------------------------- history and queue


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", _iso("o_orderdate").alias("created_at"))


_ISO_SQL = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"


@query(
    f"SELECT o_orderkey, o_orderstatus, {_ISO_SQL} AS created_at FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 500) "
    f"WHERE o_orderstatus = 'O' AND {_ISO_SQL} >= '1995' AND {_ISO_SQL} <= '1998-06-30T23:59:59'"
)
def history_limit_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.history(_orders(spark, sf_dir), "o_orderkey", equal={"o_orderstatus": "O", "o_orderpriority": ""}, created="created_at", created_from="1995", created_to="1998-06-30T23:59:59")
    return rows.select("o_orderkey", "o_orderstatus", "created_at")


@query(
    "SELECT o_orderkey, o_orderpriority, c_name FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 500) o JOIN customer ON c_custkey = o_custkey "
    "WHERE contains(lower(concat_ws(' ', o_orderkey, o_orderpriority, c_name)), 'urgent customer#')"
)
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = ledger.newest(_orders(spark, sf_dir), "o_orderkey")
    rows = recent.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    found = ledger.history(rows, "o_orderkey", text=ledger.search_text(F.col("o_orderkey"), F.col("o_orderpriority"), F.col("c_name")), search=" URGENT customer# ")
    return found.select("o_orderkey", "o_orderpriority", "c_name")


_STATE = "CASE event_type WHEN 'click' THEN 'REVIEWED' WHEN 'view' THEN 'CORRECTION_REQUIRED' WHEN 'purchase' THEN 'APPROVED' ELSE 'REINSPECTION_REQUIRED' END"


@query(
    f"WITH s AS (SELECT user_id, arg_max({_STATE}, event_id) AS st FROM events GROUP BY 1), "
    "o AS (SELECT o_orderkey, o_orderstatus, coalesce(st, 'NOT_REVIEWED') AS review_status FROM orders LEFT JOIN s ON user_id = o_custkey ORDER BY o_orderkey DESC LIMIT 500) "
    "SELECT * FROM o WHERE o_orderstatus = 'P' OR review_status IN ('NOT_REVIEWED', 'CORRECTION_REQUIRED', 'REINSPECTION_REQUIRED') ORDER BY o_orderkey DESC LIMIT 100"
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"), F.col("event_id").alias("seq"), F.expr(_STATE).alias("review_status"))
    recent = ledger.newest(_orders(spark, sf_dir), "o_orderkey")
    rows = ledger.with_latest(recent, events, "o_custkey", "seq", "review_status")
    return ledger.review_queue(rows, "o_orderkey", "o_orderstatus", "review_status", 100, manual="P").select("o_orderkey", "o_orderstatus", "review_status")


@query(
    "SELECT o_orderkey, count(l_linenumber) AS n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_quantity), '') AS lines "
    "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def nested_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    rows = ledger.nested(read(spark, sf_dir, "orders").select("o_orderkey"), items, "o_orderkey", ["l_linenumber", "l_partkey"], "lines")
    told = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return rows.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), told.alias("lines"))


# ---------------------------------------------------------------- cache


@query("SELECT user_id, event_type, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def cache_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), "value")
    old, new = rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")
    return ledger.cache_get(ledger.cache_put(old, new), ["user_id", "event_type"], "seq").select("user_id", "event_type", "seq", "value")


@query(
    "WITH r(event_type, ordinal) AS (VALUES ('purchase', 0), ('click', 1), ('view', 2)), c AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60) "
    "SELECT user_id, arg_min(event_type, ordinal) AS model, min(ordinal) AS ordinal FROM c JOIN r USING (event_type) GROUP BY 1"
)
def cache_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    models = ledger.route(["purchase", "click", " ", "purchase", "view"])
    path = spark.createDataFrame([(m, i) for i, m in enumerate(models)], "event_type string, ordinal int")
    cache = events.where("value > 60").select("user_id", "event_type").distinct()
    return ledger.first_hit(events.select("user_id").distinct(), path, cache, "user_id", "event_type", "ordinal").select("user_id", F.col("event_type").alias("model"), "ordinal")


# ---------------------------------------------------------------- rules and verdicts


@query(
    "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'N') AS uncertain, "
    "CASE WHEN bool_or(l_returnflag = 'R') THEN 'potential_non_compliance' WHEN bool_or(l_returnflag = 'N') THEN 'manual_review_required' ELSE 'compliant' END AS overall_status "
    "FROM lineitem GROUP BY 1"
)
def conditional_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "N", "UNCERTAIN").otherwise("PASS")
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("inspection_id"), status.alias("status"))
    contexts = items.select("inspection_id").distinct().withColumns({"quality_status": F.lit("good"), "line_count": F.lit(1)})
    return evaluate.verdicts(items, contexts).select(F.col("inspection_id").alias("l_orderkey"), "failed", "uncertain", "overall_status")


def _rules_values() -> str:
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    rows = [(i, r["rule_id"], r["field"], r["pattern"] if r["check_type"] == "presence_and_pattern" else None, r["confidence_floor"], r.get("applicability"), r["rule_version"]) for i, r in enumerate(rule_source.default_rules())]
    return ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows)


_FINDINGS = f"""
WITH rules(ordinal, rule_id, field, pattern, floor, applicability, rule_version) AS (VALUES {_rules_values()}),
evidence AS ({plain(EVIDENCE)}), contexts AS ({plain(CONTEXTS)}),
rows AS (
  SELECT c.inspection_id, r.*, e.value, coalesce(e.confidence, 0) AS conf, trim(coalesce(e.value, '')) = '' AS missing,
    CASE WHEN package_scope IN ('domestic', 'imported') THEN package_scope ELSE 'unknown' END AS scope, coalesce(applicability = 'imported_goods_only', false) AS imported
  FROM contexts c CROSS JOIN rules r LEFT JOIN evidence e ON e.inspection_id = c.inspection_id AND e.field = r.field
),
findings AS (
  SELECT inspection_id, rule_id, field, CASE WHEN missing OR conf < floor THEN 'UNCERTAIN' WHEN pattern IS NULL OR regexp_matches(trim(value), pattern, 'i') THEN 'PASS' ELSE 'FAIL' END AS status,
    'MAJOR' AS severity, CAST(conf AS DECIMAL(6,3)) AS confidence, rule_version,
    CASE WHEN imported AND scope = 'unknown' AND missing THEN 'unknown' WHEN imported THEN 'imported' ELSE 'all' END AS applicability, ordinal
  FROM rows WHERE NOT (imported AND scope = 'domestic')
)"""


def _screened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    told = frame(spark, sf_dir, EVIDENCE, "part").withColumn("box", F.expr(geometry.NO_BOX)).withColumn("confidence", F.col("confidence").cast("double"))
    contexts = frame(spark, sf_dir, CONTEXTS, "part")
    return told, contexts, rule_source.load_rules(spark)


@query(_FINDINGS + " SELECT inspection_id, rule_id, field, status, severity, confidence, rule_version, applicability FROM findings")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.evaluate(*_screened(spark, sf_dir))
    return found.select("inspection_id", "rule_id", "field", "status", "severity", F.col("confidence").cast("decimal(6,3)").alias("confidence"), "rule_version", "applicability")


_VERDICTS = """, counted AS (SELECT inspection_id, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'UNCERTAIN') AS uncertain, count(*) FILTER (status = 'PASS') AS passed FROM findings GROUP BY 1),
verdicts AS (SELECT inspection_id, CASE WHEN failed > 0 THEN 'potential_non_compliance' WHEN uncertain > 0 OR quality_status <> 'good' OR line_count = 0 THEN 'manual_review_required' ELSE 'compliant' END AS overall_status,
  failed, uncertain, passed FROM contexts JOIN counted USING (inspection_id))"""


@query(_FINDINGS + _VERDICTS + " SELECT * FROM verdicts")
def rule_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, contexts, rules = _screened(spark, sf_dir)
    return evaluate.verdicts(evaluate.evaluate(told, contexts, rules), contexts)


@query(_FINDINGS + _VERDICTS + " SELECT overall_status, count(*) AS n, sum(failed)::BIGINT AS failed FROM verdicts GROUP BY 1")
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_verdict(spark, sf_dir).groupBy("overall_status").agg(F.count("*").alias("n"), F.sum("failed").alias("failed"))


@query(
    _FINDINGS + ", open AS (SELECT inspection_id, string_agg(CASE WHEN status = 'UNCERTAIN' THEN replace(field, '_', ' ') END, ', ' ORDER BY ordinal) AS u, "
    "string_agg(CASE WHEN status = 'FAIL' THEN replace(field, '_', ' ') END, ', ' ORDER BY ordinal) AS f FROM findings GROUP BY 1)"
    + _VERDICTS
    + " SELECT inspection_id, overall_status, CASE overall_status WHEN 'potential_non_compliance' THEN 'Declarations failed their format check: ' || f || '.' "
    "WHEN 'manual_review_required' THEN 'Evidence is missing or uncertain: ' || coalesce(u, 'image quality') || '.' ELSE 'All checked declarations are present in a recognised form.' END AS explanation "
    "FROM verdicts JOIN open USING (inspection_id)"
)
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, contexts, rules = _screened(spark, sf_dir)
    found = evaluate.evaluate(told, contexts, rules)
    return evaluate.explanations(found, evaluate.verdicts(found, contexts)).select("inspection_id", "overall_status", "explanation")


@query(f"WITH rules(ordinal, rule_id, field, pattern, floor, applicability, rule_version) AS (VALUES {_rules_values()}) SELECT rule_id, field, 'MAJOR' AS severity, coalesce(applicability, 'all') AS applicability, rule_version FROM rules")
def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_source.catalogue(rule_source.load_rules(spark)).select("rule_id", "field", "severity", "applicability", "rule_version")


_LATEST_FIX = f"SELECT inspection_id, field, arg_max(trim(corrected_text), seq) AS fixed FROM ({plain(CORRECTIONS)}) WHERE field <> 'colour' AND trim(corrected_text) <> '' GROUP BY 1, 2"


@query(
    f"SELECT coalesce(e.inspection_id, c.inspection_id) AS inspection_id, coalesce(e.field, c.field) AS field, coalesce(fixed, value) AS value, "
    f"CAST(CASE WHEN fixed IS NOT NULL THEN 1 ELSE confidence END AS DECIMAL(6,3)) AS confidence, CASE WHEN fixed IS NOT NULL THEN 'human_correction' ELSE 'reader' END AS source, value AS original_value "
    f"FROM ({plain(EVIDENCE)}) e FULL JOIN ({_LATEST_FIX}) c ON c.inspection_id = e.inspection_id AND c.field = e.field"
)
def correction_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, _, _ = _screened(spark, sf_dir)
    changes = frame(spark, sf_dir, CORRECTIONS, "events")
    return fixes.overlay(told, changes).select("inspection_id", "field", "value", F.col("confidence").cast("decimal(6,3)").alias("confidence"), "source", "original_value")


_OVERLAID = (
    "SELECT coalesce(e.inspection_id, c.inspection_id) AS inspection_id, coalesce(e.field, c.field) AS field, coalesce(fixed, value) AS value, CASE WHEN fixed IS NOT NULL THEN 1 ELSE confidence END AS confidence "
    f"FROM ({plain(EVIDENCE)}) e FULL JOIN ({_LATEST_FIX}) c ON c.inspection_id = e.inspection_id AND c.field = e.field"
)


def _verdicts_of(evidence: str) -> str:
    return _FINDINGS.replace(plain(EVIDENCE), evidence) + _VERDICTS + " SELECT inspection_id, overall_status FROM verdicts"


@query(
    f"SELECT a.inspection_id, a.overall_status, b.overall_status AS original_overall_status FROM ({_verdicts_of(_OVERLAID)}) a JOIN ({_verdicts_of(plain(EVIDENCE))}) b USING (inspection_id) "
    f"WHERE inspection_id IN (SELECT inspection_id FROM ({_LATEST_FIX}))"
)
def correction_reevaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, contexts, rules = _screened(spark, sf_dir)
    return fixes.reevaluate(told, frame(spark, sf_dir, CORRECTIONS, "events"), contexts, rules)


# ---------------------------------------------------------------- grouping of readings


@query("SELECT user_id, event_type, count(DISTINCT floor(value)) AS n_values, count(*) AS n_rows, CASE WHEN count(DISTINCT floor(value)) > 1 THEN 'CONFLICT' ELSE 'ACCEPTED' END AS state FROM events GROUP BY 1, 2")
def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.conflicts(read(spark, sf_dir, "events").withColumn("key", F.floor("value")), ["user_id", "event_type"], "key")


@query("SELECT user_id, value, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.best(read(spark, sf_dir, "events").select("user_id", "value", "event_id", "event_type"), ["user_id"], "value", "event_id")


@query(
    "WITH k AS (SELECT user_id, event_type, min(event_id) AS pos, max(value) AS score FROM events GROUP BY 1, 2) "
    "SELECT user_id, string_agg(event_type, ', ' ORDER BY pos) AS channels, min(score) AS score FROM k GROUP BY 1"
)
def merge_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), F.col("event_type").alias("channels"), F.col("value").alias("score"), "event_id")
    return reconcile.merge_channels(rows, ["user_id"], "key", "channels", "score", "event_id")


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY pos) AS types FROM f GROUP BY 1")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    rows = first.groupBy("user_id").agg(F.collect_list(F.struct("at", "event_type")).alias("seen"))
    return rows.select("user_id", F.array_join(text.ordered_distinct(F.col("seen"), "at", "event_type"), ",").alias("types"))


@query(
    "WITH v AS (SELECT user_id, event_type, count(DISTINCT event_id % 3) AS passes, count(*) AS readings, max(value) AS confidence FROM events GROUP BY 1, 2), "
    "n AS (SELECT *, row_number() OVER w AS k, lead(passes) OVER w AS p2, lead(readings) OVER w AS r2 FROM v WINDOW w AS (PARTITION BY user_id ORDER BY passes DESC, readings DESC, confidence DESC, event_type)) "
    "SELECT user_id, CASE WHEN passes = p2 AND readings = r2 THEN NULL ELSE event_type END AS event_type, passes, readings FROM n WHERE k = 1"
)
def malformed_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 3).alias("pass"), F.col("value").alias("confidence"))
    return lines.malformed_vote(rows, ["user_id"], "event_type", "pass")


@query(
    "SELECT event_type, 'a' AS pass, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 "
    "UNION ALL SELECT event_type, 'b', count(*) FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'view') GROUP BY 1"
)
def union_all_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes that split all events by type: each event is in one of them."""
    events = read(spark, sf_dir, "events").select("event_type")
    first = F.coalesce(F.col("event_type").isin("click", "view"), F.lit(False))
    both = events.where(first).withColumn("pass", F.lit("a")).unionByName(events.where(~first).withColumn("pass", F.lit("b")))
    return both.groupBy("event_type", "pass").agg(F.count("*").alias("n"))


@query(
    "WITH seen AS (SELECT user_id, list(DISTINCT event_type) AS t FROM events WHERE value > 90 GROUP BY 1) "
    "SELECT user_id, array_to_string(list_filter(['click', 'view', 'purchase', 'signup', 'logout'], lambda x: NOT list_contains(t, x)), ',') AS missing FROM seen"
)
def array_except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "events").where("value > 90").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    wanted = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "logout")))
    return seen.select("user_id", F.array_join(F.array_except(wanted, "t"), ",").alias("missing"))


# ---------------------------------------------------------------- geometry


@query(f"SELECT panel, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM ({plain(BOXES)}) GROUP BY 1")
def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, BOXES, "lineitem").select("panel", F.struct("x1", "y1", "x2", "y2").alias("box"))
    return rows.groupBy("panel").agg(geometry.union_of(F.col("box")).alias("box")).select("panel", "box.*")


_PX = "greatest(0, least({size}, CAST(round_even({v}::DECIMAL(20,4) * {size} / 1000, 0) AS INT)))"


@query(
    "WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 1000 AS INT) AS xmin, CAST(l_suppkey % 1000 AS INT) AS ymin, CAST(l_partkey % 1000 + l_quantity - 10 AS INT) AS xmax, CAST(l_suppkey % 1000 + 30 AS INT) AS ymax FROM lineitem), "
    f"p AS (SELECT l_orderkey, l_linenumber, {_PX.format(v='xmin', size=2000)} AS x1, {_PX.format(v='ymin', size=1000)} AS y1, {_PX.format(v='xmax', size=2000)} AS x2, {_PX.format(v='ymax', size=1000)} AS y2 FROM b) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN x2 > x1 AND y2 > y1 THEN x1 END AS x1, CASE WHEN x2 > x1 AND y2 > y1 THEN y1 END AS y1, CASE WHEN x2 > x1 AND y2 > y1 THEN x2 END AS x2, CASE WHEN x2 > x1 AND y2 > y1 THEN y2 END AS y2 FROM p"
)
def normalised_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = lambda e: F.expr(e).cast("int")
    box = geometry.to_pixels(i("l_suppkey % 1000"), i("l_partkey % 1000"), i("l_suppkey % 1000 + 30"), i("l_partkey % 1000 + l_quantity - 10"), F.lit(2000), F.lit(1000))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "b.x1", "b.y1", "b.x2", "b.y2")


@query(
    f"SELECT panel, line, CASE line % 4 WHEN 1 THEN y1 WHEN 2 THEN 2000 - x2 WHEN 3 THEN 2000 - y2 ELSE x1 END AS x1, CASE line % 4 WHEN 1 THEN 1500 - x2 WHEN 2 THEN 1500 - y2 WHEN 3 THEN x1 ELSE y1 END AS y1 FROM ({plain(BOXES)})"
)
def turned_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, BOXES, "lineitem")
    box = geometry.to_original(F.struct("x1", "y1", "x2", "y2"), (F.col("line") % 4) * 90, F.lit(2000), F.lit(1500))
    return rows.select("panel", "line", box.alias("b")).select("panel", "line", "b.x1", "b.y1")


_NEAR = (
    f"WITH b AS ({plain(BOXES)}), d AS (SELECT l.panel, l.line, r.line AS label, (l.x1 + l.x2 - r.x1 - r.x2) * (l.x1 + l.x2 - r.x1 - r.x2) + (l.y1 + l.y2 - r.y1 - r.y2) * (l.y1 + l.y2 - r.y1 - r.y2) AS distance "
    "FROM b l JOIN b r ON l.panel = r.panel WHERE l.line % 2 = 0 AND r.line % 2 = 1) "
)


@query(_NEAR + "SELECT panel, line, arg_min(label, distance * 100 + label) AS label, min(distance)::BIGINT AS distance FROM d WHERE distance <= 4000000 GROUP BY 1, 2")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = frame(spark, sf_dir, BOXES, "lineitem")
    mid = lambda df, p: df.select("panel", F.col("line").alias(p), (F.col("x1") + F.col("x2")).alias(p + "x"), (F.col("y1") + F.col("y2")).alias(p + "y"))
    left, right = mid(b.where("line % 2 = 0"), "line"), mid(b.where("line % 2 = 1"), "label")
    square = lambda a, c: (F.col(a) - F.col(c)) * (F.col(a) - F.col(c))
    distance = (square("linex", "labelx") + square("liney", "labely")).cast("long")
    return lines.nearest(left, right, ["panel"], distance, ["line"], ["label"], F.lit(4_000_000)).select("panel", "line", "label", "distance")


@query(_NEAR + ", m AS (SELECT *, min(distance) OVER (PARTITION BY panel, label) AS least FROM d) SELECT panel, line, label, distance::BIGINT AS distance FROM m WHERE distance * 100 <= least * 115")
def nearest_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = frame(spark, sf_dir, BOXES, "lineitem")
    l, r = b.where("line % 2 = 0").alias("l"), b.where("line % 2 = 1").alias("r")
    square = lambda a, c: (F.col(f"l.{a}") + F.col(f"l.{c}") - F.col(f"r.{a}") - F.col(f"r.{c}"))
    d = (square("x1", "x2") * square("x1", "x2") + square("y1", "y2") * square("y1", "y2")).cast("long")
    pairs = l.join(r, F.col("l.panel") == F.col("r.panel")).select("l.panel", "l.line", F.col("r.line").alias("label"), d.alias("distance"))
    least = F.min("distance").over(Window.partitionBy("panel", "label"))
    return pairs.withColumn("least", least).where("distance * 100 <= least * 115").drop("least")


@query(f"WITH b AS ({plain(BOXES)}) SELECT panel, line FROM b WHERE NOT EXISTS (SELECT 1 FROM b r WHERE r.panel = b.panel AND r.line < b.line AND abs(r.x1 - b.x1) <= greatest(50, r.x1 // 8) AND abs(r.y1 - b.y1) <= 200)")
def region_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = frame(spark, sf_dir, BOXES, "lineitem")
    r = b.select(F.col("panel").alias("p"), F.col("line").alias("k"), F.col("x1").alias("rx"), F.col("y1").alias("ry"))
    near = (F.abs(F.col("rx") - F.col("x1")) <= F.greatest(F.lit(50), F.floor(F.col("rx") / 8))) & (F.abs(F.col("ry") - F.col("y1")) <= 200)
    return b.join(r, (F.col("panel") == F.col("p")) & (F.col("k") < F.col("line")) & near, "left_anti").select("panel", "line")


@query(
    f"WITH b AS (SELECT panel, line, x1 + x2 AS c FROM ({plain(BOXES)})), d AS (SELECT DISTINCT panel, c FROM b), w AS (SELECT panel, c, CASE WHEN c - lag(c) OVER (PARTITION BY panel ORDER BY c) > 300 THEN 1 ELSE 0 END AS wide FROM d), "
    "n AS (SELECT panel, c, sum(wide) OVER (PARTITION BY panel ORDER BY c)::BIGINT AS col FROM w) SELECT panel, line, col FROM b JOIN n USING (panel, c)"
)
def column_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = frame(spark, sf_dir, BOXES, "lineitem").select("panel", "line", (F.col("x1") + F.col("x2")).alias("c"))
    return lines.columns_by_gap(b, ["panel"], "c", F.lit(300), "col").select("panel", "line", "col")


# ---------------------------------------------------------------- words, sessions, limits


@query(
    "WITH g AS (SELECT user_id, event_id, epoch(ts) AS t, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) "
    "SELECT user_id, event_id, sum(CASE WHEN gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id)::BIGINT AS session FROM g"
)
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return lines.gap_sessions(rows, ["user_id"], ["t", "event_id"], F.col("t"), F.col("t"), F.lit(3600)).select("user_id", "event_id", "session")


@query(
    f"WITH b AS (SELECT panel, line, x1, y1, x2, y2, avg(y2 - y1) OVER (PARTITION BY panel) AS h, x1 - lag(x2) OVER (PARTITION BY panel ORDER BY x1, line) AS gap FROM ({plain(BOXES)})), "
    "s AS (SELECT *, sum(CASE WHEN gap > greatest(35, h * 2.2) THEN 1 ELSE 0 END) OVER (PARTITION BY panel ORDER BY x1, line) AS line_no FROM b) "
    "SELECT panel, line_no::BIGINT AS line_no, string_agg('w' || line, ' ' ORDER BY x1, line) AS text, min(x1) AS x1, max(x2) AS x2 FROM s GROUP BY 1, 2"
)
def words_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = frame(spark, sf_dir, BOXES, "lineitem").withColumn("word_idx", F.col("line")).withColumn("text", F.concat(F.lit("w"), "line")).withColumn("confidence", F.lit(0.9))
    return lines.words_to_lines(words, ["panel"]).select("panel", "line_no", "text", "x1", "x2")


def _limited_sql(limit: int, window: int, evicts: str) -> str:
    """The decisions, one attempt of each user after the other."""
    return f"""
WITH RECURSIVE a AS (SELECT user_id, event_id AS seq, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT user_id, n, t, seq, true AS accepted, [t] AS held, NULL::INT AS retry_after FROM a WHERE n = 1
  UNION ALL
  SELECT user_id, n, t, seq, len(k) < {limit}, CASE WHEN len(k) < {limit} THEN list_append(k, t) ELSE k END,
    CASE WHEN len(k) >= {limit} THEN greatest(1, ceil({window} - (t - k[1])))::INT END
  FROM (SELECT a.*, list_filter(r.held, lambda x: NOT (a.t - x {evicts} {window})) AS k FROM r JOIN a ON a.user_id = r.user_id AND a.n = r.n + 1)
)
SELECT user_id, t AS ts, seq, accepted, len(held)::INT AS used, retry_after FROM r"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_id").alias("seq"))


@query(_limited_sql(2, 36_000, ">="))
def sliding_log_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiter.decide(_attempts(spark, sf_dir), "user_id", "ts", "seq", limit=2, window=36_000.0)


@query(_limited_sql(3, 7200, ">"))
def limiter_keeping_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiter.decide(_attempts(spark, sf_dir), "user_id", "ts", "seq", limit=3, window=7200.0, keep_edge=True)


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return rows.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


# ---------------------------------------------------------------- canonical forms and text


@query("SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price FROM part")
def canonical_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("MRP Rs. "), F.format_number(F.col("p_retailprice").cast("decimal(12,2)"), 2), F.lit(" only, 5 off"))
    return read(spark, sf_dir, "part").select("p_partkey", canonical.price(shown).alias("price"))


@query("SELECT p_partkey, p_size || CASE p_partkey % 4 WHEN 0 THEN ' g' WHEN 1 THEN ' unit' WHEN 2 THEN ' piece' ELSE '.5 kg' END AS quantity FROM part")
def canonical_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.expr("CASE p_partkey % 4 WHEN 0 THEN ',00GMS.' WHEN 1 THEN '.0 Units' WHEN 2 THEN ' pcs' ELSE ',50 KG' END")
    return read(spark, sf_dir, "part").select("p_partkey", canonical.quantity(F.concat(F.lit("Net "), "p_size", unit)).alias("quantity"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN strftime(o_orderdate, '%Y-%m') WHEN 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def canonical_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ("yyyy/MM/dd", "d.M.yyyy", "dd-MM-yyyy", "d MMM yyyy", "MMMM yyyy")
    shown = F.lit("31-02-2026")
    for k, shape in enumerate(shapes):
        shown = F.when(F.col("o_orderkey") % 6 == k, F.upper(F.date_format("o_orderdate", shape))).otherwise(shown)
    return read(spark, sf_dir, "orders").select("o_orderkey", canonical.date(shown).alias("date"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'a@x.in|1800' || s_suppkey ELSE '1800' || s_suppkey END AS contact FROM supplier")
def canonical_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("A@X.in ; 18-00 "), "s_suppkey")).otherwise(F.concat(F.lit(" , 1800-"), "s_suppkey"))
    sorted_ = canonical.contact(shown)
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.when(sorted_.startswith("1800") & sorted_.contains("|"), F.concat_ws("|", F.element_at(F.split(sorted_, r"\|"), 2), F.element_at(F.split(sorted_, r"\|"), 1))).otherwise(sorted_).alias("contact"))


_MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(f"SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{_MAIL}'), lambda x: lower(x))) AS email FROM documents")
def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    run = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(run), 0)).alias("email")).withColumn("email", F.lower("email"))


_RUN = r"[A-Z0-9._%+\-]"
#: The panel's shapes of contacts.  The first word boundary of a run decides whether an address starts in it, so others aren't tried.
#: Before each, a sign that every line with one has.
_CONTACTS = {
    "email": ("@", rf"(?:\G|(?<!{_RUN}))(?>{_RUN}*?\b)", rf"{_RUN}++@[A-Z0-9.-]+\.[A-Z]{{2,}}\b"),
    "web": (r"(?i)www\.", "", shapes.WEB.pattern),
    "phone": (r"(?U)\d{3}[\s-]*\d{3}", "", shapes.PHONE.pattern),
}


@query()
def contact_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses, web addresses and phone numbers of documents and pages, line by line; none within 24 characters of an identifier's label."""
    texts = read(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").cast("long").alias("id"), "text")
    texts = texts.unionByName(read(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").cast("long").alias("id"), F.col("html").alias("text")))
    rows = texts.select("source", "id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).where(F.col("text").rlike(r"(?U)@|\d{3}[\s-]*\d{3}|(?i:www\.)"))
    found = []
    for kind, (sign, lead, shape) in _CONTACTS.items():
        # Group 1 is what stands before, 2 the contact, 3 what stands after.
        # The look-ahead comes first, so that the look-behind is for contacts only.
        pattern = F.lit(rf"(?isU){lead}(?={shape})(?<=(^.{{0,23}}|.{{24}}))({shape})(?=(.{{0,24}}))")
        parts = F.arrays_zip(*(F.regexp_extract_all("text", pattern, i).alias(n) for i, n in ((1, "before"), (2, "found"), (3, "after"))))
        parts = F.when(F.col("text").rlike(sign), parts)
        found.append(F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), *(x[n].alias(n) for n in ("before", "found", "after")))))
    one = rows.select("source", "id", "line", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("c")).select("source", "id", "line", "c.*")
    one = one.where(~F.concat("before", "found", "after").rlike("(?iU)" + shapes.IDENTIFIER.pattern))
    digits = F.length(F.regexp_replace("found", r"(?U)\D", ""))
    right = digits.isin(10, 11) | (F.col("found").startswith("+91") & digits.isin(12, 13))
    value = F.when(F.col("kind") == "phone", F.regexp_replace("found", r"(?U)\s+", " ")).when(F.col("kind") == "web", F.regexp_replace(F.lower("found"), "[.,;]+$", "")).otherwise(F.lower("found"))
    return one.where((F.col("kind") != "phone") | right).select("source", "id", "line", "kind", value.alias("contact"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '''=' || p_name WHEN 1 THEN '''-' || p_name WHEN 2 THEN '''@' || p_name ELSE p_name END AS cell FROM part")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.expr("CASE p_partkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END")
    return read(spark, sf_dir, "part").select("p_partkey", text.guarded_cell(F.concat(lead, "p_name")).alias("cell"))


@query("SELECT p_partkey, p_brand || '.PNG' AS name, CASE WHEN p_partkey % 3 = 0 THEN '.jpg' WHEN p_partkey % 3 = 1 THEN '.png' ELSE '.bin' END AS suffix FROM part")
def filename_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("C:\\tmp/../"), F.lit("\x07"), "p_brand", F.lit(".PNG"))
    mime = F.when(F.col("p_partkey") % 3 == 0, "image/JPEG")
    ext = F.when(F.col("p_partkey") % 3 == 2, F.lit("noext")).otherwise(name)
    return read(spark, sf_dir, "part").select("p_partkey", text.safe_filename(name).alias("name"), text.stored_suffix(mime, ext).alias("suffix"))


@query("SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9@.+]', '', 'g')) AS key, CASE c_mktsegment WHEN 'BUILDING' THEN 'MAJOR' WHEN 'MACHINERY' THEN 'MINOR' ELSE 'MAJOR' END AS severity FROM customer")
def comparable_and_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.when(F.col("c_mktsegment") == "BUILDING", "high").when(F.col("c_mktsegment") == "MACHINERY", "low")
    return read(spark, sf_dir, "customer").select("c_custkey", text.comparable(F.col("c_name")).alias("key"), canonical.severity(grade).alias("severity"))


# ---------------------------------------------------------------- panels and readers


_PANELS = """
SELECT p_partkey AS panel_id, line_idx, text, 0.94D AS confidence,
  named_struct('x1', 40, 'y1', 40 + 70 * line_idx, 'x2', 470, 'y2', 68 + 70 * line_idx) AS box,
  CAST(NULL AS ARRAY<STRUCT<text:STRING,confidence:DOUBLE,box:STRUCT<x1:INT,y1:INT,x2:INT,y2:INT>>>) AS tokens,
  CAST(NULL AS STRING) AS block_id, CAST(NULL AS STRING) AS line_id, CAST(NULL AS STRING) AS source_pass
FROM (SELECT *, posexplode(array(
  'Common Name: Roasted Nuts',
  concat('Manufactured by: ', replace(p_brand, '#', ' '), ' Foods Pvt Ltd, Plot 5, Sector 9, Pune 411001'),
  concat('Net Quantity: ', p_size, CASE WHEN p_partkey % 5 = 0 THEN ' pieces' ELSE ' g' END),
  concat('MRP: ₹', CAST(p_retailprice AS DECIMAL(12,2))),
  'Pkd on: 12 AUG 2026',
  'Consumer Care: 1800 123 4567',
  'Country of Origin: India')) AS (line_idx, text) FROM {part})
"""


# What each line declares: the place of its label and of its value, and how sure the value's shape is.
_DECLARED = """
  ('common_or_generic_name', 0, '^Common Name', ': (.*)$', 0.98), ('manufacturer_name', 1, '^Manufactured by', ': (.*?), Plot', 0.98), ('manufacturer_address', 1, '^Manufactured by', ', (Plot.*)$', 0.96),
  ('net_quantity', 2, '^Net Quantity', ': (.*)$', 1), ('mrp', 3, '^MRP', ': (.*)$', 1), ('date_of_manufacture', 4, '^Pkd ', ': (.*)$', 1), ('consumer_care_contact', 5, '^Consumer Care', ': (.*)$', 1),
  ('country_of_origin', 6, '^Country of Origin', ': (.*)$', 1)"""
_FIELD_ROWS = ", ".join(f"('{f}', {i})" for i, f in enumerate(FIELDS))


@query(
    f"""
WITH fields(field, ordinal) AS (VALUES {_FIELD_ROWS}), declared(field, line, label, shape, sure) AS (VALUES {_DECLARED}),
lines AS (SELECT p_partkey AS panel_id, unnest(range(7)) AS line, unnest(['Common Name: Roasted Nuts', 'Manufactured by: ' || replace(p_brand, '#', ' ') || ' Foods Pvt Ltd, Plot 5, Sector 9, Pune 411001',
  'Net Quantity: ' || p_size || CASE WHEN p_partkey % 5 = 0 THEN ' pieces' ELSE ' g' END, 'MRP: ₹' || CAST(p_retailprice AS DECIMAL(12,2)), 'Pkd on: 12 AUG 2026', 'Consumer Care: 1800 123 4567',
  'Country of Origin: India']) AS text FROM part),
spans AS (SELECT *, length(text) AS n, length(regexp_extract(text, label)) AS label_end, regexp_extract(text, shape, 1) AS value FROM lines JOIN declared USING (line)),
placed AS (SELECT *, strpos(text, value) - 1 AS a, strpos(text, value) - 1 + length(value) AS b FROM spans),
scored AS (SELECT *, round(0.28 + 0.27 * sure + (0.09 + 0.05) * 0.94 + 0.23 * greatest(0.9, 1 - 0.18 * (a - label_end) / n::DOUBLE) + 0.08, 4) AS score FROM placed)
SELECT p_partkey AS panel_id, f.field, value, CAST(CASE WHEN value IS NULL THEN 0 ELSE round(least(0.99, 0.6 * score + 0.24 * 0.94 + 0.16 * sure), 3) END AS DECIMAL(6,3)) AS confidence,
  CASE WHEN value IS NOT NULL THEN 40 END AS x1, 40 + 70 * line AS y1, CASE WHEN value IS NOT NULL THEN least(470, 44 + floor(b * 430.0 / n))::INT END AS x2, 68 + 70 * line AS y2
FROM part CROSS JOIN fields f LEFT JOIN scored s ON s.panel_id = p_partkey AND s.field = f.field"""
)
def panel_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.panel.spark import extract_panels

    return extract_panels(frame(spark, sf_dir, _PANELS, "part")).select("panel_id", "field", "value", F.col("confidence").cast("decimal(6,3)").alias("confidence"), "box.x1", "box.y1", "box.x2", "box.y2")


_READ = """
SELECT p_partkey AS inspection_id, cand_idx, field, shown AS raw_text, CAST(NULL AS STRING) AS normalized_value, true AS readable, score AS model_score,
  CASE WHEN p_partkey % 9 = 0 AND field = 'net_quantity' THEN NULL ELSE named_struct('ymin', 100, 'xmin', 200, 'ymax', 600, 'xmax', 800) END AS nbox,
  evidence AS evidence_text, CAST(NULL AS STRING) AS notes
FROM (SELECT *, inline(array(
  named_struct('cand_idx', 0, 'field', 'mrp', 'shown', concat('₹', CAST(p_retailprice AS DECIMAL(12,2))), 'score', 0.93D, 'evidence', concat('MRP ₹', CAST(p_retailprice AS DECIMAL(12,2)))),
  named_struct('cand_idx', 1, 'field', 'mrp', 'shown', concat('₹', CAST(p_retailprice + p_partkey % 2 AS DECIMAL(12,2))), 'score', 0.91D, 'evidence', concat('MRP ₹', CAST(p_retailprice + p_partkey % 2 AS DECIMAL(12,2)))),
  named_struct('cand_idx', 2, 'field', 'net_quantity', 'shown', concat(p_size, ' g'), 'score', CASE WHEN p_partkey % 7 = 0 THEN 0.6D ELSE 0.97D END, 'evidence', concat('Net Quantity: ', p_size, ' g')),
  named_struct('cand_idx', 3, 'field', 'consumer_email', 'shown', 'care@example.com', 'score', 0.9D, 'evidence', 'Consumer care: care@example.com'),
  named_struct('cand_idx', 4, 'field', 'consumer_phone', 'shown', '1800 123 4567', 'score', 0.88D, 'evidence', 'Consumer care: 1800 123 4567'),
  named_struct('cand_idx', 5, 'field', 'expiry_date', 'shown', '01/01/2027', 'score', 0.9D, 'evidence', 'Best before 01/01/2027')
)) FROM {part})
"""


@query(
    f"""
WITH fields(field, ordinal) AS (VALUES {_FIELD_ROWS}),
told AS (SELECT p_partkey AS id, unnest([
  {{'nth': 0, 'field': 'mrp', 'shape': '₹[0-9.]+', 'score': 0.93, 'shown': 'MRP ₹' || CAST(p_retailprice AS DECIMAL(12,2)), 'place': true}},
  {{'nth': 1, 'field': 'mrp', 'shape': '₹[0-9.]+', 'score': 0.91, 'shown': 'MRP ₹' || CAST(p_retailprice + p_partkey % 2 AS DECIMAL(12,2)), 'place': true}},
  {{'nth': 2, 'field': 'net_quantity', 'shape': '[0-9]+ g', 'score': CASE WHEN p_partkey % 7 = 0 THEN 0.6 ELSE 0.97 END, 'shown': 'Net Quantity: ' || p_size || ' g', 'place': p_partkey % 9 <> 0}},
  {{'nth': 3, 'field': 'consumer_care_contact', 'shape': '[a-z]+@[a-z.]+', 'score': 0.9, 'shown': 'Consumer care: care@example.com', 'place': true}},
  {{'nth': 4, 'field': 'consumer_care_contact', 'shape': '[0-9 ]{{10,}}', 'score': 0.88, 'shown': 'Consumer care: 1800 123 4567', 'place': true}}]) AS c FROM part),
read AS (SELECT id, c.nth AS nth, c.field AS field, c.score AS score, c.place AS place, CASE WHEN c.score >= 0.78 OR c.field = 'consumer_care_contact' THEN trim(regexp_extract(c.shown, c.shape)) END AS value FROM told),
grouped AS (SELECT id, field, count(DISTINCT value) FILTER (WHERE place) AS keys, count(*) FILTER (value IS NULL OR NOT place) AS refused,
  arg_max(value, score) FILTER (WHERE place) AS best, max(score) FILTER (place AND value IS NOT NULL) AS top, min(score) FILTER (place AND value IS NOT NULL) AS least, string_agg(value, ', ' ORDER BY nth) FILTER (WHERE place) AS every FROM read GROUP BY 1, 2),
out AS (SELECT p_partkey AS inspection_id, f.field, coalesce(refused, 0)::INT AS n_rejected, coalesce(keys, 0) AS keys, f.field = 'consumer_care_contact' AS joined, best, top, least, every
  FROM part CROSS JOIN fields f LEFT JOIN grouped g ON g.id = p_partkey AND g.field = f.field)
SELECT inspection_id, field, CASE WHEN joined THEN every WHEN keys = 1 THEN best END AS value, CAST(coalesce(CASE WHEN joined THEN least(0.95, least) WHEN keys = 1 THEN least(0.95, top) END, 0) AS DECIMAL(6,3)) AS confidence,
  CASE WHEN joined AND keys > 0 OR keys = 1 THEN 'VALIDATED' WHEN keys > 1 THEN 'CONFLICT' ELSE 'MISSING' END AS state, n_rejected > 0 OR (keys > 1 AND NOT joined) AS review_required, n_rejected,
  CASE WHEN keys > 0 THEN 400 END AS x1, CASE WHEN keys > 0 THEN 100 END AS y1, CASE WHEN keys > 0 THEN 1600 END AS x2, CASE WHEN keys > 0 THEN 600 END AS y2
FROM out"""
)
def reader_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = frame(spark, sf_dir, _READ, "part")
    sizes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("inspection_id"), F.lit("clear").alias("image_readability"), F.lit(2000).alias("image_width"), F.lit(1000).alias("image_height"))
    out = reconcile.accept(told, sizes)
    return out.select("inspection_id", "field", "value", F.col("confidence").cast("decimal(6,3)").alias("confidence"), "state", "review_required", F.size("rejected").alias("n_rejected"), "box.x1", "box.y1", "box.x2", "box.y2")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all inspections, counted."""
    return verdict_summary(spark, sf_dir)
