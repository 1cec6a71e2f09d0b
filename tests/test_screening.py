"""Rules, reconciliation, corrections, limiter, streams, decoding and exports on small rows."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import schemas
from quillon.functions import canonical, geometry, text
from quillon.operators import corrections, evaluate, export, image_quality, ledger, limiter, reconcile, records
from quillon.sources import readers, rules, tables
from quillon.streaming import audit
from quillon.streaming import limiter as stream_limiter

GOOD = {
    "common_or_generic_name": "Nuts",
    "manufacturer_name": "Sunrise Foods",
    "manufacturer_address": "Plot 5, Pune 411001",
    "net_quantity": "500 g",
    "mrp": "₹170.00",
    "date_of_manufacture": "12 AUG 2026",
    "consumer_care_contact": "care@example.com",
}


def screened(spark, fields, scope="domestic", quality="good", n=7, confidence=0.9):
    rows = [(1, f, v, confidence if not isinstance(v, tuple) else v[1]) for f, v in fields.items()]
    rows = [(i, f, v[0] if isinstance(v, tuple) else v, c) for i, f, v, c in rows]
    told = spark.createDataFrame(rows, "inspection_id long, field string, value string, confidence double").withColumn("box", F.expr(geometry.NO_BOX))
    contexts = spark.createDataFrame([(1, scope, quality, n)], "inspection_id long, package_scope string, quality_status string, line_count int")
    found, verdict = evaluate.screen(told, contexts, rules.load_rules(spark))
    return {r.rule_id: r.status for r in found.collect()}, verdict.first().overall_status


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, "compliant"),
        ({"mrp": None}, "manual_review_required"),
        ({"mrp": "ask retailer"}, "potential_non_compliance"),
        ({"net_quantity": "10 pieces"}, "potential_non_compliance"),
        ({"manufacturer_address": None}, "manual_review_required"),
        ({"mrp": ("₹170.00", 0.40)}, "manual_review_required"),
    ],
)
def test_scenarios(spark, change, want):
    assert screened(spark, GOOD | change)[1] == want


def test_scope_and_quality(spark):
    found, verdict = screened(spark, GOOD, scope="imported")
    assert found["LMPC-COO-001"] == "UNCERTAIN" and verdict == "manual_review_required"
    assert "LMPC-COO-001" not in screened(spark, GOOD)[0]
    assert screened(spark, GOOD, scope="moon")[0]["LMPC-COO-001"] == "UNCERTAIN"
    assert screened(spark, GOOD, quality="review")[1] == "manual_review_required"
    assert screened(spark, GOOD, n=0)[1] == "manual_review_required"
    assert screened(spark, GOOD | {"net_quantity": "500 g"})[0]["LMPC-NET-001"] == "PASS"


@pytest.mark.parametrize(
    "change",
    [lambda r: [*r, r[0]], lambda r: [{k: v for k, v in r[0].items() if k != "field"}], lambda r: [r[0] | {"on_field_missing": "FAIL"}], lambda r: [r[0] | {"confidence_floor": 2}], lambda r: [r[1] | {"pattern": None}], lambda r: [r[0] | {"check_type": "odd"}]],
)
def test_bad_rules(change):
    with pytest.raises(rules.RuleError):
        rules.validate(change(rules.default_rules()))


def test_rules_from_files(spark, tmp_path):
    for name, rule in zip("ba", rules.default_rules(), strict=False):
        (tmp_path / f"{name}.json").write_text(json.dumps(rule | {"active": name == "a"}))
    assert [r.rule_id for r in rules.load_rules(spark, str(tmp_path)).collect()] == ["LMPC-CARE-001"]


def test_correction_flow(spark):
    told = spark.createDataFrame([(1, f, v, 0.9) for f, v in (GOOD | {"net_quantity": None}).items()], "inspection_id long, field string, value string, confidence double")
    told = told.withColumn("box", F.expr(geometry.NO_BOX))
    contexts = spark.createDataFrame([(1, "domestic", "good", 5)], "inspection_id long, package_scope string, quality_status string, line_count int")
    changes = spark.createDataFrame(
        [(1, 1, "net_quantity", "25 pieces"), (2, 1, "net_quantity", " 250 g "), (3, 1, "net_quantity", " "), (4, 1, "colour", "red")],
        "seq long, inspection_id long, field string, corrected_text string",
    )
    row = corrections.reevaluate(told, changes, contexts, rules.load_rules(spark)).first()
    assert (row.overall_status, row.original_overall_status) == ("compliant", "manual_review_required")
    fixed = corrections.overlay(told, changes).where("field = 'net_quantity'").first()
    assert (fixed.value, fixed.confidence, fixed.source, fixed.original_value) == ("250 g", 1.0, "human_correction", None)


def candidate(i, field, shown, evidence, score=0.9, box=(100, 200, 600, 800), claim=None, readable=True):
    return (1, i, field, shown, claim, readable, score, box, evidence, None)


def accepted(spark, rows, readability="clear"):
    df = spark.createDataFrame(rows, schemas.schema("candidates"))
    sizes = spark.createDataFrame([(1, readability, 2000, 1000)], "inspection_id long, image_readability string, image_width int, image_height int")
    return {r.field: r for r in reconcile.accept(df, sizes).collect()}


def test_reconcile(spark):
    got = accepted(
        spark,
        [
            candidate(0, "mrp", "₹170", "MRP ₹170.00"),
            candidate(1, "net_quantity", "500 g", "Net Quantity: 500 g", box=None),
            candidate(2, "consumer_email", "a@x.in", "Consumer care: a@x.in", 0.93),
            candidate(3, "consumer_phone", "1800 123 4567", "Consumer care: 1800 123 4567", 0.88),
            candidate(4, "packing_date", "05/06/2026", "Pkd: 05/06/2026"),
            candidate(5, "manufacture_date", "01/06/2026", "Mfd: 01/06/2026"),
            candidate(6, "expiry_date", "01/01/2027", "Best before 01/01/2027"),
            candidate(7, "country_of_origin", "India", "Pune 411001, India"),
        ],
    )
    assert got["mrp"].value == "₹170.00" and tuple(got["mrp"].box) == (400, 100, 1600, 600) and got["mrp"].state == "VALIDATED"
    assert got["net_quantity"].value is None and got["net_quantity"].rejected[0].reason == reconcile.REJECTED_PLACE and got["net_quantity"].review_required
    assert got["consumer_care_contact"].value == "a@x.in, 1800 123 4567" and got["consumer_care_contact"].confidence == 0.88
    assert got["date_of_manufacture"].value == "01/06/2026"
    assert got["country_of_origin"].state == "MISSING" and got["country_of_origin"].review_required
    assert len(got) == 14


def test_reconcile_conflict_and_unreadable(spark):
    two = [candidate(0, "mrp", "₹120", "MRP ₹120.00"), candidate(1, "mrp", "₹170", "MRP ₹170.00", box=(0, 0, 50, 100))]
    got = accepted(spark, two, "unreadable")
    assert got["mrp"].state == "CONFLICT" and got["mrp"].value is None and tuple(got["mrp"].box) == (0, 0, 1600, 600)
    assert got["packer_name"].state == "UNREADABLE"


def test_weak_single_pass_is_refused(spark):
    rows = [candidate(0, "mrp", "₹170", "MRP ₹170.00", 0.6)]
    assert accepted(spark, rows)["mrp"].value is None
    df = spark.createDataFrame(rows, schemas.schema("candidates"))
    assert reconcile.validated(df, provenance=None).first().value == "₹170.00"


def test_addresses(spark):
    rows = [
        candidate(0, "manufacturer_address", "Plot 5, Pune", "Manufactured by Sunrise, Plot 5, Pune"),
        candidate(1, "packer_address", "Plot 5, Pune", "Manufactured by Sunrise, Plot 5, Pune"),
    ]
    got = accepted(spark, rows)
    assert got["manufacturer_address"].value == "Plot 5, Pune" and got["packer_address"].value is None


def test_limiter(spark):
    rows = [("k", 100.0, 1), ("k", 100.0, 2), ("k", 100.0, 3), ("k", 161.0, 4)]
    got = limiter.decide(spark.createDataFrame(rows, "key string, ts double, seq long"), "key", "ts", "seq", 2).orderBy("seq").collect()
    assert [(r.accepted, r.used, r.retry_after) for r in got] == [(True, 1, None), (True, 2, None), (False, 2, 60), (True, 1, None)]
    assert stream_limiter.decide([100.0, 100.0], 160.0, 2, 60.0, False)[1] and not stream_limiter.decide([100.0, 100.0], 160.0, 2, 60.0, True)[1]


def test_limiter_matches_a_plain_loop(spark):
    draw = np.random.default_rng(3)
    rows = [(int(k), float(t), i) for i, (k, t) in enumerate(zip(draw.integers(0, 4, 300), np.cumsum(draw.exponential(9, 300)), strict=True))]
    got = {r.seq: (r.accepted, r.used) for r in limiter.decide(spark.createDataFrame(rows, "key long, ts double, seq long"), "key", "ts", "seq", 3).collect()}
    held: dict = {}
    for k, t, i in rows:
        held[k], ok, _ = stream_limiter.decide(held.get(k, []), t, 3, 60.0, False)
        assert got[i] == (ok, len(held[k]))


def test_streams(spark, tmp_path):
    rows = [("a", 1000.0 + 60 * i, i) for i in range(5)] + [("a", 1061.0, 9)]
    df = spark.createDataFrame(rows, "key string, ts double, seq long").withColumn("event_time", F.timestamp_seconds("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = audit.read_events(spark, str(tmp_path / "in"), df.schema)
    out = stream_limiter.limited(events.withWatermark("event_time", "1 minute"), 1, 60.0)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.seq: r.accepted for r in spark.table("limited").collect()} == {0: True, 1: True, 2: True, 3: True, 4: True, 9: False}
    counted = audit.counts(events, "event_time", "key", "2 minutes")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("counted").collect()) == [1, 2, 3]
    audit.append(audit.once(events, "event_time", ["key"]), str(tmp_path / "out"), str(tmp_path / "c3")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_older_files_and_broken_json(spark, tmp_path):
    raw = spark.createDataFrame([(1, "u", "a.png", '{"mrp":{"text":"₹1","confidence":0.9}}', "{", "compliant"), (2, "v", "b.png", "oops", None, "x")], "inspection_id long, uuid string, original_filename string, extracted_fields string, quality string, overall_status string")
    rows = {r.inspection_id: r for r in tables.decode(raw).collect()}
    assert rows[1].extracted_fields["mrp"].text == "₹1" and rows[2].extracted_fields == {} and rows[2].findings is None or rows[2].findings == []
    assert rows[1].rule_engine_version == schemas.DEFAULT_ENGINE_VERSION
    raw.select("inspection_id", "uuid").write.parquet(str(tmp_path / "inspections"))
    assert len(tables.scan(spark, str(tmp_path), "inspections").columns) == len(schemas.schema("inspections"))


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=cmd()", "2026-01-01", "compliant", "good", "unknown", "NOT_REVIEWED")], ", ".join(f"{c} string" if c != "inspection_id" else "inspection_id long" for c in export.HISTORY))
    export.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().original_filename == "'=cmd()"
    export.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().original_filename == "=cmd()"


def test_text_functions(spark):
    row = spark.sql("select 'The package is compliant' t, 'compliant' ok, 'manual_review_required' bad, 'token=abc failed' e, 2048L b, array(' a ','b','c') l").select(
        text.explanation_consistent(F.col("t"), F.col("ok")), text.explanation_consistent(F.col("t"), F.col("bad")), text.redacted(F.col("e")), text.file_size(F.col("b")), text.cleaned_lines(F.col("l")), text.bare_filename(F.lit("../x"))
    )
    assert tuple(row.first()) == (True, False, "token=[redacted] failed", "2.0 KB", ["a", "b", "c"], False)


def test_canonical(spark):
    rows = [("mrp", "Rs 1,200", "₹1200.00", True), ("net_quantity", "500 gms", "500.0 g", True), ("date_of_manufacture", "01/02/2026", "2026-02-01", True), ("mrp", None, None, True), ("mrp", "₹1", None, False)]
    got = spark.createDataFrame(rows, "f string, a string, b string, want boolean").select(canonical.equivalent(F.col("f"), F.col("a"), F.col("b")).alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)


def test_turned_boxes_come_back(spark):
    b = geometry.box(F.lit(10), F.lit(20), F.lit(60), F.lit(50))
    for angle in (0, 90, 180, 270):
        there = geometry.from_original(b, F.lit(angle), F.lit(200), F.lit(100))
        back = spark.range(1).select(geometry.to_original(there, F.lit(angle), F.lit(200), F.lit(100)).alias("b")).first().b
        assert tuple(back) == (10, 20, 60, 50)


def test_image_gate(spark):
    draw = np.random.default_rng(0)
    good = draw.integers(0, 200, (700, 1000)).astype(np.uint8)
    images = [(bytearray(x.tobytes()), x.shape[1], x.shape[0]) for x in (good, np.full((700, 1000), 255, np.uint8), np.zeros((100, 100), np.uint8))] + [(bytearray(b"x"), 5, 5)]
    df = image_quality.with_metrics(spark.createDataFrame(images, "pixels binary, width int, height int"))
    got = [r.g for r in df.select(image_quality.gate(F.col("metrics")).alias("g")).collect()]
    assert [g.status for g in got] == ["good", "review", "review", "review"]
    assert "low_resolution" in got[2].warnings and got[3].warnings == ["undecodable"]


def test_upload_admission(spark, tmp_path):
    header = lambda w, h: b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    (tmp_path / "a.png").write_bytes(header(640, 480))
    (tmp_path / "b.txt").write_bytes(b"hello")
    (tmp_path / "c.png").write_bytes(header(8000, 5001))
    (tmp_path / "d.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 20)
    got = {r.path[-5:]: (r.format, r.reject_reason) for r in image_quality.admitted(tables.read_uploads(spark, str(tmp_path))).collect()}
    assert got == {"a.png": ("PNG", None), "b.txt": (None, "not_an_image"), "c.png": ("PNG", "too_many_pixels"), "d.png": ("PNG", "undecodable")}
    none = spark.createDataFrame([("x", 0, bytearray(b""))], "path string, length long, content binary")
    assert image_quality.admitted(none).first().reject_reason == "empty"


def test_empty_ledger(spark):
    none = spark.createDataFrame([], "k long, s string, seq long, created_at string")
    assert ledger.counts_zero_filled(none, "s", ("a",)).collect() == [("a", 0)]
    assert ledger.daily_counts(none, "created_at").count() == 0
    assert ledger.with_latest(none.select("k"), none, "k", "seq", "s").count() == 0


def test_records(spark):
    schema = schemas.schema("inspections")
    row = {f.name: None for f in schema.fields} | {"inspection_id": 1, "extracted_fields": {"mrp": {"text": "₹1", "confidence": 0.98765, "box": (0, 0, 0, 0), "source": "odd"}, "net_quantity": {"text": "", "confidence": 0.5, "box": None, "source": "gemini"}}}
    df = spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], schema)
    got = {r.field: r for r in records.fields_long(df).collect()}
    assert len(got) == 14 and (got["mrp"].confidence, got["mrp"].box, got["mrp"].source) == (0.988, None, "ocr")
    assert got["net_quantity"].confidence == 0.0 and got["packer_name"].text == ""
    reviews = spark.createDataFrame([(1, 1, "REVIEWED", "a", None, "t"), (2, 1, "APPROVED", "b", None, "t")], schemas.schema("reviews"))
    none = spark.createDataFrame([], schemas.schema("corrections")), spark.createDataFrame([], schemas.schema("audit_events"))
    one = records.detail(df, reviews, *none).first()
    assert one.review_status == "APPROVED" and one.corrections == [] and one.audit == []
    item = records.history_item(df.withColumn("review_status", F.lit("NOT_REVIEWED"))).first()
    assert (item.quality_status, item.package_scope) == ("unknown", "unknown")


def test_readers(spark):
    assert readers.Settings.from_env({"READER_TIMEOUT": "900", "READER_RPM": "x", "READER_MODELS": "a, b,,a"}) == readers.Settings(45, 10, 2, ("a", "b"))
    words = spark.createDataFrame([(1, '[{"text":"MRP","confidence":0.9,"polygon":[{"x":1.2,"y":2},{"x":9.5,"y":8}]}]'), (2, "oops")], "k long, p string")
    got = readers.parse_words(words, "k", "p").collect()
    assert [(r.text, tuple(r.box)) for r in got if r.text] == [("MRP", (1, 2, 10, 8))]
    told = spark.createDataFrame([(5, '[{"field":"mrp","raw_text":"₹1","readable":true,"model_score":0.9,"bbox_2d":[1,2,3,4],"evidence_text":"MRP ₹1"},{"field":"mrp","bbox_2d":[1]}]')], "inspection_id long, result string")
    rows = readers.candidates(told).collect()
    assert tuple(rows[0].nbox) == (1, 2, 3, 4) and rows[1].nbox is None and rows[1].cand_idx == 1

    def read(frame):
        import pandas as pd

        return pd.DataFrame({"image_sha256": frame["image_sha256"], "model": "m", "schema_version": "v", "status": "ok", "result": "[]", "safe_error": None, "duration_ms": 1.0})

    assert readers.call(spark.createDataFrame([("a",), ("a",), ("b",)], "image_sha256 string"), read).count() == 2


def test_added_check_type(spark):
    from pyspark.sql import functions as F

    from quillon.sources import rules

    rule = rules.default_rules()[0] | {"rule_id": "OWN-1", "check_type": "short", "pattern": None, "field": "mrp", "applicability": None, "confidence_floor": 0.5}
    with pytest.raises(rules.RuleError):
        rules.validate([rule])
    with pytest.raises(ValueError):
        rules.register_check_type("all_present", lambda v: F.lit(True))
    rules.register_check_type("short", lambda v: F.length(v) < 5)
    try:
        told = spark.createDataFrame([(1, "mrp", "abc", 0.9), (2, "mrp", "abcdef", 0.9), (3, "mrp", "abc", 0.1)], "inspection_id long, field string, value string, confidence double")
        told = told.withColumn("box", F.expr("CAST(NULL AS STRUCT<x1:INT,y1:INT,x2:INT,y2:INT>)"))
        contexts = spark.createDataFrame([(i, "domestic") for i in (1, 2, 3)], "inspection_id long, package_scope string")
        got = {r.inspection_id: r.status for r in evaluate.evaluate(told, contexts, rules.to_frame(spark, [rule])).collect()}
    finally:
        rules.CUSTOM.clear()
    assert got == {1: "PASS", 2: "FAIL", 3: "UNCERTAIN"}


def test_image_sizes_from_headers():
    size = image_quality.size_of
    assert size(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"), "PNG") == (640, 480)
    assert size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xff\xc2\0\x11\x08\x01\xe0\x02\x80\x03", "JPEG") == (640, 480)
    assert size(b"\xff\xd8\xff\xe0\0\x04ab", "JPEG") is None and size(b"\x89PNG", "PNG") is None
    assert size(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (639).to_bytes(3, "little") + (479).to_bytes(3, "little"), "WEBP") == (640, 480)
    assert size(b"II*\0\x08\0\0\0\x02\0\0\x01\x03\0\x01\0\0\0\x80\x02\0\0\x01\x01\x04\0\x01\0\0\0\xe0\x01\0\0", "TIFF") == (640, 480)
    assert size(b"BM" + b"\0" * 16 + (0).to_bytes(4, "little") + (480).to_bytes(4, "little"), "BMP") is None


def test_limiter_takes_long_bursts(spark):
    """100,000 attempts of one key without a pause, in seconds."""
    from pyspark.sql import functions as F

    began = time.perf_counter()
    rows = spark.range(100_000).select(F.lit(1).alias("key"), (F.col("id") / 10).alias("ts"), F.col("id").alias("seq"))
    assert limiter.decide(rows, "key", "ts", "seq", 5, 60.0).where("accepted").count() == 5 * 167
    assert time.perf_counter() - began < 30
