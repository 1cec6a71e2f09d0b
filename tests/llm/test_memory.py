"""What keeps an executor's memory small: one Python worker for each task, bounded batches."""

import pyarrow as pa
import pytest

import corpus_pipeline
from quillon.llm import common, exact_dedup, near_dedup, quality
from quillon.llm.common import read_table

SF = "/root/testdata/sf0.001"
SETTINGS = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def in_a_row(lines):
    return [x for x, below in zip(lines, lines[1:], strict=False) if "MapInArrow" in x and "MapInArrow" in below and below.index("M") > x.index("M")]


def noted(monkeypatch, module):
    """The plans of the tables that a module writes."""
    plans, write = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, tag: plans.append(plan(df)) or write(df, tag))
    return plans


@pytest.fixture
def settings(spark):
    yield
    for k in SETTINGS:
        spark.conf.unset(k)


@pytest.mark.parametrize("module, drop", [(exact_dedup, exact_dedup.drop_exact), (near_dedup, near_dedup.drop_near)])
def test_no_two_python_nodes_in_a_row(spark, monkeypatch, module, drop):
    plans = noted(monkeypatch, module)
    plans.append(plan(drop(read_table(spark, SF, "documents"))))
    assert any("MapInArrow" in x for lines in plans for x in lines)
    assert not [x for lines in plans for x in in_a_row(lines)]


def test_sample_takes_no_python_rdd(spark, monkeypatch):
    plans = noted(monkeypatch, quality)
    quality.fit(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))
    assert plans and not [x for lines in plans for x in lines if "RDD" in x]


def test_stages_bound_their_batches(spark, settings):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', 4000) AS text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    for _, stage in corpus_pipeline.STAGES:
        for k in SETTINGS:
            spark.conf.unset(k)
        stage(spark, docs.limit(0), SF)
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= common.READER_ROWS
        assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] <= common.BATCH_BYTES + 50_000


def test_smaller_settings_stay(spark, settings):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "100")
    common.modest(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("1m", "1048576b")
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "100"
