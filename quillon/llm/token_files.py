"""Token ids as Parquet list columns, written in doc_id order and read back.

File format: one row for each document with doc_id, n_tokens and ids (a list of 32-bit integers, end id
included).  Files hold disjoint, ascending doc_id ranges and rows ascend within a file.  Pages use the
Parquet v2 encodings: a dictionary where it is smaller, else delta-packed integers.  Row groups and pages
are small and of set size, and every column chunk has a page index, so a reader of doc_id and n_tokens
touches no token page, and a reader of a doc_id range touches only the pages that hold it.

Null texts count as empty: they give the end id alone.  Rows that share a doc_id are written one after the
other, in the order of their text, and their starts follow the order in the file; a null doc_id sorts first.  An empty table gives files without rows.
Extra columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, slices, tidied
from .encoding import encoder, with_end

END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
SCHEMA = "doc_id long, n_tokens int, ids array<int>"

WRITE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",  # delta encodings
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in slices(batches, "text", 3 << 20):
            ids, ends = with_end(*enc.encode(part.column("text")), end_id)
            starts = np.concatenate([[0], ends])
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(np.diff(starts).astype(np.int32)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.view("<i4")))],
                ["doc_id", "n_tokens", "ids"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(tidied(run), SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """One shuffle, of texts by doc_id range; tokenizing and writing follow in the same tasks."""
    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, text_col)
    encode_documents(ordered, tokenizer, id_col, text_col, end_id).write.options(**WRITE_OPTIONS).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _place() -> list[Column]:
    """Where a row stands: its file, and its number in it."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth")]


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and start (tokens of all documents before), from the metadata columns only."""
    return with_starts(read_token_files(spark, path).select("doc_id", "n_tokens", *_place()), spark, path)


def with_starts(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """rows: doc_id, n_tokens, others, file and nth.  Adds start.

    Files are disjoint ranges of doc_id, so a sum for each file (a row for each file, from the metadata columns) and a running
    sum within each file, in the order of its rows, give a global running sum without one global sort.
    """
    names = [c for c in rows.columns if c not in ("file", "nth")]
    light = read_token_files(spark, path).select("doc_id", "n_tokens", _place()[0])
    files = light.groupBy("file").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first"), F.sum("n_tokens").alias("total"))
    before = files.select(
        "file", F.coalesce(F.sum("total").over(Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    inner = Window.partitionBy("file").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(before, "file").select(*names, (F.col("before") + F.col("within")).alias("start"))


def check_columns(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, all from the files, whose ids are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy().tolist()
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy()).view(np.uint8))
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes), pa.array(crc, pa.int64()), batch.column("file"), batch.column("nth")], ["doc_id", "n_tokens", "ids_crc32", "file", "nth"])

    rows = read_token_files(spark, path).select("doc_id", "ids", *_place())
    told = rows.mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_crc32 long, file string, nth long")
    return with_starts(told, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
