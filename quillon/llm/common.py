"""Shared plumbing: tables, scratch space, Arrow slices, fresh column names."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step holds; bounds a worker's memory whatever the Arrow batch size.
SLICE_BYTES = 2 << 20
#: Under modest(): bytes of one Arrow batch, a little less than a slice, and rows of one batch of the Parquet reader.
BATCH_BYTES = 31 << 16
READER_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest(spark: SparkSession) -> None:
    """Lower what a task holds of a table at a time, in the JVM and in its Python worker; a session's smaller settings stay.

    Rows and results are the same.  Spark's own values are 64 MB and 4096 rows, whose buffers (doubled as they fill) an executor keeps.
    """
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
            spark.conf.set(name, most)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names.  Only a session of one machine may do without (tests): it gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "quillon-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; Hadoop removes it when the driver ends."""
    path = f"{scratch_root(spark)}/quillon-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by materialise(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quillon-" in folder:
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(conf).delete(where, True)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that no column has, whatever extra columns the input brings."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that scoring needs, the text as UTF-8 bytes (null stays null)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the bytes in one column stay near a bound (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def raw_bytes(array: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The value buffer of a binary or string array and its offsets; a null has length 0 once filled."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) else "")
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, offs, data = array.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, dtype=kind, count=len(array) + 1 + array.offset)[array.offset :].astype(np.int64)
    return memoryview(data) if data is not None else memoryview(b""), offsets


def joined(array: pa.Array) -> tuple[bytes, np.ndarray]:
    """All values end to end as one bytes object, with offsets from 0."""
    data, offsets = raw_bytes(array)
    return bytes(data[offsets[0] : offsets[-1]]), offsets - offsets[0]


def map_arrow(df: DataFrame, fn, schema: StructType | str) -> DataFrame:
    return df.mapInArrow(tidied(fn), schema)


def tidied(fn):
    """fn, giving memory back to the system when its partition ends: workers live on and share an executor's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than GNU's
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))
