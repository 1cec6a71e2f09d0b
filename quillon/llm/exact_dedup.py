"""Exact duplicates by two-pass Bloom filtering.

Pass one hashes every text and asks counting Bloom filters, one for each slice of the hashes, which hashes may
occur twice.  Pass two tests every row against a filter of those: a row that isn't in it is unique and passes
straight through; only possibly repeated rows shuffle and are compared by their full SHA-256.

Equal: identical after lower-casing A-Z only.  A null text counts as empty, and all empty texts are equal.
Of equal texts the largest doc_id stays; of rows that share doc_id and text, one stays.  A null doc_id stays only
where no equal text has another.  Extra columns pass through.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import bloom
from .common import fresh, id_text, materialise, raw_bytes, tidied

#: Copies of one doc_id and text that one row stands for while they are counted out.
COPIES = 1 << 16


def digests(texts: pa.Array) -> list[bytes]:
    """SHA-256 of each text after lower-casing A-Z (bytes.lower() touches nothing else)."""
    data, offsets = raw_bytes(texts)
    at = offsets.tolist()
    return [hashlib.sha256(bytes(data[a:b]).lower()).digest() for a, b in zip(at, at[1:], strict=False)]


def short_keys(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), dtype="<u8").reshape(-1, 4)[:, 0].copy()


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sha (32 bytes) and key (8 of them), written to shared scratch: what later steps read, without texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = digests(batch.column(1))
            yield pa.record_batch(
                [batch.column(0), pa.array(found, pa.binary()), pa.array(short_keys(found).view(np.int64))],
                ["doc_id", "sha", "key"],
            )

    return materialise(id_text(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, sha binary, key long"), "sha")


def _key(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)


def counted(keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that are surely unique; the others as (sha, doc_id, copies); and (sha, keep_id, group_size) of their groups."""
    filters = bloom.members(bloom.repeated(keys, "key", keys.count()), "key")
    # Rows of one doc_id and text are counted first, so that a large group meets in pieces; one of them can stay.
    rows = bloom.picked(keys, filters, _key, True).groupBy("sha", "doc_id").agg(F.count("*").alias("copies"))
    rows = materialise(rows, "rows")
    # As a table of its own, each side of a join with it is one plain exchange: a large group's rows can be split at run time.
    groups = materialise(rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    return bloom.picked(keys, filters, _key, False), rows, groups


def _each(rows: DataFrame) -> DataFrame:
    """A row for each of `copies`, which becomes the number of the copy from 0; batches stay small whatever the count."""
    parts = F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("int"))
    apart = rows.withColumn("part", F.explode(parts)).withColumn("copies", F.least(F.col("copies") - F.col("part").cast("long") * COPIES, F.lit(COPIES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.column("copies").to_numpy()
            at = np.flatnonzero(many == 1)
            if len(at):
                yield numbered(batch.take(pa.array(at)), np.zeros(len(at), np.int64))
            for k in np.flatnonzero(many > 1):
                yield numbered(batch.take(pa.array(np.full(many[k], k))), np.arange(many[k]))

    def numbered(batch: pa.RecordBatch, nth: np.ndarray) -> pa.RecordBatch:
        whole = nth + batch.column("part").to_numpy().astype(np.int64) * COPIES
        return batch.set_column(batch.schema.get_field_index("copies"), "copies", pa.array(whole, pa.int64()))

    return apart.mapInArrow(tidied(run), apart.schema).drop("part")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, sha, keep_id, group_size, kept."""
    alone, rows, groups = counted(text_digests(docs, id_col, text_col))
    alone = alone.select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    together = _each(rows.join(groups, "sha").select("doc_id", "sha", "keep_id", "group_size", "copies"))
    kept = (F.col("copies") == 0) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return alone.unionByName(together.select("doc_id", "sha", "keep_id", "group_size", kept.alias("kept")))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Which rows go is found out from digests.  Rows whose doc_id a filter of those says nothing about never shuffle and aren't
    hashed again; the others are hashed, and meet the digests of what goes.
    """
    _, rows, groups = counted(text_digests(docs, id_col, text_col))
    id_, sha = fresh("gone_id", docs.columns), fresh("sha", docs.columns)
    lesser = ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    changed = materialise(rows.join(groups, "sha").where(lesser | (F.col("copies") > 1)).select(F.col("doc_id").alias(id_), F.col("sha").alias(sha), lesser.alias("goes")), "changed")
    filters = bloom.members(changed.select(F.coalesce(id_, F.lit(-1)).alias(id_)), id_)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)

    def id_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(id_at).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([*batch.columns, pa.array(digests(batch.column(text_at)), pa.binary())], [*batch.schema.names, sha])

    maybe = bloom.picked(docs, filters, id_of, True, (hashed, StructType([*docs.schema.fields, StructField(sha, BinaryType())])))
    gone = changed.where("goes").select(id_, F.col(sha).alias(sha + "_gone"))
    kept = maybe.join(gone, (F.col(sha) == F.col(sha + "_gone")) & F.col(id_col).cast("long").eqNullSafe(F.col(id_)), "left_anti")
    return bloom.picked(docs, filters, id_of, False).unionByName(kept.dropDuplicates([sha, id_col]).select(*docs.columns))
