"""Sliding-window log limiter: an attempt counts against later ones only if it was accepted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..streaming.limiter import decide as step

#: Decisions that a task hands on at a time.
BATCH = 1 << 14


def decide(attempts: DataFrame, key: str, ts: str, seq: str, limit: int, window: float = 60.0, keep_edge: bool = False) -> DataFrame:
    """accepted, used and retry_after of each attempt, in order of ts and seq.

    Each decision depends on the ones before, so attempts are sorted by key and time within partitions and go by as a stream:
    what a task remembers is one key's accepted times, `limit` at most.  The cost is in step with the attempts, however many one
    key has.  keep_edge: an attempt exactly one window old still counts (ts - old > window evicts), else it is evicted
    (ts - old >= window evicts).
    """
    rows = attempts.select(key, F.col(ts).cast("double").alias(ts), F.col(seq).cast("long").alias(seq))
    kind = rows.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField(ts, DoubleType()), StructField(seq, LongType()), StructField("accepted", BooleanType()), StructField("used", IntegerType()), StructField("retry_after", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, held = object(), []
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch, told = whole.slice(at, BATCH), []
                for k, now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if k != owner:
                        owner, held = k, []
                    held, ok, wait = step(held, now, limit, window, keep_edge)
                    told.append((ok, len(held), wait))
                ok, used, wait = zip(*told, strict=True)
                yield pa.record_batch([*batch.columns, pa.array(ok, pa.bool_()), pa.array(used, pa.int32()), pa.array(wait, pa.int32())], schema.names)

    return rows.repartition(key).sortWithinPartitions(key, ts, seq).mapInArrow(run, schema)
