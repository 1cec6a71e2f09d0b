"""Bloom filters over 64-bit keys, in slices of the key space; none has a bound on all keys together.

repeated() finds keys that may occur twice.  A key's hash picks a slice of some SLICE_KEYS keys; each slice has a
counting filter of its own, filled and asked by one group that holds only its slice's keys.  Tasks hand on at most
two of a key in a flush, so a very common key costs two entries a flush and no group grows with its rows.

members() makes membership filters to broadcast: blocks of BLOCK_KEYS keys at most, each of BITS_PER_KEY bits a key (64 MB
at most).  A block speaks for its own part of the key space only, so with more keys there are more blocks, each as
selective as one; picked() takes a pass over its rows for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialise, mix64, release, tidied

BITS_PER_KEY = 16
HASHES = 4
SLICE_KEYS = 1 << 11
BLOCK_KEYS = 1 << 25
SEGMENT_BITS = 1 << 16
#: Keys that a task gathers before it hands them on.
FLUSH = 1 << 18


def bits_for(n: int) -> int:
    return 1 << (max(1024, BITS_PER_KEY * n) - 1).bit_length()


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """HASHES positions for each key, one row for each hash."""
    a = mix64(keys, 11)
    b = mix64(keys, 23) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([((a + np.uint64(i) * b) >> np.uint64(7)) & np.uint64(bits - 1) for i in range(HASHES)])


def contains(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = positions(keys, len(bitmap) * 8)
    hit = np.ones(len(keys), dtype=bool)
    for row in at:
        hit &= (bitmap[row >> np.uint64(3)] >> (row & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def part_of(keys: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Which of `parts` equal parts of the key space each key lies in."""
    return ((mix64(keys, seed) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The first column's keys, some FLUSH at a time, sorted."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += batch.num_rows
        if size > FLUSH:
            yield np.sort(np.concatenate(held))
            held, size = [], 0
    if held:
        yield np.sort(np.concatenate(held))


def _grouped(part: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The distinct parts and, packed, the values of each."""
    order = np.argsort(part, kind="stable")
    part, values = part[order], values[order]
    own, first = np.unique(part, return_index=True)
    return own, [x.tobytes() for x in np.split(values, first[1:])]


def twice(keys: np.ndarray) -> np.ndarray:
    """The keys whose positions in a counting filter of their own are all hit twice, by them or by others; distinct."""
    bits = bits_for(len(keys))
    at = positions(keys, bits)
    many = np.bincount(at.ravel().astype(np.int64), minlength=bits)
    return np.unique(keys[(many[at.astype(np.int64)] >= 2).all(axis=0)])


def repeated(keys: DataFrame, column: str, n: int) -> DataFrame:
    """key: the keys that may occur more than once, as a table in shared scratch.  A key that does is never missed."""
    slices = max(1, -(-n // SLICE_KEYS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _gathered(batches):
            third = np.zeros(len(some), dtype=bool)
            third[2:] = some[2:] == some[:-2]
            some = some[~third]
            own, packed = _grouped(part_of(some, slices, 41), some.astype("<u8"))
            yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(packed, pa.binary())], ["slice", "keys"])

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": twice(np.frombuffer(b"".join(frame["keys"]), dtype="<u8")).view(np.int64)})

    rows = keys.select(F.col(column).cast("long")).where(F.col(column).isNotNull())
    return materialise(rows.mapInArrow(tidied(emit), "slice int, keys binary").groupBy("slice").applyInPandas(ask, "key long"), "repeated")


@dataclass
class Block:
    """The filter of one part of the key space, broadcast."""

    held: Broadcast
    block: int
    blocks: int

    def mine(self, keys: np.ndarray) -> np.ndarray:
        return part_of(keys, self.blocks, 31) == np.uint64(self.block) if self.blocks > 1 else np.ones(len(keys), dtype=bool)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        return contains(self.held.value, keys)


def members(keys: DataFrame, column: str) -> list[Block]:
    """Membership filters of a table's keys.  Executors fill segments of them; the driver joins one block's segments at a time."""
    context, n = keys.sparkSession.sparkContext, keys.count()
    blocks = max(1, -(-n // BLOCK_KEYS))
    bits = max(SEGMENT_BITS, bits_for(-(-n // blocks)))
    each = bits // SEGMENT_BITS

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _gathered(batches):
            some = np.unique(some)
            at = np.unique(part_of(some, blocks, 31)[None, :] * np.uint64(bits) + positions(some, bits))
            own, packed = _grouped(at >> np.uint64(16), (at & np.uint64(SEGMENT_BITS - 1)).astype("<u2"))
            yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(packed, pa.binary())], ["segment", "low"])

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SEGMENT_BITS, dtype=np.uint8)
        for low in frame["low"]:
            total[np.frombuffer(low, dtype="<u2")] = 1
        return pd.DataFrame({"segment": [int(frame["segment"].iloc[0])], "bits": [np.packbits(total, bitorder="little").tobytes()]})

    rows = keys.select(F.col(column).cast("long")).where(F.col(column).isNotNull())
    filled = rows.mapInArrow(tidied(emit), "segment int, low binary").groupBy("segment").applyInPandas(fill, "segment int, bits binary")
    if blocks > 1:
        filled = materialise(filled, "filled")
    out = []
    for block in range(blocks):
        bitmap = np.zeros(bits // 8, dtype=np.uint8)
        for row in filled.where(F.col("segment").between(block * each, (block + 1) * each - 1)).collect():  # one block's bits, bounded above
            start = (row["segment"] - block * each) * (SEGMENT_BITS // 8)
            bitmap[start : start + SEGMENT_BITS // 8] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        out.append(Block(context.broadcast(bitmap), block, blocks))
    if blocks > 1:
        release(filled)
    return out


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def picked(df: DataFrame, filters: list[Block], keys_of: Callable[[pa.RecordBatch], np.ndarray], inside: bool, then: tuple[Step, StructType | str] | None = None) -> DataFrame:
    """The rows whose key some filter holds (perhaps falsely), or those whose key surely none holds; nothing shuffles.

    then: a step for the picked rows and its schema.  It runs in the same worker: two Python nodes in a row would take two for each task.
    """
    step, schema = then or (lambda batches: batches, df.schema)

    def one(block: Block) -> DataFrame:
        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = keys_of(batch)
                hit = block.contains(keys)
                yield batch.filter(pa.array(block.mine(keys) & (hit if inside else ~hit)))

        return df.mapInArrow(tidied(lambda batches: step(hits(batches))), schema)

    out = one(filters[0])
    for block in filters[1:]:
        out = out.unionByName(one(block))
    return out
