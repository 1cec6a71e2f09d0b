"""Panel extraction over DataFrames.

A panel is one group of tens to hundreds of lines; panels are independent.  Panels of equal lines meet and are read once.
Lines come from Arrow batches in one pass, some thousand at once.  Row clustering is an order-dependent fold and label
matching needs spans and a word similarity that built-in functions lack, hence the Python function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...schemas import BOX, FIELDS
from .fields import extract, extract_all, retry_regions
from .geometry import Box, Line

CORNERS = ("x1", "y1", "x2", "y2")
#: Lines of panels that are read at once.
AT_ONCE = 4_000


def _text(x):
    return x if isinstance(x, str) and x else None


def _box(*corners: int | None) -> Box | None:
    return None if None in corners else corners


def _sure(x: float | None) -> float:
    return float("nan") if x is None else x


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[int, list[int] | None, Line]]:
    """A batch's lines, each with its group; the first of a group has the group's panels."""
    for group, ids, place, text, confidence, tokens, block, source, *box in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        said = [(t["text"], t["confidence"], t["box"] and _box(*(t["box"][c] for c in CORNERS))) for t in tokens or ()]
        yield group, ids, Line(place, text or "", _sure(confidence), _box(*box), said, block or None, source or None)


def _dealt(rows: DataFrame, *by: str | Column) -> DataFrame:
    """Rows over all shuffle partitions: reading costs far more than their bytes tell, so partitions must not be merged by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _by_panel(lines: DataFrame, read: Callable[[list[list[Line]]], list[list[tuple]]], told: dict[str, pa.DataType]) -> DataFrame:
    """What `read` tells of each panel: rows of the columns `told`, which end in a box."""
    kind = pa.struct([*told.items(), *((c, pa.int32()) for c in CORNERS)])

    def answer(panels: list[tuple[list[int], list[Line]]]) -> pa.RecordBatch:
        found = [[dict(zip(kind.names, (*r[:-1], *(map(int, r[-1]) if r[-1] else (None,) * 4)), strict=True)) for r in rows] for rows in read([x for _, x in panels])]
        return pa.RecordBatch.from_arrays([pa.array([ids for ids, _ in panels], pa.list_(pa.int64())), pa.array(found, pa.list_(kind))], ["ids", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panels, group, waiting = [], None, 0
        for batch in batches:
            for mine, ids, line in _lines(batch):
                if mine != group:
                    if waiting >= AT_ONCE:
                        yield answer(panels)
                        panels, waiting = [], 0
                    panels.append((ids, []))
                    group = mine
                panels[-1][1].append(line)
                waiting += 1
        if panels:
            yield answer(panels)

    line = F.struct("line_idx", "text", F.col("confidence").cast("double").alias("confidence"), "tokens", "block_id", "source_pass", *(F.col(f"box.{c}").alias(c) for c in CORNERS))
    panels = _dealt(lines.select("panel_id", line.alias("line")), "panel_id").groupBy("panel_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    # Dealt by a hash: Spark leaves out a second dealing by the lines themselves, and then merges partitions.
    equal = _dealt(panels.groupBy("lines").agg(F.collect_list(F.struct("panel_id")).alias("ids")), F.xxhash64("lines")).select(F.monotonically_increasing_id().alias("group"), "ids.panel_id", "lines")
    rows = equal.select("group", "panel_id", F.posexplode("lines").alias("at", "line")).select("group", F.when(F.col("at") == 0, F.col("panel_id")).alias("ids"), "line.*")
    names = {pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double", pa.int32(): "int"}
    found = rows.mapInArrow(run, f"ids array<bigint>, found array<struct<{','.join(f'{x.name}:{names[x.type]}' for x in kind)}>>")
    out = found.select(F.explode("ids").alias("panel_id"), "found").select("panel_id", F.inline("found"))
    return out.select("panel_id", *told, F.when(F.col("x1").isNotNull(), F.struct(*CORNERS)).cast(BOX).alias("box"))


def extract_panels(lines: DataFrame) -> DataFrame:
    """panel_lines -> a row for each panel and declared field, as evidence."""

    def read(panels: list[list[Line]]) -> list[list[tuple]]:
        return [[(f, e.value, e.confidence, e.box) for f, e in found.items()] for found in extract_all(panels)]

    return _by_panel(lines, read, {"field": pa.string(), "value": pa.string(), "confidence": pa.float64()})


def retries(lines: DataFrame) -> DataFrame:
    def read(panels: list[list[Line]]) -> list[list[tuple]]:
        return [retry_regions(x, found) for x, found in zip(panels, extract_all(panels), strict=True)]

    return _by_panel(lines, read, {"field": pa.string()})


@lru_cache(maxsize=1 << 16)
def _alone(text: str, confidence: float, field: str, provenance: str | None) -> str | None:
    """A field's value in one line of its own; readers repeat texts, so answers are kept."""
    box = (0, 0, 1000, 100)
    return extract([Line(0, text, confidence, box, [(text, confidence, box)], provenance, provenance)], (field,))[field].value


def extract_texts(rows: DataFrame, text: str, confidence: str, field: str, provenance: str | None, out: str) -> DataFrame:
    """Adds column `out`: what a field's extractor finds in a text that stands alone as one line.  Equal texts meet, and are read once.

    provenance: the pass name that the line carries, or None; with one, weak readings are refused.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField(out, StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [_alone(t, float(c), f, provenance) if _text(t) and f in FIELDS else None for t, c, f in zip(frame[text], frame[confidence], frame[field], strict=True)]
            yield frame.assign(**{out: pd.Series(values, index=frame.index, dtype=object)})

    return _dealt(rows, text, field).mapInPandas(run, schema).withColumn(out, F.col(out))
