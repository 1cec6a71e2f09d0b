"""External readers as tables: settings, cache-aware calls, retry routes, and the parsing of their answers.

A reader itself (a model or an OCR engine) is outside; it enters as a function from pandas frames to pandas frames.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..schemas import schema

RESULT = "image_sha256 string, model string, schema_version string, status string, result string, safe_error string, duration_ms double"


@dataclass(frozen=True)
class Settings:
    """Reader settings; each is clamped to its range."""

    timeout_seconds: int = 45
    requests_per_minute: int = 10
    attempts: int = 2
    models: tuple[str, ...] = ()

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "READER_") -> Settings:
        env = dict(os.environ if env is None else env)

        def number(name: str, default: int, low: int, high: int) -> int:
            try:
                return max(low, min(high, int(env.get(prefix + name, default))))
            except ValueError:
                return default

        models = [m.strip() for m in env.get(prefix + "MODELS", "").split(",")]
        return cls(number("TIMEOUT", 45, 2, 45), number("RPM", 10, 1, 1000), number("ATTEMPTS", 2, 1, 5), tuple(dict.fromkeys(m for m in models if m)))


def uncached(images: DataFrame, cache: DataFrame, model: str, version: str) -> DataFrame:
    """Images without a successful cached answer of the model: only these need a call."""
    known = cache.where((F.col("model") == model) & (F.col("schema_version") == version) & (F.col("status") == "ok")).select("image_sha256")
    return images.join(known, "image_sha256", "left_anti")


def call(images: DataFrame, reader: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Answers of a reader, in Arrow batches, once for each image."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(reader, frames)

    return images.dropDuplicates(["image_sha256"]).mapInPandas(run, RESULT)


def routed(attempts: DataFrame) -> DataFrame:
    """The outcome of each request from its attempts in order: request_id, ordinal, model, outcome.

    ok ends a request; stop (an error that no other model can mend) ends it too; transient tries again; malformed
    goes to the next model.  The request's state is that of the first ending attempt, else exhausted.
    """
    w = Window.partitionBy("request_id").orderBy("ordinal")
    ending = F.col("outcome").isin("ok", "stop")
    over = F.coalesce(F.sum(ending.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    made = attempts.withColumn("_over", over).where(~F.col("_over"))
    return made.groupBy("request_id").agg(
        F.max_by(F.when(F.col("outcome").isin("ok", "stop"), F.col("outcome")).otherwise("exhausted"), "ordinal").alias("state"),
        F.max_by("model", "ordinal").alias("model"),
        F.count("*").alias("attempts"),
    )


WORDS = "array<struct<text:string,confidence:double,polygon:array<struct<x:double,y:double>>>>"


def parse_words(answers: DataFrame, key: str, payload: str) -> DataFrame:
    """Word lists of an OCR answer as rows with boxes; an answer that doesn't parse gives none."""
    words = answers.select(key, F.posexplode(F.from_json(payload, WORDS)).alias("word_idx", "w"))
    box = geometry.of_polygon(F.col("w.polygon"))
    return words.select(key, "word_idx", F.col("w.text").alias("text"), F.coalesce("w.confidence", F.lit(0.0)).alias("confidence"), box.alias("box"))


def candidates(answers: DataFrame, key: str = "inspection_id", payload: str = "result") -> DataFrame:
    """Candidate lists of a reader's answer as rows; boxes are [ymin, xmin, ymax, xmax]."""
    told = "array<struct<field:string,raw_text:string,normalized_value:string,readable:boolean,model_score:double,bbox_2d:array<int>,evidence_text:string,notes:string>>"
    rows = answers.select(key, F.posexplode(F.from_json(payload, told)).alias("cand_idx", "c"))
    b = F.col("c.bbox_2d")
    at = lambda i: F.try_element_at(b, F.lit(i))
    nbox = F.when(F.size(b) == 4, F.struct(at(1).alias("ymin"), at(2).alias("xmin"), at(3).alias("ymax"), at(4).alias("xmax")))
    names = [f.name for f in schema("candidates")]
    return rows.select(F.col(key).cast("long").alias("inspection_id"), "cand_idx", "c.*", nbox.alias("nbox")).select(*names)
