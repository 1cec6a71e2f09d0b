"""Tables as Parquet folders: scan, append, and the decoding of JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES, conform, schema


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A screening table in its current schema; files of older schemas take defaults."""
    return conform(spark.read.option("mergeSchema", True).parquet(f"{root}/{table}"), table)


def append(df: DataFrame, root: str, table: str) -> None:
    conform(df, table).write.mode("append").parquet(f"{root}/{table}")


#: Columns that arrive as JSON text, and what a broken one becomes.
JSON_COLUMNS = {"extracted_fields": "map()", "findings": "array()", "quality": None, "context": None, "recommendation": "array()", "performance": "map()", "original_extracted_fields": None}


def decode(raw: DataFrame, table: str = "inspections") -> DataFrame:
    """JSON text columns parsed; text that doesn't parse becomes an empty map or array, or null for a struct."""
    types = {f.name: f.dataType for f in schema(table)}
    out = raw
    for name, empty in JSON_COLUMNS.items():
        if name in raw.columns and dict(raw.dtypes)[name] == "string":
            parsed = F.from_json(F.col(name), types[name], {"mode": "PERMISSIVE"})
            out = out.withColumn(name, F.coalesce(parsed, F.expr(empty).cast(types[name])) if empty else parsed)
    return conform(out, table)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def unknown_keys(json: str, allowed: list[str]) -> F.Column:
    """Keys of a JSON object that its schema forbids."""
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))


__all__ = ["TABLES", "append", "decode", "read", "read_uploads", "scan", "unknown_keys"]
