"""Image metrics in numpy behind a pandas function, and admission of uploads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the quality gate.
LEAST_AREA, LEAST_SHARP, MOST_GLARE, LEAST_DARK, LEAST_CONTRAST = 250_000, 45.0, 0.12, 0.01, 18.0
MOST_BYTES, MOST_PIXELS = 10 * 1024 * 1024, 40_000_000

_METRICS = "width int, height int, sharpness double, glare double, dark double, contrast double"


def metrics(grey: np.ndarray, tiles: int = 8) -> tuple[float, float, float, float]:
    """Variance of the Laplacian, share of pixels from 245, share up to 200, median of the tiles' deviation."""
    g = grey.astype(np.float64)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    parts = [t.std() for band in np.array_split(g, min(tiles, g.shape[0])) for t in np.array_split(band, min(tiles, g.shape[1]), axis=1)]
    return float(laplacian.var()), float((g >= 245).mean()), float((g <= 200).mean()), float(np.median(parts))


def with_metrics(images: DataFrame, pixels: str = "pixels", width: str = "width", height: str = "height") -> DataFrame:
    """Adds `metrics` to rows that hold 8-bit grey pixels as bytes; null where they don't fit the size."""

    @F.pandas_udf(_METRICS)
    def read(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, ws, hs in parts:
            out = []
            for raw, w, h in zip(data, ws, hs, strict=True):
                if raw is None or not w or not h or len(raw) != w * h:
                    out.append((None,) * 6)
                else:
                    out.append((int(w), int(h), *metrics(np.frombuffer(raw, np.uint8).reshape(int(h), int(w)))))
            yield pd.DataFrame(out, columns=["width", "height", "sharpness", "glare", "dark", "contrast"])

    return images.withColumn("metrics", read(pixels, width, height))


def gate(m: Column) -> Column:
    """status, warnings and guidance of measured images.  Low contrast gives guidance but no warning."""
    sharp = m["sharpness"] >= LEAST_SHARP
    glare = (m["glare"] > MOST_GLARE) & ~(sharp & (m["dark"] >= LEAST_DARK))
    tests = [(m["width"].isNull(), "undecodable"), (m["width"] * m["height"] < LEAST_AREA, "low_resolution"), (~sharp, "blurred"), (glare, "glare")]
    warnings = F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(w)) for t, w in tests)), lambda w: w.isNotNull())
    guidance = F.concat(warnings, F.when(F.coalesce(m["contrast"] < LEAST_CONTRAST, F.lit(False)), F.array(F.lit("low_contrast"))).otherwise(F.array().cast("array<string>")))
    return F.struct(F.when(F.size(warnings) == 0, "good").otherwise("review").alias("status"), warnings.alias("warnings"), guidance.alias("guidance"))


def sniff(content: Column) -> Column:
    """The format that an image's first bytes tell, or null."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "JPEG")
        .when(head.startswith("89504E470D0A1A0A"), "PNG")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")
        .when(head.startswith("424D"), "BMP")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "TIFF")
    )


def _jpeg(raw: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(raw) and raw[at] == 0xFF:
        kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
            return int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big")
        at += 1 if kind == 0xFF else 2 + size
    return None


def _webp(raw: bytes) -> tuple[int, int] | None:
    little = lambda a, b: int.from_bytes(raw[a:b], "little")
    kind = raw[12:16]
    if kind == b"VP8X" and len(raw) >= 30:
        return 1 + little(24, 27), 1 + little(27, 30)
    if kind == b"VP8L" and len(raw) >= 25:
        return 1 + (little(21, 25) & 0x3FFF), 1 + (little(21, 25) >> 14 & 0x3FFF)
    if kind == b"VP8 " and len(raw) >= 30:
        return little(26, 28) & 0x3FFF, little(28, 30) & 0x3FFF
    return None


def _tiff(raw: bytes) -> tuple[int, int] | None:
    order = "little" if raw[:2] == b"II" else "big"
    number = lambda a, n: int.from_bytes(raw[a : a + n], order)
    table, found = number(4, 4), {}
    for k in range(number(table, 2)):
        at = table + 2 + 12 * k
        found[number(at, 2)] = number(at + 8, 2 if number(at + 2, 2) == 3 else 4)
    return (found[256], found[257]) if {256, 257} <= set(found) else None


def size_of(raw: bytes | None, kind: str | None) -> tuple[int, int] | None:
    """Width and height that an image's own header tells; None if it has none, or none that is positive."""
    found = None
    if kind == "PNG" and len(raw) >= 24 and raw[12:16] == b"IHDR":
        found = int.from_bytes(raw[16:20], "big"), int.from_bytes(raw[20:24], "big")
    elif kind == "BMP" and len(raw) >= 26:
        found = int.from_bytes(raw[18:22], "little", signed=True), abs(int.from_bytes(raw[22:26], "little", signed=True))
    elif kind in ("JPEG", "WEBP", "TIFF"):
        found = {"JPEG": _jpeg, "WEBP": _webp, "TIFF": _tiff}[kind](raw)
    return found if found and min(found) > 0 else None


def admitted(files: DataFrame) -> DataFrame:
    """binaryFile rows with sha256, format, size and reject_reason (null: admitted).  Spark's file source gives no row for
    an empty file; rows from elsewhere may be empty.  Sizes come from the headers: pixels are not decoded here."""

    @F.pandas_udf("width int, height int")
    def sizes(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for content, kinds in parts:
            found = [size_of(raw, k) or (None, None) for raw, k in zip(content, kinds, strict=True)]
            yield pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    kind = sniff(F.col("content"))
    # Only what may be an image of admissible length goes to Python.
    looked = F.when((F.col("length") <= MOST_BYTES) & kind.isNotNull(), F.col("content"))
    told = files.withColumn("format", kind).withColumn("size", sizes(F.coalesce(looked, F.lit(b"")), F.when(looked.isNotNull(), F.col("format"))))
    pixels = F.col("size.width").cast("long") * F.col("size.height")
    reason = (
        F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too_large").when(F.col("format").isNull(), "not_an_image")
        .when(pixels.isNull(), "undecodable").when(pixels > MOST_PIXELS, "too_many_pixels")
    )
    return told.select("path", "length", F.sha2("content", 256).alias("image_sha256"), "format", "size.width", "size.height", reason.alias("reject_reason"))
