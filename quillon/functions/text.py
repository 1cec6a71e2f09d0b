"""Scalar text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(x: Column) -> Column:
    """White space (of any script) collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def comparable(x: Column) -> Column:
    """What two readings are compared by: lower case, letters, digits and @ . + only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9@.+]", "")


def safe_filename(x: Column) -> Column:
    """Without control characters and folders, 180 characters at most."""
    clean = F.regexp_replace(x, r"[\x00-\x1f\x7f]", "")
    base = F.regexp_extract(F.replace(clean, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    return F.substring(F.when(F.trim(base) == "", F.lit("upload")).otherwise(base), 1, 180)


# Suffixes by declared media type.
_SUFFIX = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/bmp": ".bmp", "image/tiff": ".tiff"}


def stored_suffix(mime: Column, filename: Column) -> Column:
    """By media type, else the name's own extension, else .bin"""
    known = F.create_map(*(F.lit(v) for kv in _SUFFIX.items() for v in kv))
    own = F.lower(F.regexp_extract(filename, r"(\.[A-Za-z0-9]{1,8})$", 1))
    return F.coalesce(F.try_element_at(known, F.lower(mime)), F.nullif(own, F.lit("")), F.lit(".bin"))


def guarded_cell(x: Column) -> Column:
    """A spreadsheet cell that can't start a formula."""
    return F.when(x.rlike("^[=+@-]"), F.concat(F.lit("'"), x)).otherwise(x)


def bare_filename(x: Column) -> Column:
    """Whether a stored name stays inside its folder."""
    return F.coalesce((x != "") & ~x.rlike(r"[/\\\x00]") & ~x.isin(".", ".."), F.lit(False))


def redacted(x: Column, secrets: list[str] = ()) -> Column:
    """An error text without keys, 240 characters at most."""
    out = x
    for s in secrets:
        out = F.replace(out, F.lit(s), F.lit("[redacted]"))
    out = F.regexp_replace(out, r"(?i)(key|token|secret|authorization)(\s*[=:]\s*)\S+", "$1$2[redacted]")
    return F.substring(normalised(out), 1, 240)


def pdf_text(x: Column) -> Column:
    """Escaped for the report's markup; the rupee sign spelt out."""
    out = x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("₹", "INR ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def field_label(x: Column) -> Column:
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def percent(x: Column) -> Column:
    return F.concat((x * 100).cast("decimal(18,0)").cast("string"), F.lit("%"))


def file_size(x: Column) -> Column:
    kb = x.cast("decimal(20,4)") / 1024
    mb = x.cast("decimal(20,4)") / 1048576
    return (
        F.when(x < 1024, F.concat(x.cast("string"), F.lit(" B")))
        .when(x < 1048576, F.concat(kb.cast("decimal(18,1)").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(mb.cast("decimal(18,1)").cast("string"), F.lit(" MB")))
    )


# Phrases that an explanation of a verdict may not hold.
FORBIDDEN = {
    "compliant": ("non-compliant", "noncompliant", "violation", "manual review required"),
    "potential_non_compliance": ("is compliant", "fully compliant", "no issues"),
    "manual_review_required": ("is compliant", "fully compliant", "is non-compliant", "violates"),
}


def explanation_consistent(text: Column, status: Column) -> Column:
    """A non-empty explanation without a phrase that its verdict forbids."""
    said = F.lower(text)
    bad = F.lit(False)
    for verdict, phrases in FORBIDDEN.items():
        here = F.lit(False)
        for p in phrases:
            here = here | said.contains(p)
        bad = bad | ((status == verdict) & here)
    return F.coalesce((F.trim(text) != "") & ~bad, F.lit(False))


def cleaned_lines(lines: Column, least: int = 3, most: int = 4, longest: int = 300) -> Column:
    """Recommendation lines, or null unless there are 3 or 4 of 1 to 300 characters."""
    clean = F.transform(lines, normalised)
    ok = F.size(clean).between(least, most) & F.forall(clean, lambda s: F.length(s).between(1, longest))
    return F.when(ok, clean)


def ordered_distinct(pairs: Column, order: str, value: str) -> Column:
    """Distinct values of an array of structs in order of first appearance."""
    return F.array_distinct(F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct(p[order], p[value]))), lambda p: p[value]))
