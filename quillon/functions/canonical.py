"""Canonical forms: two readings of a field agree if theirs are equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import comparable, normalised

DAY_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d-M-yy", "d MMM yyyy", "d MMMM yyyy")
MONTH_FORMATS = ("M-yyyy", "MMM yyyy", "MMMM yyyy")

# Units that count as one.
UNITS = {"gm": "g", "gms": "g", "unit": "unit", "units": "unit", "pc": "piece", "pcs": "piece", "piece": "piece", "pieces": "piece"}

_QUANTITY = r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(kg|gms?|gm|mg|g|ml|cl|l|units?|pcs?|pieces?)\b"


def _filled(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def price(x: Column) -> Column:
    """The first number, without thousands commas, to two places."""
    number = _filled(F.regexp_extract(x, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1))
    return F.bround(F.replace(number, F.lit(","), F.lit("")).try_cast("decimal(30,10)"), 2).cast("decimal(30,2)").cast("string")


def quantity(x: Column) -> Column:
    """Number and unit; equal amounts of a unit have one form whatever their trailing zeros."""
    number = F.replace(_filled(F.regexp_extract(x, _QUANTITY, 1)), F.lit(","), F.lit("."))
    plain = number.try_cast("decimal(38,10)").cast("string")
    unit = F.lower(F.regexp_extract(x, _QUANTITY, 2))
    known = F.create_map(*(F.lit(v) for kv in UNITS.items() for v in kv))
    short = F.regexp_replace(plain, r"\.?0+$", "")
    return F.when(plain.isNotNull(), F.concat(short, F.lit(" "), F.coalesce(F.try_element_at(known, unit), unit)))


def contact(x: Column) -> Column:
    parts = F.filter(F.transform(F.split(x, r"\s*[,;]\s*"), comparable), lambda p: p != "")
    return _filled(F.array_join(F.array_sort(parts), "|"))


def _first_date(x: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in formats))


def date(x: Column) -> Column:
    """yyyy-MM-dd, or yyyy-MM where no day is given; null if it is no date."""
    # Month names parse whatever their case; separators become hyphens.
    clean = F.initcap(F.lower(F.regexp_replace(normalised(x), "[./]", "-")))
    day = F.date_format(_first_date(clean, DAY_FORMATS), "yyyy-MM-dd")
    return F.coalesce(day, F.date_format(_first_date(clean, MONTH_FORMATS), "yyyy-MM"))


def value(field: Column, x: Column) -> Column:
    """The canonical form of a field's value; null for null or empty."""
    form = (
        F.when(field == "mrp", price(x))
        .when(field == "net_quantity", quantity(x))
        .when(field == "consumer_care_contact", contact(x))
        .when(field == "date_of_manufacture", date(x))
        .otherwise(_filled(comparable(x)))
    )
    return F.when(x != "", form)


def equivalent(field: Column, a: Column, b: Column) -> Column:
    """Equal canonical forms; two missing ones are equal."""
    return value(field, a).eqNullSafe(value(field, b))


def plausible_quantity(number: Column, unit: Column) -> Column:
    n = F.replace(number, F.lit(","), F.lit(".")).try_cast("double")
    limit = F.when(F.lower(unit).isin("kg", "l", "cl"), 100_000).otherwise(1_000_000)
    return F.coalesce((n > 0) & (n <= limit), F.lit(False))


def rank_value(field: Column, x: Column) -> Column:
    """What ranked readings of a field are compared by."""
    number = F.regexp_replace(x, "[^0-9.]", "").try_cast("decimal(30,10)")
    return F.coalesce(F.when(field == "mrp", F.bround(number, 2).cast("decimal(30,2)").cast("string")), normalised(F.lower(x)))


SEVERITY = {"critical": "MAJOR", "high": "MAJOR", "medium": "MINOR", "low": "MINOR", "info": "MINOR"}


def severity(x: Column, strict: bool = False) -> Column:
    """MAJOR or MINOR.  Lenient: null is MAJOR, and what is already folded stays; strict: anything else is an error."""
    known = F.create_map(*(F.lit(v) for kv in SEVERITY.items() for v in kv))
    folded = F.try_element_at(known, F.lower(x))
    if strict:
        return F.when(folded.isNotNull(), folded).otherwise(F.raise_error(F.concat(F.lit("unknown severity: "), F.coalesce(x, F.lit("null")))).cast("string"))
    return F.coalesce(folded, F.when(F.upper(x).isin("MAJOR", "MINOR"), F.upper(x)), F.lit("MAJOR"))
