"""Ledger questions: latest state, history, review queue, counts, nested detail, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULT_REVIEW, PENDING_REVIEW, STATUSES

LIMIT_MAX = 500


def clamp(limit: int, most: int = LIMIT_MAX) -> int:
    return max(1, min(int(limit), most))


def latest_per_key(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of each key with the greatest seq, as one hash aggregate with a partial step before the shuffle."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row")).select(key, "_row.*")


def with_latest(base: DataFrame, events: DataFrame, key: str, seq: str, state: str, default: str = DEFAULT_REVIEW) -> DataFrame:
    """Left join with each key's latest event; the state of a key without one is the default."""
    last = latest_per_key(events, key, seq)
    return base.join(last, key, "left").withColumn(state, F.coalesce(F.col(state), F.lit(default)))


def point_lookup(base: DataFrame, wanted: str, number: str = "inspection_id", name: str = "uuid") -> DataFrame:
    """A row by public number or by name; digits may be either."""
    by_name = F.col(name) == wanted
    return base.where(by_name | (F.col(number) == int(wanted)) if wanted.isdigit() else by_name)


def newest(base: DataFrame, order: str, limit: int = LIMIT_MAX) -> DataFrame:
    return base.orderBy(F.col(order).desc()).limit(clamp(limit))


def search_text(*parts: Column) -> Column:
    """What a search looks through: lower case, parts joined by blanks."""
    return F.lower(F.concat_ws(" ", *(p.cast("string") for p in parts)))


def history(
    base: DataFrame,
    order: str,
    *,
    limit: int = LIMIT_MAX,
    equal: dict[str, str | None] | None = None,
    created: str | None = None,
    created_from: str | None = None,
    created_to: str | None = None,
    text: Column | None = None,
    search: str | None = None,
) -> DataFrame:
    """The newest rows first limited, then filtered: a search does not reach beyond the limit.

    Times are ISO strings and compare as strings.  Empty filters are none.
    """
    rows = newest(base, order, limit)
    tests = [F.col(c) == v for c, v in (equal or {}).items() if v]
    if created_from:
        tests.append(F.col(created) >= created_from)
    if created_to:
        tests.append(F.col(created) <= created_to)
    if search and search.strip():
        tests.append(text.contains(search.strip().lower()))
    return reduce(DataFrame.where, tests, rows)


def review_queue(rows: DataFrame, order: str, status: str = "overall_status", state: str = "review_status", limit: int = LIMIT_MAX, manual: str = STATUSES[2]) -> DataFrame:
    """Of the newest 500 rows, those that wait for someone; the newest first."""
    waiting = (F.col(status) == manual) | F.col(state).isin(*PENDING_REVIEW)
    return newest(rows, order).where(waiting).orderBy(F.col(order).desc()).limit(clamp(limit))


def counts_zero_filled(rows: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """Counts by value: known values always, others as they occur."""
    found = rows.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
    base = rows.sparkSession.createDataFrame([(k,) for k in known], "k string")
    return found.unionByName(base.select("k", F.lit(0).cast("long").alias("n"))).groupBy("k").agg(F.sum("n").alias("n")).select(F.col("k").alias(column), "n")


def daily_counts(rows: DataFrame, created: str, days: int = 14) -> DataFrame:
    """Counts of the last recorded days, oldest first.  A day is the first ten characters of an ISO time."""
    day = rows.groupBy(F.substring(created, 1, 10).alias("day")).agg(F.count("*").alias("n"))
    return day.orderBy(F.col("day").desc()).limit(days).orderBy("day")


def shares(counts: DataFrame, label: str = "day") -> DataFrame:
    """Counts with their maximum and their share of the total."""
    whole = Window.partitionBy()
    return counts.withColumn("top", F.max("n").over(whole)).withColumn("share", (F.col("n").cast("decimal(20,6)") / F.sum("n").over(whole)).cast("decimal(10,4)"))


def totals(rows: DataFrame, order: str, sample: int = LIMIT_MAX) -> DataFrame:
    n = newest(rows, order, sample).agg(F.count("*").alias("total_inspections"))
    return n.select("total_inspections", F.lit(sample).alias("sample_limit"), (F.col("total_inspections") < sample).alias("is_complete_history"))


def nested(base: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Each row with its children as an array, in order; an empty one if it has none."""
    rest = [c for c in children.columns if c != key and c not in order]
    entry = F.struct(*order, *rest)
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias(name))
    out = base.join(lists, key, "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))


def cache_put(cache: DataFrame, more: DataFrame) -> DataFrame:
    """Upsert as append: the later row of a key counts."""
    return cache.unionByName(more)


def cache_get(cache: DataFrame, keys: list[str], seq: str) -> DataFrame:
    rest = [c for c in cache.columns if c not in keys]
    return cache.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row")).select(*keys, "_row.*")


def first_hit(wanted: DataFrame, route: DataFrame, cache: DataFrame, key: str, model: str, ordinal: str) -> DataFrame:
    """For each key the first model of the route that the cache has."""
    hits = wanted.join(cache, key).join(F.broadcast(route), model)  # a route is a handful of models
    rest = [c for c in hits.columns if c != key]
    return hits.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("_row")).select(key, "_row.*")


def route(models: list[str]) -> list[str]:
    """Models in order, blanks and repeats dropped."""
    return list(dict.fromkeys(m.strip() for m in models if m and m.strip()))
