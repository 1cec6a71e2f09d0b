"""Words to lines, and questions about lines that need no extractor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_sessions(rows: DataFrame, group: list[str], order: list[str], start: Column, end: Column, limit: Column, out: str = "session") -> DataFrame:
    """Numbers runs of rows whose gap to the one before stays within a limit."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.lag(end).over(w)
    return rows.withColumn("_new", F.coalesce((start - before > limit).cast("int"), F.lit(0))).withColumn(out, F.sum("_new").over(w)).drop("_new")


def words_to_lines(words: DataFrame, group: list[str], gap: float = 35.0, heights: float = 2.2) -> DataFrame:
    """words: group, word_idx, text, confidence, x1, y1, x2, y2 of one text row -> its lines.

    A gap above 35 pixels, or 2.2 mean heights if that is more, parts two lines.
    """
    mean_h = F.avg(F.col("y2") - F.col("y1")).over(Window.partitionBy(*group))
    cut = gap_sessions(words.withColumn("_h", mean_h), group, ["x1", "word_idx"], F.col("x1"), F.col("x2"), F.greatest(F.lit(gap), F.col("_h") * heights), "line_no")
    told = F.transform(F.array_sort(F.collect_list(F.struct("x1", "word_idx", "text"))), lambda x: x["text"])
    return cut.groupBy(*group, "line_no").agg(
        F.array_join(told, " ").alias("text"), F.avg("confidence").alias("confidence"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )


def columns_by_gap(rows: DataFrame, group: list[str], centre: str, limit: Column, out: str = "column") -> DataFrame:
    """Column numbers: how many wide gaps between distinct centres lie to the left."""
    w = Window.partitionBy(*group).orderBy(centre)
    distinct = rows.select(*group, centre, limit.alias("_limit")).distinct()
    wide = F.coalesce((F.col(centre) - F.lag(centre).over(w) > F.col("_limit")).cast("int"), F.lit(0))
    numbered = distinct.withColumn("_wide", wide).withColumn(out, F.sum("_wide").over(w)).select(*group, centre, out)
    return rows.join(numbered, [*group, centre])


def nearest(left: DataFrame, right: DataFrame, on: list[str], distance: Column, key: list[str], ties: list[str], reach: Column | None = None) -> DataFrame:
    """For each left row (key) the nearest right row of the same group, within reach; ties by the given columns.

    An equi-join on the group with the distance as a condition: pairs form within a panel, not across panels.
    """
    pairs = left.join(right, on).withColumn("distance", distance)
    if reach is not None:
        pairs = pairs.where(F.col("distance") <= reach)
    rest = [c for c in pairs.columns if c not in (*on, *key, "distance", *ties)]
    order = ["distance", *ties]
    return pairs.groupBy(*on, *key).agg(F.min(F.struct(*order, *rest)).alias("_n")).select(*on, *key, "_n.*")


def pass_support(rows: DataFrame, group: list[str], value: str, source: str) -> DataFrame:
    """How many passes read each value of a group."""
    return rows.groupBy(*group, value).agg(F.count_distinct(source).alias("passes"), F.count("*").alias("readings"), F.max("confidence").alias("confidence"))


def malformed_vote(rows: DataFrame, group: list[str], value: str, source: str) -> DataFrame:
    """The value with most passes, then readings, then confidence; null where the first two tie on passes and readings."""
    votes = pass_support(rows, group, value, source)
    w = Window.partitionBy(*group).orderBy(F.col("passes").desc(), F.col("readings").desc(), F.col("confidence").desc(), F.col(value))
    top = votes.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    first = lambda c: F.max(F.when(F.col("_n") == 1, F.col(c)))
    second = lambda c: F.max(F.when(F.col("_n") == 2, F.col(c)))
    tie = F.coalesce((first("passes") == second("passes")) & (first("readings") == second("readings")), F.lit(False))
    return top.groupBy(*group).agg(F.when(~tie, first(value)).alias(value), first("passes").alias("passes"), first("readings").alias("readings"))


def token_confidence(tokens: Column, start: Column, end: Column) -> Column:
    """Mean confidence of the tokens (structs with begin, finish, confidence) that a span touches."""
    some = F.filter(tokens, lambda t: (t["finish"] > start) & (t["begin"] < end))
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda acc, t: acc + t["confidence"]) / F.size(some))


def orientation_best(rows: DataFrame, group: list[str], angle: str) -> DataFrame:
    """The turn with most label hits, then useful characters (500 count at most), then mean confidence; the first of equals."""
    score = F.struct(F.col("label_hits"), F.least(F.col("useful_chars"), F.lit(500)).alias("chars"), F.col("mean_confidence"), (-F.col(angle)).alias("o"))
    return rows.groupBy(*group).agg(F.max_by(F.col(angle), score).alias(angle))


TOKENS = "array<struct<text:string,confidence:double,box:struct<x1:int,y1:int,x2:int,y2:int>>>"


def tokens_of(text: Column, confidence: Column, box: Column) -> Column:
    """A line's words with boxes in proportion to their places in it; for adapters that give a line's box alone."""
    zero = F.struct(F.lit(1).alias("at"), F.array().cast(TOKENS).alias("out"))
    share = lambda at: (box["x1"] + F.floor((box["x2"] - box["x1"]) * at / F.length(text))).cast("int")

    def step(acc: Column, word: Column) -> Column:
        begin = F.call_function("locate", word, text, acc["at"])
        end = begin + F.length(word)
        placed = F.when(box.isNotNull(), F.struct(share(begin - 1).alias("x1"), box["y1"].alias("y1"), share(end - 1).alias("x2"), box["y2"].alias("y2")))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(word.alias("text"), confidence.alias("confidence"), placed.alias("box")))).alias("out"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), zero, step, lambda acc: acc["out"])
