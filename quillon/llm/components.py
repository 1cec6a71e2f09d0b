"""Connected components of a link table, as a distributed union-find by stars.

Large-star and small-star rounds alternate until the links no longer change (Kiveris et al., 2014).  Both
are a grouped minimum, pre-aggregated, and a join with it.  The minima are a table of their own, so the join is
of two plain exchanges, which Spark splits at run time for a node with many neighbours; no component is
gathered in one task and none reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v), u > v.  Large: each node hands its larger neighbours its least neighbour; small: the smaller ones."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialise(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = links.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each linked node reaches.  Nodes without links have no row."""
    now = materialise(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), "links"
    )
    mark = _mark(now)
    while True:
        wide = materialise(_star(now, True), "links")
        then = materialise(_star(wide, False), "links")
        release(wide)
        new = _mark(then)
        release(now)
        now = then
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
