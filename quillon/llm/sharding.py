"""Shards from a hierarchical weighted hash tree, with DataFrame functions only.

A tree has regions, racks and shards; a node's weight is the sum of its shards' weights.  A row descends from
the root: at each level every child draws -ln(u) / weight, u being a hash of the child's name and of doc_id,
and the least draw wins.  A child wins in proportion to its weight, and as a draw depends on nothing but its
own child, a change of weight moves rows only into or out of the child that changed: all other subtrees
keep theirs.

Law: key.  doc_id and the tree decide, so equal rows always meet.  Growth adds a shard as a region of its
own, whose draw is new while all others stay: rows move into the new shard only.

A null doc_id hashes like any other value.  A null text has no bytes.  Rows that repeat a doc_id share its
shard and get slots of their own.  Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows that one group of the slot numbering holds, about.
SLOT_GROUP = 20_000
OVERHEAD_BYTES = 8


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int = 24, regions: int = 2, racks: int = 3) -> tuple[Leaf, ...]:
    """Shards dealt evenly, in order, to regions and their racks."""
    places = [(g, r) for g in range(regions) for r in range(racks)]
    return tuple(Leaf(*places[i * len(places) // shards], i) for i in range(shards))


def grow(tree: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """One more shard, as the only one of a new region."""
    return (*tree, Leaf(max(x.region for x in tree) + 1, 0, max(x.shard for x in tree) + 1, weight))


def _name(level: int, *path: int) -> int:
    """A node's 64-bit name: its level and the numbers on its path, 20 bits each."""
    out = level
    for x in path:
        out = (out << 20) | (x + 1)
    return out


def _draw(key: Column, name: int, weight: float) -> Column:
    high = F.shiftrightunsigned(F.xxhash64(F.lit(name).cast("long"), key), 12)  # 52 bits
    return -F.log((high + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _winner(key: Column, children: dict[int, tuple[int, float]]) -> Column:
    """The child of least draw; children: number -> (name, weight)."""
    draws = [F.struct(_draw(key, name, weight).alias("draw"), F.lit(child).alias("child")) for child, (name, weight) in sorted(children.items())]
    return F.array_min(F.array(*draws))["child"] if len(draws) > 1 else F.lit(next(iter(children)))


def shard_of(df: DataFrame, id_col: str, tree: tuple[Leaf, ...], out: str) -> DataFrame:
    """Adds column `out`.  Only the racks of the chosen region and the shards of the chosen rack draw."""
    key = F.col(id_col)
    regions = sorted({x.region for x in tree})
    region, rack = out + "_region", out + "_rack"
    weigh = lambda some: sum(x.weight for x in some)
    df = df.withColumn(region, _winner(key, {g: (_name(1, g), weigh(x for x in tree if x.region == g)) for g in regions}))
    picks, leaves = None, None
    for g in regions:
        racks = sorted({x.rack for x in tree if x.region == g})
        here = _winner(key, {r: (_name(2, g, r), weigh(x for x in tree if (x.region, x.rack) == (g, r))) for r in racks})
        picks = F.when(F.col(region) == g, here) if picks is None else picks.when(F.col(region) == g, here)
        for r in racks:
            chosen = (F.col(region) == g) & (F.col(rack) == r)
            leaf = _winner(key, {x.shard: (_name(3, g, r, x.shard), x.weight) for x in tree if (x.region, x.rack) == (g, r)})
            leaves = F.when(chosen, leaf) if leaves is None else leaves.when(chosen, leaf)
    return df.withColumn(rack, picks).withColumn(out, leaves).drop(region, rack)


def assign(docs: DataFrame, tree: tuple[Leaf, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row.

    Slots number a shard's rows from 0 without gaps.  Rows of a shard are dealt to groups of bounded size by a
    hash of doc_id and text, so that rows of one doc_id are in several; counts of the groups give each group's first slot.
    Texts are read once: what follows needs a table of some 40 bytes a row.
    """
    tree = tree or even_tree()
    bytes_ = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.length(bytes_) + OVERHEAD_BYTES).cast("long").alias("size"), F.crc32(bytes_).cast("long").alias("text_crc32")
    )
    groups = max(1, -(-docs.count() // (len(tree) * SLOT_GROUP)))
    dealt = shard_of(rows, "doc_id", tree, "shard").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "doc_id", "text_crc32"), F.lit(groups)))
    dealt = materialise(dealt, "dealt")
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("many"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    numbered = dealt.withColumn("nth", nth.cast("long"))
    placed = numbered.join(firsts, ["shard", "part"]).withColumn("slot", F.col("first") + F.col("nth") - 1)
    return shard_of(placed, "doc_id", grow(tree), "grown_shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard")
    )
