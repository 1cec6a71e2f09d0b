"""Near-duplicates: SuperMinHash signatures, banding, exact verification and union-find grouping.

A document's set is its distinct 5-word shingles (A-Z lower-cased, words split at ASCII white space); with
fewer words the whole sequence is the one shingle; without words the set is empty and links with nothing.
Two documents link if 100 * |intersection| >= percent * |union|; percent is 85 unless given.

1. Each task turns texts into shingle hashes and SuperMinHash signatures (Ertl, 2017): every element draws
   one permutation of the signature's places and offers rank + fraction to each, in order of rank.  Ranks
   are correlated, so places fill evenly and variance is lower; once every place holds less than the next
   rank, the rest of the permutations can't matter and drawing stops.
2. Equal sets form classes; only one representative of each goes on, so exact copies cost one row.
3. Bands of 4 places make keys.  In each key's bucket one member, drawn by a hash, is the pivot; the others are
   compared with it on full shingle sets (a star, not all pairs).  Links found are merged by union-find.
4. Buckets with many members outside their largest component get further stars, each around a member outside, as long as that
   halves what is outside.
5. What buckets then still hold in several components is finished exactly, in units of bounded size: two blocks of a bucket's members,
   so that a large bucket is many tasks.  An odd sketch (the parity of how many elements hash to each of 1024 places) gives a lower
   bound of the symmetric difference, so only members that might link go on; those meet again with their full sets, and a unit hands on
   only links that join two components.  No step writes candidate pairs by the square of a bucket; nothing is capped, and the bound loses no link.

A pair at similarity 0.8 misses all 20 bands with probability 3e-5, at 0.85 with 4e-7, at 0.9 with 5e-10.
doc_id is taken to be unique: rows that repeat it are separate documents under one id, and links of either
count for that id.  Null texts have no words.  A row with a null doc_id gets the component of its equals, or
null.  Extra columns pass through drop_near(); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import fresh, id_text, joined, materialise, mix64, release, slices, tidied
from .components import connected_components

SHINGLE = 5
PERCENT = 85
PLACES = 80
BAND = 4
SKETCH = 1024
#: Members of a bucket in a block, and shingles of a block where members bring their sets.
MEMBERS = 1024
SHINGLES = 1 << 20
#: Pairs that one numpy step looks at.
PAIRS = 1 << 16
WORDS = [f"s{i}" for i in range(SKETCH // 64)]

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data, offsets = joined(texts)
    data = data.translate(_LOWER)
    plain = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(plain)
    words, ends = lists.values, lists.offsets.to_numpy().astype(np.int64)
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        words = words.filter(pa.array(real))
    coded = words.dictionary_encode()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    w = hashed[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    fold = w[: max(0, len(w) - SHINGLE + 1)]
    for k in range(1, SHINGLE):
        fold = mix64(fold, k) ^ w[k : k + len(fold)]
    fold = mix64(fold, SHINGLE)
    out = []
    at = ends.tolist()
    for a, b in zip(at, at[1:], strict=False):
        if b - a >= SHINGLE:
            s = fold[a : b - SHINGLE + 1].copy()
            s.sort()
            new = np.empty(len(s), dtype=bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(w[a:b].tobytes(), seed=b - a)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """A row of `places` values for each set: rank in the high 16 bits, fraction below."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    best = np.full((len(sets), places), np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    swaps: list[np.ndarray] = []  # for each rank so far, the place that each element's permutation swapped with it
    flat = best.reshape(-1)
    for rank in range(places):
        draw = mix64(element, 100 + rank)
        k = rank + (((draw >> np.uint64(32)) * np.uint64(places - rank)) >> np.uint64(32)).astype(np.int64)
        place = k  # what the permutation holds at k after the earlier swaps
        for earlier in range(rank - 1, -1, -1):
            place = np.where(place == earlier, swaps[earlier], np.where(place == swaps[earlier], earlier, place))
        value = (np.uint64(rank) << np.uint64(48)) | (mix64(draw, 7) >> np.uint64(16))
        np.minimum.at(flat, doc * places + place, value)
        open_ = (best == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1) & (sizes > 0)
        if not open_.any():
            break
        on = open_[doc]
        element, doc = element[on], doc[on]
        swaps = [s[on] for s in [*swaps, k]]
    return best


def signature_columns(sets: list[np.ndarray]) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """Set digests, the 64-bit words of the odd sketch, and band keys."""
    signature = superminhash(sets)
    digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = (np.concatenate([*sets, np.zeros(0, np.uint64)]) & np.uint64(SKETCH - 1)).astype(np.int64)
    odd = (np.bincount(doc * SKETCH + place, minlength=len(sets) * SKETCH) & 1).astype(np.uint8)
    sketch = np.packbits(odd.reshape(len(sets), SKETCH), axis=1, bitorder="little").view("<i8")
    keys = np.zeros((len(sets), PLACES // BAND), dtype=np.uint64)
    for band in range(PLACES // BAND):
        key = np.full(len(sets), np.uint64(band))
        for j in range(BAND):
            key = mix64(key ^ signature[:, band * BAND + j], 50 + j)
        keys[:, band] = key
    return digest, sketch, keys.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, digest, band keys and sketch words of each document, written to shared scratch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"))
            digest, sketch, keys = signature_columns(sets)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.record_batch(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), bands, *(pa.array(sketch[:, i].copy()) for i in range(len(WORDS)))],
                ["doc_id", "n", "digest", "bands", *WORDS],
            )

    schema = "doc_id long, n long, digest binary, bands array<long>" + "".join(f", {w} long" for w in WORDS)
    return materialise(id_text(docs, id_col, text_col).mapInArrow(tidied(run), schema), "signatures")


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, shingles) of the documents in ids (and of a few others, whom a Bloom filter lets through)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [s.view(np.int64) for s in shingle_sets(part.column("text"))]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], ["doc_id", "shingles"])

    key = lambda batch: batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)
    wanted = bloom.picked(id_text(docs, id_col, text_col), bloom.members(ids, ids.columns[0]), key, True, (run, "doc_id long, shingles array<long>"))
    return materialise(wanted, "sets")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if not len(x) or not len(y) or min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [batch.column(c).offsets.to_numpy() for c in ("sa", "sb")]
            flat = [batch.column(c).values.to_numpy() for c in ("sa", "sb")]
            keep = [similar(*(flat[k][ends[k][i] : ends[k][i + 1]] for k in (0, 1)), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb").mapInArrow(tidied(run), "a long, b long")


def _close(left: str, right: str, percent: int = PERCENT) -> Column:
    """Whether sizes and sketches allow the similarity.  100 (a + b - d) >= percent (a + b + d) bounds the difference d."""
    c = F.col
    n1, n2 = c(left + "n"), c(right + "n")
    differ = reduce(lambda x, y: x + y, (F.bit_count(c(left + w).bitwiseXOR(c(right + w))) for w in WORDS))
    fits = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    return fits & (differ * (100 + percent) <= (n1 + n2) * (100 - percent))


# ---------------------------------------------------------------- pairs of a bucket, in units of bounded size


def _pairs(first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (x, y), x < y, of rows of one group, some PAIRS at a time; first and end are each row's group's."""
    n = len(first)
    many = end - 1 - np.arange(n)
    total = np.cumsum(many)
    at = 0
    while at < n:
        to = int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right"))
        to = min(n, max(to, at + 1))
        left = np.repeat(np.arange(at, to), many[at:to])
        ahead = np.arange(len(left)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to])
        yield left, left + 1 + ahead
        at = to


def _open_pairs(unit: pa.RecordBatch, first: np.ndarray, end: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different components whose sizes and sketches allow the similarity, each in the first bucket that has both."""
    column = lambda name: unit.column(name).to_numpy(zero_copy_only=False)
    component, n, side, key = column("component"), column("n"), column("side"), column("key")
    alike = column("u") == column("v")
    words = np.stack([column(w).view(np.uint64) for w in WORDS], axis=1)
    bands = unit.column("bands").values.to_numpy(zero_copy_only=False)[unit.column("bands").offsets[0].as_py() :][: unit.num_rows * (PLACES // BAND)].reshape(unit.num_rows, -1)
    for x, y in _pairs(first, end):
        ok = (component[x] != component[y]) & (alike[x] | (side[x] != side[y]))
        ok &= np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
        x, y = x[ok], y[ok]
        differ = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64)
        ok = differ * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
        x, y = x[ok], y[ok]
        shared = bands[x] == bands[y]
        ok = bands[x, shared.argmax(axis=1)] == key[x]
        yield x[ok], y[ok]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Whole units (rows of one key, u and v, which come in order), several at a time, with each row's unit's first row and end."""
    rest: pa.RecordBatch | None = None

    def edges(batch: pa.RecordBatch) -> np.ndarray:
        ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "u", "v")]
        return np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in ids], axis=0)])

    def whole(batch: pa.RecordBatch, starts: np.ndarray):
        sizes = np.diff(np.r_[starts, batch.num_rows])
        return batch, np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)

    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.concat_batches([rest, batch]) if rest is not None else batch
        starts = edges(both)
        if starts[-1]:
            yield whole(both.slice(0, int(starts[-1])), starts[:-1])
        rest = both.slice(int(starts[-1]))
    if rest is not None:
        yield whole(rest, edges(rest))


def _dealt(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """Rows of the buckets (key, rep, component, main and others), once for each unit that they belong to: u, v and side.

    A bucket of `most` weight at most is one unit.  A larger one is cut into blocks by a hash of rep, those outside its main
    component into others than those inside.  A unit is two blocks, one of them outside, or one block outside with itself; so each pair
    that isn't inside the main component meets in one unit, and with few members outside a row is copied to few units.
    """
    c, out = F.col, F.col("component") != F.col("main")
    totals = rows.groupBy("key").agg(F.sum(weight).alias("all"), F.sum(F.when(out, weight).otherwise(F.lit(0))).alias("outside"))
    blocks = lambda x: F.ceil(x / F.lit(most)).cast("int")
    one = c("all") <= most
    totals = totals.select("key", F.when(one, 1).otherwise(F.greatest(F.lit(1), blocks(c("outside")))).alias("bl"), F.when(one, 0).otherwise(F.greatest(F.lit(1), blocks(c("all") - c("outside")))).alias("bm"))
    known = rows.join(materialise(totals, "blocks"), "key")
    draw = F.xxhash64(F.lit(77), "rep")
    inside = ~out & (c("bm") > 0)
    known = known.withColumn("own", F.when(inside, c("bl") + F.pmod(draw, "bm")).otherwise(F.pmod(draw, "bl")).cast("int"))
    others = F.sequence(F.lit(0), F.when(inside, c("bl")).otherwise(c("bl") + c("bm")) - 1)
    unit = lambda j: F.struct(F.least("own", j).alias("u"), F.greatest("own", j).alias("v"), (c("own") > j).alias("side"))
    known = known.withColumn("unit", F.explode(F.transform(others, unit)))
    return known.select("key", "unit.u", "unit.v", "unit.side", *(x for x in rows.columns if x not in ("key", "main"))).repartition("key", "u", "v").sortWithinPartitions("key", "u", "v")


def _promising(rows: DataFrame, percent: int) -> DataFrame:
    """(key, rep) of members that some other's sketch allows to link with; at most one row for each member and unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, first, end in _units(batches):
            found = np.zeros(unit.num_rows, dtype=bool)
            for x, y in _open_pairs(unit, first, end, percent):
                found[x] = found[y] = True
            yield unit.select(["key", "rep"]).filter(pa.array(found))

    return _dealt(rows, F.lit(1), MEMBERS).mapInArrow(tidied(run), "key long, rep long").distinct()


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) confirmed on full sets: within a unit, only those that join two components which nothing has joined yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, first, end in _units(batches):
            ends, flat = unit.column("shingles").offsets.to_numpy(), unit.column("shingles").values.to_numpy()
            rep, component = (unit.column(c).to_numpy() for c in ("rep", "component"))
            root: dict[tuple[int, int], tuple[int, int]] = {}

            def find(node):
                while (up := root.get(node, node)) != node:
                    root[node] = root.get(up, up)
                    node = up
                return node

            a, b = [], []
            for xs, ys in _open_pairs(unit, first, end, percent):
                for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                    p, q = find((int(first[x]), int(component[x]))), find((int(first[x]), int(component[y])))
                    if p != q and similar(flat[ends[x] : ends[x + 1]], flat[ends[y] : ends[y + 1]], percent):
                        root[p] = q
                        a.append(rep[x])
                        b.append(rep[y])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _dealt(rows, F.size("shingles"), SHINGLES).mapInArrow(tidied(run), "a long, b long")


# ---------------------------------------------------------------- grouping


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id."""
    c = F.col
    rows = signatures(docs, id_col, text_col)
    # A class's sketch and bands are those of any of its rows: they depend on the set alone.
    same = [F.first(x).alias(x) for x in ("n", "bands", *WORDS)]
    classes = materialise(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), *same), "classes")
    facts = classes.where(c("rep").isNotNull()).select("rep", "n", "bands", *WORDS)
    keyed = facts.select("rep", F.explode("bands").alias("key"))
    # Tables of their own, so that the joins with them are of two plain exchanges and a large bucket can be split.
    pivots = keyed.groupBy("key").agg(_drawn(0).alias("pivot"), F.count("*").alias("many")).where("many > 1")
    members = materialise(keyed.join(materialise(pivots.select("key", "pivot"), "pivots"), "key"), "members")

    def star(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b), confirmed on full sets."""
        for column, prefix in (("b", "r_"), ("a", "l_")):
            pairs = pairs.join(facts.select(c("rep").alias(column), *(c(x).alias(prefix + x) for x in ("n", *WORDS))), column)
        close = materialise(pairs.where(_close("l_", "r_", percent)).select("a", "b"), "star")
        if close.isEmpty():
            return close
        ends = close.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        return materialise(verified(close, sets_of(docs, ends, id_col, text_col), percent), "links")

    # Each bucket's members meet one of them, drawn by a hash; later, in large buckets, another of those outside the main component.
    found = star(members.where("rep <> pivot").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct())
    parts = materialise(connected_components(found), "components")
    left, nth = None, 0
    while True:
        nth += 1
        rest = _unfinished(members.select("key", "rep"), parts)
        large = rest.where(c("outside") > MEMBERS)
        now = large.where("component <> main").count()
        if not now or (left is not None and 2 * now > left):
            break
        left = now
        drawn = materialise(large.where("component <> main").groupBy("key").agg(F.min_by("component", F.xxhash64(F.lit(nth), "rep")).alias("theirs"), _drawn(nth).alias("pivot")), "pivots")
        meet = large.join(drawn, "key").where("component <> theirs").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
        parts = _joined_up(parts, star(meet))
        release(rest)

    # What buckets still hold in several components meets in units; only members with an open pair go on to full sets.
    of = [x for x in facts.columns if x != "rep"]
    some = materialise(_promising(rest.join(facts, "rep").select("key", "rep", "component", "main", *of), percent), "promising")
    if not some.isEmpty():
        sets = sets_of(docs, some.select("rep").distinct(), id_col, text_col).withColumnRenamed("doc_id", "rep")
        last = some.join(rest, ["key", "rep"]).join(facts, "rep").join(sets, "rep").select("key", "rep", "component", "main", *of, "shingles")
        parts = _joined_up(parts, materialise(_linked(last, percent), "links"))
    for done in (members, rest, some):
        release(done)

    groups = classes.where("size > 1").select("digest", c("rep"))
    found = rows.select("doc_id", c("n").alias("n_shingles"), "digest").join(groups, "digest", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    return found.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def _drawn(nth: int) -> Column:
    """A member of a group, by hash: one that links with nobody is then no likelier than another."""
    return F.min_by("rep", F.xxhash64(F.lit(nth), "rep"))


def _unfinished(members: DataFrame, parts: DataFrame) -> DataFrame:
    """key, rep, component, main (the bucket's largest component) and outside (members of others) of buckets with three members
    or more in several components.  Of two members, the one pair has been compared."""
    placed = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    share = placed.groupBy("key", "component").agg(F.count("*").alias("many"))
    mixed = share.groupBy("key").agg(F.sum("many").alias("size"), F.max(F.struct("many", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1 AND size > 2")
    mixed = materialise(mixed.select("key", F.col("most.component").alias("main"), (F.col("size") - F.col("most.many")).alias("outside")), "mixed")
    return materialise(placed.join(mixed, "key"), "rest")


def _joined_up(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components once links are added."""
    both = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
    return materialise(connected_components(both), "components")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component stays (the least doc_id), with all its columns."""
    found = near_components(docs, id_col, text_col, percent)
    gone = materialise(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    filters = bloom.members(gone, "doc_id")
    at = docs.columns.index(id_col)

    def key(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(at).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)

    name = fresh("gone_id", docs.columns)
    rest = bloom.picked(docs, filters, key, True).join(gone.withColumnRenamed("doc_id", name), F.col(id_col) == F.col(name), "left_anti")
    return bloom.picked(docs, filters, key, False).unionByName(rest)
