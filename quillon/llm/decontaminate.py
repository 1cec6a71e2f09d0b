"""Benchmark decontamination by Wu-Manber multi-pattern search.

Words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z.  A window is ten consecutive
words of a benchmark item; an item of one to nine words is one window.  Windows become byte strings
" w1 w2 ... wn "; a document becomes its words with one space between, before and after.

The search is Wu and Manber's: a shift table over blocks of B bytes tells how far the reading position may
move, a block whose shift is 0 selects the bucket of windows that end their first m bytes with it, and a
direct comparison confirms.  Equal windows of several items are one, with a list of items.  Many text segments move in step, each at its own position, so that a step is a
few numpy operations over all of them; positions are skipped exactly as in the sequential form.  Windows of
similar length share a table (m is the shortest of them).

Null has no words.  Documents or items without words give no hits.  Items may repeat: each item_id counts
once.  An item without an id hits words like any other, but is neither counted nor listed.  An item_id may be of any type; ids are listed,
and sorted, as strings.  An empty table on either side gives no hits.  Extra columns are not read by the query.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, joined, map_arrow, materialise, slices

WINDOW = 10
#: Bytes of item text that one block of the benchmark holds: what is broadcast at a time is some ten times that.
BLOCK_BYTES = 8 << 20
STRETCHES = "array<struct<a:bigint,b:bigint>>"
#: Bytes of a document that one reading position covers.
SEGMENT = 4096

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").encode().translate(_FOLD).split())


@dataclass
class Table:
    """Wu-Manber tables for windows of m bytes at least; a window is a range of the items' text."""

    m: int
    block: int
    bits: int
    shift: np.ndarray  # by a block's hash: how far the reading position may move
    mask: np.uint64  # the bytes of an 8-byte read that belong to the block
    suffix: np.ndarray  # sorted: the block that ends each window's first m bytes
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    first: np.ndarray  # where a window's items begin in `items`; they end where the next one's begin
    items: list[str | None]
    text: bytes


def _eights(text: bytes) -> np.ndarray:
    """The 8 bytes from each place on, as an integer; the text's last 8 bytes are spare."""
    return np.ndarray(shape=(len(text) - 7,), dtype="<u8", buffer=np.frombuffer(text, dtype=np.uint8), strides=(1,))


def _hash(blocks: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def distinct(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows that has equal ones side by side, and where in it a new one begins."""
    a, b = start.tolist(), end.tolist()
    digest = np.fromiter((xxhash.xxh3_64_intdigest(text[x:y]) for x, y in zip(a, b, strict=True)), dtype=np.uint64, count=len(a))
    order = np.argsort(digest, kind="stable")
    new = np.r_[True, digest[order[1:]] != digest[order[:-1]]]
    for k in np.flatnonzero(~new):  # the same digest: the same bytes, or else one more window
        x, y = order[k - 1], order[k]
        new[k] = text[a[x] : b[x]] != text[a[y] : b[y]]
    return order, np.flatnonzero(new)


def build_tables(items: list[tuple[object, str | None]]) -> list[Table]:
    """Tables for the windows of all items, by classes of length; some 30 bytes for each window beside the text."""
    names = [None if i is None else str(i) for i, _ in items]
    parts, spans, base = [], [], 0
    for item, (_, text) in enumerate(items):
        words = normalised(text)
        if not words:
            continue
        part = b" " + words + b" "
        gaps = np.flatnonzero(np.frombuffer(part, dtype=np.uint8) == 32) + base
        n = min(WINDOW, len(gaps) - 1)
        first = gaps[: len(gaps) - n]
        spans.append(np.stack([first, gaps[n:] + 1, np.full(len(first), n), np.full(len(first), item)]))
        parts.append(part)
        base += len(part)
    if not parts:
        return []
    text = b"".join(parts) + b"\0" * 8
    eights = _eights(text)
    start, end, words, item = np.concatenate(spans, axis=1)
    size = np.minimum(end - start, 32)  # 32 bytes and more share a table
    tables = []
    for low in (2, 4, 8, 16, 32):
        mine = np.flatnonzero((size >= low) & (size < 2 * low))
        if not len(mine):
            continue
        order, heads = distinct(text, start[mine], end[mine])
        owners = np.split(item[mine[order]], heads[1:])
        mine = mine[order[heads]]
        m = int((end - start)[mine].min())
        block = min(8, max(2, m // 2))
        bits = min(22, max(10, (4 * len(mine) * (m - block + 1)).bit_length()))
        mask = np.uint64((1 << (8 * block)) - 1)
        shift = np.full(1 << bits, m - block + 1, dtype=np.int32)
        for j in range(m - block + 1):  # later places of a block allow less; they come last
            shift[_hash(eights[start[mine] + j] & mask, bits)] = m - block - j
        suffix = eights[start[mine] + m - block] & mask
        order = np.argsort(suffix, kind="stable")
        mine = mine[order]
        own = [np.unique(owners[k]).tolist() for k in order.tolist()]
        first = np.cumsum([0, *map(len, own)])
        tables.append(Table(m, block, bits, shift, mask, suffix[order], start[mine], end[mine], words[mine], first, [names[i] for x in own for i in x], text))
    return tables


def occurrences(table: Table, text: bytes) -> Iterator[tuple[int, int, int]]:
    """(place, words, window) of each window of the table in the text, whose last 8 bytes are spare.

    Every segment has a cursor; a cursor stops where the next segment's first place begins.
    """
    last = len(text) - 8 - table.m  # the last place where a window can begin
    if last < 0:
        return
    eights = _eights(text)
    at = np.arange(0, last + 1, SEGMENT, dtype=np.int64)
    stop = np.minimum(at + SEGMENT, last + 1)
    back = table.m - table.block
    while len(at):
        blocks = eights[at + back] & table.mask
        move = table.shift[_hash(blocks, table.bits)]
        found = np.flatnonzero(move == 0)
        if len(found):
            low = np.searchsorted(table.suffix, blocks[found], side="left")
            high = np.searchsorted(table.suffix, blocks[found], side="right")
            for place, a, b in zip(at[found].tolist(), low.tolist(), high.tolist(), strict=True):
                for w in range(a, b):
                    if text.startswith(table.text[table.start[w] : table.end[w]], place):
                        yield place, int(table.words[w]), w
        at = at + np.maximum(move, 1)
        on = at < stop
        if not on.all():
            at, stop = at[on], stop[on]


def collapse(data: bytes, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The documents' words with one space between and around, end to end; each document's first place and word count."""
    raw = np.frombuffer(data.translate(_FOLD), dtype=np.uint8)
    word = raw != 32
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    begins[edges] = word[edges]  # a word ends with its document
    # Before each word's first byte goes one space; what isn't a word goes.
    kept = np.flatnonzero(word)
    if not len(kept):
        return b" " + b"\0" * 8, np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    starts = begins[kept]
    doc_first = np.searchsorted(kept, offsets[:-1])  # index among the kept bytes
    has = np.searchsorted(kept, offsets[1:]) > doc_first
    words_before = np.concatenate([[0], np.cumsum(starts)])
    ends = np.searchsorted(kept, offsets[1:])
    counts = words_before[ends] - words_before[doc_first]
    # Each document with words has one more space, at its end.
    closing = np.concatenate([[0], np.cumsum(has)])[:-1]
    to = np.arange(len(kept)) + np.cumsum(starts)
    to += np.repeat(closing, ends - doc_first)
    size = len(kept) + int(starts.sum()) + int(has.sum())
    out = np.full(size + 8, 32, dtype=np.uint8)
    out[to] = raw[kept]
    out[size:] = 0
    first = doc_first + words_before[doc_first] + closing
    return out.tobytes(), first, counts


def find(tables: list[Table], data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Word counts; for documents with hits, the hit stretches of words (from, to) and the items."""
    text, first, counts = collapse(data, offsets)
    stretches: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    owner = np.flatnonzero(counts)  # documents that have places of their own
    blanks: np.ndarray | None = None
    for table in tables:
        found = list(occurrences(table, text))
        if not found:
            continue
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
        place, words, window = (np.array(x) for x in zip(*found, strict=True))
        doc = owner[np.searchsorted(first[owner], place, side="right") - 1]
        begin = np.searchsorted(blanks, place) - np.searchsorted(blanks, first[doc])
        for d, a, n in zip(doc.tolist(), begin.tolist(), words.tolist(), strict=True):
            stretches[d].append((a, a + n))
        for d, w in np.unique(np.stack([doc, window], axis=1), axis=0).tolist():
            items[d].update(x for x in table.items[table.first[w] : table.first[w + 1]] if x is not None)
    return counts, stretches, items


def merged(stretches: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Stretches in order, overlapping and touching ones as one."""
    out: list[dict[str, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], b)
        else:
            out.append({"a": a, "b": b})
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in blocks of bounded text; they pass through the driver one at a time."""
    held, size = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def hits(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, items (sorted as strings).

    One block of the benchmark is broadcast at a time, while the driver has the next one.  A benchmark of several blocks takes a pass for each; what a
    pass has found goes on to the next through shared scratch.
    """
    spark = docs.sparkSession
    found = f"stretches {STRETCHES}, items array<string>"
    rows = id_text(docs, id_col, text_col).withColumns({"stretches": F.array().cast(STRETCHES), "items": F.array().cast("array<string>")})
    blocks = _blocks(benchmark, item_col, item_text)
    block = next(blocks, [])
    while True:
        tables, block = build_tables(block), next(blocks, None)
        held, last = spark.sparkContext.broadcast(tables), block is None

        def run(batches: Iterator[pa.RecordBatch], held=held, last=last) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                data, offsets = joined(part.column("text"))
                counts, stretches, items = find(held.value, data, offsets)
                told = part.column("items").to_pylist()
                known = part.column("stretches").to_pylist()
                for doc, x in stretches.items():
                    known[doc] = merged([(y["a"], y["b"]) for y in known[doc]] + x)
                    told[doc] = sorted({*told[doc], *items[doc]})
                ids, kind = pa.array(told, pa.list_(pa.string())), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                if last:
                    hit = [sum(y["b"] - y["a"] for y in x) for x in known]
                    yield pa.record_batch([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), ids], ["doc_id", "n_words", "n_hit", "items"])
                else:
                    yield pa.record_batch([part.column("doc_id"), part.column("text"), pa.array(known, kind), ids], ["doc_id", "text", "stretches", "items"])

        if last:
            return map_arrow(rows, run, "doc_id long, n_words long, n_hit long, items array<string>")
        rows = materialise(map_arrow(rows, run, "doc_id long, text binary, " + found), "hits")


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """The documents without a hit, with all their columns; nothing shuffles."""
    at = docs.columns.index(text_col)
    rows = docs
    for block in _blocks(benchmark, item_col, item_text):
        held = docs.sparkSession.sparkContext.broadcast(build_tables(block))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, at):
                data, offsets = joined(part.column(at))
                clean = np.ones(part.num_rows, dtype=bool)
                clean[list(find(held.value, data, offsets)[1])] = False
                yield part.filter(pa.array(clean))

        rows = map_arrow(rows if rows is docs else materialise(rows, "clean"), run, docs.schema)
    return rows
