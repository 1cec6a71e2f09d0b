"""Order-preserving packing of token ids into windows, by dynamic programming with a monotone queue.

Documents follow one another in input order, each as its ids and an end id.  Cuts may fall at the ends of
documents and sentences; only inside a sentence longer than a window also at every STEP-th token, so that it can be packed.
cost(j) = penalty(j) + min over cuts i, 0 < j - i <= size, of cost(i) + padding(j - i): a document's end
costs nothing, a sentence's end SENTENCE, another place TRUNCATE.  As padding(j - i) = size - (j - i), the best
i is the least cost(i) + i in a sliding range, which a monotone queue gives in constant time for each cut.

Each task packs its own stretch of the input as a stream: a batch is packed together with what the batch
before left in its last, unfilled window.  Nothing shuffles and memory is bounded by a batch, so a stretch
costs one unfilled window at its end, which is cut to powers of two: such windows need no padding.

Null texts count as empty: they give the end id alone.  A repeated or null doc_id is a document like any
other.  An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text, slices, tidied
from .encoding import encoder, with_end

SIZE = 2048
END_ID = 1
SENTENCE = 2
TRUNCATE = 24
STEP = 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(places: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Indexes into places of the best window ends up to the last place from which a window is filled.

    places ascend from 0 by steps of at most `size`; the last one is a cut.
    """
    at = places.tolist()
    fee = penalty.tolist()
    cost = [0] * len(at)
    came = [0] * len(at)
    queue: deque[int] = deque([0])
    key = [0] * len(at)  # cost(i) + i
    for j in range(1, len(at)):
        low = at[j] - size
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        came[j] = i
        cost[j] = key[i] + size - at[j] + fee[j]
        key[j] = cost[j] + at[j]
        while queue and key[queue[-1]] >= key[j]:
            queue.pop()
        queue.append(j)
    path = [len(at) - 1]
    while path[-1]:
        path.append(came[path[-1]])
    return path[::-1]


def candidate_cuts(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, with 0 in front, and their penalties."""
    n = len(ids)
    fee = np.full(n + 1, -1, dtype=np.int32)
    known = ids < len(sentence)
    stops = np.flatnonzero(sentence[np.where(known, ids, 0)] & known) + 1
    fee[stops] = SENTENCE
    fee[ends] = 0
    fee[0] = fee[n] = 0
    places = np.flatnonzero(fee >= 0)
    for k in np.flatnonzero(np.diff(places) > size):  # a sentence that no window holds
        fee[places[k] + STEP : places[k + 1] : STEP] = TRUNCATE
    places = np.flatnonzero(fee >= 0)
    return places, fee[places]


def sentence_ids(enc) -> np.ndarray:
    """For each id, whether its token ends a sentence: marks only, one of them . ! or ?"""
    out = np.zeros(enc.tokenizer.get_vocab_size() + 1, dtype=bool)
    for token, i in enc.tokenizer.get_vocab().items():
        marks = token.removesuffix("</w>")
        out[i] = bool(marks) and not any(c.isalnum() for c in marks) and any(c in ".!?" for c in marks)
    return out


def tail_sizes(n: int, size: int = SIZE) -> list[int]:
    """A last stretch as windows of powers of two."""
    out = [size] * (n // size)
    return out + [1 << b for b in range(n.bit_length(), -1, -1) if (n % size) >> b & 1]


class Packer:
    """Packs a stream of documents; holds at most what one unfilled window needs."""

    def __init__(self, sentence: np.ndarray, first_sequence: int, size: int = SIZE) -> None:
        self.sentence, self.next, self.size = sentence, first_sequence, size
        self.ids = np.zeros(0, dtype="<u4")
        self.docs: list[tuple[int | None, int, int, int]] = []  # doc_id, start, tokens here, tokens of the document

    def add(self, doc_ids: list, ids: np.ndarray, ends: np.ndarray, last: bool = False) -> list[tuple]:
        sizes = np.diff(np.concatenate([[0], ends])).tolist()
        self.docs += [(d, 0, n, n) for d, n in zip(doc_ids, sizes, strict=True)]
        self.ids = np.concatenate([self.ids, ids])
        total = len(self.ids)
        if not total or (not last and total < 2 * self.size):
            return []
        held = np.cumsum([n for _, _, n, _ in self.docs])
        places, fee = candidate_cuts(self.ids, held, self.sentence, self.size)
        path = places[cuts(places, fee, self.size)].tolist()
        tail = path[-2]
        windows = list(zip(path, path[1:-1], strict=False))
        if last:
            at = tail
            for n in tail_sizes(total - tail, self.size):
                windows.append((at, at + n))
                at += n
            tail = total
        return self._emit(windows, tail)

    def _emit(self, windows: list[tuple[int, int]], upto: int) -> list[tuple]:
        out = []
        raw = memoryview(np.ascontiguousarray(self.ids).view(np.uint8))
        k, begin = 0, 0  # the document that a window begins in, and its place
        for a, b in windows:
            at = a
            while at < b:
                doc, start, n, whole = self.docs[k]
                end = min(b, begin + n)
                if end > at:
                    out.append((doc, start + at - begin, end - at, zlib.crc32(raw[4 * at : 4 * end]), whole, self.next, at - a))
                at = end
                if at == begin + n:
                    begin, k = at, k + 1
            self.next += 1
        rest = []
        for doc, start, n, whole in self.docs[k:]:
            done = max(0, upto - begin)
            if n > done:
                rest.append((doc, start + done, n - done, whole))
            begin += n
        self.docs, self.ids = rest, self.ids[upto:].copy()
        return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = Packer(sentence_ids(enc), TaskContext.get().partitionId() << 32, size)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names)

        for part in slices(batches, "text", 3 << 20):
            ids, ends = with_end(*enc.encode(part.column("text")), end_id)
            found = packer.add(part.column("doc_id").to_pylist(), ids, ends)
            if found:
                yield rows(found)
        found = packer.add([], np.zeros(0, "<u4"), np.zeros(0, np.int64), last=True)
        if found:
            yield rows(found)

    return id_text(docs, id_col, text_col).mapInArrow(tidied(run), SCHEMA)
