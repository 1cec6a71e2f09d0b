"""Quality score of whole texts by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by OVERLAP, the last one being shorter,
so that the whole document is covered.  A filter of WIDTH bytes has a learned weight for each of its places
and byte values; it is looked up at every STRIDE-th byte, passed through a rectifier and max-pooled over its
chunk.  The pooled chunks are combined by their mean and by their maximum, and a logistic layer turns both
into one probability.

Training is plain numpy (Adam, cross-entropy with both classes weighted evenly, several passes) on the driver, over a bounded sample
of labelled rows: the TRAIN_ROWS rows with the least hash of doc_id whose crc32(doc_id as text) mod 5 is not 0, every chunk of each.
The sample is a table; each pass takes it in another order.  With more than HELD_BYTES of text the driver streams it pass by pass, in the
same orders, and holds a partition at a time.
Only text is an input of the score.  Initial weights come from a fixed seed, so training is repeatable.

A null text counts as empty; an empty text scores by the bias alone.  A very long text is scored in blocks of BLOCK chunks.
A doc_id with several labels counts by the least of them; rows that repeat a labelled doc_id are training rows of their own.  Without labels the score is 0.5 for all.
Rows with repeated ids are scored alike; a null doc_id counts as not held out.  Extra columns pass through
keep_good().
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, joined, materialise, release, slices, tidied

WIDTH = 4
STRIDE = 2
FILTERS = 8
CHUNK = 512
OVERLAP = 128
TRAIN_ROWS = 2000
#: Zero bytes after each text, so that filters at its end don't see the next one.
GAP = WIDTH + STRIDE
#: Bytes of sample texts that the driver holds; a larger sample is streamed pass by pass.
HELD_BYTES = 64 << 20
#: Chunks that one numpy step looks at.
BLOCK = 1024
#: Training steps of BATCH rows, in as many passes over the sample as they take.
STEPS = 500
BATCH = 32
CUT = 0.3


@dataclass
class Network:
    """filters: (WIDTH / 2, 65536, FILTERS), a weight for each pair of bytes; head: weights of mean and maximum."""

    filters: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    head_bias: float

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        # A pair's weight starts as the sum of its bytes' weights, so that unseen pairs behave like seen ones.
        bytes_ = draw.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        return cls(bytes_, np.zeros(FILTERS, np.float32), draw.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)

    def pairs(self) -> np.ndarray:
        """The filters as tables over pairs of bytes (little-endian), for half as many look-ups."""
        low, high = self.filters[0::2], self.filters[1::2]
        return np.ascontiguousarray((high[:, :, None, :] + low[:, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS))


def chunk_edges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each chunk within its text, and its text's index."""
    step = CHUNK - OVERLAP
    many = np.where(sizes > 0, np.maximum(1, -(-(sizes - OVERLAP) // step)), 0)
    doc = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    begin = nth * step
    return begin, np.minimum(begin + CHUNK, sizes[doc]), doc


def pooled(tables: np.ndarray, bias: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Max-pooled activations of each chunk (places in raw); chunks must have bytes."""
    # STRIDE is 2 and chunk steps are even, but texts begin anywhere: look up from each text's own first byte.
    pair = np.ndarray(shape=(len(raw) - 1,), dtype="<u2", buffer=raw, strides=(1,))
    n = (end - begin + STRIDE - 1) // STRIDE
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) * STRIDE - np.repeat(first * STRIDE - begin, n)
    value = tables[0][pair[at]]
    for k in range(1, WIDTH // 2):
        value += tables[k][pair[at + 2 * k]]
    out = np.maximum.reduceat(value, first, axis=0) + bias
    return np.maximum(out, 0)


def features(net_tables: np.ndarray, bias: np.ndarray, data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Mean and maximum of the pooled chunks of each text; zeros for an empty one."""
    sizes = np.diff(offsets)
    begin, end, doc = chunk_edges(sizes)
    out = np.zeros((len(sizes), 2 * FILTERS), dtype=np.float32)
    if len(doc):
        base = offsets[:-1] + np.arange(len(sizes)) * GAP
        begin, end = begin + base[doc], end + base[doc]
        raw = np.zeros(len(data) + len(sizes) * GAP, dtype=np.uint8)
        raw[np.arange(len(data)) + np.repeat(np.arange(len(sizes)) * GAP, sizes)] = np.frombuffer(data, dtype=np.uint8)
        top = np.concatenate([pooled(net_tables, bias, raw, begin[k : k + BLOCK], end[k : k + BLOCK]) for k in range(0, len(doc), BLOCK)])
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        many = np.diff(np.r_[first, len(doc)])
        out[doc[first], :FILTERS] = np.add.reduceat(top, first, axis=0) / many[:, None]
        out[doc[first], FILTERS:] = np.maximum.reduceat(top, first, axis=0)
    return out


def probability(net: Network, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ net.head + net.head_bias, -30, 30)))


def peaks(filters: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's greatest filter responses and the first place that reaches each."""
    widest = int((end - begin).max())
    at = begin[:, None] + np.arange(0, widest, STRIDE)
    off = at >= end[:, None]
    at[off] = 0
    value = filters[0][raw[at]]
    for t in range(1, WIDTH):
        value += filters[t][raw[at + t]]
    value[off] = -np.inf
    best = value.argmax(axis=1)
    return np.take_along_axis(value, best[:, None, :], axis=1)[:, 0], begin[:, None] + best * STRIDE


class Trainer:
    """Adam on batches of texts; weighs both classes alike."""

    def __init__(self, share: float, steps: int, seed: int = 7) -> None:
        net = Network.new(seed)
        self.net, self.steps, self.step = net, steps, 0
        self.weight = np.array([0.5 / (1 - share), 0.5 / share], np.float32)
        self.params = [net.filters, net.bias, net.head, np.zeros(1, np.float32)]
        self.m = [np.zeros_like(p) for p in self.params]
        self.v = [np.zeros_like(p) for p in self.params]

    def learn(self, texts: list[bytes], labels: list[int]) -> None:
        net = self.net
        sizes = np.array([len(t) for t in texts])
        y = np.array(labels)
        begin, end, doc = chunk_edges(sizes)
        base = np.cumsum(sizes + GAP) - sizes - GAP
        begin, end = begin + base[doc], end + base[doc]
        raw = np.frombuffer(b"".join(t + b"\0" * GAP for t in texts), dtype=np.uint8)
        parts = [peaks(net.filters, raw, begin[k : k + BLOCK], end[k : k + BLOCK]) for k in range(0, len(doc), BLOCK)]
        top, where = (np.concatenate(x) for x in zip(*parts, strict=True))
        act = np.maximum(top + net.bias, 0)
        many = np.bincount(doc, minlength=len(texts)).astype(np.float32)
        start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        mean = np.add.reduceat(act, start, axis=0) / many[:, None]
        peak = np.maximum.reduceat(act, start, axis=0)
        x = np.concatenate([mean, peak], axis=1)
        p = 1 / (1 + np.exp(-np.clip(x @ net.head + self.params[3][0], -30, 30)))
        err = ((p - y) * self.weight[y] / len(texts)).astype(np.float32)
        back = err[:, None] * net.head[None, :]
        is_peak = act == peak[doc]
        share_peak = np.add.reduceat(is_peak.astype(np.float32), start, axis=0)
        g_act = back[doc, :FILTERS] / many[doc][:, None] + is_peak * back[doc, FILTERS:] / share_peak[doc]
        g_act *= act > 0
        g_filters = np.zeros_like(net.filters)
        f = np.broadcast_to(np.arange(FILTERS), where.shape)
        for t in range(WIDTH):
            np.add.at(g_filters[t], (raw[where + t], f), g_act)
        self._move([g_filters, g_act.sum(axis=0), x.T @ err + 1e-4 * net.head, np.array([err.sum()], np.float32)])

    def _move(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        rate = 0.02 * 0.06 ** (self.step / self.steps)
        for q, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-6)
        self.net.head_bias = float(self.params[3][0])


def passes(rows: int) -> int:
    return -(-STEPS // -(-rows // BATCH))


def constant(labels: list[int]) -> Network:
    """What is learnt from one class, or from nothing."""
    net = Network.new()
    net.head[:] = 0
    net.head_bias = float(4 * labels[0] - 2) if labels else 0.0
    return net


def train(labels: list[int], told: Callable[[int], Iterable[tuple[bytes, int]]], seed: int = 7) -> Network:
    """labels: those of all rows; told(nth): the rows' texts and labels in the nth pass's order."""
    if len(set(labels)) < 2:
        return constant(labels)
    trainer = Trainer(sum(labels) / len(labels), passes(len(labels)) * -(-len(labels) // BATCH), seed)
    for nth in range(passes(len(labels))):
        rows = iter(told(nth))
        while some := list(islice(rows, BATCH)):
            some = [x for x in some if x[0]]
            if some:
                trainer.learn([x[0] for x in some], [x[1] for x in some])
    return trainer.net


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """A bounded sample, as a table: of the labelled rows that aren't held out, `most` with the least hash of doc_id."""
    c = F.col("label_id")
    known = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).where(c.isNotNull() & F.col("label").isin(0, 1) & ~held_out(c))
    pick = known.groupBy("label_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64(c), c).limit(most)
    told = pick.collect()  # `most` rows at most; as an Arrow table they take no Python workers, as a list they would
    few = pa.table([pa.array([r[k] for r in told], kind) for k, kind in enumerate((pa.int64(), pa.int32()))], ["label_id", "label"])
    few = F.broadcast(docs.sparkSession.createDataFrame(few))
    rows = id_text(docs, id_col, text_col).join(few, F.col("doc_id") == c).select("doc_id", "label", F.coalesce("text", F.lit(b"")).alias("text"))
    return materialise(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "sample")


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", most: int = TRAIN_ROWS) -> Network:
    sample = training_rows(docs, labels, id_col, text_col, label_col, most)
    seen = sample.select("label", F.length("text")).collect()  # `most` rows at most
    order = lambda nth: F.xxhash64(F.lit(nth), "doc_id")

    def streamed(nth: int) -> Iterator[tuple[bytes, int]]:
        rows = sample.orderBy(order(nth), "doc_id", "text").select("text", "label")
        return ((bytes(r[0]), r[1]) for r in rows.toLocalIterator())

    def held(nth: int) -> Iterator[tuple[bytes, int]]:
        return ((bytes(r["text"]), r["label"]) for r in sorted(rows, key=lambda r: (r["draws"][nth], r["doc_id"], r["text"])))

    small = sum(r[1] for r in seen) <= HELD_BYTES
    if small:  # the same orders, without a job for each pass
        rows = sample.withColumn("draws", F.array(*map(order, range(passes(len(seen)))))).collect() if seen else []
    net = train([r[0] for r in seen], held if small else streamed)
    release(sample)
    return net


def scorer(net: Network):
    """A function from a string or binary array to scores."""
    tables = net.pairs()

    def score(texts: pa.Array) -> np.ndarray:
        data, offsets = joined(texts)
        return probability(net, features(tables, net.bias, data, offsets)).astype(np.float64)

    return score


def score_documents(docs: DataFrame, net: Network, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, held_out, score and predicted of each document; nothing shuffles."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(held.value)
        for part in slices(batches, "text", 1 << 20):
            ids = part.column("doc_id")
            out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids.to_pylist()]
            p = score(part.column("text"))
            yield pa.record_batch([ids, pa.array(out), pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return id_text(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Network, text_col="text") -> DataFrame:
    """The rows predicted good, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(held.value)
        for part in slices(batches, at, 1 << 20):
            yield part.filter(pa.array(score(part.column(at)) >= CUT))

    return docs.mapInArrow(tidied(run), docs.schema)
