"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words are split into runs of letters, digits and marks, and hashed to buckets. Each bucket has a sparse random
index vector given by its number; its word vector is the sum of the index vectors around its occurrences in all
documents, gathered in tables of fixed size (BUCKETS by DIMENSIONS), one a task, that are added up by slices. A
document's vector has the mean and spread of its words' vectors and how alike neighbours' are. The network learns from at most SAMPLE
labelled rows, those of least hash; a temperature found on rows that it didn't learn from calibrates it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS, DIMENSIONS, NONZEROS, WINDOW = 16, 32, 2, 2
BUCKETS = 1 << BUCKET_BITS
#: Numbers of a document: mean and spread of its words' vectors, three likenesses of neighbours, length.
FEATURES = 2 * DIMENSIONS + 4
#: Most labelled rows that the network learns from and is calibrated on.
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 0.01, 1e-4
#: Buckets of a slice of the table on its way.
SLICE = 2048
#: Documents and words handled at once.
DOCS_AT_ONCE, WORDS_AT_ONCE = 500, 1 << 20
_RUNS = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[!-/:-@\[-`{-~]+").findall


class _Buckets(dict):
    """Word -> buckets of its runs; emptied at a bound."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 300_000:
            self.clear()
        self[word] = made = tuple(xxhash.xxh3_64_intdigest(x) & BUCKETS - 1 for x in _RUNS(word))
        return made


_buckets_of = _Buckets()


def buckets(text: str | None) -> np.ndarray:
    words = text.encode().split() if text else ()
    return np.fromiter(chain.from_iterable(map(_buckets_of.__getitem__, words)), np.int32)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's NONZEROS entries."""
    seeds = [xxhash.xxh3_128_intdigest(i.to_bytes(4, "little")) for i in range(BUCKETS)]
    places = np.array([[(s >> 16 * j) % DIMENSIONS for j in range(NONZEROS)] for s in seeds], np.int64)
    signs = np.array([[1 - 2 * (s >> 100 + j & 1) for j in range(NONZEROS)] for s in seeds], np.float64)
    return places, signs


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's table of context sums, in slices (slice, sums)."""
    places, signs = index_vectors()
    total, some = np.zeros(BUCKETS * DIMENSIONS), False

    def add(parts: list[np.ndarray]) -> None:
        nonlocal total
        words, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        for gap in range(1, WINDOW + 1):
            near = of[gap:] == of[:-gap]
            left, right = words[:-gap][near].astype(np.int64), words[gap:][near].astype(np.int64)
            for word, other in ((left, right), (right, left)):
                for j in range(NONZEROS):
                    total += np.bincount(word * DIMENSIONS + places[other, j], signs[other, j], BUCKETS * DIMENSIONS)

    parts, size = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if len(found := buckets(text)):
                parts.append(found)
                size += len(found)
                some = True
                if size >= WORDS_AT_ONCE:
                    add(parts)
                    parts, size = [], 0
    if parts:
        add(parts)
    if some:
        slices = total.astype("<i4").reshape(-1, SLICE * DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in slices], pa.binary())], ["slice", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums = np.frombuffer(zlib.decompress(packed), "<i4").astype(np.int64)
            total[at] = total[at] + sums if at in total else sums
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["slice", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors of all buckets from all documents; those never seen are 0. Its size doesn't depend on docs."""
    parts = docs.select(text).mapInArrow(_gathered, "slice int, sums binary").repartition(8, "slice").mapInArrow(_added, "slice int, sums binary").collect()
    table = np.zeros((BUCKETS // SLICE, SLICE * DIMENSIONS), np.float32)
    for at, sums in parts:
        table[at] = np.frombuffer(sums, np.float32)
    table = table.reshape(BUCKETS, DIMENSIONS)
    table -= table.mean(axis=0)  # the direction that all words share
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)


def pooled(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """A row a text: mean and spread of its words' vectors, how alike neighbours' vectors are (on average; equal; equal
    but for one word between), and its length; zeros without words."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for start in range(0, len(texts), DOCS_AT_ONCE):
        parts = [buckets(x) for x in texts[start : start + DOCS_AT_ONCE]]
        rows = start + np.flatnonzero([len(x) for x in parts])
        if not len(rows):
            continue
        sizes = np.array([len(x) for x in parts if len(x)])
        words, at = np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        vectors, of, alike = table[words], np.repeat(np.arange(len(sizes)), sizes), np.zeros((len(words), 3), np.float32)
        alike[:-1, 0] = np.einsum("ij,ij->i", vectors[:-1], vectors[1:])
        alike[:-1, 1], alike[:-2, 2] = words[:-1] == words[1:], words[:-2] == words[2:]
        for column, gap in ((0, 1), (1, 1), (2, 2)):
            alike[:-gap, column][of[:-gap] != of[gap:]] = 0
        mean = np.add.reduceat(vectors, at, axis=0) / sizes[:, None]
        square = np.add.reduceat(vectors * vectors, at, axis=0) / sizes[:, None]
        out[rows, :DIMENSIONS] = mean
        out[rows, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[rows, 2 * DIMENSIONS : -1] = np.add.reduceat(alike, at, axis=0) / sizes[:, None]
        out[rows, -1] = np.log1p(sizes) / 10
    return out


@dataclass
class Network:
    """sigmoid(logit / temperature), where logit comes from tanh units over standardised inputs; prior without layers."""

    prior: float
    layers: tuple | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """Fit on nine tenths of the rows, in the order given, and calibrate on the rest. One label only: its share."""
    prior = float((y.sum() + 1) / (len(y) + 2))
    if len(y) < 20 or y.min() == y.max():
        return Network(prior)
    x, y, held = x.astype(np.float64), y.astype(np.float64), np.arange(len(y)) % 10 == 9
    rnd, fit = np.random.default_rng(seed), np.flatnonzero(~held)
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    z = (x - mean) / scale
    weights = [rnd.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        for part in np.array_split(rnd.permutation(fit), max(1, len(fit) // 256)):
            w1, b1, w2, b2 = weights
            hidden = np.tanh(z[part] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -40, 40))) - y[part]) / len(part)
            back = np.outer(error, w2) * (1 - hidden * hidden)
            grads = [z[part].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ error + DECAY * w2, error.sum()]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    made = Network(prior, (mean, scale, *weights))
    logits, truth = made.logits(x[held]), y[held]
    loss = lambda t: float(np.mean(np.logaddexp(0, logits / t) - truth * logits / t))
    made.temperature = min(np.geomspace(0.5, 8, 41), key=loss)
    return made


@dataclass
class Model:
    """What scores texts: two broadcast values of fixed size."""

    vectors: object
    network: object

    def score(self, text: Column) -> Column:
        """double in [0, 1] for each text; null and empty ones are scored by zeros."""
        vectors, network = self.vectors, self.network

        @F.arrow_udf("double")
        def scores(texts: pa.Array) -> pa.Array:
            return pa.array(network.value.scores(pooled(texts.to_pylist(), vectors.value).astype(np.float64)), pa.float64())

        return scores(text)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Word vectors from all docs; the network from those of the first sample labels, by hash of id, that have a text.

    Labels that are null are left out; a document with several labels counts for each.
    """
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs, text))
    order = F.xxhash64("_id")
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").orderBy(order, "_id", "_y").limit(sample)
    picked = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).join(F.broadcast(chosen), F.col("_d") == F.col("_id"))  # sample bounds the side

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x.tobytes() for x in pooled(batch.column(2).to_pylist(), vectors.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["h", "y", "x"])

    found = picked.select(order.alias("h"), "_y", "_t").mapInArrow(rows, "h long, y double, x binary").collect()
    found.sort(key=lambda r: (r.h, r.y, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float32) for r in found], np.float32).reshape(-1, FEATURES)
    return Model(vectors, context.broadcast(train(x, np.array([r.y for r in found]))))
