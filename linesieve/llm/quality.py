"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network with calibrated output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, text_or_empty
from .spans import WHITE, mix, per_text, span_hashes, texts_of

#: Words share BUCKETS vectors of DIMS components by hash, so the table has a fixed size whatever the vocabulary.
BUCKETS, DIMS = 1 << 15, 32
#: Components of a word's index vector that are not zero.
MARKS = 2
#: Neighbours on either side that make a word's context.
REACH = 2
#: Words' vectors in one row on their way to the sum.
ROW_BUCKETS = 256
#: Labelled documents that the network may be fitted on, at most; chosen by a hash of the id.
MAX_LABELLED = 20_000
HIDDEN = 32
FEATURES = 3 * DIMS + 1

_KIND = np.full(256, 3, np.uint8)
_KIND[WHITE] = 0
for _low, _high, _kind in ((48, 58, 2), (65, 91, 1), (97, 123, 1), (128, 256, 1)):
    _KIND[_low:_high] = _kind


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places (MARKS, BUCKETS) and signs of the marks of every bucket's index vector."""
    draw = mix(np.arange(MARKS * BUCKETS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(11))
    places = (draw % np.uint64(DIMS)).astype(np.int64).reshape(MARKS, BUCKETS)
    signs = np.where((draw >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).reshape(MARKS, BUCKETS)
    return places, signs


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token of all texts, and each text's bounds; tokens are runs of letters, digits or signs."""
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    ink = kind[starts] > 0
    starts, ends = starts[ink], ends[ink]
    return (span_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), per_text(starts, offsets)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sums of neighbours' index vectors, ROW_BUCKETS words a row."""
    places, signs = index_vectors()
    sums = np.zeros(BUCKETS * DIMS)
    for batch in batches:
        for _, _, data, offsets in texts_of(batch.column(0)):
            words, bounds = tokens(data, offsets)
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for step in range(1, REACH + 1):
                near = text[step:] == text[:-step]
                left, right = words[:-step][near], words[step:][near]
                for a, b in ((left, right), (right, left)):
                    for k in range(MARKS):
                        sums += np.bincount(a * DIMS + places[k][b], signs[k][b], BUCKETS * DIMS)
    rows = sums.astype(np.float32).reshape(-1, ROW_BUCKETS * DIMS)
    used = np.flatnonzero(rows.any(1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array([rows[i].tobytes() for i in used], pa.binary())], names=["part", "sums"]
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            row = np.frombuffer(blob, np.float32)
            totals[part] = totals[part] + row if part in totals else row.astype(np.float64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.int32()), pa.array([t.astype(np.float32).tobytes() for t in totals.values()], pa.binary())], names=["part", "sums"]
    )


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS, DIMS) unit vectors from the contexts of all words of all documents.

    Each task adds up its own documents before the shuffle; what reaches the driver is the table itself, 4 MB.
    """
    ship(docs.sparkSession)
    parts = docs.select(text_or_empty(text_col).alias("body")).mapInArrow(_contexts, "part int, sums binary")
    table = np.zeros((BUCKETS // ROW_BUCKETS, ROW_BUCKETS * DIMS))
    for part, blob in parts.repartition("part").mapInArrow(_added, "part int, sums binary").collect():
        table[part] += np.frombuffer(blob, np.float32)
    table = _unit(table.reshape(BUCKETS, DIMS))
    seen = table.any(1)
    if seen.any():
        table[seen] = _unit(table[seen] - table[seen].mean(0))
    return table.astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean and spread of its word vectors, mean product of neighbours, and the logarithm of its length."""
    words, bounds = tokens(data, offsets)
    counts = np.diff(bounds)
    out = np.zeros((len(counts), FEATURES), np.float32)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    x = vectors[words]
    starts = bounds[:-1][filled]
    n = counts[filled, None]
    mean = np.add.reduceat(x, starts) / n
    square = np.add.reduceat(x * x, starts) / n
    pairs = np.zeros_like(x)
    pairs[:-1] = x[:-1] * x[1:]
    pairs[bounds[1:][filled] - 1] = 0
    product = np.add.reduceat(pairs, starts) / np.maximum(n - 1, 1)
    out[filled, :DIMS] = mean
    out[filled, DIMS:2 * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[filled, 2 * DIMS:3 * DIMS] = product
    out[filled, -1] = np.log1p(counts[filled])
    return out


@dataclass
class Network:
    """Standardised features, one hidden layer, and a temperature for the output."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.center) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train_network(x: np.ndarray, y: np.ndarray, epochs: int = 120, seed: int = 5) -> Network:
    """Fits the network on four fifths of the rows with Adam; the rest stops it and sets the temperature.

    Without rows the probability is one half; with one class alone it is close to that class.
    """
    x = x.astype(np.float64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, fit = order[:len(x) // 5], order[len(x) // 5:]
    center = x[fit].mean(0) if len(fit) else np.zeros(FEATURES)
    scale = x[fit].std(0) if len(fit) else np.ones(FEATURES)
    scale[scale < 1e-6] = 1
    net = Network(center, scale, rng.normal(0, 0.1, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if len(fit) < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        net.b2 = float(np.log(share / (1 - share)))
        return net
    net.w2 = rng.normal(0, 0.1, HIDDEN)
    names = ("w1", "b1", "w2", "b2")
    moments = {k: (np.zeros_like(np.asarray(getattr(net, k), float)), np.zeros_like(np.asarray(getattr(net, k), float))) for k in names}
    z, target, step = (x - center) / scale, y.astype(np.float64), 0
    best, kept, stale = np.inf, None, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 256)):
            hidden = np.tanh(z[rows] @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-(hidden @ net.w2 + net.b2))) - target[rows]) / len(rows)
            back = np.outer(error, net.w2) * (1 - hidden * hidden)
            slopes = {"w1": z[rows].T @ back + 1e-4 * net.w1, "b1": back.sum(0), "w2": hidden.T @ error + 1e-4 * net.w2, "b2": error.sum()}
            step += 1
            for k in names:
                m, v = moments[k]
                m = 0.9 * m + 0.1 * slopes[k]
                v = 0.999 * v + 0.001 * slopes[k] ** 2
                moments[k] = m, v
                setattr(net, k, getattr(net, k) - 0.003 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8))
        now = _loss(net.logits(x[held]), target[held]) if len(held) else 0.0
        if now < best - 1e-5:
            best, kept, stale = now, [np.copy(getattr(net, k)) for k in names], 0
        else:
            stale += 1
            if stale == 15:
                break
    for k, value in zip(names, kept):
        setattr(net, k, value)
    if len(held):
        logits = net.logits(x[held])
        choices = np.exp(np.linspace(-1.5, 1.5, 121))
        net.temperature = float(min(choices, key=lambda t: _loss(logits / t, target[held])))
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def train_quality(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED
) -> QualityModel:
    """Word vectors from all documents, and a network from those in `labelled` (id, label 0 or 1).

    Null ids and labels are left out; of several labels of one id the mean decides. At most `max_labelled` documents,
    about, are used; a larger table is thinned by a hash of the id.
    """
    vectors = word_vectors(docs, text_col)
    labelled = labelled.select(F.col(labelled.columns[0]).cast("bigint").alias("label_id"), F.col(labelled.columns[1]).cast("double").alias("label"))
    labelled = labelled.dropna().groupBy("label_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    share = min(1.0, max_labelled / max(labelled.count(), 1))
    chosen = labelled.filter(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    schema = pa.schema([("label", pa.int32()), ("features", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in texts_of(batch.column(1), 1 << 19):
                rows = pooled(data, offsets, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], pa.array([r.tobytes() for r in rows], pa.binary())], schema=schema)

    texts = docs.select(F.col(id_col).cast("bigint").alias("label_id"), text_or_empty(text_col).alias("body"))
    # The sample is bounded by max_labelled, so it may be copied to every executor.
    rows = texts.join(F.broadcast(chosen), "label_id").select("label", "body").mapInArrow(run, "label int, features binary").collect()
    rows = sorted((bytes(r.features), r.label) for r in rows)
    x = np.array([np.frombuffer(f, np.float32) for f, _ in rows]).reshape(-1, FEATURES)
    return QualityModel(vectors, train_network(x, np.array([label for _, label in rows], float)))


def _scored(docs: DataFrame, model: QualityModel, text_col: str, passed: list) -> DataFrame:
    """The `passed` columns and score of every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*passed, text_or_empty(text_col).alias("body"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in texts_of(batch.column("body"), 1 << 19):
                scores = shared.value.network.probabilities(pooled(data, offsets, shared.value.vectors))
                columns = [batch.column(c)[first:end] for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores.astype(np.float64))], names=[*names, "score"])

    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and score (0 to 1) of every row's whole text.

    A null text is empty; empty texts get the network's value for a document without words. A null id stays null,
    repeated rows are scored alike, other columns are ignored, and no rows give no rows.
    """
    return _scored(docs, model, text_col, [F.col(id_col).cast("bigint").alias(id_col)])


def keep_scored(docs: DataFrame, model: QualityModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose score is at least `least`."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = _scored(docs, model, text_col, [row.alias("row")]).filter(F.col("score") >= least)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
