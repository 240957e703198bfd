"""Language-model scores by a hidden Markov model over word classes, trained with Baum-Welch over all documents.

A text's probability is that of its sequence of word classes under the hidden Markov model, times each word's share of
its class. Frequent words are classes of their own; other words share a class by their ending. So the model's parameters
have a fixed size, while word counts, which grow with the corpus, stay in a table and meet the texts by joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty
from .spans import LOWER, per_text, span_hashes, texts_of, word_spans

STATES = 8
#: Classes: the text's end, then frequent words, then endings.
FREQUENT, ENDINGS = 1024, 1024
CLASSES = FREQUENT + ENDINGS
ITERATIONS = 5
#: Tokens that a training sequence counts; longer documents are trained in pieces and scored whole. A piece sees AROUND
#: tokens of its document before and behind its own, so that the states at a cut follow from both sides of it.
PIECE = 256
AROUND = 16
#: Text whose words share one dictionary.
BLOCK_BYTES = 16 << 20

_ENCODED = "block long, idx int, word string, n long, doc_id long, held boolean, body binary"
_ENCODED_ARROW = pa.schema([
    ("block", pa.int64()), ("idx", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64()),
    ("held", pa.bool_()), ("body", pa.binary()),
])
#: Sorts a block's documents behind its dictionary.
_DOCUMENT = (1 << 31) - 1



def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of documents: one row per distinct word with its count in training texts, and one row per document with
    the numbers of its words."""
    block, held_back, size = TaskContext.get().partitionId() << 24, [], 0
    for batch in batches:
        for first, end, data, offsets in texts_of(batch.column(2)):
            data = LOWER[data]
            starts, ends = word_spans(data, offsets)
            hashes = span_hashes(data, starts, ends)
            rows = batch.slice(first, end - first)
            held_back.append((rows.column(0), rows.column(1), np.diff(per_text(starts, offsets)), hashes, data, starts.astype(np.int32), ends.astype(np.int32)))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield from _block(block, held_back)
                block, held_back, size = block + 1, [], 0
    if held_back:
        yield from _block(block, held_back)


def _block(block: int, slices: list[tuple]) -> Iterator[pa.RecordBatch]:
    keys, first, numbers = np.unique(np.concatenate([s[3] for s in slices]), return_index=True, return_inverse=True)
    begins = np.cumsum([0] + [len(s[3]) for s in slices])
    held = np.concatenate([np.repeat(np.asarray(s[1]), s[2]) for s in slices])
    used = np.bincount(numbers[~held], minlength=len(keys))
    owner = np.searchsorted(begins, first, "right") - 1
    for at in range(0, len(keys), 32768):
        part = range(at, min(at + 32768, len(keys)))
        words = []
        for i in part:
            _, _, _, _, data, starts, ends = slices[owner[i]]
            k = first[i] - begins[owner[i]]
            words.append(data[starts[k]:ends[k]].tobytes().decode())
        n = len(words)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n, block)), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(words, pa.string()),
            pa.array(used[at:at + n]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()),
        ], schema=_ENCODED_ARROW)
    numbers = numbers.astype(np.uint32)
    at = 0
    for ids, held, counts, *_ in slices:
        ends = at + np.cumsum(counts)
        n = len(ids)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n, block)), pa.array(np.full(n, _DOCUMENT, np.int32)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()),
            ids, held, pa.array([numbers[e - c:e].tobytes() for e, c in zip(ends, counts)], pa.binary()),
        ], schema=_ENCODED_ARROW)
        at += int(counts.sum())


_CLASSED = "doc_id long, held boolean, n_tokens long, n_known long, base_score double, within double, classes binary"
_CLASSED_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_score", pa.float64()), ("within", pa.float64()), ("classes", pa.binary()),
])


def _classify(train_tokens: int, distinct: int, end_count: int, class_tokens: np.ndarray, class_words: np.ndarray):
    """Documents with their words' classes, from blocks that come dictionary first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = math.log10(train_tokens + distinct + 1)
        end_base = math.log10(end_count + 1) - scale
        block, counts, classes, table = None, [], [], None
        for batch in batches:
            blocks, idx = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(idx == _DOCUMENT) != 0)) + 1
            for low, high in zip([0, *edges], [*edges, len(blocks)]):
                if low == high:
                    continue
                if blocks[low] != block:
                    block, counts, classes, table = blocks[low], [], [], None
                part = batch.slice(low, high - low)
                if idx[low] != _DOCUMENT:
                    counts.append(np.asarray(part.column(2)))
                    classes.append(np.asarray(part.column(3)))
                    continue
                if table is None:
                    c = np.concatenate(counts) if counts else np.empty(0, np.int64)
                    k = np.concatenate(classes).astype(np.int64) if classes else np.empty(0, np.int64)
                    inner = np.where(k < FREQUENT, 0.0, np.log10(c + 1) - np.log10(class_tokens[k] + class_words[k] + 1))
                    table = c > 0, np.log10(c + 1) - scale, inner, k.astype(np.uint16)
                known, base, inner, k = table
                rows = []
                for body in part.column(6).to_pylist():
                    words = np.frombuffer(body, np.uint32)
                    rows.append((
                        len(words) + 1, int(known[words].sum()) + (end_count > 0), float(base[words].sum()) + end_base,
                        float(inner[words].sum()), np.append(k[words], np.uint16(0)).astype(np.uint16).tobytes(),
                    ))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(_CLASSED_ARROW)[2:])]
                yield pa.RecordBatch.from_arrays([part.column(4), part.column(5), *columns], schema=_CLASSED_ARROW)

    return run


class Parameters:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, class_tokens: np.ndarray, states: int) -> Parameters:
        """Class frequencies, moved at random so that states differ; states tend to stay."""
        rng = np.random.default_rng(97)
        emit = (class_tokens + 1.0) * rng.lognormal(0, 0.7, (states, len(class_tokens)))
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Parameters:
        """Probabilities from expected counts, each raised a little so that no sequence is impossible."""
        share = lambda x, least: (x + least) / (x + least).sum(-1, keepdims=True)
        return cls(share(start, 0.1), share(move, 0.1), share(emit, 0.01))


def _batched(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the sequences by falling length, observations (time, sequence), and the sequences alive at each time."""
    lengths = np.array([len(p) for p in pieces])
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max())
    alive = np.searchsorted(-lengths[order], -np.arange(steps), "left")
    begins = np.concatenate(([0], np.cumsum(alive)))
    flat = np.empty(int(begins[-1]), np.uint16)
    for k, i in enumerate(order):
        flat[begins[:len(pieces[i])] + k] = pieces[i]
    return order, flat, begins


def forward_score(sequences: list[np.ndarray], p: Parameters) -> np.ndarray:
    """Exact log10 probability of each whole sequence: the forward recursion, scaled to sum to one after every step."""
    order, flat, begins = _batched(sequences)
    emit = np.ascontiguousarray(p.emit.T)
    total = np.zeros(len(sequences))
    state = np.repeat(p.start[None, :], begins[1], 0)
    for t in range(len(begins) - 1):
        n = begins[t + 1] - begins[t]
        state = (state[:n] @ p.move if t else state) * emit[flat[begins[t]:begins[t + 1]]]
        size = state.sum(1)
        state /= size[:, None]
        total[:n] += np.log10(size)
    out = np.empty(len(sequences))
    out[order] = total
    return out


def pieces_of(words: np.ndarray, size: int = PIECE, around: int = AROUND) -> list[tuple[np.ndarray, int, int]]:
    """The document in pieces with their surroundings: (tokens, first and end of the piece's own tokens). Every token, and
    the move into it, is some piece's own; the first piece begins with the document."""
    out = []
    for at in range(0, len(words), size):
        low, end = max(0, at - around), min(len(words), at + size)
        out.append((words[low:end + around], at - low, end - low))
    return out


def expected_counts(
    sequences: list[np.ndarray], fresh: np.ndarray, p: Parameters, own: list[tuple[int, int]] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts (of sequences that are `fresh`), moves and emissions over the sequences, or over the
    `own` range of each: emissions there, and moves into its tokens."""
    order, flat, begins = _batched(sequences)
    own = own or [(0, len(s)) for s in sequences]
    low, high = (np.array(x)[order] for x in zip(*own))
    emit = np.ascontiguousarray(p.emit.T.astype(np.float32))
    move = p.move.astype(np.float32)
    ahead = np.empty((len(flat), len(p.start)), np.float32)
    sizes = np.empty(len(flat), np.float32)
    state = np.repeat(p.start[None, :].astype(np.float32), begins[1], 0)
    for t in range(len(begins) - 1):
        a, b = begins[t], begins[t + 1]
        state = (state[:b - a] @ move if t else state) * emit[flat[a:b]]
        sizes[a:b] = state.sum(1)
        state /= sizes[a:b, None]
        ahead[a:b] = state
    moves = np.zeros(move.shape)
    back = np.ones((begins[-1] - begins[-2], len(p.start)), np.float32)
    for t in range(len(begins) - 2, -1, -1):
        a, b = begins[t], begins[t + 1]
        if t < len(begins) - 2:
            c = begins[t + 2]
            weighted = back * emit[flat[b:c]] / sizes[b:c, None]
            mine = ((low[:c - b] <= t + 1) & (t + 1 < high[:c - b])).astype(np.float32)
            moves += (ahead[a:a + c - b] * mine[:, None]).T @ weighted
            back = np.ones((b - a, len(p.start)), np.float32)
            back[:c - b] = weighted @ move.T
        if t < len(begins) - 2:
            ahead[a:b] *= back
    ahead /= ahead.sum(1, keepdims=True)
    start = ahead[:begins[1]][fresh[order]].sum(0)
    for t in range(len(begins) - 1):
        n = begins[t + 1] - begins[t]
        ahead[begins[t]:begins[t + 1]] *= ((low[:n] <= t) & (t < high[:n]))[:, None]
    emitted = np.stack([np.bincount(flat, ahead[:, k], p.emit.shape[1]) for k in range(len(p.start))])
    return start.astype(np.float64), moves * p.move, emitted


def _count(p: Parameters, batch_tokens: int = 400_000):
    """The task's counts, one row per state: its start, its moves, its emissions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(p.start)
        totals = np.zeros((k, 1 + k + p.emit.shape[1]))
        pieces, fresh, own, size = [], [], [], 0

        def add() -> None:
            start, moves, emitted = expected_counts(pieces, np.array(fresh), p, own)
            totals[:, 0] += start
            totals[:, 1:1 + k] += moves
            totals[:, 1 + k:] += emitted

        for batch in batches:
            for body in batch.column(0).to_pylist():
                words = np.frombuffer(body, np.uint16)
                for at, (piece, low, high) in enumerate(pieces_of(words)):
                    pieces.append(piece)
                    fresh.append(at == 0)
                    own.append((low, high))
                size += len(words)
                if size >= batch_tokens:
                    add()
                    pieces, fresh, own, size = [], [], [], 0
        if pieces:
            add()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array([row.tobytes() for row in totals], pa.binary())], names=["state", "counts"]
        )

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for state, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            totals[state] = totals.get(state, 0) + np.frombuffer(blob)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["state", "counts"]
    )


def train(classed: DataFrame, class_tokens: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> Parameters:
    """Baum-Welch over the rows' `classes`. Tasks add up their expected counts, Spark adds those of all tasks per state,
    and the driver gets one row per state."""
    p = Parameters.first(class_tokens, states)
    for _ in range(iterations):
        rows = classed.select("classes").mapInArrow(_count(p), "state int, counts binary").repartition("state")
        counts = np.zeros((states, 1 + states + len(class_tokens)))
        for state, blob in rows.mapInArrow(_sum_counts, "state int, counts binary").collect():
            counts[state] += np.frombuffer(blob)
        p = Parameters.from_counts(counts[:, 0], counts[:, 1:1 + states], counts[:, 1 + states:])
    return p


def _score(p: Parameters, batch_tokens: int = 2_000_000):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back, size = [], 0

        def score() -> pa.RecordBatch:
            table = pa.Table.from_batches(held_back)
            sequences = [np.frombuffer(b, np.uint16) for b in table.column("classes").to_pylist()]
            scores = forward_score(sequences, p) + table.column("within").to_numpy()
            columns = [table.column(c).combine_chunks() for c in ("doc_id", "held", "n_tokens", "n_known", "base_score")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(scores)], schema=schema)

        for batch in batches:
            at = 0
            ends = np.cumsum(np.asarray(batch.column(2)))
            while at < len(batch):
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + batch_tokens - size, "right")))
                held_back.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - done
                at = to
                if size >= batch_tokens or at < len(batch):
                    yield score()
                    held_back, size = [], 0
        if held_back:
            yield score()

    return run


def hmm_scores(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row's whole text.

    Tokens are the runs without ASCII white space after A-Z are lower-cased, then one end. `held_out` marks rows that
    nothing is learnt from; null counts as false. base_score is the smoothed unigram model's log10 probability, score the
    hidden Markov model's. A null or blank text is its end alone; a null id stays null; repeated rows count and are
    scored like others; other columns are ignored; no rows give no rows, and without training rows every word is unknown.

    Words are counted per block of documents first, so that a very frequent word reaches the shuffle once a block.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "hmm")
    source = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), text_or_empty(text_col).alias("body")
    )
    encoded = space.write(source.mapInArrow(_encode, _ENCODED), "encoded", compression="zstd")
    words = encoded.filter(F.col("word").isNotNull()).select("block", "idx", "word", "n")
    texts = encoded.filter(F.col("word").isNull())

    counts = words.groupBy("word").agg(F.sum("n").alias("c"))
    counts = space.write(counts.withColumn("ending", FREQUENT + F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(ENDINGS))), "counts")
    seen = counts.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    end_count = texts.filter("not held").count()
    train_tokens, distinct = seen["n"] + end_count, seen["v"] + (end_count > 0)
    # Frequent words: a table of FREQUENT - 1 rows.
    frequent = counts.filter("c > 0").orderBy(F.desc("c"), "word").limit(FREQUENT - 1).select("word", "c").collect()
    rows = [(r["word"], k + 1) for k, r in enumerate(frequent)]
    own = F.broadcast(spark.createDataFrame(rows, "word string, own int"))
    classes = counts.join(own, "word", "left").select("word", "c", F.coalesce("own", "ending").cast("int").alias("class"))
    classes = space.write(classes, "classes")
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    class_tokens[0] = end_count
    for row in classes.filter("c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        class_tokens[row["class"]], class_words[row["class"]] = row["n"], row["v"]

    dictionary = words.join(classes, "word").select("block", "idx", "c", "class")
    none = lambda kind: F.lit(None).cast(kind)
    blocks = dictionary.select("block", "idx", "c", "class", none("long").alias("doc_id"), none("boolean").alias("held"), none("binary").alias("body"))
    blocks = blocks.unionByName(texts.select(
        "block", "idx", none("long").alias("c"), none("int").alias("class"), "doc_id", "held", "body"
    )).repartition("block").sortWithinPartitions("block", "idx")
    classed = space.write(blocks.mapInArrow(_classify(train_tokens, distinct, end_count, class_tokens, class_words), _CLASSED), "classed", compression="zstd")
    space.drop("encoded", "counts", "classes")
    p = train(classed.filter("not held"), class_tokens, states, iterations)
    scored = classed.mapInArrow(_score(p), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
