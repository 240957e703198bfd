"""Ranked lexical search over K2-treaps: quadtrees of the grid of terms and documents whose cells hold impact maxima.

Documents are indexed in blocks. A block's grid has a row for each of its terms and a column for each of its documents;
a point holds the impact of a term in a document. The grid is cut into four again and again. Of each cell that isn't
empty the index keeps four bits, for the quarters that aren't empty, and its maximum as the difference from the parent's,
unless it is the only quarter of its parent and so has the parent's maximum.

A search follows, for each term of an item, the path of its row through the tree. The terms' paths go down together by
ranges of documents: a range's bound is the weighted sum of the maxima of its cells. The ranges with the highest bounds
go first; those that can't reach the item's best scores so far, in this block or blocks before it, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty
from .spans import LOWER, cuts_at_white, per_text, ragged, span_codes, texts_of, word_spans

#: Bytes that end a term: all of ASCII but digits and letters.
BREAK = np.zeros(256, bool)
BREAK[:128] = True
BREAK[48:58] = BREAK[65:91] = BREAK[97:123] = False
#: Text and documents of one block, at most; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
BLOCK_DOCS = 4096
#: Text of the items that are searched for in one pass; a single item may be longer.
PASS_BYTES = 2 << 20
#: Items searched together in a task, and ranges of each that go down at a time, at least.
TOGETHER = 32
BEAM = 16
_COUNT = np.array([bin(k).count("1") for k in range(16)], np.int64)


def term_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts, A to Z in lower case, and each text's bounds in them."""
    if len(data) <= 2 * BLOCK_BYTES or len(offsets) > 2:
        starts, ends = word_spans(data, offsets, BREAK)
        return span_codes(LOWER[data], starts, ends), per_text(starts, offsets)
    parts = []
    for low, high in cuts_at_white(data.tobytes(), BLOCK_BYTES):
        part = LOWER[data[low:high]]
        parts.append(span_codes(part, *word_spans(part, np.array([0, len(part)]), BREAK)))
    codes = np.concatenate(parts)
    return codes, np.array([0, len(codes)])


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, terms' hashes, bounds) of blocks of texts."""
    for at in range(0, len(column), BLOCK_DOCS):
        for first, end, data, offsets in texts_of(column.slice(at, BLOCK_DOCS), BLOCK_BYTES):
            yield at + first, at + end, *term_codes(data, offsets)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for batch in batches:
        for _, _, codes, bounds in _blocks(batch.column(0)):
            documents += int((np.diff(bounds) > 0).sum())
            terms += len(codes)
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], names=["documents", "terms"])


def _spread_bits(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """A K2-treap of points (row, column, value) with values above 0 on a grid of 2^height rows and columns.

    `levels` counts the cells of each level, root first. `bits` has four bits a cell above the last level: bit 2 * r + c
    is set if the quarter of its lower (r = 0) or upper rows and lower or upper columns isn't empty. `drops` has, root
    first, what the maximum of each cell with brothers lacks of its parent's; the root's own maximum stands in `peak`.
    """

    def __init__(self, height: int, levels: list[int], bits: np.ndarray, drops: np.ndarray, peak: int):
        self.height, self.levels, self.bits, self.drops, self.peak = height, levels, bits, drops, peak

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> "Treap":
        cells = _spread_bits(rows) << np.uint64(1) | _spread_bits(columns)
        order = np.argsort(cells)
        cells, top = cells[order], values[order].astype(np.int64)
        bits, drops, levels = [], [], [len(cells)]
        for _ in range(height):
            quarter, above = (cells & np.uint64(3)).astype(np.int64), cells >> np.uint64(2)
            first = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
            best = np.maximum.reduceat(top, first)
            bits.append(np.bitwise_or.reduceat(1 << quarter, first).astype(np.uint8))
            size = np.diff(np.append(first, len(cells)))
            drops.append((np.repeat(best, size) - top)[np.repeat(size > 1, size)])
            cells, top = above[first], best
            levels.append(len(cells))
        join = lambda parts, kind: np.concatenate([*parts[::-1], np.empty(0, kind)]).astype(kind)
        return cls(height, levels[::-1], join(bits, np.uint8), join(drops, np.uint32), int(top[0]))

    def unfold(self) -> tuple[np.ndarray, np.ndarray]:
        """First child and maximum of every cell, cells numbered level by level."""
        child = np.concatenate((1 + np.cumsum(_COUNT[self.bits]) - _COUNT[self.bits], np.zeros(self.levels[-1], np.int64)))
        top, at, cell, drop = np.empty(sum(self.levels), np.int64), 1, 0, 0
        top[0] = self.peak
        for n, below in zip(self.levels, self.levels[1:]):
            size = _COUNT[self.bits[cell:cell + n]]
            best, lower = np.repeat(top[cell:cell + n], size), np.flatnonzero(np.repeat(size > 1, size))
            best[lower] -= self.drops[drop:drop + len(lower)]
            top[at:at + below] = best
            cell, at, drop = cell + n, at + below, drop + len(lower)
        return child, top

    def packed_bits(self) -> bytes:
        """The cells' bits, two cells a byte."""
        even = np.append(self.bits, np.zeros(len(self.bits) % 2, np.uint8))
        return (even[::2] | even[1::2] << 4).tobytes()

    @staticmethod
    def unpacked_bits(packed: np.ndarray, levels: list[int]) -> np.ndarray:
        return np.stack((packed & 15, packed >> 4), axis=1).ravel()[:sum(levels[:-1])]


_INDEX_ARROW = pa.schema([
    ("ids", pa.list_(pa.int64())), ("terms", pa.binary()), ("held_by", pa.binary()), ("height", pa.int32()),
    ("levels", pa.list_(pa.int64())), ("bits", pa.binary()), ("drops", pa.binary()), ("peak", pa.int64()),
])
_INDEX = "ids array<long>, terms binary, held_by binary, height int, levels array<long>, bits binary, drops binary, peak long"


def _index(documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, codes, bounds in _blocks(batch.column("body")):
                if not len(codes):
                    continue
                n = np.diff(bounds)
                terms, row = np.unique(codes, return_inverse=True)
                point, tf = np.unique(np.repeat(np.arange(len(n)), n) * len(terms) + row, return_counts=True)
                column, row = point // len(terms), point % len(terms)
                m = 100 - 25 + (25 * n.astype(object) * documents) // total
                impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m.astype(np.int64)[column])
                height = max(len(terms) - 1, len(n) - 1, 1).bit_length()
                some = impact > 0
                none = Treap(height, [], np.empty(0, np.uint8), np.empty(0, np.uint32), 0)
                treap = Treap.build(row[some], column[some], impact[some], height) if some.any() else none
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("id").slice(first, end - first).to_pylist()], pa.list_(pa.int64())), pa.array([terms.tobytes()], pa.binary()),
                    pa.array([np.bincount(row, minlength=len(terms)).astype(np.uint32).tobytes()], pa.binary()), pa.array([height], pa.int32()),
                    pa.array([treap.levels], pa.list_(pa.int64())), pa.array([treap.packed_bits()], pa.binary()),
                    pa.array([treap.drops.tobytes()], pa.binary()), pa.array([treap.peak], pa.int64()),
                ], schema=_INDEX_ARROW)

    return run


class SearchIndex:
    """The blocks' treaps as a table of files, the number of documents with a term, and of all their terms."""

    def __init__(self, blocks: DataFrame, documents: int, terms: int):
        self.blocks, self.documents, self.terms = blocks, documents, terms


def build_index(docs: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text") -> SearchIndex:
    """Indexes all terms of all rows: one scan counts documents and terms, which the impacts need, a second builds the blocks.

    A null text has no terms. Terms are known by 64-bit hashes. A task holds one block: a text, or BLOCK_BYTES of texts.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("body"))
    sizes = texts.select("body").mapInArrow(_sizes, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = sizes[0] or 0, sizes[1] or 0
    return SearchIndex(space.write(texts.mapInArrow(_index(documents, terms), _INDEX), "index", compression="zstd"), documents, terms)


class Items:
    """Terms of some items as flat arrays: item number, hash of the term and weight; a repeated term's weight counts as often."""

    def __init__(self, texts: list[str]):
        data = [t.encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
        flat = np.frombuffer(b"".join(data), np.uint8)
        codes, bounds = term_codes(flat, offsets) if len(flat) else (np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
        self.count = len(texts)
        item = np.repeat(np.arange(len(texts)), np.diff(bounds))
        self.terms, row = np.unique(codes, return_inverse=True)
        pair, times = np.unique(item * max(len(self.terms), 1) + row, return_counts=True)
        self.item, self.row = pair // max(len(self.terms), 1), pair % max(len(self.terms), 1)
        self.weight = times

    def weigh(self, held_by: dict[int, int], documents: int) -> None:
        """Multiplies by the weight of the term: floor(1000 * ln((2N + 2) / (2df + 1)))."""
        w = [math.floor(1000 * math.log((2 * documents + 2) / (2 * held_by.get(int(t), 0) + 1))) for t in self.terms]
        self.weight = self.weight * np.array([*w, 0], np.int64)[self.row]


def _held_by(wanted: np.ndarray):
    """(term, documents that hold it) for the wanted terms of the blocks, summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("held_by")):
                terms, counts = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32)
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                total += np.where(terms[at] == wanted, counts[at], 0)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[seen].view(np.int64)), pa.array(total[seen])], names=["term", "n"])

    return run


class Best:
    """The k highest scores of each item so far; equal scores by ascending id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)
        self.item, self.score, self.id, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if not len(item):
            return
        item, score = np.concatenate((self.item, item)), np.concatenate((self.score, score))
        ids, null = np.concatenate((self.id, ids)), np.concatenate((self.null, null))
        order = np.lexsort((ids, null, -score, item))
        place = _places(item[order])
        rows = order[place < self.k]
        self.item, self.score, self.id, self.null = item[rows], score[rows], ids[rows], null[rows]
        full = place[place < self.k] == self.k - 1
        self.least[self.item[full]] = self.score[full]


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """The first row of each key."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])[:len(sorted_keys)])


def _places(sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each row among the rows with its key."""
    first = _firsts(sorted_keys)
    return np.arange(len(sorted_keys)) - np.repeat(first, np.diff(np.append(first, len(sorted_keys))))


def descend(treap: Treap, columns: int, item: np.ndarray, row: np.ndarray, weight: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best) -> None:
    """Adds the block's best documents for the items to `best`; (item, row, weight) are the items' terms in the block,
    sorted by item. Bounds never grow on the way down, so what lies below an item's least score is left out for good;
    what equals it is followed, since the smaller id counts."""
    if not len(item):
        return
    child, top = treap.unfold()
    cell = np.zeros(len(item), np.int64)

    def step(cell: np.ndarray, row: np.ndarray, level: np.ndarray | int, right: int) -> tuple[np.ndarray, np.ndarray]:
        """The quarters that the rows' paths reach on one side, and which of them aren't empty."""
        bits = treap.bits[cell].astype(np.int64)
        quarter = ((row >> (treap.height - 1 - level)) & 1) * 2 + right
        return child[cell] + _COUNT[bits & ((1 << quarter) - 1)], (bits >> quarter & 1).astype(bool)

    # Above the levels that cut the block's documents, all ranges are one.
    begin = treap.height - (columns - 1).bit_length()
    for level in range(begin):
        cell, there = step(cell, row, level, 0)
        item, row, weight, cell = item[there], row[there], weight[there], cell[there]
    if not len(item):
        return
    start = _firsts(item)
    ranges = {
        "item": item[start], "low": np.zeros(len(start), np.int64), "level": np.full(len(start), begin),
        "bound": np.add.reduceat(weight * top[cell], start), "start": start, "size": np.diff(np.append(start, len(item))),
    }
    while True:
        done = ranges["level"] == treap.height
        at = ranges["low"][done]
        best.add(ranges["item"][done], ranges["bound"][done], ids[at], null[at])
        open_ = ~done & (ranges["bound"] >= best.least[ranges["item"]])
        if not open_.any():
            return
        ranges = {c: v[open_] for c, v in ranges.items()}
        # The ranges with the highest bounds of each item: a beam, or a quarter of those that are open.
        order = np.lexsort((-ranges["bound"], ranges["item"]))
        place, number = np.empty(len(order), np.int64), np.bincount(ranges["item"], minlength=len(best.least))
        place[order] = _places(ranges["item"][order])
        chosen = place < np.maximum(BEAM, number[ranges["item"]] // 4)
        go = {c: v[chosen] for c, v in ranges.items()}
        rest = {c: v[~chosen] for c, v in ranges.items()}
        entry = ragged(np.arange(len(row)), go["start"], go["size"])
        owner = np.repeat(np.arange(len(go["item"])), go["size"])
        sides = []
        for right in (0, 1):
            below, there = step(cell[entry], row[entry], go["level"][owner], right)
            sides.append((owner[there] * 2 + right, entry[there], below[there]))
        key, entry, below = (np.concatenate(c) for c in zip(*sides))
        order = np.argsort(key, kind="stable")
        key, entry, below = key[order], entry[order], below[order]
        start = _firsts(key)
        parent, right = key[start] >> 1, key[start] & 1
        level = go["level"][parent] + 1
        stay = ragged(np.arange(len(row)), rest["start"], rest["size"])
        new = {
            "item": go["item"][parent], "low": go["low"][parent] + (right << (treap.height - level)), "level": level,
            "bound": np.add.reduceat(weight[entry] * top[below], start), "start": start + len(stay), "size": np.diff(np.append(start, len(key))),
        }
        rest["start"] = np.cumsum(rest["size"]) - rest["size"]
        ranges = {c: np.concatenate((rest[c], new[c])) for c in ranges}
        every = np.concatenate((stay, entry))
        row, weight, cell = row[every], weight[every], np.concatenate((cell[stay], below))


_FOUND = "item int, item_id long, doc_id long, score long"


def _search(items: Items, names: list[int | None], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items.count, k)
        for batch in batches:
            for block in range(len(batch)):
                cells = {c: batch.column(c)[block] for c in batch.schema.names}
                if not len(cells["levels"]):
                    continue
                terms = np.frombuffer(cells["terms"].as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(terms, items.terms), len(terms) - 1)
                there = np.append(terms[at] == items.terms, False)[items.row] & (items.weight > 0)
                item, row, weight = items.item[there], at[items.row[there]], items.weight[there]
                ids = cells["ids"].values
                null = np.asarray(ids.is_null())
                ids = np.asarray(ids.fill_null(0))
                levels = cells["levels"].as_py()
                treap = Treap(
                    cells["height"].as_py(), levels, Treap.unpacked_bits(np.frombuffer(cells["bits"].as_buffer(), np.uint8), levels),
                    np.frombuffer(cells["drops"].as_buffer(), np.uint32), cells["peak"].as_py(),
                )
                for first in range(0, items.count, TOGETHER):
                    low, high = np.searchsorted(item, (first, first + TOGETHER))
                    descend(treap, len(ids), item[low:high], row[low:high], weight[low:high], ids, null, best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item.astype(np.int32)), pa.array([names[i] for i in best.item], pa.int64()),
             pa.array(best.id, mask=best.null), pa.array(best.score)],
            names=["item", "item_id", "doc_id", "score"],
        )

    return run


def _passes(items: DataFrame) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of the items, in lists of about PASS_BYTES of text."""
    names, texts, size = [], [], 0
    for item in items.toLocalIterator():
        names.append(item.item_id)
        texts.append(item.body)
        size += len(item.body) + 16
        if size >= PASS_BYTES:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


def search(index: SearchIndex, items: DataFrame, space: Workspace, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0, equal scores by
    ascending id, null ids last.

    Rows that share an id are documents of their own. Items with the same id and text are one; with different texts they
    are ranked apart. Items go through the index in passes of PASS_BYTES of text, which the driver and every task hold;
    each task hands on k documents an item.
    """
    asked = items.select(F.col(id_col).cast("bigint").alias("item_id"), text_or_empty(text_col).alias("body")).distinct()
    parts = []
    for names, texts in _passes(asked):
        wanted = Items(texts)
        held = index.blocks.select("terms", "held_by").mapInArrow(_held_by(wanted.terms), "term long, n long")
        held = {r.term & 0xFFFFFFFFFFFFFFFF: r.n for r in held.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        wanted.weigh(held, index.documents)
        found = index.blocks.select("ids", "terms", "height", "levels", "bits", "drops", "peak").mapInArrow(_search(wanted, names, k), _FOUND)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        parts.append(space.write(ranked.select("item_id", "rank", "doc_id", "score"), f"found-{len(parts)}"))
    if not parts:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """`search` of the items in an index of all rows of `docs`; the index is deleted at the end."""
    space = Workspace(docs.sparkSession, "search")
    index = build_index(docs, space)
    found = search(index, items, space, k)
    space.drop("index")
    return found
