"""How filters of documents overlap: one 32-bit survival word a document, added up by carry-save positional popcounts."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .spans import word_slices

#: The filters, a letter each; a document fails filter k if bit k of its mask is set.
FILTERS = "ABCDE"
#: Bit S of TRUTH[m] is set if a document that fails the filters in m survives the subset S of filters.
TRUTH = np.array([sum(1 << s for s in range(32) if not s & m) for m in range(32)], np.uint32)

_UPPER = bytes(range(65, 91))
_SPECIAL = re.compile(rb"[#$%&*|]").search
#: Groups counted by a task before their counts are handed on.
GROUPS = 20_000


def text_fails(text: str) -> int:
    """The filters A to D that a text fails: under 200 words; fewer distinct words than half of all; over 2 capitals
    in 100 code points; any of # $ % & * |."""
    raw = text.encode()
    words, distinct = 0, set()
    for part in word_slices(raw):
        words += len(part)
        distinct.update(part)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (words < 200) | (100 * len(distinct) < 50 * words) << 1 | (100 * upper > 2 * len(text)) << 2 | (_SPECIAL(raw) is not None) << 3


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fails, digests = [], []
        for value in batch.column("body"):
            text = value.as_py()
            fails.append(text_fails(text))
            digests.append(hashlib.sha256(text.encode()).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(fails, pa.int32())],
            names=["id", "part", "digest", "fails"],
        )


def fail_masks(docs: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, fails) of every row: the mask of the filters A to D on the row's own text, and of E, which a row fails
    whose whole text is that of a row with a smaller id. Texts are equal if their SHA-256 is.

    The smallest id of a text is a partial aggregate, and only texts of several rows are joined back.
    """
    source = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
    )
    seen = space.write(source.mapInArrow(_examine, "id long, part string, digest binary, fails int"), "seen")
    first = seen.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    later = F.coalesce(F.col("first") < F.col("id"), F.col("first").isNotNull())
    return seen.join(first.drop("n"), "digest", "left").select("id", "part", (F.col("fails") + F.when(later, 16).otherwise(0)).alias("fails"))


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set.

    Three words of one weight turn into a sum of that weight and a carry of twice the weight, all words of a weight at
    a time, until one word of each weight is left; its bits are the counts' binary digits.
    """
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 1:
            n = -(-len(words) // 3)
            a, b = words[:n], words[n:2 * n]
            c = np.zeros(n, np.uint32)
            c[:max(len(words) - 2 * n, 0)] = words[2 * n:]
            if len(b) < n:
                b = np.append(b, np.zeros(n - len(b), np.uint32))
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = half ^ c
        counts += ((words[0] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).astype(np.int64) * weight
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of every subset of filters for each (part, good, toxic) that a task has seen."""
    held: dict[tuple, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        groups = list(held.items())
        held.clear()
        for at in range(0, len(groups), 2000):
            keys, counts = zip(*groups[at:at + 2000])
            part, good, toxic = zip(*keys)
            n, again = np.concatenate(counts), np.repeat(np.arange(len(keys)), 32)
            good, toxic = np.array(good)[again], np.array(toxic)[again]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()).take(pa.array(again)), pa.array(np.tile(np.arange(32, dtype=np.int32), len(keys))),
                 pa.array(n), pa.array(n * good), pa.array(n * toxic)],
                names=["part", "subset", "n", "good", "toxic"],
            )

    for batch in batches:
        if not len(batch):
            continue
        parts = batch.column("part").dictionary_encode()
        good, toxic = (np.asarray(batch.column(c)).astype(np.int64) for c in ("good", "toxic"))
        group = np.asarray(parts.indices).astype(np.int64) * 4 + good * 2 + toxic
        order = np.argsort(group, kind="stable")
        words, group = TRUTH[np.asarray(batch.column("fails"))][order], group[order]
        cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        for low, high in zip(cuts[:-1], cuts[1:]):
            code = int(group[low])
            key = (parts.dictionary[code // 4].as_py(), code >> 1 & 1, code & 1)
            counts = positional_counts(words[low:high])
            held[key] = held[key] + counts if key in held else counts
        if len(held) > GROUPS:
            yield from flush()
    yield from flush()


def subset_survivors(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, subset, n, good, toxic): the documents of each part that every subset of the filters leaves, those of them
    labelled quality 1, and those labelled toxic 1. An id with several label rows has a label if one of them says so."""
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    none = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    marked = masks.join(marks, "id", "left").select("part", "fails", none("good"), none("toxic"))
    counts = marked.mapInArrow(_count, "part string, subset int, n long, good long, toxic long")
    return counts.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


_REPORT = [("kept", "long"), ("removed", "long"), ("redundant", "long"), ("unique_fails", "long"), ("good_lost", "long"), ("toxic_lost", "long"), ("shapley", "long")]


def _report(letters: str) -> Callable:
    orders = list(itertools.permutations(range(len(letters))))
    names = np.repeat(["".join(letters[k] for k in order) for order in orders], len(letters)).tolist()
    own = 1 << np.array(orders)
    after = np.cumsum(own, axis=1)
    before, own, after = (after - own).ravel(), own.ravel(), after.ravel()
    every = (1 << len(letters)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                table = np.zeros((3, 32), np.int64)
                for cell in cells:
                    table[:, cell["subset"]] = cell["n"], cell["good"], cell["toxic"]
                kept, lost = table[0, after], table[:, before] - table[:, after]
                shapley = np.bincount(own, lost[0], every + 1).astype(np.int64)[own]
                columns = [kept, lost[0], table[0, 0] - table[0, own] - lost[0], table[0, every ^ own] - table[0, every], lost[1], lost[2], shapley]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(own), pa.string()), pa.array(names), pa.array(np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(orders))),
                     *[pa.array(c) for c in columns]],
                    names=["part", "filter_order", "step", *[c for c, _ in _REPORT]],
                )

    return run


def audit_report(survivors: DataFrame, letters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the survivors of each part's 32 subsets.

    kept: left after this step; removed: taken out by it; redundant: fail its filter but were taken out before;
    unique_fails: fail no other filter; good_lost and toxic_lost: the labelled ones among the removed; shapley: what the
    filter removes, over all orders. All are differences of survivors, so no document is looked at again.
    """
    cells = survivors.groupBy("part").agg(F.collect_list(F.struct("subset", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(_report(letters), "part string, filter_order string, step int, " + ", ".join(f"{c} {t}" for c, t in _REPORT))


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """`audit_report` of the five filters over all rows of `docs`, by the values of `part_col`.

    A null text is empty, a null part is the empty string. A null id counts as larger than all others and has no labels;
    rows that share an id are neither's earlier copy. No rows give no rows; other columns are ignored. A task holds one
    text, its distinct words and at most GROUPS tables of 32 counts.
    """
    space = Workspace(docs.sparkSession, "audit")
    return audit_report(subset_survivors(fail_masks(docs, space, id_col, text_col, part_col), labels, id_col))
