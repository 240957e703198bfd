"""Containment joins: needed lines in views, anchors in texts, stored copies of originals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linesieve.functions.text import content_digest
from linesieve.operators.lines import ID, LINE
from linesieve.sources.staging import stage, staging


#: (least length, bytes of a gram, grams of a window): a needed line belongs to the first class that it is long enough for,
#: so that it holds a whole window. A window needs gram + window - 1 bytes; both are powers of two.
CLASSES = [
    (271, 16, 256), (143, 16, 128), (79, 16, 64), (47, 16, 32), (23, 8, 16), (11, 4, 8), (5, 2, 4), (2, 2, 1), (1, 1, 1),
]
#: The classes up to this one have grams of one length. The least gram of a window is also the least one of each smaller window
#: around it, so the minimizers of the class with the smallest windows hold those of the others.
NESTED = 3
EMPTY = len(CLASSES)  # class of the empty text, which stands in every line; its key is 0
PIECE = 1 << 20  # bytes of text whose windows are hashed at a time
HASHES = ["_one", "_two"]
FEW = 8  # lines with the least minimizer of a needed line that are compared without a look at its others
KEYS = 16  # windows of a needed line among which the rarest is chosen


def _minimizer_batches(classes: list[tuple[int, int, int]], piece: int, limit: int | None):
    """Arrow batches with ``_bytes`` and ``_class`` to one row per line and minimizer, ``_key`` in place of ``_bytes``.

    All of it is nested, so that Spark ships it with the task and executors need not have this package.
    """

    def doubled(values: np.ndarray, width: int, combine) -> np.ndarray:
        k = 1
        while k < width:
            values = combine(values[:-k], values[k:])
            k *= 2
        return values

    def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a * np.uint64(0x9E3779B97F4A7C15) + b
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    def pieces(first: np.ndarray, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Line, place of the first window and number of windows of pieces, some at a time; long lines are several pieces."""
        parts = -(-windows // piece)
        line = np.repeat(np.arange(len(first)), parts)
        skip = (np.arange(len(line)) - np.repeat(np.cumsum(parts) - parts, parts)) * piece
        n = np.minimum(windows[line] - skip, piece)
        group = np.cumsum(n) // piece
        for some in np.split(np.arange(len(line)), np.flatnonzero(np.diff(group)) + 1):
            yield line[some], first[line[some]] + skip[some], n[some]

    def least_keys(grams: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The least gram of each piece, which is the least one of every window that it stands in."""
        between = np.stack([starts, stops], axis=1).ravel()
        return np.minimum.reduceat(np.append(grams, np.uint64(0)), between)[::2]

    def keys(data: np.ndarray, first: np.ndarray, length: np.ndarray, least: int, gram: int, window: int):
        byte = mixed(np.arange(256, dtype=np.uint64), np.uint64(gram))
        for line, start, n in pieces(first, length - least + 1) if len(first) else ():
            size = n + least - 1
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) - np.repeat(ends - size, size)
            grams = doubled(byte[data[at + np.repeat(start, size)]], gram, mixed)
            if limit == 1:
                yield line, least_keys(grams, ends - size, ends - gram + 1)
                continue
            low = doubled(grams, window, np.minimum)
            new = np.ones(len(low), bool)
            new[1:] = low[1:] != low[:-1]
            at, line = at[:len(low)], np.repeat(line, size)[:len(low)]
            take = (at < np.repeat(n, size)[:len(low)]) & (new | (at == 0))
            yield line[take], low[take]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_bytes")).cast(pa.large_binary())
            _, ends, data = column.buffers()
            ends = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            kinds = batch.column(batch.schema.get_field_index("_class")).to_numpy(zero_copy_only=False)
            line = [np.flatnonzero(kinds == len(classes))]
            key = [np.zeros(len(line[0]), np.uint64)]
            for k, (least, gram, window) in enumerate(classes):
                rows = np.flatnonzero((kinds == k) & (np.diff(ends) >= least))
                for at, low in keys(data, ends[rows], np.diff(ends)[rows], least, gram, window):
                    line.append(rows[at])
                    key.append(low)
            line, key = np.concatenate(line), np.concatenate(key)
            order = np.lexsort((key, line))
            line, key = line[order], key[order]
            once = np.ones(len(line), bool)
            once[1:] = (line[1:] != line[:-1]) | (key[1:] != key[:-1])
            line, key = line[once], key[once]
            if limit is not None:
                rank = np.arange(len(line)) - np.searchsorted(line, line)
                line, key = line[rank < limit], key[rank < limit]
            out = batch.drop_columns(["_bytes"]).take(pa.array(line))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(key.view(np.int64))], names=[*out.schema.names, "_key"])

    return run


def _class_of(line: Column) -> Column:
    out = F.lit(EMPTY)
    for k, (least, _, _) in reversed(list(enumerate(CLASSES))):
        out = F.when(F.octet_length(line) >= least, k).otherwise(out)
    return out


def with_keys(df: DataFrame, keep: list[str], limit: int | None = None) -> DataFrame:
    """``keep``, ``_class`` and ``_key``: the minimizers of the line for the windows of its ``_class``, one a row; with
    ``limit`` the least ones.

    Of every window of neighbouring grams the gram with the least hash is a minimizer. A text that stands inside another
    one has its windows there too, so it shares each of its minimizers with it; a text without a whole window has none.
    With class ``EMPTY`` every text has the key 0.
    """
    kept = df.select(*keep, "_class")
    schema = T.StructType([*kept.schema.fields, T.StructField("_key", T.LongType())])
    run = _minimizer_batches(CLASSES, PIECE, limit)
    return df.select(*keep, "_class", F.col(LINE).cast("binary").alias("_bytes")).where("_bytes is not null").mapInArrow(run, schema)


def _hashed(df: DataFrame, *keep: str) -> DataFrame:
    """128 bits of hashes in place of the line, next to ``keep``."""
    return df.select(ID, F.xxhash64(LINE).alias(HASHES[0]), F.xxhash64(F.lit(1), LINE).alias(HASHES[1]), *keep)


def _classed(parts: DataFrame) -> DataFrame:
    return _hashed(parts.where(F.col(LINE).isNotNull()), LINE).withColumn("_class", _class_of(F.col(LINE)))


def _asked(parts: DataFrame) -> DataFrame:
    """Each asked text once, by its hashes, with its class and least minimizer."""
    return stage(with_keys(_classed(parts), [ID, *HASHES], 1).distinct(), "asked-keys")


def _index(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """The minimizers of ``lines``, by the hashes of the line, for the classes that their output asks for."""
    kinds = asked.groupBy(ID, F.greatest("_class", F.lit(NESTED)).alias("_kind")).agg(F.max("_class").alias("_class")).drop("_kind")
    return stage(with_keys(_hashed(lines, LINE).join(kinds, ID), [ID, *HASHES]), "line-keys")


def _met_by(df: DataFrame, *keep: str | Column) -> DataFrame:
    """``keep`` and ``_place``, a hash of output, kind of gram and minimizer; equal hashes only propose what is then compared."""
    return df.where(F.col("_class") < EMPTY).select(*keep, F.xxhash64(ID, F.greatest("_class", F.lit(NESTED)), "_key").alias("_place"))


def _rarest(places: DataFrame, held: DataFrame) -> DataFrame:
    """Hashes of asked texts, with ``_text`` for the lines at the place of their rarest minimizer."""
    often = held.groupBy("_place").agg(F.count(F.lit(1)).alias("_n"))
    found = F.coalesce("_n", F.lit(0))
    rarest = places.join(often, "_place", "left").groupBy(ID, *HASHES).agg(F.min_by("_place", found).alias("_place"), F.min(found).alias("_n"))
    return rarest.where(F.col("_n") > 0).drop("_n").join(held, "_place").drop("_place")


def _pairs(parts: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
    """Hashes of asked texts, with ``_text``, the hash of a line that may hold it; all lines that hold it are among them.

    No text moves but that of parts whose least minimizer is in more than ``FEW`` lines: those are looked up by their rarest one.
    """
    held = _met_by(index, F.col(HASHES[0]).alias("_text"))
    rare = lambda texts: _met_by(with_keys(texts, [ID, *HASHES], KEYS).distinct(), ID, *HASHES)
    if not staging():  # no table would keep what the branches below share, and no job may run here
        return _rarest(rare(_classed(parts)), held.distinct()).distinct()
    first = _met_by(asked, ID, *HASHES)
    hits = stage(held.join(first.select("_place"), "_place", "left_semi").distinct(), "met-keys")
    often = hits.groupBy("_place").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select("_place")
    if often.isEmpty():
        return first.join(hits, "_place").drop("_place").distinct()
    few = first.join(often, "_place", "left_anti").join(hits, "_place").drop("_place")
    many = _classed(parts).join(first.join(often, "_place", "left_semi"), [ID, *HASHES], "left_semi")
    places = stage(rare(many), "asked-often")
    near = stage(held.join(places.select("_place"), "_place", "left_semi").distinct(), "met-often")
    return few.unionByName(_rarest(places, near)).distinct()


def _holding(parts: DataFrame, pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of ``lines`` with ``_part`` and its hashes, compared in full for each of ``pairs``."""
    wanted = _hashed(parts, LINE).join(pairs.select(ID, *HASHES), [ID, *HASHES], "left_semi")
    named = wanted.groupBy(ID, *HASHES).agg(F.first(LINE).alias("_part")).join(pairs, [ID, *HASHES])
    return (
        lines.withColumn("_text", F.xxhash64(LINE)).join(named, [ID, "_text"])
        .where(F.contains(F.col(LINE), F.col("_part"))).drop("_text")
    )


def lines_holding(parts: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of ``lines`` with ``_part``: each text of ``parts`` that occurs in them, within one output.

    Lines are indexed by minimizers, one in 8 bytes where a part of 23 bytes is asked for, one in 128 where all parts are
    long. A line that holds a part has all of the part's minimizers: parts whose least one occurs nowhere go first, those with
    it in few lines meet these, and the others meet only the lines with their rarest one, by equality of output and key. An
    output with very many parts and lines spreads over all tasks. Every pair is then compared in full. An empty part is in
    every line.
    """
    asked = _asked(parts.where(F.col(LINE) != ""))
    pairs = stage(_pairs(parts, asked, _index(asked, lines)), "line-pairs")
    found = _holding(parts, pairs, lines).drop(*HASHES)
    empty = parts.where(F.col(LINE) == "").select(ID, F.col(LINE).alias("_part")).distinct()
    return found.unionByName(lines.join(empty, ID).where(F.col(LINE).isNotNull()))


def _inside(needed: DataFrame, asked: DataFrame, shown: DataFrame) -> DataFrame:
    """Hashes of the asked texts, each once, that are a shown line or stand inside one."""
    index = _index(asked, shown)
    pairs = stage(_pairs(needed, asked, index), "line-pairs")
    # Equal lines are told by hashes, so that their texts stay where they are.
    same = pairs.select(ID, *HASHES).distinct().join(index.select(ID, *HASHES).distinct(), [ID, *HASHES], "left_semi")
    same = stage(same, "equal-lines")
    found = _holding(needed, pairs.join(same, [ID, *HASHES], "left_anti"), shown).select(ID, *HASHES).distinct()
    # Where the empty text is asked for, every line is in the index.
    empty = F.col("_class") == EMPTY
    blank = asked.where(empty).join(index.where(empty).select(ID), ID, "left_semi").select(ID, *HASHES)
    return found.unionByName(same).unionByName(blank)


def missing_lines(needed: DataFrame, view_lines: DataFrame) -> DataFrame:
    """Needed lines, each once, that are part of no view line of the same output."""
    shown = view_lines.where(F.col(LINE).isNotNull()).select(ID, LINE)
    # Most needed lines are view lines: only the others are looked for inside, in views of outputs that have such lines.
    left = stage(needed.select(ID, LINE).distinct().join(shown, [ID, LINE], "left_anti"), "not-equal")
    return _hashed(left, LINE).join(_inside(left, _asked(left), shown), [ID, *HASHES], "left_anti").select(ID, LINE)


def containment_check(needed: DataFrame, view_lines: DataFrame) -> DataFrame:
    """Per output: number of needed lines, number missing, passed.

    Lines are counted by 128 bits of hashes, so that texts travel only where a needed line may stand inside another one.
    """
    shown = view_lines.where(F.col(LINE).isNotNull()).select(ID, LINE)
    asked = _asked(needed)
    met = _inside(needed, asked, shown).withColumn("_met", F.lit(1))
    joined = asked.join(met, [ID, *HASHES], "left").groupBy(ID).agg(
        F.count(F.lit(1)).alias("needed"), F.count_if(F.col("_met").isNull()).alias("missing")
    )
    return joined.withColumn("passed", F.col("missing") == 0)


def anchor_gate(texts: DataFrame, anchors: DataFrame, key: str = "case", text_col: str = "text") -> DataFrame:
    """Every anchor group needs one alternative in the case's text, letter case ignored."""
    groups = anchors.groupBy(key, "group_no").agg(F.collect_set(F.lower("alternative")).alias("alternatives"))
    per_case = groups.groupBy(key).agg(F.collect_list("alternatives").alias("groups"))
    low = texts.select(key, F.lower(text_col).alias("_low"))
    hit = lambda g: F.exists(g, lambda a: F.contains(F.col("_low"), a))
    return low.join(per_case, key).select(
        key,
        F.size("groups").alias("anchor_groups"),
        F.size(F.filter("groups", hit)).alias("groups_hit"),
        F.forall("groups", hit).alias("anchors_ok"),
    )


def recovery_check(results: DataFrame, artifacts: DataFrame, raw: str = "raw") -> DataFrame:
    """Whether the stored payload behind each id equals the original, compared by digest."""
    stored = artifacts.select(F.col("id").alias("artifact_id"), content_digest("payload").alias("_stored"))
    wanted = results.where(F.col("artifact_id").isNotNull()).withColumn("_raw", content_digest(raw))
    return wanted.join(stored, "artifact_id", "left").withColumn(
        "recovered", F.coalesce(F.col("_raw") == F.col("_stored"), F.lit(False))
    ).drop("_raw", "_stored")


def stored_secrets(outputs: DataFrame, artifacts: DataFrame, secret: Column) -> DataFrame:
    """Secret outputs whose content is in the store; must be empty."""
    flagged = outputs.where(secret).withColumn("sha256", content_digest("raw"))
    return flagged.join(artifacts.select("sha256"), "sha256", "left_semi")


def label_lookup(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Join a label table; the planner broadcasts it only while its measured size allows."""
    return df.join(labels, key)
