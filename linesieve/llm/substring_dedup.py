"""Removal of passages that occur more than once: documents meet on winnowed anchors, matches are extended both ways.

A window is `length` consecutive words of a document. Its anchor is the run of GRAM words with the least hash in it, so
equal windows have equal anchors at the same distance from their start. One anchor serves a run of neighbouring windows,
its segment of words.

1. Seeds: anchors whose gram has another place. A gram with one place only has no equal windows.
2. Copies of a whole segment (same gram, same words around it) are repeats from end to end; they are counted by partial
   aggregates, and one of them stands for all from here on.
3. Grams with several different segments: the segments' words are fetched from the texts, and the seeds are extended a
   word at a time to both sides. Seeds share a repeat if the d words before and the r words after them agree, with
   d + GRAM + r = length. Neighbouring repeats make one maximal repeat.

Grams with more than RUN segments, such as those at the ends of a passage that a third of all documents hold, are not
brought into one task: their extensions become keys of an aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, free_name, keep_matching, text_or_empty
from .spans import SLICE, _powers, cuts_at_white, mix, per_text, span_codes, texts_of, word_slices, word_spans

#: Words of an anchor.
GRAM = 10
#: Words whose windows are worked on at a time.
BLOCK = 1 << 20
#: Segments of one gram that are compared in one task; those of more are compared across tasks.
RUN = 500
#: Segments compared at a time.
BATCH = 20_000


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's bounds in them. A text longer than a slice is cut at white space."""
    if len(data) <= 2 * SLICE or len(offsets) > 2:
        starts, ends = word_spans(data, offsets)
        return span_codes(data, starts, ends), per_text(starts, offsets)
    parts = []
    for low, high in cuts_at_white(data.tobytes(), SLICE):
        part = data[low:high]
        parts.append(span_codes(part, *word_spans(part, np.array([0, len(part)]))))
    codes = np.concatenate(parts)
    return codes, np.array([0, len(codes)])


def _running(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    powers, inverses = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers[:len(codes)], out=sums[1:])
    return sums, inverses


def anchors_of(codes: np.ndarray, bounds: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Anchors of all texts: text number, first and last window start and anchor (in `codes`), hashes of gram and segment."""
    if len(codes) < length:
        return {}
    sums, inverses = _running(codes)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverses[:len(codes) - GRAM + 1])
    # Least (hash, place) of every window by doubling; the place breaks ties from the left.
    span, width = length - GRAM + 1, 1
    least = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[:width - span], least[span - width:])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= bounds[text + 1])
    if not len(start):
        return {}
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    low, high, place = start[first], start[np.append(first[1:], len(start)) - 1], place[first]
    segment = mix((sums[high + length] - sums[low]) * inverses[low])
    segment = mix(segment + ((place - low) * (1 << 20) + high - low).astype(np.uint64))
    return {"text": text[low], "low": low, "high": high, "place": place, "gram": grams[place], "segment": segment}


_ANCHORS = "gram long, segment long, doc long, code long, pos int, more short, back short"
_ANCHORS_ARROW = pa.schema([
    ("gram", pa.int64()), ("segment", pa.int64()), ("doc", pa.int64()), ("code", pa.int64()), ("pos", pa.int32()),
    ("more", pa.int16()), ("back", pa.int16()),
])


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, names = np.asarray(batch.column("doc")), np.asarray(batch.column("code"))
            for first, _, data, offsets in texts_of(batch.column("body")):
                codes, bounds = word_codes(data, offsets)
                # A slice of several texts is one block; a long text is cut into blocks that share length - 1 words.
                blocks = range(0, max(len(codes) - length + 1, 1), BLOCK) if len(bounds) == 2 else [0]
                for at in blocks:
                    part = codes[at:at + BLOCK + length - 1] if len(bounds) == 2 else codes
                    found = anchors_of(part, bounds if len(bounds) > 2 else np.array([0, len(part)]), length)
                    if found:
                        text = found["text"]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(found["gram"].view(np.int64)), pa.array(found["segment"].view(np.int64)), pa.array(docs[text + first]),
                            pa.array(names[text + first]), pa.array((found["low"] - bounds[text] + at).astype(np.int32)),
                            pa.array((found["high"] - found["low"]).astype(np.int16)), pa.array((found["place"] - found["low"]).astype(np.int16)),
                        ], schema=_ANCHORS_ARROW)

    return run


_SEGMENTS = "gram long, wide boolean, single boolean, doc long, code long, pos int, more short, back short, words binary"
_SEGMENTS_ARROW = pa.schema([
    ("gram", pa.int64()), ("wide", pa.bool_()), ("single", pa.bool_()), ("doc", pa.int64()), ("code", pa.int64()),
    ("pos", pa.int32()), ("more", pa.int16()), ("back", pa.int16()), ("words", pa.binary()),
])


def _segments(length: int):
    """The words of the segments to compare, joined by spaces, from their document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, code, text, places in zip(*(batch.column(c) for c in ("doc", "code", "body", "places"))):
                places = sorted(places.as_py(), key=lambda p: p["pos"])
                held, at, k = [], 0, 0
                for part in word_slices(text.as_py().encode()):
                    held += part
                    while k < len(places) and (end := (p := places[k])["pos"] + p["more"] + length) <= at + len(held):
                        words = b" ".join(held[p["pos"] - at:end - at])
                        rows.append((p["gram"], p["wide"], p["single"], doc.as_py(), code.as_py(), p["pos"], p["more"], p["back"], words))
                        k += 1
                    if k == len(places):
                        break
                    drop = min(places[k]["pos"] - at, len(held))
                    held, at = held[drop:], at + drop
                if len(rows) >= 4096:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SEGMENTS_ARROW)], schema=_SEGMENTS_ARROW)


def _extensions(table: pa.Table | pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each segment and each number d of words before its gram: a key of those words, one of the words after the
    gram that make up the window, and whether the segment holds the window. Keys grow by a word at a time."""
    reach = length - GRAM
    column = table.column("words")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    more, back = (np.asarray(table.column(c)).astype(np.int64) for c in ("more", "back"))
    codes = []
    for _, _, data, offsets in texts_of(column):
        codes.append(span_codes(data, *word_spans(data, offsets)))
    codes = np.concatenate([*codes, np.zeros(1, np.uint64)])
    base = np.concatenate(([0], np.cumsum(more + length)))[:-1]
    before, after = (np.zeros((len(more), reach + 1), np.uint64) for _ in range(2))
    for k in range(reach):
        left = np.where(back > k, base + back - 1 - k, -1)
        right = np.where(back + GRAM + k < more + length, base + back + GRAM + k, -1)
        before[:, k + 1] = mix(before[:, k] + codes[left] + np.uint64(1))
        after[:, k + 1] = mix(after[:, k] + codes[right] + np.uint64(2))
    depth = np.arange(reach + 1)
    holds = (depth <= back[:, None]) & (depth >= (back - more)[:, None])
    return before, after[:, ::-1], holds


def _repeated(gram: np.ndarray, before: np.ndarray, after: np.ndarray, holds: np.ndarray) -> np.ndarray:
    """Which windows another segment with the same gram holds too, as marks by segment and words before the gram."""
    marks = np.zeros(holds.shape, bool)
    for d in range(holds.shape[1]):
        rows = np.flatnonzero(holds[:, d])
        key = (gram[rows], before[rows, d], after[rows, d])
        order = np.lexsort(key)
        same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in key])
        twice = np.zeros(len(rows), bool)
        twice[1:] |= same
        twice[:-1] |= same
        marks[rows[order[twice]], d] = True
    return marks


_RUNS = "doc long, code long, pos int, size int"


def _runs_of(doc: np.ndarray, code: np.ndarray, pos: np.ndarray, back: np.ndarray, marks: np.ndarray, length: int) -> pa.RecordBatch:
    """Maximal repeats: neighbouring marked windows of a segment as one run of words."""
    wide = np.zeros((len(marks), marks.shape[1] + 2), np.int8)
    wide[:, 1:-1] = marks
    step = np.diff(wide, axis=1)
    row, low = np.nonzero(step == 1)
    high = np.nonzero(step == -1)[1] - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[row]), pa.array(code[row]), pa.array((pos[row] + back[row] - high).astype(np.int32)), pa.array((high - low + length).astype(np.int32))],
        names=["doc", "code", "pos", "size"],
    )


def _extend(length: int):
    """Compares the segments of each gram; rows come sorted by gram."""

    def compare(table: pa.Table) -> pa.RecordBatch:
        marks = _repeated(np.asarray(table.column("gram")), *_extensions(table, length))
        marks &= np.asarray(table.column("single"))[:, None]
        return _runs_of(*(np.asarray(table.column(c)).astype(np.int64) for c in ("doc", "code", "pos", "back")), marks, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BATCH:
                table = pa.Table.from_batches(held)
                gram = np.asarray(table.column("gram"))
                cut = int(np.searchsorted(gram, gram[-1]))
                if cut:
                    yield compare(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))

    return run


def _keys(length: int):
    """One row per window of the segments, with the key of its extensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                before, after, holds = _extensions(part, length)
                row, d = np.nonzero(holds)
                gram, doc, code, pos, back = (np.asarray(part.column(c)).astype(np.int64)[row] for c in ("gram", "doc", "code", "pos", "back"))
                one, two = before[row, d], after[row, d]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(mix(one + mix(two) + d.astype(np.uint64)).view(np.int64)), pa.array(mix(two + mix(one + np.uint64(7))).view(np.int64)),
                     pa.array(np.asarray(part.column("single"))[row]), pa.array(doc), pa.array(code), pa.array((pos + back - d).astype(np.int32))],
                    names=["gram", "one", "two", "single", "doc", "code", "pos"],
                )

    return run


def repeated_words(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `row` (its columns other than the text), doc_id, body (its text) and runs.

    `runs` holds, as first word * 2^16 + words, runs of words which together are what is covered by a window of `length`
    words whose words also start anywhere else, in the same or another row. Words are runs without ASCII white space;
    windows are judged on the input. A null text has no words, texts below `length` words have no runs. Rows that repeat
    an id or a whole row are documents of their own. No rows give no rows. Lengths from GRAM + 1 to 4,096 are taken.

    Words, grams and extensions are compared by 64-bit hashes, a window by those of its gram and of both extensions.
    """
    if not GRAM < length <= 4096:
        raise ValueError(f"length must be from {GRAM + 1} to 4096, not {length}")
    spark = docs.sparkSession
    space = Workspace(spark, "seeds")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    source = docs.select(F.struct(*others).alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("body"))
    # Rows with the same id and text share a key; their results are equal, since each repeats the other.
    source = source.withColumn("doc", F.coalesce("doc_id", F.lit(0))).withColumn("code", F.xxhash64("body", F.col("doc_id").isNull()))
    texts = source.select("doc", "code", "body")

    anchors = space.write(texts.mapInArrow(_anchors(length), _ANCHORS), "anchors")
    grams = space.write(anchors.groupBy("gram").count().filter("count > 1").select("gram"), "grams")
    seeds = space.write(keep_matching(anchors, grams, "gram", grams.count()), "seeds")
    space.drop("anchors", "grams")
    place = F.struct("doc", "code", "pos", "more", "back")
    distinct = space.write(seeds.groupBy("gram", "segment").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")), "distinct")
    copied = distinct.filter("n > 1").select("gram", "segment")
    whole = seeds.join(copied, ["gram", "segment"], "left_semi").select("doc", "code", "pos", (F.col("more") + length).cast("int").alias("size"))

    several = distinct.groupBy("gram").count().filter("count > 1").select("gram", (F.col("count") > RUN).alias("wide"))
    opened = distinct.join(several, "gram").select("gram", "wide", (F.col("n") == 1).alias("single"), "at.*")
    # A document's list is bounded by its length: a place stands in it once.
    places = opened.groupBy("doc", "code").agg(F.collect_list(F.struct("gram", "wide", "single", "pos", "more", "back")).alias("places"))
    segments = texts.join(places, ["doc", "code"]).mapInArrow(_segments(length), _SEGMENTS)
    # Repeated rows give a segment more than once; it is one place all the same.
    segments = space.write(segments.distinct(), "segments")
    near = segments.filter("not wide").repartition("gram").sortWithinPartitions("gram").mapInArrow(_extend(length), _RUNS)
    keys = space.write(
        segments.filter("wide").mapInArrow(_keys(length), "gram long, one long, two long, single boolean, doc long, code long, pos int"), "keys"
    )
    again = keys.groupBy("gram", "one", "two").count().filter("count > 1").drop("count")
    far = keys.filter("single").join(again, ["gram", "one", "two"], "left_semi").select("doc", "code", "pos", F.lit(length).alias("size"))
    runs = whole.unionByName(near).unionByName(far)
    # One number per run of words; a set, since repeated rows share a key. A set is bounded by the text's length.
    packed = runs.groupBy("doc", "code").agg(F.collect_set(F.col("pos").cast("long") * (1 << 16) + F.col("size")).alias("runs"))
    packed = space.write(packed, "runs")
    space.drop("seeds", "distinct", "segments", "keys")
    return source.join(packed, ["doc", "code"], "left").select("row", "doc_id", "body", "runs")


def _spans(runs: list[int] | None) -> np.ndarray:
    """Maximal runs [first word, end) as an array of two columns."""
    if not runs:
        return np.empty((0, 2), np.int64)
    packed = np.sort(np.array(runs, np.int64))
    start = packed >> 16
    end = np.maximum.accumulate(start + (packed & 0xFFFF))
    first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return np.stack([start[first], end[np.append(first[1:], len(start)) - 1]], axis=1)


def kept_words(raw: bytes, spans: np.ndarray) -> Iterator[list[bytes]]:
    """The words outside the spans, in lists from slices of the text."""
    at = 0
    for words in word_slices(raw):
        keep, low = [], 0
        inside = spans[(spans[:, 1] > at) & (spans[:, 0] < at + len(words))] - at
        for a, b in inside.tolist():
            keep += words[low:max(a, 0)]
            low = b
        yield keep + words[low:]
        at += len(words)


def word_repeat_spans(runs: DataFrame) -> DataFrame:
    """(doc_id, first_word, n_words): the maximal runs of removed words of each row of `repeated_words`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_spans(r) for r in batch.column("runs").to_pylist()]
            every = np.concatenate([np.empty((0, 2), np.int64), *spans])
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(spans)), list(map(len, spans)))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(every[:, 0]), pa.array(every[:, 1] - every[:, 0])], names=["doc_id", "first_word", "n_words"])

    return runs.filter("runs is not null").select("doc_id", "runs").mapInArrow(run, "doc_id long, first_word long, n_words long")


def word_removal_digests(runs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space) of each row of `repeated_words`."""

    def digest(text: str, runs: list[int] | None) -> tuple[int, int, str]:
        raw, spans = text.encode(), _spans(runs)
        total, some, code = 0, False, hashlib.sha256()
        for words in kept_words(raw, spans):
            if words:
                code.update((b" " if some else b"") + b" ".join(words))
                some, total = True, total + len(words)
        removed = int((spans[:, 1] - spans[:, 0]).sum())
        return total + removed, removed, code.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(text.as_py(), runs.as_py()) for text, runs in zip(batch.column("body"), batch.column("runs"))]
            n, removed, code = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(code, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return runs.select("doc_id", "body", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeated_words(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, columns in place; texts that lose words become their kept words joined by one space, others stay
    as they are, null texts too. See `repeated_words`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column("body"), batch.column("runs")):
                spans = _spans(runs.as_py())
                body = text.as_py()
                texts.append(b" ".join(b" ".join(p) for p in kept_words(body.encode(), spans) if p).decode() if len(spans) else body)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "body"])

    null_text = free_name(docs, "null_text")
    runs = repeated_words(docs.withColumn(null_text, F.col(text_col).isNull()), length, id_col, text_col).select("row", "body", "runs")
    cut = runs.mapInArrow(run, T.StructType([runs.schema["row"], T.StructField("body", T.StringType())]))
    text = F.when(~F.col(f"row.`{null_text}`"), F.col("body")).alias(text_col)
    return cut.select(*[text if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
