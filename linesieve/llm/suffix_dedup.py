"""Removal of byte strings that occur earlier in the corpus, by sorting suffixes in sampled ranges of their leading bytes.

Not every suffix is sorted. A window of LENGTH bytes is represented by the suffix at its anchor, the place with the least
hash of GRAM bytes in it. Equal windows have equal anchors, so equal windows meet among the suffixes that begin with the
same GRAM bytes, and nothing is lost. One anchor serves a run of neighbouring windows, its segment of text.

Copies of one segment inside a task are resolved there. The first of each goes to the bucket of its leading bytes: sampled
splitters cut the order of (leading bytes, hash of the gram, hash of the segment), so a gram that fills whole buckets is
cut by its segments. Buckets sort by multikey quicksort. Segments equal to an earlier one are removed whole; different
segments with the same gram are compared window by window, from their texts. The windows of a run that goes on in the
next bucket are compared across buckets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, free_name, keep_matching, shuffle_partitions, text_or_empty
from .spans import _VALUE, _powers, mix, texts_of

#: Bytes of an anchor's gram.
GRAM = 24
#: Largest length of strings: a segment holds at most 2 * length - GRAM bytes, and a run's size has 16 bits.
LONGEST = ((1 << 16) - 1 + GRAM) // 2
#: Text whose anchors make one bucket, about.
BUCKET_BYTES = 32 << 20
#: Anchors sampled for one splitter; the sample is bounded by this times the number of buckets.
SAMPLE = 200
#: Distinct segments of one gram whose windows are compared in one task; those of more are compared across tasks.
RUN = 20_000
LAST_ID = (1 << 63) - 1


def multikey_quicksort(keys: list[np.ndarray], small: int = 4096) -> np.ndarray:
    """Order of rows by several key columns: three-way partition by one column, equal rows go on with the next."""
    out = np.empty(len(keys[0]), np.int64)
    stack = [(np.arange(len(out)), 0, 0)]
    while stack:
        rows, depth, at = stack.pop()
        if len(rows) < 2 or depth == len(keys):
            out[at:at + len(rows)] = rows
        elif len(rows) <= small:
            out[at:at + len(rows)] = rows[np.lexsort([k[rows] for k in reversed(keys[depth:])])]
        else:
            column = keys[depth][rows]
            pivot = np.sort(column[::len(column) // 15])[7]
            less, more = column < pivot, column > pivot
            equal = ~(less | more)
            a, b = int(less.sum()), int(equal.sum())
            stack += [(rows[less], depth, at), (rows[equal], depth + 1, at + a), (rows[more], depth, at + a + b)]
    return out


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a sorted row differs from the one before; the first one does."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Anchors of all texts: text number, first and last window start and anchor (in the buffer), leading bytes, hashes."""
    n = len(data)
    if n < length:
        return {}
    powers, inverses = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:n - GRAM + 1]) * inverses[:n - GRAM + 1])
    # Least (hash, place) of every window by doubling; the place breaks ties from the left.
    span, least, width = length - GRAM + 1, (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[:width - span], least[span - width:])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= offsets[text + 1])
    if not len(start):
        return {}
    place, text = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64), text[start]
    first = np.flatnonzero(_changes([place, text]))
    low, high, place, text = start[first], start[np.append(first[1:], len(start)) - 1], place[first], text[first]
    head = np.zeros(len(place), np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | data[place + k]
    segment = mix((sums[high + length] - sums[low]) * inverses[low])
    segment = mix(segment + ((place - low) * (1 << 20) + high - low).astype(np.uint64))
    return {"text": text, "low": low, "high": high, "place": place, "head": head, "gram": grams[place], "segment": segment}


#: Columns of an anchor on its way to a bucket. `pos` is the first window's start in its document, `back` the anchor's
#: distance from it and `more` the number of further windows.
COLUMNS = (("head", np.uint64), ("gram", np.uint64), ("segment", np.uint64), ("doc", np.int64), ("pos", np.int64), ("back", np.uint16), ("more", np.uint16))


def _pack(anchors: dict[str, np.ndarray], part: slice) -> bytes:
    return b"".join(np.ascontiguousarray(anchors[c][part], t).tobytes() for c, t in COLUMNS)


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    size = sum(np.dtype(t).itemsize for _, t in COLUMNS)
    parts: dict[str, list] = {c: [] for c, _ in COLUMNS}
    for blob in blobs:
        n, at = len(blob) // size, 0
        for c, t in COLUMNS:
            parts[c].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return {c: np.concatenate(parts[c]) if blobs else np.empty(0, t) for c, t in COLUMNS}


_ORDER = ("head", "gram", "segment", "doc", "pos")


def _sorted_anchors(batch: pa.RecordBatch, length: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Per slice of texts the anchors in suffix order, and which are the first of their segment."""
    docs, bases = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    for first, end, data, offsets in texts_of(batch.column(2)):
        found = anchors_of(data, offsets, length)
        if not found:
            continue
        text = found["text"] + first
        anchors = {
            "head": found["head"], "gram": found["gram"], "segment": found["segment"], "doc": docs[text],
            "pos": bases[text] + found["low"] - offsets[found["text"]], "back": found["place"] - found["low"],
            "more": found["high"] - found["low"],
        }
        order = multikey_quicksort([anchors[c] for c in _ORDER])
        anchors = {c: v[order] for c, v in anchors.items()}
        yield anchors, _changes([anchors[c] for c in _ORDER[:3]])


def _sample(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchors, new in _sorted_anchors(batch, length):
                yield pa.RecordBatch.from_arrays([pa.array(anchors[c][new].view(np.int64)) for c in _ORDER[:3]], names=list(_ORDER[:3]))

    return run


def _cuts(anchors: dict[str, np.ndarray], splitters: list[tuple[int, int, int]]) -> list[int]:
    """Where the splitters fall in the sorted anchors."""
    out = []
    for splitter in splitters:
        low, high = 0, len(anchors["head"])
        for column, value in zip(_ORDER[:3], splitter):
            part = anchors[column][low:high]
            value = np.uint64(value)
            low, high = low + int(np.searchsorted(part, value, "left")), low + int(np.searchsorted(part, value, "right"))
        out.append(low)
    return out


_DEALT = "bucket int, anchors binary, done binary"


def _deal(length: int, splitters: list[tuple[int, int, int]]):
    """Rows (bucket, its anchors packed); repeats inside a slice are resolved here and travel as `done`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchors, new in _sorted_anchors(batch, length):
                again = ~new
                done = np.stack([anchors["doc"][again], anchors["pos"][again], anchors["more"][again].astype(np.int64) + length]).tobytes()
                anchors = {c: v[new] for c, v in anchors.items()}
                bounds = [0, *_cuts(anchors, splitters), len(anchors["head"])]
                buckets = [k for k in range(len(bounds) - 1) if bounds[k + 1] > bounds[k]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(buckets, pa.int32()), pa.array([_pack(anchors, slice(bounds[k], bounds[k + 1])) for k in buckets], pa.binary()),
                    pa.array([done if i == 0 else b"" for i in range(len(buckets))], pa.binary()),
                ], names=["bucket", "anchors", "done"])

    return run


#: `gram` is null for a removed run of bytes; else the row is a segment to compare, `wide` across tasks.
_JUDGED = "doc long, pos long, size int, gram long, wide boolean"
_JUDGED_ARROW = pa.schema([("doc", pa.int64()), ("pos", pa.int64()), ("size", pa.int32()), ("gram", pa.int64()), ("wide", pa.bool_())])


def _removed(doc: np.ndarray, pos: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(doc), 65536):
        part = slice(at, at + 65536)
        n = len(doc[part])
        yield pa.RecordBatch.from_arrays([
            pa.array(doc[part]), pa.array(pos[part]), pa.array(size[part].astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())
        ], schema=_JUDGED_ARROW)


def _judge(length: int, splitters: list[tuple[int, int, int]]):
    """Sorts one bucket and compares neighbours. A run goes on in another bucket if a splitter cuts its segments."""
    cut = sorted({head for head, _, segment in splitters if segment})
    cut_grams = sorted({gram for _, gram, segment in splitters if segment})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, blob, done in zip(*(c.to_pylist() for c in batch.columns)):
                blobs.setdefault(bucket, []).append(blob)
                if done:
                    yield from _removed(*np.frombuffer(done, np.int64).reshape(3, -1))
        for bucket in sorted(blobs):
            anchors = _unpack(blobs.pop(bucket))
            order = multikey_quicksort([anchors[c] for c in _ORDER])
            anchors = {c: v[order] for c, v in anchors.items()}
            new_run, first = _changes([anchors["head"], anchors["gram"]]), _changes([anchors[c] for c in _ORDER[:3]])
            size = anchors["more"].astype(np.int64) + length
            yield from _removed(anchors["doc"][~first], anchors["pos"][~first], size[~first])
            run_of = np.cumsum(new_run) - 1
            distinct = np.bincount(run_of[first])
            heads, grams = anchors["head"][new_run], anchors["gram"][new_run]
            border = np.isin(heads, np.array(cut, np.uint64)) & np.isin(grams, np.array(cut_grams, np.uint64))
            opened = np.flatnonzero(first & ((distinct > 1) | border)[run_of])
            wide = ((distinct > RUN) | border)[run_of[opened]]
            for at in range(0, len(opened), 65536):
                rows = opened[at:at + 65536]
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchors["doc"][rows]), pa.array(anchors["pos"][rows]), pa.array(size[rows].astype(np.int32)),
                    pa.array(anchors["gram"][rows].view(np.int64)), pa.array(wide[at:at + 65536]),
                ], schema=_JUDGED_ARROW)

    return run


_SEGMENTS = "gram long, wide boolean, doc long, pos long, bytes binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments to compare, from their document's text."""
    for batch in batches:
        for doc, base, text, segments in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            rows = [(s["gram"], s["wide"], doc, s["pos"], raw[s["pos"] - base:s["pos"] - base + s["size"]]) for s in segments if 0 <= s["pos"] - base and s["pos"] - base + s["size"] <= len(raw)]
            if rows:
                gram, wide, docs, pos, part = zip(*rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(gram, pa.int64()), pa.array(wide, pa.bool_()), pa.array(docs, pa.int64()), pa.array(pos, pa.int64()), pa.array(part, pa.binary())
                ], names=["gram", "wide", "doc", "pos", "bytes"])


def _windows(table: pa.Table | pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """Row number, start in the document and bytes (as big-endian words) of every window of the segments."""
    sizes = np.array([len(b) for b in table.column("bytes").to_pylist()], np.int64)
    data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(sizes)), counts)
    step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(np.cumsum(sizes) - sizes, counts) + step
    padded = -(-length // 8) * 8
    matrix = np.zeros((len(row), padded), np.uint8)
    if len(row):
        matrix[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[at]
    return row, table.column("pos").to_numpy()[row] + step, matrix.view(">u8").astype(np.uint64)


def _compare_runs(length: int, batch_rows: int = 4000):
    """Windows of segments with the same gram, sorted by their bytes; all but the first of equal ones are removed."""

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        row, start, words = _windows(table, length)
        gram, doc = table.column("gram").to_numpy()[row], table.column("doc").to_numpy()[row]
        keys = [gram, *words.T]
        order = multikey_quicksort([*keys, doc, start])
        again = order[~_changes([k[order] for k in keys])]
        yield from _merged(doc[again], start[again], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= batch_rows:
                table = pa.Table.from_batches(held).combine_chunks()
                gram = table.column("gram").to_numpy()
                cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
                for part in _run_slices(gram[:cut], batch_rows):
                    yield from compare(table.slice(*part))
                held = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            for part in _run_slices(table.column("gram").to_numpy(), batch_rows):
                yield from compare(table.slice(*part))

    return run


def _run_slices(gram: np.ndarray, batch_rows: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of about `batch_rows` rows that end with a run."""
    ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))
    low = 0
    while low < len(gram):
        high = int(ends[min(np.searchsorted(ends, low + batch_rows), len(ends) - 1)])
        yield low, high - low
        low = high


def _merged(doc: np.ndarray, start: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Removed runs from window starts; neighbours become one run, of at most 2^14 windows."""
    if not len(doc):
        return
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    if len(doc) > 1:
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (start[1:] % (1 << 14) == 0)
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(doc)) - 1
    yield from _removed(doc[low], start[low], start[high] + length - start[low])


_WINDOW_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("start", pa.int64())])


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                row, start, words = _windows(part, length)
                one, two = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
                for word in words.T:
                    one, two = mix(one ^ word), mix((two + word) * np.uint64(0xD6E8FEB86659FD93))
                yield pa.RecordBatch.from_arrays([
                    pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(part.column("doc").to_numpy()[row]), pa.array(start)
                ], schema=_WINDOW_ARROW)

    return run


def _placed(docs: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """All rows with `doc` and `base`, and the distinct documents among them.

    Rows that share an id lie one behind the other in one line of positions, in the order of a hash of their texts.
    """
    docs = docs.withColumn("doc", F.coalesce(F.col("doc_id"), F.lit(LAST_ID)))
    alone = docs.withColumn("base", F.lit(0).cast("long"))
    shared = space.write(docs.groupBy("doc").count().filter("count > 1").select("doc"), "shared-ids")
    n = shared.count()
    if not n:
        return alone, alone.select("doc", "base", "body")
    texts = keep_matching(docs, shared, "doc", n).select("doc", "body").distinct()
    texts = texts.select("doc", F.xxhash64("body").alias("code"), "body", F.octet_length("body").cast("long").alias("size"))
    before = Window.partitionBy("doc").orderBy("code", "body").rowsBetween(Window.unboundedPreceding, -1)
    texts = texts.withColumn("place", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = docs.join(texts.select("doc", "body", "place"), ["doc", "body"], "left")
    placed = placed.withColumn("base", F.coalesce("place", F.lit(0))).drop("place")
    single = alone.select("doc", "base", "body").join(shared, "doc", "left_anti")
    return placed, single.unionByName(texts.select("doc", F.col("place").alias("base"), "body"))


def _splitters(source: DataFrame, buckets: int, size: int, rows: int, length: int) -> list[tuple[int, int, int]]:
    """Suffix keys that cut a sample into equal parts. The sample, of at most SAMPLE keys a bucket, decides only how
    evenly suffixes are dealt."""
    wanted = buckets * SAMPLE
    share = min(1.0, max(32 * wanted / max(size, 1), 64 / max(rows, 1)))
    chosen = source.filter(F.pmod(F.xxhash64("doc", F.lit("splitters")), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    keys = chosen.mapInArrow(_sample(length), "head long, gram long, segment long").distinct()
    keys = keys.orderBy(F.xxhash64("gram", "segment")).limit(wanted).collect()
    ordered = sorted(tuple(int(v) & 0xFFFFFFFFFFFFFFFF for v in key) for key in keys)
    cuts = sorted({ordered[i * len(ordered) // buckets] for i in range(1, buckets)}) if ordered else []
    # A bucket begins with a gram; only a gram that fills whole buckets is cut by its segments.
    return sorted({key if k and cuts[k - 1][:2] == key[:2] else (*key[:2], 0) for k, key in enumerate(cuts)})


def repeated_runs(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `row` (its columns other than the text), doc_id, body (its text), base and runs.

    `runs` holds, as position * 2^16 + size with positions from `base`, runs of bytes of the UTF-8 text which together
    are what is covered by a string of `length` bytes that also starts earlier: in a row with a smaller id, or earlier
    in the row. Strings are judged on the input. A null text is empty, and a text shorter than `length` has no runs; a
    null id counts as larger than all others; rows that share an id are one document, in the order of a hash of their
    texts, and equal ones among them don't repeat each other. No rows give no rows. Lengths below GRAM or above LONGEST
    are refused.
    """
    if not GRAM <= length <= LONGEST:
        raise ValueError(f"length must be from {GRAM} to {LONGEST}, not {length}")
    spark = docs.sparkSession
    space = Workspace(spark, "suffix")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    body = docs.select(F.struct(*others).alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("body"))
    total = body.agg(F.sum(F.octet_length("body").cast("long")), F.count(F.lit(1))).first()
    size, rows = total[0] or 0, total[1]
    placed, source = _placed(body, space)

    buckets = max(shuffle_partitions(spark), math.ceil(size / BUCKET_BYTES))
    splitters = _splitters(source, buckets, size, rows, length)
    dealt = source.mapInArrow(_deal(length, splitters), _DEALT).repartitionById(buckets, "bucket")
    judged = space.write(dealt.mapInArrow(_judge(length, splitters), _JUDGED), "judged")

    opened = judged.filter(F.col("gram").isNotNull())
    places = opened.groupBy("doc").agg(F.collect_list(F.struct("pos", "size", "gram", "wide")).alias("segments"))
    places = space.write(places, "places")
    affected = keep_matching(source, places.select("doc"), "doc", places.count()).join(places, "doc")
    segments = space.write(affected.select("doc", "base", "body", "segments").mapInArrow(_segments, _SEGMENTS), "segments")
    near = segments.filter("not wide").repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare_runs(length), _JUDGED)
    windows = space.write(
        segments.filter("wide").mapInArrow(_window_hashes(length), "h1 long, h2 long, doc long, start long"), "windows"
    )
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    far = windows.join(first, ["h1", "h2"]).filter((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    removed = judged.filter(F.col("gram").isNull()).select("doc", "pos", "size")
    removed = removed.unionByName(near.select("doc", "pos", "size"))
    removed = removed.unionByName(far.select("doc", F.col("start").alias("pos"), F.lit(length).alias("size")))
    # One number per run of bytes; a document's list is bounded by its length.
    packed = removed.groupBy("doc").agg(F.collect_list(F.col("pos") * (1 << 16) + F.col("size")).alias("runs"))
    packed = space.write(packed, "runs")
    space.drop("judged", "places", "segments", "windows")
    return placed.join(packed, "doc", "left").select("row", "doc_id", "body", "base", "runs")


def _runs_to_spans(runs: list[int] | None, base: int, size: int) -> np.ndarray:
    """Maximal runs [start, end) inside a text of `size` bytes at `base`, as an array of two columns."""
    if not runs:
        return np.empty((0, 2), np.int64)
    packed = np.array(runs, np.int64)
    start, end = (packed >> 16) - base, (packed >> 16) + (packed & 0xFFFF) - base
    inside = (start >= 0) & (end <= size)
    start, end = start[inside], end[inside]
    if not len(start):
        return np.empty((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return np.stack([start[first], end[np.append(first[1:], len(start)) - 1]], axis=1)


def spans_of(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    """Bytes of the text and its removed spans for each row of (.., body, base, runs)."""
    for text, base, runs in zip(*(batch.column(c).to_pylist() for c in ("body", "base", "runs"))):
        raw = text.encode()
        yield raw, _runs_to_spans(runs, base, len(raw))


def _kept(raw: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def removal_digests(runs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of each row of `repeated_runs`."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest())
                for raw, spans in spans_of(batch)
            ]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=schema)

    return runs.select("doc_id", "body", "base", "runs").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, columns in place, with repeated runs cut out of their texts.

    A text is a string, so of characters that are cut in part all bytes stay. Null texts stay null. See `repeated_runs`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw, spans in spans_of(batch):
                inner = []
                for a, b in spans.tolist():
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    inner.append((a, b))
                texts.append(_kept(raw, np.array(inner, np.int64).reshape(-1, 2)).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "body"])

    null_text = free_name(docs, "null_text")
    marked = docs.withColumn(null_text, F.col(text_col).isNull())
    runs = repeated_runs(marked, length, id_col, text_col).select("row", "body", "base", "runs")
    schema = T.StructType([runs.schema["row"], T.StructField("body", T.StringType())])
    cut = runs.mapInArrow(run, schema)
    text = F.when(~F.col(f"row.`{null_text}`"), F.col("body")).alias(text_col)
    return cut.select(*[text if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
