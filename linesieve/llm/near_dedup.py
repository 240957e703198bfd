"""Near-duplicate documents by HyperMinHash registers, banding, collision-corrected estimates and full verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, keep_matching, text_or_empty
from .components import connected_components
from .spans import LOWER, mix, per_text, ragged, span_hashes, texts_of, word_spans

#: Registers of a signature; bands take as many of them as fit (`banding`).
REGISTERS = 132
#: Probability with which a link at exactly the threshold may share no band.
MISSED = 5e-5
#: Bits of a register: leading zeros of the bucket's least hash, then the bits after its first one.
MANTISSA_BITS = 10
#: Rounds in which empty buckets take elements dealt anew, before each empty bucket gets a hash function of its own.
ROUNDS = 6
#: Members of one bucket compared in a task, about; larger buckets are cut into tiles.
TILE = 512

_rng = np.random.default_rng(577)
_ODD = _rng.integers(1, 1 << 62, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _rng.integers(1, 1 << 63, 64 + REGISTERS, np.uint64)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and each text's count.

    A text with fewer than `width` words has its whole word sequence as one shingle; one without words has none.
    """
    data = LOWER[data]
    starts, ends = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    bounds = per_text(starts, offsets)
    counts = np.diff(bounds)
    n = len(words)
    sums = np.zeros(n, np.uint64)
    for k in range(width):
        sums[:n - k] += words[k:] * _ODD[k]
    sums = mix(sums + np.uint64(width))
    pieces, sizes = [], np.zeros(len(counts), np.int64)
    for i, (low, count) in enumerate(zip(bounds[:-1], counts)):
        if count >= width:
            piece = np.unique(sums[low:low + count - width + 1])
        elif count:
            piece = mix((words[low:low + count] * _ODD[:count]).sum(dtype=np.uint64, keepdims=True) + np.uint64(count))
        else:
            continue
        pieces.append(piece)
        sizes[i] = len(piece)
    return (np.concatenate(pieces) if pieces else np.empty(0, np.uint64)), sizes


def _least(shingles: np.ndarray, owner: np.ndarray, texts: int, seed: np.uint64) -> np.ndarray:
    """Per text and bucket the least hash among the elements dealt to it."""
    hashed = mix(shingles + seed)
    bucket = ((hashed >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    out = np.full(texts * REGISTERS, _EMPTY, np.uint64)
    np.minimum.at(out, owner * REGISTERS + bucket.astype(np.int64), mix(hashed))
    return out.reshape(texts, REGISTERS)


def registers(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of each text; texts are to have shingles.

    A bucket takes its value in the first round that deals it an element. Two texts then agree in a bucket with a
    probability of their similarity, because they agree exactly if the least element of their union is in both.
    """
    texts = len(sizes)
    owner = np.repeat(np.arange(texts), sizes)
    least = _least(shingles, owner, texts, _SEEDS[0])
    ends = np.cumsum(sizes)
    for seed in _SEEDS[1:ROUNDS]:
        short = np.flatnonzero((least == _EMPTY).any(1))
        if not len(short):
            break
        again = ragged(shingles, (ends - sizes)[short], sizes[short])
        found = _least(again, np.repeat(np.arange(len(short)), sizes[short]), len(short), seed)
        least[short] = np.where(least[short] == _EMPTY, found, least[short])
    for i in np.flatnonzero((least == _EMPTY).any(1)):
        empty = np.flatnonzero(least[i] == _EMPTY)
        own = shingles[ends[i] - sizes[i]:ends[i]]
        least[i, empty] = [mix(own + _SEEDS[64 + b]).min() for b in empty]
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, (1 << (16 - MANTISSA_BITS)) - 1)
    return ((zeros << MANTISSA_BITS) | ((fraction - 0.5) * (2 << MANTISSA_BITS)).astype(np.int64)).astype(np.uint16)


def banding(threshold: float) -> tuple[int, int]:
    """Bands and registers of a band: the longest bands that miss at most MISSED of the links at the threshold.

    22 bands of 6 miss 3e-5 at 0.85, 26 bands of 5 miss 3e-5 at 0.8.
    """
    rows = next((r for r in range(len(_ODD), 1, -1) if (1 - threshold ** r) ** (REGISTERS // r) <= MISSED), 1)
    return REGISTERS // rows, rows


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per text and band."""
    parts = regs[:, :bands * rows].reshape(len(regs), bands, rows).astype(np.uint64) + np.uint64(1)
    return mix((parts * _ODD[:rows]).sum(2, dtype=np.uint64) + mix(np.arange(bands, dtype=np.uint64) + np.uint64(7)))


def estimate(same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal registers, less the equal ones expected of sets with nothing in common.

    The least of k elements lies at x with density k (1 - x)^(k - 1), and a register's cell around x is about
    0.72 x / 2^MANTISSA_BITS wide; the product of both densities and that width, over all x, is the chance of a collision.
    """
    k_a, k_b = np.maximum(n_a / REGISTERS, 1), np.maximum(n_b / REGISTERS, 1)
    chance = 0.72 / (1 << MANTISSA_BITS) * k_a * k_b / ((k_a + k_b - 0.999) * (k_a + k_b))
    expected = REGISTERS * np.minimum(chance, 0.5)
    return (same - expected) / (REGISTERS - expected)


def _floor(threshold: float) -> float:
    """Estimates below this are more than five standard deviations under the threshold."""
    return threshold - 5 * math.sqrt(max(threshold * (1 - threshold), 0.01) / REGISTERS)


_SIGNATURE = "doc_id long, n_shingles long, digest binary, regs binary"


def _signatures(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("regs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in texts_of(batch.column(1)):
                shingles, sizes = shingle_sets(data, offsets, width)
                ends = np.cumsum(sizes)
                regs = registers(shingles, sizes[sizes > 0])
                rows = iter(regs)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[first:end], pa.array(sizes),
                    pa.array([hashlib.blake2b(shingles[e - n:e], digest_size=16).digest() if n else None for e, n in zip(ends, sizes)], pa.binary()),
                    pa.array([next(rows).tobytes() if n else None for n in sizes], pa.binary()),
                ], schema=schema)

    return run


def _sets(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in texts_of(batch.column(1)):
                shingles, sizes = shingle_sets(data, offsets, width)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[first:end], pa.array([shingles[e - n:e].tobytes() for e, n in zip(ends, sizes)], pa.binary())
                ], schema=schema)

    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(regs, bands, rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys.ravel()), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(regs))), pa.array(np.repeat(np.asarray(batch.column(0)), bands)),
            ], names=["key", "band", "rep"])

    return run


def _estimated(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
            n_a, n_b = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
            near = estimate((left == right).sum(1), n_a, n_b) >= _floor(threshold)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(percent: int):
    """Pairs with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column("set_a"), batch.column("set_b"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tile_pairs(tile: pa.Table, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, other rows, estimates): pairs of different components whose estimate is high enough.

    Rows that share several buckets are compared in that of their first common band alone; in a tile of two blocks, only
    rows of different blocks are.
    """
    regs = np.frombuffer(b"".join(tile.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    part, block, n = (tile.column(c).to_numpy() for c in ("part", "block", "n"))
    band, rows = tile.column("band")[0].as_py(), banding(threshold)[1]
    alone = block.min() == block.max()
    for i in range(len(tile)):
        rest = np.flatnonzero(part[i + 1:] != part[i]) + i + 1
        if not alone:
            rest = rest[block[rest] != block[i]]
        same = regs[rest] == regs[i]
        first = ~same[:, :band * rows].reshape(len(rest), band, rows).all(2).any(1) if band else np.ones(len(rest), bool)
        guess = estimate(same.sum(1), n[rest], np.full(len(rest), n[i]))
        near = first & (guess >= _floor(threshold))
        if near.any():
            yield i, rest[near], guess[near]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tiles of rows that come sorted by tile."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        columns = [held.column(c).to_numpy() for c in ("key", "i", "j")]
        low = 0
        for cut in np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1:
            yield held.slice(low, cut - low)
            low = cut
        held = held.slice(low)
    if held is not None and len(held):
        yield held


_TILED = ("key", "band", "i", "j", "block", "rep", "part")


def _tile_members(threshold: float):
    """The rows of each tile that have a pair to verify there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            wanted = np.zeros(len(tile), bool)
            for i, rest, _ in _tile_pairs(tile, threshold):
                wanted[i] = True
                wanted[rest] = True
            yield from tile.select(_TILED).filter(pa.array(wanted)).to_batches()

    return run


def _tile_links(threshold: float, percent: int):
    """Links of each tile that join components, likely ones first; a pair is verified only while its ends are apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            pairs = [(g, i, j) for i, rest, guess in _tile_pairs(tile, threshold) for g, j in zip(guess.tolist(), rest.tolist())]
            pairs.sort(key=lambda p: (-p[0], p[1], p[2]))
            sets = [np.frombuffer(b, np.uint64) for b in tile.column("shingles").to_pylist()]
            rep, part = tile.column("rep").to_pylist(), tile.column("part").to_pylist()
            root = {p: p for p in part}

            def find(p: int) -> int:
                while root[p] != p:
                    root[p] = root[root[p]]
                    p = root[p]
                return p

            links = []
            for _, i, j in pairs:
                a, b = find(part[i]), find(part[j])
                if a != b and linked(sets[i], sets[j], percent):
                    root[max(a, b)] = min(a, b)
                    links.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_dedup(
    docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: links are 100 * intersection >= percent * union of shingle sets.

    Words are runs without ASCII white space after A-Z are lower-cased; a set holds the distinct shingles of `width`
    words, or the whole sequence where there are fewer. A null, empty or blank text has no shingles and links with
    nothing. A null id has a null component, links with nothing and is kept. Rows that share an id are one node, linked
    by any of its texts. Other columns are ignored; no rows give no rows.

    Documents with equal sets are one representative. In each bucket of equal bands all members are paired with one
    pivot, which differs by bucket; each document's best pair is verified first, then pairs that still cross components.
    Members of a bucket that then still belong to different components are compared with one another, in tiles, so no
    link is lost to the pivots; a tile returns only links that join components. Verification intersects full sets.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "near")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("body"))
    signed = space.write(source.mapInArrow(_signatures(width), _SIGNATURE), "signed")
    linkable = signed.filter("n_shingles > 0 and doc_id is not null")
    reps = space.write(linkable.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")
    ), "reps")
    members = space.write(
        signed.select("doc_id", "n_shingles", "digest").join(reps.select("digest", "rep"), "digest", "left").drop("digest"), "members"
    )

    rows = reps.select("rep", "regs").mapInArrow(_bands(*banding(percent / 100)), "key long, band int, rep long")
    rows = rows.withColumn("turn", F.xxhash64("rep", "key"))
    buckets = rows.groupBy("key").agg(F.min(F.struct("turn", "rep")).alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = space.write(rows.join(buckets, "key").select("key", "band", "rep", F.col("pivot.rep").alias("pivot"), "size"), "shared")
    paired = space.write(
        shared.filter("rep <> pivot").groupBy(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
        .agg(F.count(F.lit(1)).alias("bands")), "paired",
    )
    ids = space.write(shared.select("rep").distinct().withColumnRenamed("rep", "doc_id"), "ids")
    sets = space.write(keep_matching(source, ids, "doc_id", ids.count()).mapInArrow(_sets(width), "doc_id long, shingles binary"), "sets")

    marks = reps.select("rep", "n", "regs")
    left = marks.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a"))
    right = marks.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = pairs.join(left, "a").join(right, "b").mapInArrow(_estimated(percent / 100), "a long, b long")
        full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
        full = full.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
        return space.write(full.mapInArrow(_verified(percent), "a long, b long"), name)

    def crossing(pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """Pairs whose ends lie in different components."""
        a = parts.select(F.col("node").alias("a"), F.col("component").alias("part_a"))
        b = parts.select(F.col("node").alias("b"), F.col("component").alias("part_b"))
        joined = pairs.join(a, "a", "left").join(b, "b", "left")
        return joined.filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).drop("part_a", "part_b")

    ways = paired.select("a", "b", F.explode(F.array("a", "b")).alias("doc"), "bands")
    best = ways.groupBy("doc").agg(F.max(F.struct("bands", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
    best = space.write(best, "best")
    edges = verified(best, "edges-1")
    parts = space.write(connected_components(edges, space), "parts-1")
    rest = crossing(paired.select("a", "b").join(best, ["a", "b"], "left_anti"), parts)
    edges = edges.unionByName(verified(rest, "edges-2"))
    parts = space.write(connected_components(edges, Workspace(spark, "near")), "parts-2")

    named = shared.filter("size > 2").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("part", F.coalesce("component", "rep"))
    mixed = named.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
    blocks = F.ceil(F.col("size") / TILE)
    tiled = (
        named.join(mixed, "key").withColumn("blocks", F.ceil(F.col("size") / TILE))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "part")
    )

    def by_tile(rows: DataFrame) -> DataFrame:
        return rows.join(marks, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

    schema = "key long, band int, i long, j long, block long, rep long, part long"
    chosen = space.write(by_tile(tiled).mapInArrow(_tile_members(percent / 100), schema), "chosen")
    late = by_tile(chosen.join(sets.withColumnRenamed("doc_id", "rep"), "rep")).mapInArrow(_tile_links(percent / 100, percent), "a long, b long")
    late = space.write(late, "edges-3")
    parts = space.write(connected_components(edges.unionByName(late), Workspace(spark, "near")), "parts-3")
    space.drop("sets", "shared", "edges-1", "edges-2", "edges-3", "parts-1", "parts-2", "paired", "signed", "best", "ids", "chosen")

    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_representatives(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose document has the smallest id of its component, or a null id."""
    decided = near_dedup(docs, percent, id_col=id_col, text_col=text_col)
    dropped = Workspace(docs.sparkSession, "dropped").write(decided.filter("not kept").select(id_col).distinct(), "ids")
    return keep_matching(docs, dropped, id_col, dropped.count(), how="left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
