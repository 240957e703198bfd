"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty
from .words import word_encoder

#: Items evolved together; an island works on one such shard, whatever the table's size.
SHARD_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 4
POPULATION = 4
ELITES = 2
#: Sequences of a shard less full than this are packed again together with those of other shards.
LOOSE = 0.99

Packing = list[list[int]]


def best_fit(order: list[int], lengths: list[int], capacity: int, bins: Packing) -> Packing:
    """Puts the items, in the given order, each into the bin that it leaves fullest; opens a bin where none has room."""
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for item in order:
        size = lengths[item]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(item)
        else:
            left, k = capacity, len(bins)
            bins.append([item])
        if left > size:
            insort(room, (left - size, k))
    return bins


def fitness(bins: Packing, lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, unequal filling, which leaves more room to close a bin."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(first: Packing, second: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """Injects well-filled bins of `second` into `first` whole, removes the bins that then hold duplicates and the worst
    remaining bins, and puts the displaced items back by best fit, longest first."""
    filled = [(sum(lengths[i] for i in b), k) for k, b in enumerate(second)]
    good = [k for fill, k in filled if fill >= 0.995 * capacity] or [max(filled)[1]]
    injected = [second[k] for k in rng.sample(good, max(1, len(good) // 2))]
    taken = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in first:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            displaced.extend(i for i in b if i not in taken)
    kept.sort(key=lambda b: -sum(lengths[i] for i in b))
    for b in kept[max(1, len(kept) - max(2, len(kept) // 20)):]:
        displaced.extend(b)
    kept = [list(b) for b in kept[:max(1, len(kept) - max(2, len(kept) // 20))]]
    displaced.sort(key=lambda i: (-lengths[i], rng.random()))
    return best_fit(displaced, lengths, capacity, [*map(list, injected), *kept])


def evolve(lengths: list[int], capacity: int, seeds: list[Packing], rng: random.Random) -> list[Packing]:
    """The best packings after some generations from the given ones and packings of random orders. At least one generation
    is bred; then it ends at the lower bound."""
    n = len(lengths)
    bound = -(-sum(lengths) // capacity)
    population = list(seeds)
    rank = lambda bins: fitness(bins, lengths, capacity)
    for generation in range(GENERATIONS):
        while len(population) < POPULATION:
            population.append(best_fit(rng.sample(range(n), n), lengths, capacity, []))
        population.sort(key=rank, reverse=True)
        if generation and len(population[0]) <= bound:
            break
        children = [
            crossover(population[0], population[k], lengths, capacity, rng) for k in range(1, len(population))
        ] + [crossover(population[1], population[0], lengths, capacity, rng)]
        population = sorted(population + children, key=rank, reverse=True)[:POPULATION]
    return sorted(population, key=rank, reverse=True)[:ELITES]


def _flat(bins: Packing, n: int) -> bytes:
    owner = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        owner[b] = k
    return owner.tobytes()


def _bins(owner: bytes) -> Packing:
    owner = np.frombuffer(owner, np.int32)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(owner.max() + 1))
    return [part.tolist() for part in np.split(order, cuts[1:])]


_STATE = "shard long, island int, ids binary, lengths binary, packings array<binary>"
_PLACED = "item long, shard long, bin int, at long, fill long"


def _evolve_island(capacity: int, epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                lengths = np.frombuffer(row.lengths, np.int64).tolist()
                rng = random.Random(f"{row.shard}/{row.island}/{epoch}")
                best = evolve(lengths, capacity, [_bins(p) for p in row.packings], rng)
                out.append((row.shard, row.island, row.ids, row.lengths, [_flat(b, len(lengths)) for b in best]))
            yield pd.DataFrame(out, columns=["shard", "island", "ids", "lengths", "packings"])

    return run


def _place_best(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids, lengths = np.frombuffer(row.ids, np.int64), np.frombuffer(row.lengths, np.int64)
                sizes = lengths.tolist()
                bins = max(map(_bins, row.packings), key=lambda b: fitness(b, sizes, capacity))
                order = np.concatenate([np.array(b, np.int64) for b in bins])
                counts = np.array([len(b) for b in bins])
                owner = np.repeat(np.arange(len(bins), dtype=np.int32), counts)
                ends = np.cumsum(lengths[order])
                opens = (ends - lengths[order])[np.cumsum(counts) - counts]
                fills = np.add.reduceat(lengths[order], np.cumsum(counts) - counts)
                yield pd.DataFrame({
                    "item": ids[order], "shard": row.shard, "bin": owner,
                    "at": ends - lengths[order] - opens[owner], "fill": fills[owner],
                })

    return run


def _shard_state(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("item", "ascending")])
    ids, lengths = (np.asarray(table.column(c).combine_chunks()).astype(np.int64).tobytes() for c in ("item", "length"))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "ids": [ids], "lengths": [lengths]})


def _round(items: DataFrame, shards: int, capacity: int, space: Workspace, name: str) -> DataFrame:
    """Packs every shard of (item, length) on its islands; elites move to the next island between epochs."""
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    state = dealt.groupBy("shard").applyInArrow(_shard_state, "shard long, ids binary, lengths binary")
    state = state.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "ids", "lengths",
        F.array().cast("array<binary>").alias("packings"),
    )
    for epoch in range(EPOCHS):
        state = space.write(
            state.repartition("shard", "island").mapInPandas(_evolve_island(capacity, epoch), _STATE), f"{name}-{epoch}"
        )
        migrants = state.select(
            "shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("packings").alias("arrived")
        )
        state = state.join(migrants, ["shard", "island"]).select(
            "shard", "island", "ids", "lengths", F.concat("packings", "arrived").alias("packings")
        )
    # After the last migration one island has seen every island's elites of its ring neighbour; with two, all of them.
    pooled = state.groupBy("shard").agg(
        F.first("ids").alias("ids"), F.first("lengths").alias("lengths"), F.flatten(F.collect_list("packings")).alias("packings")
    )
    return space.write(pooled.mapInPandas(_place_best(capacity), _PLACED), f"{name}-placed")


def pack(items: DataFrame, capacity: int, id_col: str = "item", length_col: str = "length") -> DataFrame:
    """Places every item in a sequence of at most `capacity`: item, sequence_id, offset.

    Items of exactly the capacity are sequences by themselves. The others are dealt by hash into shards of about
    SHARD_ITEMS, each evolved on ISLANDS islands; items of loosely filled sequences are then packed again across shards.
    Items with a null or non-positive length, or one above the capacity, get a null sequence; ids are to be distinct.
    No items give no rows.
    """
    spark = items.sparkSession
    space = Workspace(spark, "pack")
    items = items.select(F.col(id_col).cast("bigint").alias("item"), F.col(length_col).cast("bigint").alias("length"))
    small = items.filter((F.col("length") > 0) & (F.col("length") < capacity))
    n = small.count()
    placed = _round(small, max(1, -(-n // SHARD_ITEMS)), capacity, space, "first")
    loose = placed.filter(F.col("fill") < LOOSE * capacity)
    again = loose.select("item").join(small, "item")
    m = loose.count()
    second = _round(again, max(1, -(-m // SHARD_ITEMS)), capacity, space, "second")
    number = lambda kind: ((F.col("shard") * (1 << 20) + F.col("bin")) * 4 + kind).alias("sequence_id")
    full = items.filter(F.col("length") == capacity)
    rest = items.filter(F.col("length").isNull() | (F.col("length") <= 0) | (F.col("length") > capacity))
    return (
        placed.filter(F.col("fill") >= LOOSE * capacity).select("item", number(1), F.col("at").alias("offset"))
        .unionByName(second.select("item", number(2), F.col("at").alias("offset")))
        .unionByName(full.select("item", (F.col("item") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
        .unionByName(rest.select("item", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")))
    )


PIECE_SCHEMA = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of a document's ids, `end_id` last: only longer documents are cut, every `capacity` tokens.

    `item` numbers the pieces of this evaluation; write the table before using it twice.
    """
    schema = pa.schema([
        ("item", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        item = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, end, ids, counts in encoder.encode(batch.column(1)):
                ids = np.ascontiguousarray(np.insert(ids, np.cumsum(counts), end_id), "<u4")
                counts = counts + 1
                parts = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), parts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
                begin = np.repeat(np.cumsum(counts) - counts, parts) + piece * capacity
                size = np.minimum(capacity, np.repeat(counts, parts) - piece * capacity)
                crcs = [zlib.crc32(ids[a:a + k]) for a, k in zip(begin, size)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(item + np.arange(len(owner))), batch.column(0)[first:end].take(pa.array(owner)),
                    pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(size), pa.array(crcs, pa.int64()),
                ], schema=schema)
                item += len(owner)

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("body"))
    return source.mapInArrow(run, PIECE_SCHEMA)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    A null text is empty and gives the end id alone; a null id stays null; repeated rows are packed like any others;
    other columns are ignored; an empty table gives no rows. Ids are read once; only piece lengths are shuffled.
    """
    space = Workspace(docs.sparkSession, "pieces")
    pieces = space.write(pieces_of(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    return pieces.join(pack(pieces, capacity), "item").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
