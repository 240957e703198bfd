"""Near-duplicate vectors by int8 tile products with error bounds, and exact recomputation of what may reach the threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace
from .components import connected_components

#: Vectors that one tile side holds, about.
TILE_ROWS = 1536
#: Vectors, chosen by hash, around which blocks are formed; a bounded sample that only decides which tiles are skipped.
PIVOTS = 48


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales, and the exact lengths of the coded vectors and of what the coding lost."""
    scale = np.abs(unit).max(1) / 127
    scale[scale == 0] = 1
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(unit - coded, axis=1)


def possible_pairs(a: tuple, b: tuple, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs whose cosine may reach the threshold, and whether it certainly does.

    x.y = x'.y' + x'.e_y + e_x.y with codes x', y' and losses e, so |x.y - x'.y'| <= |x'| |e_y| + |e_x| |y|, and |y| = 1.
    Sums of int8 products stay below 2^24 for 1,024 components, so float32 products of such slices are exact.
    """
    codes_a, scale_a, size_a, loss_a = a
    codes_b, scale_b, _, loss_b = b
    cb = codes_b.astype(np.float32)
    for start in range(0, len(codes_a), 512):
        rows = slice(start, start + 512)
        ca = codes_a[rows].astype(np.float32)
        dots = ca[:, :1024] @ cb[:, :1024].T
        if ca.shape[1] > 1024:
            dots = dots.astype(np.float64)
            for k in range(1024, ca.shape[1], 1024):
                dots += ca[:, k:k + 1024] @ cb[:, k:k + 1024].T
        # A coarse bound for the whole slice first, then each pair's own bound.
        least = threshold - float(size_a[rows].max() * loss_b.max()) - float(loss_a[rows].max()) - 1e-9
        floor = least / (float(scale_a[rows].max()) * float(scale_b.max())) if least > 0 else -np.inf
        i, j = np.nonzero(dots >= floor)
        bound = size_a[rows][i] * loss_b[j] + loss_a[rows][i] + 1e-9
        coded = dots[i, j] * scale_a[rows][i] * scale_b[j]
        hit = coded + bound >= threshold
        yield i[hit] + start, j[hit], (coded - bound >= threshold)[hit]


def exact_links(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of full-precision vectors have a cosine at or above the threshold, in double precision."""
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 65536):
        a, b = x[i[s:s + 65536]], y[j[s:s + 65536]]
        dots = np.einsum("ij,ij->i", a, b)
        sizes = np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
        out[s:s + 65536] = dots / sizes >= threshold
    return out


def spanning(pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """A forest with the same components as the index pairs."""
    parent = list(range(n))
    forest = []
    for left, right in pairs:
        for a, b in zip(left.tolist(), right.tolist()):
            x, y = a, b
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((a, b))
    return forest


_CODED = "node long, row long, n long, dims int, codes binary, scale double, size double, loss double, pivot int, angle double"
_BLOCKS = "block long, dims int, pivot int, radius double, ids binary, rows binary, n binary, codes binary, scale binary, size binary, loss binary"
_FOUND = "node long, other long, links long, row_a long, row_b long, n_a long, n_b long"


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a list column and the matrix of their values, for each length of lists."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for dims in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dims)
        yield at, values[(ends[at] - dims)[:, None] + np.arange(dims)]


def _coded(pivots: dict[int, np.ndarray]):
    """Per vector: its int8 codes with what bounds their error, and the pivot next to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _by_length(batch.column("vector")):
                unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
                codes, scale, size, loss = quantise(unit)
                side = pivots.get(unit.shape[1])
                if side is None:
                    best, angle = np.full(len(at), -1), np.full(len(at), math.pi)
                else:
                    cosines = unit @ side.T
                    best = cosines.argmax(1)
                    angle = np.arccos(np.clip(cosines.max(1), -1.0, 1.0))
                kept = [batch.column(c).take(pa.array(at)) for c in ("node", "row", "n")]
                yield pa.RecordBatch.from_arrays([
                    *kept, pa.array(np.full(len(at), unit.shape[1]), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(scale), pa.array(size), pa.array(loss), pa.array(best, pa.int32()), pa.array(angle),
                ], names=["node", "row", "n", "dims", "codes", "scale", "size", "loss", "pivot", "angle"])

    return run


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """One row per block: ids, copies, int8 codes with their bounds, and the widest angle to the block's pivot."""
    packed = lambda c: [table.column(c).to_numpy().tobytes()]
    return pa.table({
        "block": pa.array([key[0].as_py()], pa.int64()), "dims": pa.array([table.column("dims")[0].as_py()], pa.int32()),
        "pivot": pa.array([table.column("pivot")[0].as_py()], pa.int32()),
        "radius": pa.array([table.column("angle").to_numpy().max()], pa.float64()),
        "ids": packed("node"), "rows": packed("row"), "n": packed("n"), "codes": [b"".join(table.column("codes").to_pylist())],
        "scale": packed("scale"), "size": packed("size"), "loss": packed("loss"),
    })


def _side(row: dict, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Ids, rows, numbers of copies and the quantised vectors of one side of a tile."""
    ids, rows, n = (np.frombuffer(row[f"{c}_{name}"], np.int64) for c in ("ids", "rows", "n"))
    codes = np.frombuffer(row[f"codes_{name}"], np.int8).reshape(len(ids), -1)
    return ids, rows, n, (codes, *(np.frombuffer(row[f"{c}_{name}"], np.float64) for c in ("scale", "size", "loss")))


def _found(node, other=None, links=None, rows=(None, None), n=(None, None)) -> pa.RecordBatch:
    """Rows of `_FOUND`; what isn't given is null."""
    columns = [node, other, links, *rows, *n]
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(node), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns],
        names=["node", "other", "links", "row_a", "row_b", "n_a", "n_b"],
    )


def _tiles(threshold: float):
    """Per tile: each vector's number of copies that are certainly linked, a forest of those links, and the pairs which the
    codes leave open; never the list of all links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                same = row["a"] == row["b"]
                ids_a, rows_a, n_a, qa = _side(row, "a")
                ids_b, rows_b, n_b, qb = (ids_a, rows_a, n_a, qa) if same else _side(row, "b")
                links_a, links_b, sure = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64), []
                for i, j, certain in possible_pairs(qa, qb, threshold):
                    if same:
                        i, j, certain = i[i < j], j[i < j], certain[i < j]
                    p, q = i[~certain], j[~certain]
                    if len(p):
                        yield _found(ids_a[p], ids_b[q], rows=(rows_a[p], rows_b[q]), n=(n_a[p], n_b[q]))
                    i, j = i[certain], j[certain]
                    np.add.at(links_a, i, n_b[j])
                    np.add.at(links_b, j, n_a[i])
                    sure.append((i, j + (0 if same else len(ids_a))))
                if same:
                    links_a += links_b
                    links_b[:] = 0
                ids = ids_a if same else np.concatenate((ids_a, ids_b))
                yield _found(
                    np.concatenate((ids_a[links_a > 0], ids_b[links_b > 0])), links=np.concatenate((links_a[links_a > 0], links_b[links_b > 0]))
                )
                forest = np.array(spanning(sure, len(ids)), np.int64).reshape(-1, 2)
                yield _found(ids[forest[:, 0]], ids[forest[:, 1]], links=np.zeros(len(forest), np.int64))

    return run


def _recomputed(threshold: float):
    """Per open pair whose full vectors reach the threshold: the link from both ends, with the copies at the other one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("node", "other", "n_a", "n_b")
            node, other, n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
            for (at, x), (_, y) in zip(_by_length(batch.column("x")), _by_length(batch.column("y"))):
                pairs = np.arange(len(at))
                at = at[exact_links(x, y, pairs, pairs, threshold)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((node[at], other[at])), pa.int64()),
                    pa.array(np.concatenate((other[at], node[at])), pa.int64()),
                    pa.array(np.concatenate((n_b[at], n_a[at])), pa.int64()),
                ], names=["node", "other", "links"])

    return run


def embedding_dedup(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row: links are cosines of at least `threshold`, which is > 0.

    A vector that is null, empty, zero, or holds a null, an infinity or a NaN links with nothing; so do vectors of
    different length. Rows with equal vectors are linked; rows with a null id get null component and no links. Rows that
    share an id are one node whose links are counted together. Other columns are ignored; no rows give no rows.

    Equal vectors become one representative with a count, so a large group of copies costs one row. Representatives form
    blocks around pivots; two blocks meet in a tile unless the angle between their pivots, less both radii, rules out
    every pair. Blocks and tiles hold int8 codes. A tile returns counts and a forest of the links that the codes' error
    bounds make certain, and the pairs they leave open; only those fetch full vectors, by joins, and are recomputed.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "embed")
    # Adding zero makes -0.0 equal 0.0.
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.transform(F.col(vector_col), lambda v: v.cast("double") + F.lit(0.0)).alias("vector"),
    )
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    usable = (
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
        & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("vector", lambda v: v != 0), F.lit(False))
    )
    # Lengths of very large or small components would overflow when squared; a power of two changes no cosine.
    top = F.array_max(F.transform("vector", lambda v: F.abs(v)))
    power = F.pow(F.lit(2.0), -F.floor(F.log2(top)))
    rows = rows.withColumn("usable", usable)
    good = rows.filter("usable").withColumn("vector", F.when((top > 1e100) | (top < 1e-100), F.transform("vector", lambda v: v * power)).otherwise(F.col("vector")))
    good = space.write(good.select("vec_id", "vector"), "vectors")
    nodes = good.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"))
    # Different vectors may share an id, so each gets a number of its own, fixed by the writing.
    nodes = space.write(nodes.withColumn("row", F.monotonically_increasing_id()), "nodes")
    members = good.join(nodes, "vector").select("vec_id", "node", "n")

    sample = nodes.orderBy(F.xxhash64("vector"), "node").limit(PIVOTS).select("vector").collect()
    pivots: dict[int, list] = {}
    for (vector,) in sample:
        pivots.setdefault(len(vector), []).append(np.array(vector) / np.linalg.norm(vector))
    pivots = {dims: np.array(side) for dims, side in pivots.items()}
    placed = space.write(nodes.select("node", "row", "n", "vector").mapInArrow(_coded(pivots), _CODED), "placed")
    sizes = placed.groupBy("dims", "pivot").count().withColumn("parts", F.ceil(F.col("count") / TILE_ROWS)).drop("count")
    dealt = placed.join(sizes, ["dims", "pivot"])
    # A cell with many vectors is dealt into parts by hash.
    dealt = dealt.withColumn("block", F.xxhash64("dims", "pivot", F.pmod(F.xxhash64("row"), F.col("parts"))))
    blocks = space.write(dealt.select("block", *placed.columns).groupBy("block").applyInArrow(_block, _BLOCKS), "blocks")
    space.drop("placed")
    info = blocks.select("block", "dims", "pivot", "radius")
    reach = math.acos(min(1.0, threshold)) + 1e-6
    # Angles between pivots, a table of at most PIVOTS^2 rows.
    between = [
        (dims, a, b, math.acos(min(1.0, max(-1.0, float(side[a] @ side[b])))))
        for dims, side in pivots.items() for a in range(len(side)) for b in range(len(side))
    ]
    angles = spark.createDataFrame(between, "dims int, pivot int, pivot_b int, between double") if between else spark.createDataFrame([], "dims int, pivot int, pivot_b int, between double")
    left = info.join(F.broadcast(angles), ["dims", "pivot"], "left")
    right = info.select("dims", F.col("pivot").alias("pivot_b"), F.col("block").alias("b"), F.col("radius").alias("radius_b"))
    near = left.join(right, ["dims", "pivot_b"]).filter(
        (F.col("block") <= F.col("b")) & (F.col("between") - F.col("radius") - F.col("radius_b") <= reach)
    ).select(F.col("block").alias("a"), "b")
    # Vectors of a length that no pivot has meet all blocks of their length.
    lone = info.filter("pivot < 0")
    near = near.unionByName(
        lone.select("dims", F.col("block").alias("a")).join(lone.select("dims", F.col("block").alias("b")), "dims").filter("a <= b").select("a", "b")
    )
    side = lambda name: blocks.select(
        F.col("block").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("ids", "rows", "n", "codes", "scale", "size", "loss")]
    )
    tiles = near.join(side("a"), "a").join(side("b"), "b")
    found = space.write(tiles.repartition("a", "b").mapInArrow(_tiles(threshold), _FOUND), "found")
    space.drop("blocks")
    full = lambda row, name: nodes.select(F.col("row").alias(row), F.col("vector").alias(name))
    doubtful = found.filter(F.col("row_a").isNotNull()).select("node", "other", "row_a", "row_b", "n_a", "n_b")
    doubtful = doubtful.join(full("row_a", "x"), "row_a").join(full("row_b", "y"), "row_b")
    checked = doubtful.select("node", "other", "n_a", "n_b", "x", "y").mapInArrow(_recomputed(threshold), "node long, other long, links long")
    found = found.filter(F.col("row_a").isNull()).select("node", "other", "links").unionByName(space.write(checked, "checked"))
    links = found.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b"))
    parts = connected_components(edges, space)
    solved = members.join(links, "node", "left").join(parts, "node", "left").select(
        "vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    solved = solved.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    alone = rows.filter("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
        F.col("vec_id").isNotNull().alias("kept"),
    )
    return solved.unionByName(alone).withColumnRenamed("vec_id", id_col)
