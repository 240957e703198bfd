"""Bounded windows over long groups.

A group (one output, one source, one user) may hold a large share of all rows, so no window here spans
a whole group. Rows are cut into blocks of the ordering value; windows run inside a block, and what
a block needs from its neighbours comes from a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536
CHUNK = "_chunk"

# How a per-block value is combined over the other blocks, and over which of them.
BEFORE = (Window.unboundedPreceding, -1)
AFTER = (1, Window.unboundedFollowing)
ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def with_chunk(df: DataFrame, order: str | Column = "line_no", size: int = BLOCK) -> DataFrame:
    order = F.col(order) if isinstance(order, str) else order
    return df.withColumn(CHUNK, F.floor(order / F.lit(size)).cast("long"))


def in_chunk(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def carry(
    df: DataFrame,
    keys: list[str],
    parts: dict[str, tuple[Column, Callable[[Column], Column], tuple]],
    long_only: Column | None = None,
) -> DataFrame:
    """Add block-crossing values to every row.

    ``parts`` maps a new column to (aggregate within a block, combiner over blocks, block range).
    ``long_only`` restricts the work to groups that span several blocks; the others get NULL.
    The block table has one row per block, and the join keys equal the row partitioning.
    """
    source = df if long_only is None else df.where(long_only)
    per_block = source.groupBy(*keys, CHUNK).agg(*[p[0].alias(n) for n, p in parts.items()])
    spans = {
        n: p[1](F.col(n)).over(Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(*p[2]))
        for n, p in parts.items()
    }
    table = per_block.select(*keys, CHUNK, *[c.alias(n) for n, c in spans.items()])
    return df.join(table, [*keys, CHUNK], "left")


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list,
    block: str | Column,
    size: int = BLOCK,
    index: str = "idx",
    total: str = "n_items",
    long_only: Column | None = None,
) -> DataFrame:
    """0-based position ``idx`` within the group and the group size, for any group length.

    ``block`` is a number that never decreases along ``order``; ``size`` is its span per block.
    """
    cut = with_chunk(df, block, size)
    w = in_chunk(keys, *order)
    local = cut.withColumns(
        {index: F.row_number().over(w) - 1, total: F.count(F.lit(1)).over(Window.partitionBy(*keys, CHUNK))}
    )
    count = F.count(F.lit(1))
    table = carry_table(cut, keys, count, long_only)
    full = local.join(table, [*keys, CHUNK], "left")
    return full.withColumns(
        {
            index: (F.col(index) + F.coalesce(F.col("_before"), F.lit(0))).cast("long"),
            total: F.coalesce(F.col("_all"), F.col(total)).cast("long"),
        }
    ).drop(CHUNK, "_before", "_all")


def carry_table(cut: DataFrame, keys: list[str], count: Column, long_only: Column | None) -> DataFrame:
    source = cut if long_only is None else cut.where(long_only)
    per_block = source.groupBy(*keys, CHUNK).agg(count.alias("_n"))
    w = Window.partitionBy(*keys).orderBy(CHUNK)
    return per_block.select(
        *keys,
        CHUNK,
        F.sum("_n").over(w.rowsBetween(*BEFORE)).alias("_before"),
        F.sum("_n").over(w.rowsBetween(*ALL)).alias("_all"),
    )
