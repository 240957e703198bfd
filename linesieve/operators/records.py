"""Record sampling and numeric summaries of grouped tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.operators.chunks import ALL, BLOCK, CHUNK, carry, numbered, with_chunk


def sample_records(
    df: DataFrame, keys: list[str], order: str | list[str], critical: Column, cap: int, size: int = BLOCK,
    block: str | Column | None = None, head: int = P.JSON_HEAD_ITEMS, tail: int = P.JSON_TAIL_ITEMS,
) -> DataFrame:
    """Groups up to ``cap`` stay whole; longer ones keep every critical row, and first and last rows
    as far as the cap leaves room.

    Adds ``_index``, ``total_items`` and ``sampled_items``. Critical rows are counted block by block and
    never ranked, so a group may hold any number of them; ranked are at most ``head + tail`` rows.
    """
    order = [order] if isinstance(order, str) else list(order)
    placed = numbered(df, keys, order, block if block is not None else order[0], size, "_index", "total_items")
    placed = placed.withColumn("_critical", F.coalesce(critical, F.lit(False)))
    edge = ~F.col("_critical") & ((F.col("_index") < head) | (F.col("_index") >= F.col("total_items") - tail))
    linked = carry(
        with_chunk(placed.withColumn("_edge", edge), "_index", size), keys,
        {"_hits": (F.count_if("_critical"), F.sum, ALL), "_edges": (F.count_if("_edge"), F.sum, ALL)},
    )
    whole = F.col("total_items") <= cap
    room = F.least(F.col("_edges"), F.greatest(cap - F.col("_hits"), F.lit(0)))
    # The place of an edge row among the edge rows: only groups above the cap and their few edges are ranked.
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_index"))
    edges = linked.where(~whole & F.col("_edge")).withColumn("_rank", rank).where(F.col("_rank") <= room).drop("_rank")
    kept = linked.where(whole | F.col("_critical")).unionByName(edges)
    sampled = F.when(whole, F.col("total_items")).otherwise(F.col("_hits") + room)
    return kept.withColumn("sampled_items", sampled).drop("_critical", "_edge", "_hits", "_edges", CHUNK)


def numeric_summary(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """min, max and mean of each numeric field that is present often enough in its group.

    Long form: one row per group and field. Group sizes come from the same aggregation, so the
    fields are spread after the rows were already reduced to one per group.
    """
    parts = [F.count(F.lit(1)).alias("n_items")]
    for f in fields:
        value = F.col(f).cast("double")
        parts.append(
            F.struct(
                F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
                F.avg(value).alias("mean"),
            ).alias(f"_{f}")
        )
    wide = df.groupBy(*keys).agg(*parts)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("s")) for f in fields])
    long = wide.select(*keys, "n_items", F.explode(pairs).alias("_p")).select(*keys, "n_items", "_p.field", "_p.s.*")
    return long.where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("n_items") / 3))).drop("n_items")


def numeric_summary_of_maps(df: DataFrame, keys: list[str], record: Column) -> DataFrame:
    """The same summary for records given as ``map<string, variant>``: fields are data, not columns."""
    if not keys:
        return numeric_summary_of_maps(df.withColumn("_all", F.lit(1)), ["_all"], record).drop("_all")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"))
    entries = df.select(*keys, F.explode(record).alias("field", "_v")).where(F.to_json("_v").rlike(r"^-?\d"))
    value = F.try_variant_get("_v", "$", "double")
    stats = entries.select(*keys, "field", value.alias("x")).groupBy(*keys, "field").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean")
    )
    return stats.join(sizes, keys).where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("n_items") / 3))).drop("n_items")
