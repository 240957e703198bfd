"""Streaming variants: metrics by day, store upserts, and compaction of arriving outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linesieve.operators.store import ARTIFACT, assign_ids, latest, latest_puts
from linesieve.plans.compact import compact_corpus


def stream_run_totals(runs: DataFrame, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """Run totals by day and kind; a day is final once the watermark has passed it."""
    return (
        runs.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", width), "kind")
        .agg(
            F.count(F.lit(1)).alias("runs"), F.count_if("transformed").alias("transformed"),
            F.sum("raw_bytes").alias("raw_bytes"), F.sum("compact_bytes").alias("compact_bytes"),
            F.count_if(~F.col("quality_passed")).alias("guard_failures"),
        )
        .select(F.col("window.start").alias("day"), "kind", "runs", "transformed", "raw_bytes", "compact_bytes", "guard_failures")
    )


def _put(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write one batch of puts to its own folder; a repeated batch replaces its earlier attempt."""
    latest_puts(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch_id={batch_id}")


def stream_upsert_artifacts(puts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append each batch's newest row per content; ``current_artifacts`` merges the batches.

    Appending keeps a batch's cost proportional to the batch, not to the store.
    """
    return (
        puts.writeStream.foreachBatch(lambda df, n: _put(df, n, path))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def current_artifacts(spark, path: str) -> DataFrame:
    """The store after all batches: newest row per content, with ids."""
    rows = spark.read.option("basePath", path).parquet(path).drop("batch_id")
    first = rows.groupBy("sha256").agg(F.min("created_at").alias("created_at"))
    ids = assign_ids(first).select("sha256", "id")
    return latest(rows, "sha256", ["created_at"]).join(ids, "sha256").select(*ARTIFACT)


FACTS = ["created_at", "command", "cwd", "exit_code", "kind"]


def stream_store_state(
    puts: DataFrame, path: str, checkpoint: str, retention: str = "7 days", trigger: dict | None = None
) -> list[StreamingQuery]:
    """Puts into a store whose keys are held by the state store: what a batch costs follows the batch alone.

    Two queries over the same puts. One lets each content through once (a content not put within ``retention`` may come
    again, which does no harm); one keeps the first and the newest put of each digest, without bytes, and writes those
    that a batch changed. Late and repeated puts change what they should and nothing else. ``stored_state`` reads both.
    """
    trigger = trigger or {"availableNow": True}
    contents = puts.withWatermark("created_at", retention).dropDuplicatesWithinWatermark(["sha256"])
    facts = puts.groupBy("sha256").agg(
        F.min("created_at").alias("first_put"), F.max_by(F.struct(*FACTS), F.struct("created_at", "cwd")).alias("newest")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/facts/batch_id={batch_id}")

    return [
        contents.select("sha256", "encoding", "payload", "raw_bytes", "raw_lines").writeStream.format("parquet")
        .option("checkpointLocation", f"{checkpoint}/contents").trigger(**trigger).start(f"{path}/contents"),
        facts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{checkpoint}/facts").trigger(**trigger).start(),
    ]


def stored_state(spark, path: str) -> DataFrame:
    """The store after all batches: of each content the facts that were written last, its bytes and its id."""
    facts = spark.read.option("basePath", f"{path}/facts").parquet(f"{path}/facts")
    last = facts.groupBy("sha256").agg(F.max_by(F.struct("first_put", "newest"), "batch_id").alias("f"))
    ids = assign_ids(last.select("sha256", F.col("f.first_put").alias("created_at"))).select("sha256", "id")
    # The same bytes may have come more than once.
    contents = latest(spark.read.parquet(f"{path}/contents"), "sha256", ["raw_bytes"])
    return last.select("sha256", "f.newest.*").join(contents, "sha256").join(ids, "sha256").select(*ARTIFACT)


def stream_compact(
    outputs: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Compact arriving outputs batch by batch; an output is complete in one row, so no state is kept."""
    def run(batch: DataFrame, batch_id: int) -> None:
        compact_corpus(batch, **options).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        outputs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
