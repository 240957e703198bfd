"""Runs with partial aggregates kept beside them: totals are merged from one small row per batch, day, kind and profile."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.operators.metrics import SIZES, with_ratios

KEYS = ["run_date", "kind", "profile"]
COUNTS = ["runs", "transformed", "guard_failures"]
PARTIAL = "batch string, run_date date, kind string, profile string, " + ", ".join(f"{c} long" for c in [*COUNTS, *SIZES])


def partials_of(runs: DataFrame) -> DataFrame:
    """One row per day, kind and profile: counts and sums that add up."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return runs.groupBy(F.to_date("created_at").alias("run_date"), "kind", "profile").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("transformed").alias("transformed"),
        F.count_if(~F.col("quality_passed")).alias("guard_failures"), *[total(c) for c in SIZES],
    )


class RunTable:
    """Runs on disk in batches, cut by day, and their partial aggregates.

    A batch counts once its partials are written, which is the last thing that an append does; a broken append leaves
    rows that no total and no read sees. Appending a batch again under its id replaces it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, runs: DataFrame, batch: str | None = None) -> None:
        batch = batch or uuid.uuid4().hex
        dated = runs.withColumn("run_date", F.to_date("created_at"))
        dated.write.mode("overwrite").partitionBy("run_date").parquet(f"{self.path}/runs/batch={batch}")
        # From the rows as written, so that both agree whatever the source does.
        rows = self.spark.read.schema(dated.schema).parquet(f"{self.path}/runs/batch={batch}")
        partials_of(rows).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/partials/batch={batch}")

    def partials(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/partials")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], PARTIAL)
        return self.spark.read.schema(PARTIAL).parquet(f"{self.path}/partials")

    def rows(self) -> DataFrame:
        """All rows of batches that count."""
        return self.spark.read.parquet(f"{self.path}/runs").join(self.partials().select("batch").distinct(), "batch", "left_semi").drop("batch")

    def since(self, as_of: datetime | None = None, days: int | None = None) -> DataFrame:
        """Partials of the runs of the last ``days`` days before ``as_of``, or of all.

        Whole days come from the partials; only the day in which the time begins is read from the runs, and of them
        only that day's folders.
        """
        partials = self.partials()
        if as_of is None or days is None:
            return partials.drop("batch")
        start = as_of - timedelta(days=days)
        first = F.lit(start.strftime("%Y-%m-%d")).cast("date")
        at = F.lit(start.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
        later = partials.where(F.col("run_date") > first).drop("batch")
        if partials.where(F.col("run_date") == first).isEmpty():
            return later
        edge = self.rows().where((F.col("run_date") == first) & (F.col("created_at") >= at))
        return later.unionByName(partials_of(edge.drop("run_date")))

    # ---- the metrics, from partials ------------------------------------------------------------

    def run_totals(self, as_of: datetime | None = None, days: int | None = None) -> DataFrame:
        return _sums(self.since(as_of, days).groupBy(), COUNTS + SIZES)

    def savings_by_kind(self, as_of: datetime | None = None, days: int | None = None) -> DataFrame:
        """Runs and bytes per kind, biggest saving first."""
        table = _sums(self.since(as_of, days).groupBy("kind"), ["runs", "raw_bytes", "compact_bytes"])
        return table.orderBy(F.desc(F.col("raw_bytes") - F.col("compact_bytes")), "kind")

    def savings_by_profile(self) -> DataFrame:
        """Runs, accepted views and sizes per profile and kind, with subtotals (``level`` 0, 1, 3)."""
        grouped = self.since().rollup("profile", "kind")
        table = _sums(grouped, ["runs", "transformed", *SIZES], F.grouping_id().alias("level"))
        return with_ratios(table.withColumnRenamed("runs", "cases"))


def _sums(grouped, names: list[str], *more: Column) -> DataFrame:
    return grouped.agg(*more, *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
