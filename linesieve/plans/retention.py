"""Retention of the store on disk: whole days go as folders, the day of the cut is rewritten."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.sources.staging import stage

DAY = "run_date"


def _days(spark: SparkSession, path: str) -> dict[str, object]:
    """Day folders of a table, by day."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for file in fs.listStatus(where) if fs.exists(where) else []:
        name = file.getPath().getName()
        if file.isDirectory() and name.startswith(f"{DAY}="):
            found[name.removeprefix(f"{DAY}=")] = (fs, file.getPath())
    return found


def purge_days(spark: SparkSession, path: str, cut: datetime) -> None:
    """Deletes the rows of a table cut by day that were created before ``cut``.

    Earlier days are deleted without being read. Of the day of the cut, the rows that stay are written aside and then
    replace it (dynamic partition overwrite). No later day is touched. Repeating it, also after it was broken off,
    gives the same table. The cut is a time of the session's time zone.
    """
    edge = cut.strftime("%Y-%m-%d")
    for day, (fs, folder) in _days(spark, path).items():
        if day < edge:
            fs.delete(folder, True)
    if edge not in _days(spark, path):
        return
    border = spark.read.parquet(path).where(F.col(DAY) == edge)
    at = F.lit(cut.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    if border.where(F.col("created_at") < at).isEmpty():
        return
    kept = stage(border.where(F.col("created_at") >= at), "border-day")
    if kept.isEmpty():
        fs, folder = _days(spark, path)[edge]
        fs.delete(folder, True)
    else:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(DAY).parquet(path)


def purge_store(
    spark: SparkSession, artifacts_path: str, runs_path: str, as_of: datetime, older_than_days: int | None = None
) -> DataFrame:
    """Deletes artifacts and runs older than ``older_than_days`` days (default 7) from both tables on disk.

    Returns the ids of the artifacts that are gone. An artifact that was put again since keeps its newest rows and its
    id; only its old rows go.
    """
    days = P.DEFAULT_RETENTION_DAYS if older_than_days is None else older_than_days
    cut = as_of - timedelta(days=days)
    gone = spark.createDataFrame([], "id string")
    if _days(spark, artifacts_path):
        at = F.lit(cut.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
        rows = spark.read.parquet(artifacts_path).select("id", "created_at")
        gone = stage(rows.groupBy("id").agg(F.max("created_at").alias("last")).where(F.col("last") < at).select("id"), "purged")
    purge_days(spark, artifacts_path, cut)
    purge_days(spark, runs_path, cut)
    return gone
