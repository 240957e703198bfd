"""Run metrics: totals, savings by kind and profile, corpus summary, newest artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesieve.functions.text import saved_ratio

SIZES = ["raw_bytes", "compact_bytes", "raw_tokens_est", "compact_tokens_est"]


def since(runs: DataFrame, as_of: Column, days: int | None) -> DataFrame:
    """Rows of the last ``days`` days; a date partition column is filtered as well, so whole folders drop out."""
    if days is None:
        return runs
    start = as_of - F.make_interval(days=F.lit(days))
    rows = runs.where(F.col("created_at") >= start)
    return rows.where(F.col("run_date") >= F.to_date(start)) if "run_date" in runs.columns else rows


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(F.col(name)), F.lit(0)).cast("long").alias(name)


def run_totals(runs: DataFrame, as_of: Column | None = None, since_days: int | None = None) -> DataFrame:
    return since(runs, as_of, since_days).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("transformed").alias("transformed"),
        *[_sum(c) for c in SIZES],
        F.count_if(~F.col("quality_passed")).alias("guard_failures"),
    )


def savings_by_kind(runs: DataFrame, as_of: Column | None = None, since_days: int | None = None) -> DataFrame:
    """Runs and bytes per kind, biggest saving first."""
    return (
        since(runs, as_of, since_days)
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("runs"), _sum("raw_bytes"), _sum("compact_bytes"))
        .orderBy(F.desc(F.col("raw_bytes") - F.col("compact_bytes")), "kind")
    )


def with_ratios(df: DataFrame) -> DataFrame:
    ratio = lambda raw, new: F.when(F.col(raw) == 0, 0.0).otherwise((F.col(raw) - F.col(new)) / F.col(raw))
    return df.withColumns(
        {
            "byte_savings_ratio": ratio("raw_bytes", "compact_bytes"),
            "token_savings_ratio_est": ratio("raw_tokens_est", "compact_tokens_est"),
        }
    )


def savings_by_profile(results: DataFrame) -> DataFrame:
    """Cases, accepted views and sizes per profile and kind, with subtotals (``level`` 0, 1, 3)."""
    table = results.rollup("profile", "kind").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("cases"),
        F.count_if("transformed").alias("transformed"), *[_sum(c) for c in SIZES],
    )
    return with_ratios(table)


def corpus_summary(results: DataFrame) -> DataFrame:
    """Overall counts and percent of tokens saved."""
    total = results.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("transformed").alias("transformed"),
        F.count_if("quality_passed").alias("quality_passed"),
        F.count_if(F.col("artifact_id").isNotNull()).alias("artifacts"),
        _sum("raw_tokens_est"), _sum("compact_tokens_est"),
    )
    saved = F.col("raw_tokens_est") - F.col("compact_tokens_est")
    percent = F.when(F.col("raw_tokens_est") == 0, 0.0).otherwise(F.round(saved * 100 / F.col("raw_tokens_est"), 3))
    return total.withColumns({"saved_tokens": saved, "savings_pct": percent})


def recent_artifacts(artifacts: DataFrame, limit: int = 20) -> DataFrame:
    """Newest artifacts without their payload."""
    columns = [c for c in artifacts.columns if c != "payload"]
    return artifacts.select(*columns).orderBy(F.desc("created_at"), "id").limit(limit)
