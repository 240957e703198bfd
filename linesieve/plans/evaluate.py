"""Evaluation: the same corpus under every profile, with fact, recovery and secrecy checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.functions.knobs import PROFILES
from linesieve.functions.text import content_digest
from linesieve.operators.containment import anchor_gate
from linesieve.operators.detect import under_profiles  # noqa: F401  (part of this module's interface)
from linesieve.operators.metrics import savings_by_profile
from linesieve.plans.compact import compact_corpus, first_missing
from linesieve.plans.reduce import decisive_lines


def required_facts(results: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchor groups seen in each result's view."""
    texts = results.select(F.col("output_id").alias("case"), F.col("output").cast("string").alias("text"))
    return anchor_gate(texts, anchors)


def critical_retention(results: DataFrame, outputs: DataFrame) -> DataFrame:
    """For failing outputs: the first decisive line that the view lacks, NULL when none."""
    failing = outputs.where(F.col("exit_code") != 0).select("output_id", "raw")
    view = F.col("output").cast("string")
    return failing.join(results.select("output_id", "output"), "output_id").select(
        "output_id", first_missing(decisive_lines(F.col("raw").cast("string")), view).alias("missing_line")
    ).withColumn("retained", F.col("missing_line").isNull())


def expected_passthrough(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases that had to stay as they are but were changed; must be empty."""
    return results.join(cases.where("expect_passthrough").select("output_id"), "output_id").where("transformed")


def strict_gate(results: DataFrame, outputs: DataFrame, cases: DataFrame, anchors: DataFrame) -> DataFrame:
    """All visible conditions of a case at once; ``cases`` has exact_visible and sensitive flags."""
    facts = required_facts(results, anchors).withColumnRenamed("case", "output_id").select("output_id", "anchors_ok")
    # Texts are compared by their digests, so none of them is sorted for a join.
    views = results.select(
        "output_id", "kind", "transformed", "fallback_reason", "artifact_id", "quality_passed", content_digest("output").alias("_view")
    )
    originals = outputs.select("output_id", content_digest("raw").alias("_raw"))
    joined = views.join(originals, "output_id").join(cases, "output_id").join(facts, "output_id", "left")
    same = F.col("_view") == F.col("_raw")
    anchors_ok = F.coalesce("anchors_ok", F.lit(True))
    exact = ~F.col("exact_visible") | same
    sensitive = ~F.col("sensitive") | (same & F.col("artifact_id").isNull())
    return joined.select(
        "output_id", "kind", "transformed", "fallback_reason",
        anchors_ok.alias("anchors_ok"), exact.alias("exact_ok"), sensitive.alias("sensitive_ok"),
        (anchors_ok & exact & sensitive & F.col("quality_passed")).alias("strict_pass"),
        (same | F.col("artifact_id").isNotNull()).alias("exact_available"),
    )


def profile_comparison(outputs: DataFrame, profiles: list[str] = PROFILES, **options) -> DataFrame:
    """Savings of the corpus under each profile, with subtotals by kind."""
    return savings_by_profile(compact_corpus(outputs, profiles=profiles, **options))
