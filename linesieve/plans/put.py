"""Compaction with the store: decide, give ids, write originals and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.predicates import contains_secret
from linesieve.operators.lines import ID
from linesieve.operators.store import as_artifacts, assign_ids, latest_puts
from linesieve.plans.compact import RESULT, compact_corpus, repeated_ids, with_ids
from linesieve.sources.staging import stage
from linesieve.sources.store_tables import append_runs, as_runs, write_artifacts


def originals_of(results: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """Accepted results with an id, next to their original bytes, which they carry or ``outputs`` have."""
    kept = results.where(F.col("artifact_id").isNotNull()).drop("output")
    return kept if outputs is None else kept.join(outputs.select("output_id", "raw"), "output_id")


def _carrying(results: DataFrame) -> DataFrame:
    """Results with ``raw`` as a table: bytes that are shown are written once, rows get a number ``_row`` and their digest."""
    same = F.col("output").eqNullSafe(F.col("raw"))
    added = {"_same": same, "_original": F.when(~same, F.col("raw")), "_sha": F.sha2("raw", 256), "_row": F.monotonically_increasing_id()}
    written = stage(results.withColumns(added).drop("raw"), "results")
    return written.withColumn("raw", F.when(F.col("_same"), F.col("output")).otherwise(F.col("_original"))).drop("_same", "_original")


def _results_with_originals(outputs: DataFrame, allow_secrets: bool) -> DataFrame:
    """Results next to their originals and savings threshold. Those of an id that several outputs have meet the originals
    of all of them; those without an id meet none."""
    originals = ["raw", "min_savings_ratio"]
    full = _carrying(compact_corpus(outputs, True, allow_secrets, keep=originals))
    again = repeated_ids(full)
    if again is None:
        return full
    met = with_ids(full, again, "left_semi").select(*RESULT).join(outputs.select(ID, *originals), ID)
    return _carrying(with_ids(full, again, "left_anti").select(*RESULT, *originals).unionByName(met))


def with_final_ids(results: DataFrame, ids: DataFrame, min_savings: str = "min_savings_ratio") -> DataFrame:
    """Replace provisional ids by assigned ones; a longer id that eats the saving restores the original.

    ``results`` carries ``raw`` and the savings threshold, and maybe its digest ``_sha``; ``ids`` maps digests to ids.
    """
    known = results if "_sha" in results.columns else results.withColumn("_sha", F.sha2("raw", 256))
    joined = known.join(
        ids.select(F.col("sha256").alias("_sha"), F.col("id").alias("_id")), "_sha", "left"
    )
    changed = F.col("artifact_id").isNotNull() & (F.col("_id") != F.col("artifact_id"))
    longer = F.when(changed, F.length("_id") - F.length("artifact_id")).otherwise(0)
    new_bytes = F.col("compact_bytes") + longer
    ratio = (F.col("raw_bytes") - new_bytes) / F.col("raw_bytes")
    lost = changed & ((new_bytes >= F.col("raw_bytes")) | (ratio < F.col(min_savings)))
    text = F.col("output").cast("string")
    renamed = F.concat(
        F.replace(F.substring_index(text, "\n", 1), F.col("artifact_id"), F.col("_id")),
        F.expr("substring(cast(output as string), length(substring_index(cast(output as string), '\n', 1)) + 1)"),
    ).cast("binary")
    pick = lambda name, when_lost, when_changed: F.when(lost, when_lost).when(changed, when_changed).otherwise(F.col(name))
    return joined.withColumn("_lost", lost).select(
        *[c for c in results.columns if c not in
          ("output", "artifact_id", "compact_bytes", "transformed", "fallback_reason", "compact_lines", "compact_tokens_est")],
        pick("output", F.col("raw"), renamed).alias("output"),
        pick("artifact_id", F.lit(None), F.col("_id")).alias("artifact_id"),
        pick("compact_bytes", F.col("raw_bytes"), new_bytes).alias("compact_bytes"),
        F.when(lost, F.col("raw_lines")).otherwise(F.col("compact_lines")).alias("compact_lines"),
        F.when(lost, F.col("raw_tokens_est")).otherwise(F.col("compact_tokens_est")).alias("compact_tokens_est"),
        F.when(lost, False).otherwise(F.col("transformed")).alias("transformed"),
        F.when(lost, "the longer id takes up what the view saves").otherwise(F.col("fallback_reason"))
        .alias("fallback_reason"),
    )


def compact_and_store(
    outputs: DataFrame, artifacts_path: str, runs_path: str, created_at: Column, existing: DataFrame | None = None,
    allow_secrets: bool = False,
) -> DataFrame:
    """Run the corpus job, then append originals and one metrics row per output. Returns the results.

    Originals are written only for accepted views, so no rejected candidate leaves one behind. Outputs with a
    probable secret get no id unless secrets are allowed; they are worked on apart, and nothing of them is staged. A
    put of known bytes appends a newer row for its id.
    """
    held_back = None
    if not allow_secrets:
        secret = F.coalesce(contains_secret(F.col("raw").cast("string")), F.lit(False))
        held_back, outputs = outputs.where(secret), outputs.where(~secret)
    full = _results_with_originals(outputs, allow_secrets)
    # One row for each content gets its id; ids are worked out without the payloads.
    puts = originals_of(full).select(F.col("_sha").alias("sha256"), created_at.alias("created_at"), "_row")
    named = stage(assign_ids(latest_puts(puts, ["created_at"]), existing), "named")
    # Results have the shortest ids already, so only what deviates from them is joined to the texts.
    longer = stage(named.where(F.col("id") != F.substring("sha256", 1, P.ID_LENGTHS[0])).select("sha256", "id"), "longer-ids")
    final = with_final_ids(full, longer)
    held = final.where("artifact_id is not null").select(F.col("_sha").alias("sha256")).distinct()
    put = named.join(held, "sha256", "left_semi").select("_row")
    left = stage(originals_of(full).select("_row").join(put, "_row", "left_anti"), "not-put")
    rows = as_artifacts(originals_of(full).join(left, "_row", "left_anti"), created_at).join(longer, "sha256", "left")
    results = final.select(*RESULT)
    if held_back is not None:
        results = results.unionByName(compact_corpus(held_back, True, False).select(*results.columns))
    write_artifacts(rows.withColumn("id", F.coalesce("id", F.substring("sha256", 1, P.ID_LENGTHS[0]))), artifacts_path)
    append_runs(as_runs(results, created_at), runs_path)
    return results
