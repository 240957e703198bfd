"""The flagship job: classify, reduce, guard, decide, and hand the originals to the store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.predicates import contains_secret
from linesieve.functions.text import (
    content_digest, content_id, estimate_tokens, let, line_count, normalize_line, normalize_newlines, render_view, saved_ratio,
    strip, strip_ansi,
)
from linesieve.operators.detect import SMALL, by_profile, classify, detect_struct, eligibility, under_profiles
from linesieve.operators.lines import ID
from linesieve.operators.reduce_text import may_need_windows, reduce_generic_cell
from linesieve.plans.reduce import (
    ROUTES, custom_route, decisive_lines, declared_critical, effective_confidence, reduce_outputs, view_notes,
)
from linesieve.sources.staging import seal, sealed_staging, stage, unseal, unstaged

RESULT = [
    ID, "kind", "profile", "transformed", "quality_passed", "fallback_reason", "artifact_id", "output",
    "raw_bytes", "compact_bytes", "raw_lines", "compact_lines", "raw_tokens_est", "compact_tokens_est",
    "notes", "detection_reason", "confidence", "omitted_lines", "command", "cwd", "exit_code",
]


# ---- guard ------------------------------------------------------------------------------------

def first_missing(needed: Column, view: Column) -> Column:
    """The first needed text that is no part of the view; whole view lines are ruled out first."""
    texts = F.filter(F.transform(needed, lambda x: normalize_line(x)), lambda x: x != "")
    left = F.array_except(texts, F.split(view, "\n"))
    return F.get(F.filter(left, lambda x: ~F.contains(view, x)), F.lit(0))


def guard_ladder(
    failing: Column, decisive: Column, decisive_gone: Column, declared_gone: Column, protected_gone: Column, omitted: Column,
    retrieval: Column, confidence: Column, emptied: Column,
) -> Column:
    """The first reason against a view: ``decisive`` counts the decisive lines, the three ``gone`` texts are missing ones."""
    shown = lambda label, x: F.concat(F.lit(label), x)
    return (
        F.when(failing & (decisive == 0), "non-zero exit without identifiable decisive lines")
        .when(failing & decisive_gone.isNotNull(), shown("critical line omitted: ", decisive_gone))
        .when(declared_gone.isNotNull(), shown("filter-declared critical line omitted: ", declared_gone))
        .when(protected_gone.isNotNull(), shown("protected line omitted: ", protected_gone))
        .when((omitted > 0) & ~retrieval, "omission without exact-retrieval store")
        .when((confidence < P.MIN_OMISSION_CONFIDENCE) & (omitted > 0), "format confidence too low for selective omission")
        .when(emptied, "candidate became empty")
    )


def guard_reason(
    exit_code: Column, raw_text: Column, view: Column, critical: Column, protected: Column, omitted: Column,
    confidence: Column, retrieval: Column,
) -> Column:
    """Why a view must not replace its original, or NULL."""
    compact = strip_ansi(view)

    def checks(c):
        return guard_ladder(
            c["failing"], F.size(c["decisive"]), c["m1"], c["m2"], c["m3"], omitted, retrieval, confidence,
            (strip(view) == "") & (strip(raw_text) != ""),
        )

    decisive = F.when(exit_code != 0, decisive_lines(raw_text)).otherwise(F.array().cast("array<string>"))
    return let(
        let(
            decisive,
            lambda d: F.struct(
                (exit_code != 0).alias("failing"), d.alias("decisive"),
                F.when(F.size(d) > 0, first_missing(d, compact)).alias("m1"),
                first_missing(critical, compact).alias("m2"), first_missing(protected, compact).alias("m3"),
            ),
        ),
        checks,
    )


def validate(candidates: DataFrame) -> DataFrame:
    """Add ``guard`` (passed, reason) to candidates that carry raw, view and their needed texts."""
    reason = guard_reason(
        F.col("exit_code"), F.col("raw").cast("string"), F.col("view"), F.col("critical"), F.col("protected"),
        F.col("omitted_lines"), F.col("confidence"), F.col("retrieval_available"),
    )
    return candidates.withColumn("_reason", reason).withColumn(
        "guard", F.struct(F.col("_reason").isNull().alias("passed"), F.col("_reason").alias("reason"))
    ).drop("_reason")


# ---- decision ---------------------------------------------------------------------------------

def candidates_of(staged: DataFrame, views: DataFrame, parts: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per reduced output: the original, its view and everything the guard needs."""
    # A reducer that leaves nothing gives no row; its output is still judged, with an empty view.
    joined = staged.join(views, ID, "left").withColumns(
        {"view": F.coalesce("view", F.lit("")), "omitted_lines": F.coalesce("omitted_lines", F.lit(0))}
    )
    return _with_needs(joined, {r for r, _ in parts} if parts is not None else set(ROUTES))


def cell_candidates(staged: DataFrame) -> DataFrame:
    """``candidates_of`` for outputs of the route ``generic`` whose view is made inside their row, so that no line and no
    original moves."""
    view = reduce_generic_cell(normalize_newlines(F.col("raw").cast("string")), F.col("profile"))
    joined = staged.withColumn("_v", view).withColumns({
        "view": F.coalesce("_v.view", F.lit("")), "omitted_lines": F.coalesce("_v.omitted_lines", F.lit(0)), "tags": F.col("_v.tags"),
        "protected": F.lit(None).cast("array<string>"),
    })
    return _with_needs(joined.drop("_v"), {"generic"})


def _with_needs(joined: DataFrame, routes: set[str]) -> DataFrame:
    raw_text = F.col("raw").cast("string")
    none = F.array().cast("array<string>")
    return joined.withColumns(
        {
            "critical": declared_critical(raw_text, F.col("route"), F.col("exit_code"), F.col("tags"), routes),
            "protected": F.coalesce("protected", none),
            "notes": view_notes(F.col("route"), F.col("route_note"), F.col("profile"), F.col("tags"), routes),
            "confidence": effective_confidence(
                F.col("route"), F.col("profile"), F.col("confidence"), F.col("tags")
            ),
            "detected_confidence": F.col("confidence"),
        }
    )


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def fallback(
    omitted: Column, store_allowed: Column, secret: Column, guard: Column, unchanged: Column, new_n: Column, raw_n: Column, least: Column
) -> Column:
    """Why the original is shown, or NULL; the first reason wins."""
    ratio = saved_ratio(raw_n, new_n)
    return (
        F.when(
            (omitted > 0) & ~store_allowed,
            F.when(secret, "probable secret: exact-recovery storage not permitted").otherwise("exact-recovery store unavailable"),
        )
        .when(guard.isNotNull(), F.concat(F.lit("quality guard: "), guard))
        .when(unchanged, "filter found no safe reduction")
        .when(
            (new_n >= raw_n) | (ratio < least),
            F.concat(F.lit("net savings "), percent(ratio), F.lit(" below minimum "), percent(least)),
        )
    )


def decide(candidates: DataFrame, store_available: bool = True, allow_secrets: bool = False) -> DataFrame:
    """The fallback ladder, first reason wins; the header counts against the savings. ``secret`` comes with the rows."""
    raw, view = F.col("raw"), F.col("view")
    omitted = F.col("omitted_lines")
    facts = candidates.withColumn(
        "store_allowed", F.col("store_original") & F.lit(store_available) & (~F.col("secret") | F.lit(allow_secrets))
    ).withColumn("retrieval_available", F.lit(True))
    checked = validate(facts).withColumn("new_id", F.when(F.col("store_allowed"), content_id(raw)))
    rendered = checked.withColumn(
        "rendered", render_view(view, F.col("kind"), F.col("new_id"), F.col("exit_code"), F.col("raw_lines"), omitted)
    )
    sized = rendered.withColumns(
        {"_raw_n": F.octet_length(raw).cast("long"), "_new_n": F.octet_length("rendered").cast("long")}
    )
    reason = fallback(
        omitted, F.col("store_allowed"), F.col("secret"), F.col("guard.reason"), view.cast("binary") == raw, F.col("_new_n"),
        F.col("_raw_n"), F.col("min_savings_ratio"),
    )
    allowed = (omitted <= 0) | F.col("store_allowed")
    return sized.withColumn("fallback_reason", reason).withColumns(
        {
            "transformed": F.col("fallback_reason").isNull(),
            "quality_passed": ~allowed | F.col("guard.passed"),
        }
    )


def as_results(decided: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Result rows, with the columns ``keep``: the rendered view where accepted, else the exact original."""
    done = F.col("transformed")
    raw_text = F.col("raw").cast("string")
    shown = lambda name: F.when(done, F.col(name))
    return decided.withColumns(
        {
            "output": F.when(done, F.col("rendered").cast("binary")).otherwise(F.col("raw")),
            "artifact_id": shown("new_id"),
            "raw_bytes": F.octet_length("raw").cast("long"),
            "raw_tokens_est": estimate_tokens(raw_text),
            "detection_reason": shown("detection_reason"),
            "confidence": shown("detected_confidence"),
            "omitted_lines": shown("omitted_lines"),
        }
    ).withColumns(
        {
            "compact_bytes": F.octet_length("output").cast("long"),
            "compact_lines": F.when(done, line_count("rendered")).otherwise(F.col("raw_lines")),
            "compact_tokens_est": F.when(done, estimate_tokens("rendered")).otherwise(F.col("raw_tokens_est")),
        }
    ).select(*RESULT, *keep)


def passthrough(outputs: DataFrame, kind: Column, reason: Column, keep: list[str] = ()) -> DataFrame:
    """Outputs shown exactly as they are, with equal sizes on both sides."""
    raw_text = F.col("raw").cast("string")
    blank = lambda t: F.lit(None).cast(t)
    return outputs.withColumns(
        {
            "kind": kind, "transformed": F.lit(False), "quality_passed": F.lit(True), "fallback_reason": reason,
            "artifact_id": blank("string"), "output": F.col("raw"),
            "raw_bytes": F.octet_length("raw").cast("long"), "raw_tokens_est": estimate_tokens(raw_text),
            "notes": F.array().cast("array<string>"), "detection_reason": blank("string"),
            "confidence": blank("double"), "omitted_lines": blank("long"),
        }
    ).withColumns(
        {
            "compact_bytes": F.col("raw_bytes"), "compact_lines": F.col("raw_lines"),
            "compact_tokens_est": F.col("raw_tokens_est"),
        }
    ).select(*RESULT, *keep)


def skipped(sized: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Empty, binary, undecodable and small outputs; only the small ones are classified."""
    small = sized.where(F.col("skip_reason").isNotNull())
    below = F.col("skip_reason") == SMALL
    found = detect_struct(F.col("command"), F.col("raw").cast("string"), F.col("kind_hint"))
    known = small.withColumn("kind", F.when(below, found["kind"]))
    hint = F.when(F.col("kind_hint") != "", F.col("kind_hint"))
    plain = F.col("skip_reason")
    kind = (
        F.when(plain == "empty output", F.coalesce(hint, F.lit("empty")))
        .when(plain == SMALL, F.col("kind"))
        .otherwise(F.coalesce(hint, F.lit("binary")))
    )
    return passthrough(known, kind, plain, keep)


def compact_corpus(
    outputs: DataFrame, store_available: bool = True, allow_secrets: bool = False, staged: bool = True,
    profiles: list[str] | None = None, keep: list[str] = (),
) -> DataFrame:
    """All outputs with their view or the reason for showing the original.

    One pass finds everything that holds for an output whatever its profile (kind, size, secret) and writes
    it once, cut by route, profile and secret: the reducers read only their own part, none repeats the detection,
    and routes that do not occur are not planned. Generic views that need no windows are made inside the rows of that
    table. Texts of outputs with a probable secret are written encrypted, here and by their reducers; those of skipped
    outputs are read again from ``outputs``. With ``profiles`` every output is judged under each of them (see
    ``under_profiles``). Results have the columns ``keep`` of the outputs as well.
    """
    sized = eligibility(outputs)
    secret = F.when(F.col("skip_reason").isNull(), contains_secret(F.col("raw").cast("string"))).otherwise(False)
    found = classify(sized.withColumn("secret", F.coalesce(secret, F.lit(False))), profiles)
    judged = F.col("skip_reason").isNull()
    names = {"": F.col("profile")} if profiles is None else {f"_{p}": F.lit(p) for p in profiles}
    found = found.withColumns({f"route{n}": F.when(judged, custom_route(F.col(f"route{n}"))) for n in names})
    small = skipped(sized if profiles is None else under_profiles(sized, profiles), keep)
    options = {"store_available": store_available, "allow_secrets": allow_secrets, "keep": keep}
    if not staged:
        with unstaged():
            found = found.drop("text").where(judged)
            return _reduced(found if profiles is None else by_profile(found, profiles), None, **options).unionByName(small)
    raw = F.col("raw")
    kept = {"raw": F.when(judged & ~F.col("secret"), raw), "sealed": F.when(judged & F.col("secret"), seal(raw))}
    for name, profile in names.items():
        long = judged & may_need_windows(line_count("text"), profile)
        kept[f"cell{name}"] = F.coalesce((F.col(f"route{name}") == "generic") & profile.isNotNull() & ~long, F.lit(False))
    cut = [*[f"{part}{name}" for name in names for part in ("route", "cell")], "secret"]
    found = found.withColumns(kept).drop("text")
    if profiles is None:
        written = stage(found, "classified", [*cut, "profile"])
    else:
        written = by_profile(stage(found, "classified", cut), profiles, ["cell"])
    work = written.where(F.col("route").isNotNull())
    done = []
    parts = _parts(written)
    again = repeated_ids(work)
    plain = [(route, profile, cell) for route, profile, held, cell in parts if route is not None and not held]
    held_back = [(route, profile, cell) for route, profile, held, cell in parts if route is not None and held]
    if plain:
        done += _judged(work.where(~F.col("secret")).drop("sealed"), plain, again, **options)
    if held_back:
        with sealed_staging():
            secrets = work.where("secret").withColumn("raw", unseal(F.col("sealed"))).drop("sealed")
            done += _judged(secrets, held_back, again, **options)
    if not done or any(part[0] is None for part in parts):
        done.append(small)
    return reduce(DataFrame.unionByName, done)


def _parts(work: DataFrame) -> list[tuple[str | None, str, bool, bool]]:
    """The routes, profiles, secret marks and cell marks that occur: at most one row for each combination of them."""
    return [tuple(r) for r in work.select("route", "profile", "secret", "cell").distinct().collect()]


def repeated_ids(rows: DataFrame) -> DataFrame | None:
    """The ids of several rows, or none: what works inside one row would part what a reducer finds by the id."""
    again = rows.groupBy(ID).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col(ID).isNull())
    again = stage(again.select(ID), "repeated-ids")
    return None if again.isEmpty() else again


def with_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` with (``left_semi``) or without (``left_anti``) the ids, of which one may be NULL."""
    named = ids.select(F.col(ID).alias("_again"))
    return rows.join(named, F.col(ID).eqNullSafe(F.col("_again")), how)


def _judged(
    work: DataFrame, parts: list[tuple[str, str, bool]], again: DataFrame | None, **options
) -> list[DataFrame]:
    """Results of outputs that are reduced inside their row, and of those whose lines are."""
    cells, others = work.where("cell"), work.where(~F.col("cell"))
    rest = [(route, profile) for route, profile, cell in parts if not cell or again is not None]
    done = []
    if any(cell for _, _, cell in parts):
        if again is not None:
            others = others.unionByName(with_ids(cells, again, "left_semi"))
            cells = with_ids(cells, again, "left_anti")
        done.append(_decided(cell_candidates(cells), **options))
    if rest:
        done.append(_reduced(others, list(dict.fromkeys(rest)), **options))
    return done


def _reduced(work: DataFrame, parts: list[tuple[str, str]] | None, **options) -> DataFrame:
    return _decided(candidates_of(work, reduce_outputs(work, parts), parts), **options)


def _decided(candidates: DataFrame, store_available: bool, allow_secrets: bool, keep: list[str]) -> DataFrame:
    return as_results(decide(candidates, store_available, allow_secrets), keep)
