"""Format detection and routing: one ordered CASE per output, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.knobs import MAX, PROFILES, STRICT
from linesieve.functions.predicates import match_head, match_parts
from linesieve.functions.text import (
    is_binary, is_valid_json, json_value, let, line_count, normalize_newlines, split_lines, strip, strip_ansi,
)

SMALL = "below compression threshold"


def command_words(argv: Column) -> Column:
    """Argument words; a one-string command is split at white space."""
    whole = strip(F.element_at(argv, 1))
    return F.when(
        F.size(argv) == 1,
        F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, r"(?U)\s+")),
    ).otherwise(argv)


def detection(kind: str, confidence: float, reason: str) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason")
    )


def detect_struct(command: Column, text: Column, hint: Column) -> Column:
    """Struct(kind, confidence, reason): the first rule that holds; text rules look at the whole text."""
    lower = F.transform(command_words(command), lambda w: F.lower(w))
    return let(
        let(
            F.struct(lower.alias("words"), strip_ansi(text).alias("clean")),
            lambda s: F.struct(s["words"], s["clean"], F.lower(s["clean"]).alias("low")),
        ),
        lambda s: detect_by(s["words"], hint, _text_signs(s["clean"], s["low"], text)),
    )


def _text_signs(clean: Column, low: Column, text: Column) -> dict[str, Column]:
    """What the rules ask of a text that is one cell."""
    severity_dense = let(
        split_lines(clean),
        lambda ls: F.size(F.filter(ls, lambda x: x.rlike(P.SEVERITY_WORDS)))
        >= F.greatest(F.lit(8), F.floor(F.size(ls) / 8)),
    )
    return {
        "diff_head": F.startswith(clean, F.lit("diff --git ")),
        "hunk": F.contains(clean, F.lit("@@ ")) & clean.rlike(P.GIT_HUNK),
        "test_words": F.contains(low, F.lit("test")) | F.contains(low, F.lit("passed")) | F.contains(low, F.lit("failed")),
        "markers": sum((F.contains(low, F.lit(m)).cast("int") for m in P.TEST_MARKERS), F.lit(0)),
        "json": is_valid_json(text),
        "dense": clean.rlike(P.SEVERITY_WORDS) & severity_dense,
    }


def detect_by(words: Column, hint: Column, signs: dict[str, Column]) -> Column:
    """Struct(kind, confidence, reason) from the command's words in lower case and the signs of the text."""
    base = F.coalesce(F.regexp_extract(F.get(words, F.lit(0)), r"(?s)([^/\\]*)\z", 1), F.lit(""))
    args = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    has = lambda w: F.array_contains(words, w)
    arg_in = lambda *ws: F.exists(args, lambda w: w.isin(*ws))
    log_file = F.exists(args, lambda w: F.endswith(w, F.lit(".log")) | F.endswith(w, F.lit(".out")))

    gitlike = (base == "git") | (base.isin("hub", "gh") & has("diff"))
    is_diff_text = signs["diff_head"]

    test_word = (
        F.when(base == "cargo", arg_in("test", "nextest"))
        .when(base.isin("go", "dotnet"), arg_in("test"))
        .when(base.isin("gradle", "gradlew", "mvn"), F.exists(args, lambda w: F.contains(w, F.lit("test"))))
        .otherwise(True)
    )
    script = F.exists(args, lambda w: w.isin(P.PACKAGE_TEST_WORDS) | F.startswith(w, F.lit("test:")))
    return (
        F.when(
            hint.isNotNull() & (hint != ""),
            F.struct(hint.alias("kind"), F.lit(1.0).alias("confidence"), F.lit("explicit hint").alias("reason")),
        )
        .when(gitlike & has("status"), detection("git_status", 0.99, "git status command"))
        .when(gitlike & (has("diff") | is_diff_text), detection("git_diff", 0.99, "git diff command"))
        .when(gitlike & has("log"), detection("git_log", 0.96, "git log command"))
        .when(base.isin(P.TEST_COMMANDS) & test_word, detection("test", 0.98, "test command"))
        .when(base.isin(P.PACKAGE_COMMANDS) & script & signs["test_words"], detection("test", 0.94, "package test output"))
        .when(base.isin(P.SEARCH_COMMANDS), detection("search", 0.96, "search command"))
        .when(base.isin(P.TREE_COMMANDS) & log_file, detection("log", 0.92, "log file command"))
        .when(base.isin(P.TREE_COMMANDS), detection("tree", 0.9, "filesystem listing command"))
        .when(
            base.isin(P.LOG_COMMANDS)
            & (
                log_file
                | F.contains(F.concat(F.lit(" "), F.array_join(words, " ")), F.lit(" logs"))
                | base.isin("journalctl", "dmesg")
            ),
            detection("log", 0.92, "log command"),
        )
        .when(signs["json"], detection("json", 0.99, "valid JSON"))
        .when(is_diff_text | signs["hunk"], detection("git_diff", 0.96, "diff markers"))
        .when(signs["markers"] >= 2, detection("test", 0.86, "test markers"))
        .when(signs["dense"], detection("log", 0.82, "log severity density"))
        .otherwise(detection("generic", 0.55, "no strong format match"))
    )


def detect_kind(outputs: DataFrame) -> DataFrame:
    """Add ``detection`` (kind, confidence, reason)."""
    return outputs.withColumn(
        "detection", detect_struct(F.col("command"), F.col("raw").cast("string"), F.col("kind_hint"))
    )


def eligibility(outputs: DataFrame) -> DataFrame:
    """Add ``raw_lines`` and ``skip_reason``: why an output is shown as it is, or NULL."""
    raw = F.col("raw")
    text = raw.cast("string")
    sized = outputs.withColumn("raw_lines", line_count(text))
    return sized.withColumn(
        "skip_reason",
        F.when(F.octet_length(raw) == 0, "empty output")
        .when(is_binary(raw), "binary output protected")
        .when(~F.is_valid_utf8(text), "undecodable output protected")
        .when(
            (F.octet_length(raw) < F.col("min_bytes")) & (F.col("raw_lines") < F.col("min_lines")),
            SMALL,
        ),
    )


def eligible(outputs: DataFrame) -> DataFrame:
    return eligibility(outputs).where(F.col("skip_reason").isNull())


# ---- route ------------------------------------------------------------------------------------

def _many_paths(lines: Column) -> Column:
    path = lambda x: let(match_head(x), lambda h: F.when(h != "", match_parts(x, h)["path"]))
    paths = F.filter(F.transform(lines, path), lambda p: p.isNotNull())
    return let(paths, lambda p: F.coalesce(F.array_min(p) != F.array_max(p), F.lit(False)))


def is_tree_noise(line: Column) -> Column:
    bare = strip(line)
    return (bare == "") | bare.isin(".", "./") | bare.rlike(P.TREE_TOTALS)


def tree_depth(line: Column) -> Column:
    return F.floor(F.length(F.regexp_extract(line, P.TREE_NODE, 1)) / 4).cast("long")


def _hierarchy_holds(lines: Column) -> Column:
    """Few unreadable rows, and no node more than one level below the row before it."""
    def check(rows):
        nodes = F.transform(F.filter(rows, lambda x: x.rlike(P.TREE_NODE)), tree_depth)
        return let(
            nodes,
            lambda d: (F.size(d) > 0)
            & (F.size(rows) - F.size(d) <= F.greatest(F.lit(3), F.floor(F.size(d) / 10)))
            & F.forall(
                F.transform(d, lambda x, i: x - F.coalesce(F.get(d, i - 1), F.lit(-1))), lambda step: step <= 1
            ),
        )

    return let(F.filter(lines, lambda x: ~is_tree_noise(x)), check)


def listing_by(n: Column, long_rows: Column, marked: Column, holds: Column) -> Column:
    """``tree_flat``, ``tree_nested``, or ``generic`` with the note why."""
    return (
        F.when(n < P.TREE_MIN_LINES, "generic")
        .when(long_rows >= F.greatest(F.lit(4), F.floor(n / 3)), "generic:long listing protected")
        .when(marked & ~holds, "generic:unrecognized hierarchy protected")
        .when(marked, "tree_nested")
        .otherwise("tree_flat")
    )


def _listing_route(text: Column, lines: Column) -> Column:
    marked = F.lit(False)
    for mark in P.TREE_MARKS:
        marked = marked | F.contains(text, F.lit(mark))
    long_row = lambda x: strip(x).rlike(P.LONG_LISTING)
    return let(
        F.filter(lines, lambda x: strip(x) != ""),
        lambda rows: listing_by(F.size(rows), F.size(F.filter(rows, long_row)), marked, _hierarchy_holds(rows)),
    )


def under_profiles(outputs: DataFrame, profiles: list[str] = PROFILES) -> DataFrame:
    """Every output once per profile; ``source_id`` keeps the original id."""
    each = F.explode(F.array(*[F.lit(p) for p in profiles])) if len(profiles) > 1 else F.lit(profiles[0])
    return (
        outputs.drop("profile").withColumn("profile", each)
        .withColumn("source_id", F.col("output_id").cast("string"))
        .withColumn("output_id", F.concat_ws("#", "profile", "source_id"))
    )


def route_by(kind: Column, profile: Column, parses: Column, many_paths: Column, listing: Column) -> Column:
    """The reducer for a kind under a profile; ``listing`` is the route of a file listing, with a note after a colon."""
    strict = profile == STRICT
    return (
        F.when(kind == "git_diff", "git_diff")
        .when(kind == "git_log", F.when(profile == MAX, "git_log").otherwise("duplicates"))
        .when(kind == "git_status", F.when(strict, "duplicates").otherwise("git_status"))
        .when(kind == "json", F.when(~parses, "generic").when(strict, "json_strict").otherwise("json"))
        .when(kind == "test", F.when(strict, "test_strict").otherwise("test"))
        .when(strict, "generic")
        .when(kind == "log", "log")
        .when(kind == "search", F.when(many_paths, "search").otherwise("generic"))
        .when(kind == "tree", listing)
        .otherwise("generic")
    )


def classify(outputs: DataFrame, profiles: list[str] | None = None) -> DataFrame:
    """Add the detection, the clean text ``text``, the reducer ``route`` and an optional ``route_note``.

    Rows with a ``skip_reason`` get no route, and a kind only when they are merely small. With ``profiles`` each output
    stays one row, with a route and a note for each profile, named after it (see ``by_profile``).
    """
    text = F.col("raw").cast("string")
    detected = detect_struct(F.col("command"), text, F.col("kind_hint"))
    if "skip_reason" in outputs.columns:
        detected = F.when(F.col("skip_reason").isNull() | (F.col("skip_reason") == SMALL), detected)
    found = outputs.withColumn("_d", detected)
    known = found.withColumns(
        {
            "kind": F.col("_d.kind"), "confidence": F.col("_d.confidence"), "detection_reason": F.col("_d.reason"),
            "text": normalize_newlines(text),
        }
    ).drop("_d")
    lines = split_lines("text")

    def route(profile):
        found = route_by(
            F.col("kind"), profile, json_value(strip_ansi(text)).isNotNull(), _many_paths(lines), _listing_route(F.col("text"), lines)
        )
        return F.when(F.col("skip_reason").isNull(), found) if "skip_reason" in outputs.columns else found

    wanted = {"": F.col("profile")} if profiles is None else {f"_{p}": F.lit(p) for p in profiles}
    routed = known.withColumns({f"_r{name}": F.split(route(profile), ":") for name, profile in wanted.items()})
    split = {f"{part}{name}": F.get(f"_r{name}", F.lit(k)) for name in wanted for k, part in enumerate(["route", "route_note"])}
    return routed.withColumns(split).drop(*[f"_r{name}" for name in wanted])


def by_profile(routed: DataFrame, profiles: list[str], marks: list[str] = ()) -> DataFrame:
    """``under_profiles`` of outputs that were classified with ``profiles``: each row has the route and the note of its profile,
    and of ``marks`` those that are named after it.

    The profile is a constant of each part, so that a filter reaches the table that ``routed`` is read from.
    """
    names = ["route", "route_note", *marks]
    common = [c for c in routed.columns if c not in {f"{n}_{p}" for n in names for p in profiles}]
    part = lambda p: under_profiles(routed.select(*common, *[F.col(f"{n}_{p}").alias(n) for n in names]), [p])
    return reduce(DataFrame.unionByName, [part(p) for p in profiles])
