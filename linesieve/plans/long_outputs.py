"""The whole job for outputs beyond one cell: lines in, decisions and view parts out, nothing gathered per output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from linesieve.functions import patterns as P
from linesieve.functions.predicates import contains_secret, is_critical_line, is_error_match, is_test_warning, match_head, match_parts, severity_class
from linesieve.functions.text import let, normalize_line, strip, token_parts, tokens_from_parts, view_header
from linesieve.operators.chunks import numbered
from linesieve.operators.containment import missing_lines
from linesieve.operators.detect import SMALL
from linesieve.operators.detect_lines import classify_lines, line_signs
from linesieve.operators.lines import ID, LINE, N, NO, extract_critical_lines
from linesieve.plans.compact import fallback, guard_ladder
from linesieve.plans.reduce import custom_route, effective_confidence, protected_lines, reduce_lines, view_notes
from linesieve.sources.staging import sealed_staging, stage

PART_LINES = 10_000  # lines of a view or an original in one part
FAN = 1_000  # digests that make one digest of the next level
TAGS = ["duplicate", "progress", "window"]
DECISIVE, DECLARED, PROTECTED = 1, 2, 3


def text_parts(rows: DataFrame, order: str = NO, lines: int = PART_LINES) -> DataFrame:
    """(output_id, part, text): runs of at most ``lines`` numbered lines, each line with its line feed."""
    piece = F.struct(F.col(order).alias("at"), F.col(LINE))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x[LINE]), "\n"), F.lit("\n"))
    return rows.groupBy(ID, F.floor(F.col(order) / lines).alias("part")).agg(text.alias("text"))


def with_offsets(parts: DataFrame) -> DataFrame:
    """Adds ``offset``, the bytes of the output's parts before, from a table of sizes."""
    sizes = parts.select(ID, "part", F.octet_length("text").cast("long").alias("bytes"))
    before = Window.partitionBy(ID).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select(ID, "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))
    return parts.join(placed, [ID, "part"])


def tree_digests(parts: DataFrame) -> DataFrame:
    """(output_id, sha256) from the digests of the parts, FAN at a time up to one: the id of a text beyond one cell."""
    level = parts.select(ID, "part", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    for _ in range(4):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha256"))), lambda x: x["sha256"]), "")
        level = level.groupBy(ID, F.floor(F.col("part") / FAN).alias("part")).agg(F.sha2(joined, 256).alias("sha256"))
    return level.select(ID, "sha256")


def declared_lines(lines: DataFrame, route: str) -> DataFrame | None:
    """(output_id, rank, line_no, line): what the reducer of a route promises to keep, in the order of complaint."""
    line = F.col(LINE)
    zero = F.lit(0)
    pick = lambda rows, rank=zero: rows.select(ID, rank.alias("rank"), NO, LINE)
    if route == "log":
        level = severity_class(LINE)
        return pick(lines.where(level.isin("critical", "warning")), F.when(level == "critical", 0).otherwise(1))
    if route in ("generic", "test_strict"):
        return pick(extract_critical_lines(lines))
    if route == "test":
        return pick(lines.where(F.when(F.col("failed"), is_critical_line(line)).otherwise(is_test_warning(line))))
    if route == "search":
        body = let(match_head(line), lambda h: F.when(h != "", match_parts(line, h)["body"]).otherwise(""))
        bodies = lines.withColumn(LINE, body)
        return pick(bodies.where((line != "") & is_error_match(line)))
    return None


def _by_route(work: DataFrame, parts: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """View rows of all routes, and the texts that the views must hold."""
    routes: dict[str, set] = {}
    for route, profile in parts:
        routes.setdefault(route, set()).add(profile)
    views, needed = [], []
    for route, profiles in routes.items():
        lines = work.where(F.col("route") == route).drop("route")
        views.append(reduce_lines(lines, route, next(iter(profiles)) if len(profiles) == 1 else None))
        fails = extract_critical_lines(lines.where("exit_code <> 0"))
        needed.append(fails.select(ID, F.lit(DECISIVE).alias("class"), F.lit(0).alias("rank"), NO, LINE))
        declared, protected = declared_lines(lines, route), protected_lines(lines, route)
        if declared is not None:
            needed.append(declared.select(ID, F.lit(DECLARED).alias("class"), "rank", NO, LINE))
        if protected is not None:
            needed.append(protected.select(ID, F.lit(PROTECTED).alias("class"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias(NO), LINE))
    asked = reduce(DataFrame.unionByName, needed).withColumn(LINE, normalize_line(LINE)).where(F.col(LINE) != "")
    first = F.min(F.struct("rank", NO))
    return reduce(DataFrame.unionByName, views), asked.groupBy(ID, "class", LINE).agg(first.alias("seen"))


def _body(views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The view's rows with their place, and per output what the decision asks of them. Final empty rows don't count."""
    # Rows are dealt by their place in the view, so no task holds a view; the numbers of the tasks order its blocks.
    dealt = views.repartitionByRange(ID, "o1", "o2", "o3").withColumn("_task", F.spark_partition_id())
    dealt = stage(dealt, "view-rows")
    shown = dealt.where(F.col(LINE).isNotNull())
    placed = stage(numbered(shown, [ID], ["o1", "o2", "o3"], "_task", 1, "pos", "n_view").select(ID, "pos", LINE), "view-placed")
    counts = dealt.groupBy(ID).agg(
        F.sum("dropped").alias("omitted_lines"), *[F.max(F.col("tag") == t).alias(f"_{t}") for t in TAGS]
    )
    last = placed.groupBy(ID).agg(F.max(F.when(F.col(LINE) != "", F.col("pos"))).alias("_last"))
    body = placed.join(last.where("_last is not null"), ID).where(F.col("pos") <= F.col("_last")).drop("_last")
    cjk, n_bytes, marks = token_parts(LINE)
    sizes = body.groupBy(ID).agg(
        F.count(F.lit(1)).alias("view_lines"), F.sum(n_bytes).cast("long").alias("view_bytes"), F.sum(cjk).cast("long").alias("view_cjk"),
        F.sum(marks).cast("long").alias("view_marks"), F.max(strip(LINE) != "").alias("some"),
    )
    whole = placed.groupBy(ID).agg(
        (F.sum(n_bytes) + F.count(F.lit(1)) - 1).cast("long").alias("all_bytes"), F.count(F.lit(1)).alias("_rows"),
        F.max(F.when(F.col(LINE) != "", F.col("pos"))).alias("_last"),
    )
    # As a text, rows that end with an empty one are a line less.
    told = F.col("_rows") - F.when(F.coalesce("_last", F.lit(-1)) < F.col("_rows") - 1, 1).otherwise(0)
    whole = whole.select(ID, "all_bytes", told.alias("told_lines"))
    return body, counts.join(whole, ID, "left").join(sizes, ID, "left")


def compact_lines(
    lines: DataFrame, facts: DataFrame, store_available: bool = True, allow_secrets: bool = False, part_lines: int = PART_LINES
) -> tuple[DataFrame, DataFrame]:
    """Decisions and accepted views for outputs given as line tables.

    ``lines`` has output_id, line_no, n_lines and line; ``facts`` has, for each output, raw_bytes and the columns of an
    output (``with_output_defaults``). The rules are those of ``compact_corpus``: the same detector, reducers, guard and
    ladder of reasons. The results have the sizes, the reason and, for accepted views, the id; the parts (output_id,
    part, offset, text) of an output are, one behind the other, its rendered view. Nothing that grows with an output is
    gathered in one cell or one task: detection adds up line statistics, views are numbered block by block, and the
    guard looks needed lines up by a join. Differences: lines are not parsed as JSON; a secret is looked for line by
    line; the id is a digest of the digests of the original's parts; an original that needs no change but lacks or has
    its last line feed counts as changed.

    Outputs with a probable secret are worked on apart, and only their staged tables are encrypted: each read of those
    decrypts every line anew.
    """
    held = stage(lines.where(contains_secret(LINE)).select(ID).distinct(), "secret-outputs")
    options = (store_available, allow_secrets, part_lines)
    results, parts = _compacted(lines.join(held, ID, "left_anti"), facts.join(held, ID, "left_anti"), *options)
    if not held.isEmpty():
        with sealed_staging():
            more, further = _compacted(lines.join(held, ID, "left_semi"), facts.join(held, ID, "left_semi"), *options)
            results, parts = results.unionByName(more), parts.unionByName(further)
    return results, parts


def _compacted(
    lines: DataFrame, facts: DataFrame, store_available: bool, allow_secrets: bool, part_lines: int
) -> tuple[DataFrame, DataFrame]:
    lines = stage(lines.select(ID, NO, N, LINE), "lines")
    known = stage(_known(facts, lines, store_available, allow_secrets), "known")
    parts = [tuple(r) for r in known.where("skip_reason is null").select("route", "profile").distinct().collect()]
    if not parts:
        return _skipped(known), lines.select(ID, F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("offset"), F.col(LINE).alias("text")).limit(0)
    open_ = known.where("skip_reason is null")
    work = lines.join(open_.select(ID, "route", "profile", "exit_code", "failed"), ID)
    views, needed = _by_route(work, parts)
    body, sizes = _body(views)
    judged = _judge(open_, body, sizes, needed, lines, part_lines)
    judged = stage(judged, "judged")
    header = judged.where("transformed and header is not null").select(ID, F.lit(0).cast("long").alias("part"), F.concat("header", F.lit("\n")).alias("text"))
    shown = body.join(judged.where("transformed").select(ID), ID, "left_semi")
    texts = text_parts(shown, "pos", part_lines).withColumn("part", F.col("part") + 1)
    return judged.drop("header").unionByName(_skipped(known)), with_offsets(header.unionByName(texts))


def _known(facts: DataFrame, lines: DataFrame, store_available: bool, allow_secrets: bool) -> DataFrame:
    known = classify_lines(facts, line_signs(lines))
    count = F.coalesce("raw_lines", F.lit(0).cast("long"))
    skip = F.when(F.col("raw_bytes") == 0, "empty output").when(
        (F.col("raw_bytes") < F.col("min_bytes")) & (count < F.col("min_lines")), SMALL
    )
    secret = F.coalesce("secret", F.lit(False))
    tokens = tokens_from_parts(F.coalesce("cjk", F.lit(0)), F.col("raw_bytes"), F.coalesce("marks", F.lit(0)))
    return known.withColumns({
        "raw_lines": count, "skip_reason": F.coalesce(skip, F.when(F.col("route").isNull(), "empty output")), "route": custom_route(F.col("route")),
        "secret": secret, "failed": (F.col("exit_code") != 0) | F.coalesce("test_failed", F.lit(False)), "raw_tokens_est": tokens,
        "store_allowed": F.col("store_original") & F.lit(store_available) & (~secret | F.lit(allow_secrets)),
    })


_RESULT = [
    ID, "kind", "profile", "transformed", "quality_passed", "fallback_reason", "artifact_id", "raw_bytes", "compact_bytes", "raw_lines",
    "compact_lines", "raw_tokens_est", "compact_tokens_est", "notes", "detection_reason", "confidence", "omitted_lines", "command", "cwd", "exit_code",
]


def _skipped(known: DataFrame) -> DataFrame:
    blank = lambda t: F.lit(None).cast(t)
    hint = F.when(F.col("kind_hint") != "", F.col("kind_hint"))
    return known.where("skip_reason is not null").withColumns({
        "kind": F.when(F.col("skip_reason") == SMALL, F.coalesce("kind", hint)).otherwise(F.coalesce(hint, F.lit("empty"))),
        "transformed": F.lit(False), "quality_passed": F.lit(True), "fallback_reason": F.col("skip_reason"), "artifact_id": blank("string"),
        "compact_bytes": F.col("raw_bytes"), "compact_lines": F.col("raw_lines"), "compact_tokens_est": F.col("raw_tokens_est"),
        "notes": F.array().cast("array<string>"), "detection_reason": blank("string"), "confidence": blank("double"), "omitted_lines": blank("long"),
    }).select(*_RESULT)


def _judge(known: DataFrame, body: DataFrame, sizes: DataFrame, needed: DataFrame, lines: DataFrame, part_lines: int) -> DataFrame:
    """The guard and the ladder of reasons for every output; ``header`` is the line above its view."""
    gone = missing_lines(needed.select(ID, LINE), body.select(ID, LINE))
    first = F.min(F.struct("class", "seen", LINE))
    lost = needed.join(gone, [ID, LINE], "left_semi").groupBy(ID, "class").agg(first.alias("_f"))
    told = lost.groupBy(ID).agg(*[
        F.max(F.when(F.col("class") == c, F.col(f"_f.{LINE}"))).alias(name) for c, name in ((DECISIVE, "_m1"), (DECLARED, "_m2"), (PROTECTED, "_m3"))
    ])
    decisive = needed.where(F.col("class") == DECISIVE).groupBy(ID).agg(F.count(F.lit(1)).alias("_decisive"))
    ids = tree_digests(text_parts(lines.join(known.where("store_allowed").select(ID), ID, "left_semi"), NO, part_lines))
    joined = known.join(sizes, ID, "left").join(told, ID, "left").join(decisive, ID, "left").join(ids, ID, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    tags = F.filter(F.array(*[F.when(flag(F.col(f"_{t}")), t) for t in TAGS]), lambda t: t.isNotNull())
    full = joined.withColumns({
        "omitted_lines": zero("omitted_lines"), "view_lines": zero("view_lines"), "tags": tags, "new_id": F.substring("sha256", 1, P.ID_LENGTHS[0]),
    })
    routes = {"generic", "duplicates", "log", "test", "test_strict", "search", "tree_flat", "tree_nested", "git_status", "git_log", "git_diff"}
    route, profile = F.col("route"), F.col("profile")
    full = full.withColumns({
        "notes": view_notes(route, F.col("route_note"), profile, F.col("tags"), routes),
        "sure": effective_confidence(route, profile, F.col("confidence"), F.col("tags")),
        "header": view_header("kind", "new_id", "exit_code", "raw_lines", zero("told_lines"), "omitted_lines"),
    })
    omitted, n = F.col("omitted_lines"), F.col("view_lines")
    # A generic view without any applied rule promises nothing.
    promised = F.when((route != "generic") | (F.size("tags") > 0), F.col("_m2"))
    guard = guard_ladder(
        F.col("exit_code") != 0, zero("_decisive"), F.col("_m1"), promised, F.col("_m3"), omitted, F.lit(True), F.col("sure"),
        ~flag(F.col("some")) & (F.col("filled") > 0),
    )
    head = F.col("header")
    head_cjk, head_bytes, head_marks = (F.coalesce(x, F.lit(0)) for x in token_parts(head))
    body_bytes = zero("view_bytes") + n
    new_n = (body_bytes + F.when(head.isNotNull(), head_bytes + 1).otherwise(0)).cast("long")
    # A protected diff is shown as it came.
    unchanged = (route == "git_diff") | (omitted == 0) & (F.size("tags") == 0) & (F.col("all_bytes") == F.col("raw_bytes")) & (F.col("line_bytes") + F.col("raw_lines") - 1 == F.col("raw_bytes"))
    full = full.withColumns({"guard": guard, "_new_n": new_n, "_tokens": tokens_from_parts(zero("view_cjk") + head_cjk, new_n, zero("view_marks") + head_marks)})
    full = full.withColumn("fallback_reason", fallback(
        omitted, F.col("store_allowed"), F.col("secret"), F.col("guard"), flag(unchanged), F.col("_new_n"), F.col("raw_bytes"), F.col("min_savings_ratio")
    ))
    done = F.col("fallback_reason").isNull()
    keep = lambda c: F.when(done, c)
    allowed = (omitted <= 0) | F.col("store_allowed")
    compact_lines_ = n + F.when(head.isNotNull(), 1).otherwise(0)
    return full.withColumns({
        "transformed": done, "quality_passed": ~allowed | F.col("guard").isNull(), "artifact_id": keep(F.col("new_id")),
        "compact_bytes": keep(F.col("_new_n")), "compact_lines": keep(compact_lines_), "compact_tokens_est": keep(F.col("_tokens")),
    }).withColumns({
        "compact_bytes": F.coalesce("compact_bytes", "raw_bytes"), "compact_lines": F.coalesce("compact_lines", "raw_lines"),
        "compact_tokens_est": F.coalesce("compact_tokens_est", "raw_tokens_est"), "detection_reason": keep(F.col("detection_reason")),
        "confidence": keep(F.col("confidence")), "omitted_lines": keep(omitted),
    }).select(*_RESULT, "header")
