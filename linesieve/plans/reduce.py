"""Dispatch: each classified output goes to the reducer of its route."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.knobs import MAX, STRICT
from linesieve.functions.predicates import (
    is_critical_line, is_error_match, is_test_failure, is_test_warning, match_head, match_parts, severity_class,
)
from linesieve.functions.text import (
    json_value, let, minify_json, normalize_newlines, split_lines, strip_ansi,
)
from linesieve.operators.lines import ID, LINE, NO, assemble_view
from linesieve.operators.reduce_git import cap_commit_bodies, git_status_facts, group_git_status
from linesieve.operators.reduce_json import critical_values, reduce_json
from linesieve.operators.reduce_listing import listing_key_files, reduce_listing
from linesieve.operators.reduce_search import reduce_search, search_paths
from linesieve.operators.reduce_text import (
    reduce_duplicates, reduce_generic, reduce_log, reduce_test, reduce_test_strict,
)
from linesieve.sources.outputs import explode_lines

ROUTES = [
    "generic", "duplicates", "log", "test", "test_strict", "search", "tree_flat", "tree_nested", "git_status",
    "git_log", "git_diff", "json", "json_strict",
]
_custom: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_reducer(kind: str, reducer: Callable[[DataFrame], DataFrame]) -> None:
    """Use ``reducer`` (line table to view table) for outputs detected or hinted as ``kind``."""
    _custom[kind] = reducer


def custom_route(route: Column) -> Column:
    """Outputs of a registered kind leave the built-in routes."""
    return F.when(F.col("kind").isin(list(_custom)), F.concat(F.lit("custom_"), F.col("kind"))).otherwise(route)


def _lines(outputs: DataFrame, *extra: Column) -> DataFrame:
    return explode_lines(outputs.select(ID, "profile", *extra, normalize_newlines(F.col("raw").cast("string")).alias("text")))


def _with_facts(views: DataFrame, facts: DataFrame) -> DataFrame:
    needed = facts.groupBy(ID).agg(F.collect_set(LINE).alias("protected"))
    return views.join(needed, ID, "left")


def _has_failure(text: Column) -> Column:
    return F.exists(split_lines(text), lambda x: is_test_failure(x))


def reduce_lines(lines: DataFrame, route: str, profile: str | None = None) -> DataFrame:
    """View table of the line tables of one route; lines carry ``profile`` and, for test runs, ``failed`` or ``exit_code``."""
    if route.startswith("custom_"):
        return _custom[route.removeprefix("custom_")](lines)
    if route == "generic":
        return reduce_generic(lines, profile)
    if route in ("tree_flat", "tree_nested"):
        return reduce_listing(lines.withColumn("nested", F.lit(route == "tree_nested")))
    if route == "git_diff":
        zero = F.lit(0).cast("long")
        return lines.select(
            ID, F.col(NO).alias("o1"), zero.alias("o2"), zero.alias("o3"), LINE, zero.alias("dropped"), F.lit(None).cast("string").alias("tag")
        )
    table = {
        "duplicates": reduce_duplicates, "log": reduce_log, "test": reduce_test, "test_strict": reduce_test_strict,
        "search": reduce_search, "git_status": group_git_status, "git_log": cap_commit_bodies,
    }
    return table[route](lines)


def protected_lines(lines: DataFrame, route: str) -> DataFrame | None:
    """Texts that the view of a route must hold, or None."""
    if route == "search":
        return search_paths(lines)
    if route in ("tree_flat", "tree_nested"):
        return listing_key_files(lines.withColumn("nested", F.lit(route == "tree_nested")))
    return git_status_facts(lines) if route == "git_status" else None


def reduce_route(outputs: DataFrame, route: str, profile: str | None = None) -> DataFrame:
    """Views of the outputs of one route: view, omitted_lines, tags and optional protected texts."""
    raw_text = F.col("raw").cast("string")
    texts = outputs.select(ID, "profile", raw_text.alias("text"))
    if route == "json":
        return reduce_json(texts)
    if route == "json_strict":
        return texts.select(
            ID, minify_json(strip_ansi("text")).alias("view"), F.lit(0).cast("long").alias("omitted_lines")
        )
    if route == "git_diff":
        return texts.select(ID, F.col("text").alias("view"), F.lit(0).cast("long").alias("omitted_lines"))
    failed = (F.col("exit_code") != 0) | _has_failure(normalize_newlines(raw_text))
    lines = _lines(outputs, failed.alias("failed")) if route == "test" else _lines(outputs)
    views = assemble_view(reduce_lines(lines, route, profile))
    facts = protected_lines(lines, route)
    return views if facts is None else _with_facts(views, facts)


def reduce_outputs(classified: DataFrame, parts: list[tuple[str, str]] | None = None) -> DataFrame:
    """All views. ``parts`` lists the (route, profile) pairs that occur, so no empty branch is planned."""
    parts = parts if parts is not None else [(r, None) for r in ROUTES]
    routes: dict[str, set] = {}
    for route, profile in parts:
        routes.setdefault(route, set()).add(profile)
    branches = []
    for route, profiles in routes.items():
        one = next(iter(profiles)) if len(profiles) == 1 else None
        view = reduce_route(classified.where(F.col("route") == route), route, one)
        for name in ("tags", "protected"):
            if name not in view.columns:
                view = view.withColumn(name, F.array().cast("array<string>"))
        branches.append(view.select(ID, "view", "omitted_lines", "tags", "protected"))
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out


# ---- per-output facts ---------------------------------------------------------------------------

def decisive_lines(text: Column) -> Column:
    """Distinct decisive lines of a text in first-seen order."""
    # Split lines hold no line breaks, so only escape sequences are left to remove.
    lines = F.transform(split_lines(text), lambda x: strip_ansi(x))
    return F.array_distinct(F.filter(lines, lambda x: is_critical_line(x)))


def _choose(route: Column, table: dict[str, Callable[[], Column]], routes: set[str], default: Column) -> Column:
    """CASE over the routes that occur; expressions of the others are not even built."""
    out = default
    for name, make in table.items():
        if name in routes:
            out = F.when(route == name, make()).otherwise(out)
    return out


def declared_critical(
    text: Column, route: Column, exit_code: Column, tags: Column, routes: set[str] = frozenset(ROUTES)
) -> Column:
    """What the reducer of each route promises to keep.

    A generic view without any applied rule holds every line, so there is nothing to look for.
    """
    clean = normalize_newlines(text)
    none = F.array().cast("array<string>")

    def log():
        return let(
            split_lines(clean),
            lambda lines: F.concat(
                F.filter(lines, lambda x: severity_class(x) == "critical"),
                F.filter(lines, lambda x: severity_class(x) == "warning"),
            ),
        )

    def search():
        body = lambda x: let(match_head(x), lambda h: F.when(h != "", match_parts(x, h)["body"]).otherwise(""))
        bodies = F.transform(split_lines(clean), body)
        return F.array_distinct(F.filter(bodies, lambda b: (b != "") & is_error_match(b)))

    def test():
        return F.when((exit_code != 0) | _has_failure(clean), decisive_lines(clean)).otherwise(
            F.filter(split_lines(clean), lambda x: is_test_warning(x))
        )

    table = {
        "generic": lambda: F.when(F.size(tags) > 0, decisive_lines(clean)).otherwise(none),
        "test_strict": lambda: decisive_lines(clean),
        "log": log,
        "test": test,
        "search": search,
        "json": lambda: critical_values(F.to_json(json_value(strip_ansi(text)))),
    }
    return _choose(route, table, routes, none)


def effective_confidence(route: Column, profile: Column, confidence: Column, tags: Column) -> Column:
    raised = F.greatest(confidence, F.lit(0.85))
    has = lambda t: F.array_contains(tags, t)
    return (
        F.when(route == "git_diff", F.lit(1.0))
        .when((route != "generic") | (profile == STRICT), confidence)
        .when(has("window"), raised)
        .when(has("duplicate") & ~has("progress"), F.lit(1.0))
        .otherwise(raised)
    )


def view_notes(
    route: Column, route_note: Column, profile: Column, tags: Column, routes: set[str] = frozenset(ROUTES)
) -> Column:
    """The rules that were applied, in words."""
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    none = F.array().cast("array<string>")
    tree = ["entries picked evenly over each group", "group prefix written once", "key files listed"]

    def generic():
        reduced = F.size(tags) > 0
        said = (
            F.when(
                F.array_contains(tags, "window"), words("runs and progress shortened", "edges and decisive lines with neighbours")
            )
            .when(reduced & (profile == STRICT), words("runs of equal lines shortened"))
            .when(reduced, words("runs and progress shortened"))
            .otherwise(none)
        )
        return F.concat(said, F.when(route_note.isNotNull(), F.array(route_note)).otherwise(none))

    fixed = {
        "log": ["severe lines kept", "routine lines counted by template"],
        "test_strict": ["progress marks counted"],
        "search": [
            "matches listed under their file", "matches picked evenly over each file", "frequent matches named by an alias",
            "paths written once",
        ],
        "tree_flat": ["paths grouped by their first part", *tree],
        "tree_nested": ["full paths rebuilt from the drawing", *tree],
        "git_status": ["entries grouped by state", "every path kept"],
        "git_log": ["first lines of each message"],
        "git_diff": ["diff shown as it came"],
        "json": ["long arrays sampled", "critical values kept"],
        "json_strict": ["white space between values removed"],
        "test": ["failures, warnings and totals with neighbours"],
    }
    table = {name: (lambda texts=texts: words(*texts)) for name, texts in fixed.items()}
    table["generic"] = generic
    table["duplicates"] = lambda: F.when(
        F.col("kind") == "git_status", words("equal rows shortened")
    ).otherwise(words("only runs of equal lines shortened"))
    return _choose(route, table, routes, none)
