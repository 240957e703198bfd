"""Reducers for free text, logs and test runs: line table in, view table out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.knobs import MAX, SAFE, STRICT, knob
from linesieve.functions.predicates import (
    is_critical_line, is_test_failure, is_test_location, is_test_progress, is_test_summary, is_test_warning, severity_class,
)
from linesieve.functions.text import compact_template, let, split_lines, strip
from linesieve.operators.chunks import ALL, BLOCK, carry, numbered, with_chunk
from linesieve.operators.containment import lines_holding
from linesieve.operators.lines import (
    ID, LINE, N, NO, VIEW, anchor_rows, collapse_cell, collapse_consecutive_duplicates, collapse_progress, emit, expand_windows,
    extract_critical_lines, marker, render_windows, view_row,
)
from linesieve.sources.staging import stage

END = 2**61  # sort place of closing sections


def reduce_duplicates(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """Only runs of equal lines are shortened."""
    return collapse_consecutive_duplicates(lines, size).select(*VIEW)


def reduce_generic(lines: DataFrame, profile: str | None = None, size: int = BLOCK) -> DataFrame:
    """Equal runs, then progress families, then (``max`` on long views) critical windows.

    ``profile`` is for tables of one profile; otherwise the ``profile`` column decides per output.
    """
    if profile is not None:
        lines = lines.withColumn("profile", F.lit(profile))
    lines = lines.select(ID, NO, N, LINE, "profile")
    strict = F.col("profile") == STRICT
    maybe_long = may_need_windows(F.col(N), F.col("profile"))
    loose = lambda part: collapse_progress(collapse_consecutive_duplicates(part, size))
    views = []
    if profile in (None, STRICT):
        views.append(reduce_duplicates(lines.where(strict), size))
    if profile != STRICT:
        views.append(loose(lines.where(~strict & ~maybe_long)).select(*VIEW))
    if profile in (None, MAX):
        long_lines = lines.where(maybe_long)
        views.append(window_generic(loose(long_lines), long_lines, size))
    return reduce(DataFrame.unionByName, views)


def reduce_generic_cell(text: Column, profile: Column) -> Column:
    """The assembled view of ``reduce_generic`` for a text that is one cell, unless it may need windows: those look needed
    lines up by joins. Struct of ``view``, ``omitted_lines`` and ``tags``."""
    return let(split_lines(text), lambda p: F.when(profile == STRICT, collapse_cell(p, False)).otherwise(collapse_cell(p, True)))


def may_need_windows(n_lines: Column, profile: Column) -> Column:
    """A view has at most one row more than its output has lines."""
    return (profile == MAX) & (n_lines >= P.GENERIC_WINDOW_ABOVE)


def window_generic(rows: DataFrame, lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """Views above the line limit keep head, tail and lines holding a decisive line, with context."""
    placed = numbered(rows, [ID], ["o1", "o2"], F.least(F.col("o1"), F.col(N)), size, index="pos", total="n_view")
    placed = stage(placed, "long-views")
    short = placed.where(F.col("n_view") <= P.GENERIC_WINDOW_ABOVE).select(*VIEW)
    long = placed.where(F.col("n_view") > P.GENERIC_WINDOW_ABOVE)
    counts = long.where(F.col("dropped") > 0).select(
        ID, F.lit(0).cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"), F.lit(0).cast("long").alias("o3"),
        F.lit(None).cast("string").alias(LINE), "dropped", "tag",
    )
    as_lines = long.select(ID, F.col("pos").alias(NO), F.col("n_view").alias(N), LINE)
    # A decisive line hits by its own text. Another line can only hold one whose match lies at its edge,
    # so those few texts (each a line of this output) are looked up in the remaining lines, by a join.
    edge = extract_critical_lines(lines.select(ID, NO, LINE)).where(needs_edge(LINE) & (F.col(LINE) != ""))
    at_border = (F.col(NO) < P.GENERIC_HEAD) | (F.col(NO) >= F.col(N) - P.GENERIC_TAIL)
    direct = at_border | is_critical_line(LINE)
    nested = lines_holding(edge.select(ID, LINE), as_lines.where(~direct)).select(ID, NO, N).distinct()
    hits = as_lines.where(direct).select(ID, NO, N).unionByName(nested)
    view = render_windows(as_lines, expand_windows(hits, P.GENERIC_RADIUS), size).select(*VIEW)
    return short.unionByName(counts).unionByName(view)


def needs_edge(line) -> Column:
    """Whether a decisive line may lose its match once other text stands before or after it."""
    line = F.col(line) if isinstance(line, str) else line
    framed = [
        is_critical_line(F.concat(F.lit(before), line, F.lit(after)))
        for before in ("(", "(x") for after in ("(", "x")
    ]
    return ~(framed[0] & framed[1] & framed[2] & framed[3])


# ---- logs -------------------------------------------------------------------------------------

def log_template_counts(lines: DataFrame) -> DataFrame:
    """Families of routine log lines: template, count, first place and first text."""
    return (
        lines.where(severity_class(LINE) == "other")
        .groupBy(ID, compact_template(LINE).alias("template"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.min(NO).alias("first_no"), F.min_by(LINE, NO).alias("first_line"),
            *[F.first(c).alias(c) for c in lines.columns if c not in (ID, NO, LINE)],
        )
        .where(F.col("template") != "")
    )


def reduce_log(lines: DataFrame, profile: str | None = None, size: int = BLOCK) -> DataFrame:
    """Severe lines, edges and one line per template with context, then the template counts."""
    if profile is not None:
        lines = lines.withColumn("profile", F.lit(profile))
    lines = lines.select(ID, NO, N, LINE, "profile")
    # One row per template and output; three branches read it, so it is written once.
    families = stage(log_template_counts(lines), "templates")
    radius = knob("log_radius")
    edges = anchor_rows(lines, P.LOG_HEAD, P.LOG_TAIL, severity_class(LINE) != "other").select(ID, NO, N, "profile")
    first_of = families.where(F.col("n") >= knob("log_min_family")).select(
        ID, F.col("first_no").alias(NO), N, "profile"
    )
    view = render_windows(lines, expand_windows(edges.unionByName(first_of), radius), size).select(*VIEW)
    return view.unionByName(template_section(families))


def template_section(families: DataFrame) -> DataFrame:
    """``×count template`` rows in first-seen order, capped with a closing count."""
    repeated = families.where(F.col("n") > 1)
    shown = P.KNOBS["log_templates_shown"]
    ranked = repeated.withColumn(
        "rank", F.row_number().over(Window.partitionBy(ID).orderBy("first_no"))
    ).where(F.col("rank") <= max(shown.values()))
    listed = emit(
        ranked.where(F.col("rank") <= knob("log_templates_shown")),
        F.array(view_row(END, F.col("rank") + 2, F.concat(marker("×", F.col("n"), " "), F.col("template")))),
    )
    totals = repeated.groupBy(ID).agg(F.count(F.lit(1)).alias("families"), F.first("profile").alias("profile"))
    more = F.col("families") - knob("log_templates_shown")
    framed = emit(
        totals,
        F.array(
            view_row(END, 0, F.lit("")),
            view_row(END, 1, F.lit("[repeated log templates]")),
            F.when(more > 0, view_row(END + 1, 0, marker("… ", more, " more template groups in artifact …"))),
        ),
    )
    return listed.unionByName(framed)


# ---- test runs --------------------------------------------------------------------------------

def reduce_test(lines: DataFrame, profile: str | None = None, size: int = BLOCK) -> DataFrame:
    """Failing runs keep failures, places and summaries; passing runs keep warnings and summaries.

    ``failed`` per output comes with the lines when known there; otherwise it is found here from
    ``exit_code`` and the lines.
    """
    if profile is not None:
        lines = lines.withColumn("profile", F.lit(profile))
    if "failed" not in lines.columns:
        bad = F.bool_or((F.col("exit_code") != 0) | is_test_failure(LINE))
        lines = carry(with_chunk(lines, NO, size), [ID], {"failed": (bad, F.bool_or, ALL)})
    lines = lines.select(ID, NO, N, LINE, "profile", "failed")
    failed = F.col("failed")
    either = lambda fail, ok: F.when(failed, fail).otherwise(ok)
    hits = anchor_rows(
        lines, either(P.FAIL_HEAD, P.PASS_HEAD), either(P.FAIL_TAIL, P.PASS_TAIL),
        either(is_test_failure(LINE) | is_test_location(LINE), is_test_warning(LINE)), is_test_summary(LINE),
    )
    covered = expand_windows(hits, either(knob("fail_radius"), knob("pass_radius")))
    return render_windows(lines, covered, size).select(*VIEW)


def reduce_test_strict(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """Equal runs and pure progress rows go; a closing row counts the progress marks."""
    rows = collapse_consecutive_duplicates(lines.select(ID, NO, N, LINE), size).select(*VIEW)
    marks = rows.where(is_test_progress(LINE)).groupBy(ID).agg(F.sum(F.length(strip(LINE))).alias("marks"))
    closing = emit(
        marks,
        F.array(view_row(END, 0, marker("… ", F.col("marks"), " test progress markers collapsed …"), 1, "progress")),
    )
    return rows.where(~is_test_progress(LINE)).unionByName(closing)
