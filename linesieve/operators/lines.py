"""Line-set operators.

A line table has ``output_id``, ``line_no`` (0-based, without holes), ``n_lines`` and ``line``. A view
table has ``output_id``, the sort columns ``o1, o2, o3``, ``line``, ``dropped`` (source lines this row
stands for) and ``tag`` (which rule made the row). A view row with a NULL line only carries a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesieve.functions.predicates import is_critical_line, is_progress
from linesieve.functions.text import compact_template, let, normalize_line
from linesieve.operators.chunks import AFTER, ALL, BEFORE, BLOCK, CHUNK, carry, in_chunk, numbered, with_chunk

ID, NO, N, LINE = "output_id", "line_no", "n_lines", "line"
VIEW = [ID, "o1", "o2", "o3", LINE, "dropped", "tag"]


def view_row(o1, o2, line, dropped=0, tag=None, o3=0) -> Column:
    as_long = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    return F.struct(
        as_long(o1).alias("o1"), as_long(o2).alias("o2"), as_long(o3).alias("o3"),
        line.cast("string").alias(LINE), as_long(dropped).alias("dropped"),
        F.lit(tag).cast("string").alias("tag"),
    )


def emit(df: DataFrame, rows: Column, extra: list[str] = ()) -> DataFrame:
    """Turn an array of view rows into view-table rows; NULL entries vanish."""
    return (
        df.select(ID, *extra, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("_v"))
        .select(ID, "_v.*", *extra)
    )


def marker(before: str, number: Column, after: str) -> Column:
    return F.concat(F.lit(before), number.cast("string"), F.lit(after))


def omitted_marker(n: Column) -> Column:
    return marker("… ", n, " lines omitted …")


def repeated_marker(again: Column) -> Column:
    return marker("… previous line repeated ", again, " more times …")


def collapsed_marker(gone: Column) -> Column:
    return marker("… ", gone, " intermediate progress lines collapsed …")


# ---- L1 ---------------------------------------------------------------------------------------

def duplicate_runs(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """First row of each run of equal consecutive lines, with the run length ``run``."""
    carry_cols = [c for c in lines.columns if c not in (NO, LINE)]
    cut = with_chunk(lines, NO, size)
    # The last row of a full block is repeated in the next block, as the neighbour to compare with.
    border = (F.col(NO) % size == size - 1) & (F.col(NO) < F.col(N) - 1)
    haloed = cut.withColumn(
        CHUNK, F.explode(F.when(border, F.array(F.col(CHUNK), F.col(CHUNK) + 1)).otherwise(F.array(CHUNK)))
    )
    w = in_chunk([ID], NO)
    starts = (
        haloed.withColumn("_prev", F.lag(LINE).over(w))
        .where((F.col(CHUNK) * size <= F.col(NO)) & (F.col("_prev").isNull() | (F.col("_prev") != F.col(LINE))))
        .drop("_prev")
        .withColumn("_next", F.lead(NO).over(w))
    )
    linked = carry(starts, [ID], {"_later": (F.min(NO), F.min, AFTER)}, F.col(N) > size)
    return linked.withColumn(
        "run", F.coalesce("_next", "_later", N) - F.col(NO)
    ).select(*carry_cols, NO, LINE, "run")


def collapse_consecutive_duplicates(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """First line of every run, then a marker with the number of repeats."""
    extra = [c for c in lines.columns if c not in (ID, NO, LINE)]
    again = F.col("run") - 1
    return emit(
        duplicate_runs(lines, size),
        F.array(
            view_row(F.col(NO), 0, F.col(LINE)),
            F.when(
                again > 0,
                view_row(F.col(NO), 1, repeated_marker(again), again, "duplicate"),
            ),
        ),
        extra,
    )


# ---- L2 ---------------------------------------------------------------------------------------

def progress_families(rows: DataFrame) -> DataFrame:
    """Progress lines of a view table grouped by template: first position, last text, number."""
    pos = F.struct("o1", "o2")
    extra = [c for c in rows.columns if c not in VIEW]
    return (
        rows.where(is_progress(LINE) & F.col("tag").isNull())
        .groupBy(ID, compact_template(LINE).alias("template"))
        .agg(
            F.min(pos).alias("first_pos"), F.max_by(LINE, pos).alias(LINE), F.count(F.lit(1)).alias("n"),
            *[F.first(c).alias(c) for c in extra],
        )
    )


def collapse_progress(rows: DataFrame) -> DataFrame:
    """One line per progress family, at its first place and with its last text, plus a final count."""
    extra = [c for c in rows.columns if c not in VIEW]
    families = progress_families(rows)
    kept = families.select(
        ID, F.col("first_pos.o1").alias("o1"), F.col("first_pos.o2").alias("o2"), F.lit(0).cast("long").alias("o3"),
        LINE, F.lit(0).cast("long").alias("dropped"), F.lit(None).cast("string").alias("tag"), *extra,
    )
    gone = (
        families.groupBy(ID).agg(F.sum(F.col("n") - 1).alias("_gone"), *[F.first(c).alias(c) for c in extra])
        .where("_gone > 0")
    )
    closing = emit(
        gone,
        F.array(view_row(
            2**62, 0, collapsed_marker(F.col("_gone")), F.col("_gone"), "progress",
        )),
        extra,
    )
    return rows.where(~is_progress(LINE) | F.col("tag").isNotNull()).unionByName(kept).unionByName(closing)


# ---- L1 and L2 of a text that is one cell -----------------------------------------------------

def runs_in_cell(lines: Column) -> Column:
    """``duplicate_runs`` of an array of lines: structs of ``no``, ``line`` and ``run``."""
    new = lambda x, i: (i == 0) | (F.get(lines, i - 1) != x)
    first = F.transform(lines, lambda x, i: F.when(new(x, i), F.struct(i.alias("no"), x.alias("line"))))
    end = lambda s, i: F.coalesce(F.get(s, i + 1)["no"], F.size(lines))
    return let(
        F.filter(first, lambda s: s.isNotNull()),
        lambda s: F.transform(s, lambda x, i: F.struct(x["no"].alias("no"), x["line"].alias("line"), (end(s, i) - x["no"]).alias("run"))),
    )


def _cell_view(texts: Column, omitted: Column, *tags: Column) -> Column:
    return F.struct(
        F.array_join(texts, "\n").alias("view"), omitted.cast("long").alias("omitted_lines"),
        F.filter(F.array(*tags), lambda t: t.isNotNull()).alias("tags"),
    )


def collapse_cell(lines: Column, progress: bool) -> Column:
    """The assembled view of ``collapse_consecutive_duplicates``, with ``progress`` of ``collapse_progress`` as well, for an
    array of lines: struct of ``view``, ``omitted_lines`` and ``tags``, NULL without lines.

    The rows of a cell are together already, so nothing is exchanged. Families are neighbours once their rows are sorted.
    """
    again = lambda runs: F.size(lines) - F.size(runs)
    duplicate = lambda runs: F.when(again(runs) > 0, F.lit("duplicate"))

    def plain(runs):
        rows = lambda r: F.when(r["run"] > 1, F.array(r["line"], repeated_marker(r["run"] - 1))).otherwise(F.array(r["line"]))
        texts = F.when(again(runs) == 0, lines).otherwise(F.flatten(F.transform(runs, rows)))
        return _cell_view(texts, again(runs), duplicate(runs))

    def families(runs, hits):
        named = lambda r: F.struct(compact_template(r["line"]).alias("template"), r["no"].alias("no"), r["line"].alias("line"))
        differs = lambda rows, x, i: F.coalesce(F.get(rows, i)["template"] != x["template"], F.lit(True))
        return let(
            F.sort_array(F.transform(hits, named)),
            lambda rows: let(
                F.struct(
                    F.filter(rows, lambda x, i: differs(rows, x, i - 1)).alias("first"),
                    F.filter(rows, lambda x, i: differs(rows, x, i + 1)).alias("last"),
                    F.transform(hits, lambda r: r["no"]).alias("nos"),
                ),
                lambda f: collapsed(runs, f),
            ),
        )

    def collapsed(runs, f):
        gone = F.size(f["nos"]) - F.size(f["first"])
        piece = lambda no, o2, line: F.struct(no.alias("o1"), F.lit(o2).alias("o2"), line.alias("line"))
        others = F.filter(runs, lambda r: ~is_progress(r["line"]))
        rows = F.sort_array(F.concat(
            F.transform(others, lambda r: piece(r["no"], 0, r["line"])),
            F.transform(F.filter(runs, lambda r: r["run"] > 1), lambda r: piece(r["no"], 1, repeated_marker(r["run"] - 1))),
            F.transform(f["first"], lambda x, i: piece(x["no"], 0, F.get(f["last"], i)["line"])),
        ))
        closing = F.when(gone > 0, F.array(collapsed_marker(gone))).otherwise(F.array().cast("array<string>"))
        texts = F.concat(F.transform(rows, lambda r: r["line"]), closing)
        return _cell_view(texts, again(runs) + gone, duplicate(runs), F.when(gone > 0, F.lit("progress")))

    def loose(runs):
        hits = F.filter(runs, lambda r: is_progress(r["line"]))
        return let(hits, lambda h: F.when(F.size(h) > 0, families(runs, h)).otherwise(plain(runs)))

    return F.when(F.size(lines) > 0, let(runs_in_cell(lines), loose if progress else plain))


# ---- L3-L5 ------------------------------------------------------------------------------------

def anchor_rows(lines: DataFrame, head: int | Column = 0, tail: int | Column = 0, *predicates: Column) -> DataFrame:
    """Lines in the head, in the tail, or hit by any predicate."""
    hit = (F.col(NO) < head) | (F.col(NO) >= F.col(N) - tail)
    for p in predicates:
        hit = hit | p
    return lines.where(hit)


def expand_windows(hits: DataFrame, radius: int | Column) -> DataFrame:
    """Distinct line numbers within ``radius`` of a hit, clipped to the output."""
    radius = radius if isinstance(radius, Column) else F.lit(radius)
    low = F.greatest(F.lit(0).cast("long"), F.col(NO) - radius)
    high = F.least(F.col(N) - 1, F.col(NO) + radius)
    return hits.select(ID, F.explode(F.sequence(low, high)).alias(NO)).distinct()


def keep_covered(lines: DataFrame, covered: DataFrame) -> DataFrame:
    return lines.join(covered, [ID, NO], "left_semi")


def with_gap(kept: DataFrame, size: int = BLOCK) -> DataFrame:
    """Add ``gap`` (lines missing before this kept row) and ``rest`` (missing after the last one)."""
    cut = with_chunk(kept, NO, size)
    w = in_chunk([ID], NO)
    local = cut.withColumns({"_prev": F.lag(NO).over(w), "_next": F.lead(NO).over(w)})
    linked = carry(
        local, [ID], {"_back": (F.max(NO), F.max, BEFORE), "_ahead": (F.min(NO), F.min, AFTER)}, F.col(N) > size
    )
    previous = F.coalesce("_prev", "_back", F.lit(-1))
    is_last = F.coalesce("_next", "_ahead").isNull()
    return linked.withColumns(
        {
            "gap": F.col(NO) - previous - 1,
            "rest": F.when(is_last, F.col(N) - 1 - F.col(NO)).otherwise(0),
        }
    ).drop(CHUNK, "_prev", "_next", "_back", "_ahead")


def render_windows(lines: DataFrame, covered: DataFrame, size: int = BLOCK) -> DataFrame:
    """Covered lines, with every maximal uncovered run replaced by a counting marker."""
    extra = [c for c in lines.columns if c not in (ID, NO, LINE)]
    kept = with_gap(keep_covered(lines, covered), size)
    return emit(
        kept,
        F.array(
            F.when(F.col("gap") > 0, view_row(F.col(NO), -1, omitted_marker(F.col("gap")), F.col("gap"), "window")),
            view_row(F.col(NO), 0, F.col(LINE)),
            F.when(F.col("rest") > 0, view_row(F.col(NO), 1, omitted_marker(F.col("rest")), F.col("rest"), "window")),
        ),
        extra,
    )


# ---- L6 ---------------------------------------------------------------------------------------

def assemble_view(rows: DataFrame) -> DataFrame:
    """One text per output, with its omitted count and the rules that were applied.

    For views of texts that were single cells before; a longer view stays a view table.
    """
    piece = F.when(F.col(LINE).isNotNull(), F.struct("o1", "o2", "o3", LINE))
    return rows.groupBy(ID).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x[LINE]), "\n").alias("view"),
        F.sum("dropped").alias("omitted_lines"),
        F.collect_set("tag").alias("tags"),
    )


# ---- L7 ---------------------------------------------------------------------------------------

def is_spread_anchor(idx: Column, n: Column, k: int | Column) -> Column:
    """Whether position ``idx`` of ``n`` is one of ``k`` evenly spread ordinals (ties to even)."""
    k = k if isinstance(k, Column) else F.lit(k)
    ordinals = F.transform(
        F.sequence(F.lit(0).cast("long"), k.cast("long") - 1),
        lambda s: F.rint((s * (n - 1)).cast("double") / (k - 1)).cast("long"),
    )
    return F.when(n <= k, True).when(k <= 1, idx == 0).otherwise(F.array_contains(ordinals, idx))


def spread_sample(items: DataFrame, keys: list[str], order: str, k: int, size: int = BLOCK) -> DataFrame:
    """At most ``k`` rows per group, spread over the group's whole length."""
    return numbered(items, keys, [order], order, size).where(is_spread_anchor(F.col("idx"), F.col("n_items"), k))


# ---- L8-L10 -----------------------------------------------------------------------------------

def slice_lines(lines: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Lines ``start`` to ``end``, 1-based and inclusive; an open side or a zero start means the edge."""
    low = max(0, (start or 1) - 1)
    picked = lines.where(F.col(NO) >= low)
    return picked if end is None else picked.where(F.col(NO) < max(0, end))


def head_lines(lines: DataFrame, k: int) -> DataFrame:
    return lines.where(F.col(NO) < k)


def tail_lines(lines: DataFrame, k: int) -> DataFrame:
    return lines.where(F.col(NO) >= F.col(N) - k)


def grep_context(
    lines: DataFrame, pattern: str, context: int = 2, fixed: bool = False, size: int = BLOCK
) -> DataFrame:
    """Hits with their neighbours as ``n:line`` (1-based), groups parted by ``--``, for every output."""
    hit = F.contains(F.col(LINE), F.lit(pattern)) if fixed else F.col(LINE).rlike(pattern)
    covered = expand_windows(lines.where(hit), context)
    kept = with_gap(keep_covered(lines, covered), size)
    parted = (F.col("gap") > 0) & (F.col(NO) - F.col("gap") > 0)
    return emit(
        kept,
        F.array(
            F.when(parted, view_row(F.col(NO), -1, F.lit("--"))),
            view_row(F.col(NO), 0, F.concat((F.col(NO) + 1).cast("string"), F.lit(":"), F.col(LINE))),
        ),
    )


# ---- L11-L12 ----------------------------------------------------------------------------------

def extract_critical_lines(lines: DataFrame) -> DataFrame:
    """Distinct decisive lines per output with their first place."""
    return (
        lines.select(ID, NO, normalize_line(LINE).alias(LINE))
        .where(is_critical_line(LINE))
        .groupBy(ID, LINE)
        .agg(F.min(NO).alias(NO))
    )


def carry_section(
    rows: DataFrame, keys: list[str], order: str, header: Column, size: int = BLOCK, name: str = "section"
) -> DataFrame:
    """The last non-NULL ``header`` value at or before each row of its group."""
    cut = with_chunk(rows.withColumn("_h", header), order, size)
    local = cut.withColumn(
        name,
        F.last("_h", ignorenulls=True).over(
            in_chunk(keys, order).rowsBetween(*(BEFORE[0], 0))
        ),
    )
    latest = F.max_by("_h", F.when(F.col("_h").isNotNull(), F.col(order)))
    linked = carry(local, keys, {"_earlier": (latest, lambda c: F.last(c, ignorenulls=True), BEFORE)})
    return linked.withColumn(name, F.coalesce(name, "_earlier")).drop("_h", "_earlier", CHUNK)


def count_lines(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """Add ``n_lines`` to a line table without it."""
    cut = with_chunk(lines, NO, size)
    return carry(cut, [ID], {N: (F.count(F.lit(1)), F.sum, ALL)}).drop(CHUNK)
