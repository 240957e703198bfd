"""Reducer for search matches: grouped by path, sampled, repeated bodies aliased."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.knobs import knob
from linesieve.functions.predicates import is_error_match, is_symbol_definition, match_head, match_parts
from linesieve.operators.chunks import ALL, BEFORE, BLOCK, CHUNK, carry, numbered, with_chunk
from linesieve.operators.lines import ID, LINE, NO, VIEW, emit, is_spread_anchor, marker, view_row
from linesieve.operators.reduce_text import END
from linesieve.sources.staging import stage

GROUP = [ID, "path"]


def parse_matches(lines: DataFrame) -> DataFrame:
    """Parsed match rows: path, match_line, sep, body next to the raw line."""
    headed = lines.withColumn("_head", match_head(LINE)).where(F.col("_head") != "")
    return headed.withColumns(match_parts(F.col(LINE), F.col("_head"))).drop("_head")


def sample_matches(matches: DataFrame, samples: Column, size: int = BLOCK) -> DataFrame:
    """All error matches plus evenly spread ones, per path.

    Adds ``is_error``, the group's size ``n_matches`` and its first line ``first_no``. The budget
    ``samples`` limits spread matches only while the errors leave room; with as many errors as the
    budget every spread match stays too.
    """
    flagged = with_chunk(matches.withColumn("is_error", is_error_match("body")), NO, size)
    w = Window.partitionBy(*GROUP, CHUNK)
    local = flagged.withColumn("_local", F.row_number().over(w.orderBy(NO)) - 1)
    linked = carry(
        local, GROUP,
        {
            "_n": (F.count(F.lit(1)), F.sum, ALL),
            "_before": (F.count(F.lit(1)), F.sum, BEFORE),
            "n_errors": (F.count_if("is_error"), F.sum, ALL),
            "first_no": (F.min(NO), F.min, ALL),
        },
    )
    placed = linked.withColumns(
        {"idx": F.col("_local") + F.coalesce("_before", F.lit(0)), "n_matches": F.col("_n")}
    ).drop("_local", "_before", "_n", CHUNK)
    anchor = is_spread_anchor(F.col("idx"), F.col("n_matches"), samples)
    errors = placed.where("is_error")
    # At most ``samples`` rows per path are left here, so the window over a path is small.
    spread = placed.where(~F.col("is_error") & anchor)
    per_path = Window.partitionBy(*GROUP)
    room = samples - F.col("n_errors")
    spread = spread.withColumns(
        {"_rank": F.row_number().over(per_path.orderBy(NO)), "_spread": F.count(F.lit(1)).over(per_path)}
    ).where((room <= 0) | (F.col("_spread") <= room) | (F.col("_rank") <= room)).drop("_rank", "_spread")
    return errors.unionByName(spread)


def alias_repeated_bodies(chosen: DataFrame, size: int = BLOCK) -> DataFrame:
    """Bodies worth an alias ``@i``: enough repeats, and enough characters saved.

    An alias of length m pays off while m <= most. Numbers run in first-seen order, and the length
    changes only after 9, 99, 999, ... accepted bodies. So each length is one round: number the bodies
    that fit it, take its quota, and go on behind the last one taken. A round ends the work as soon
    as no output has filled its quota, so there are as many rounds as alias digits.
    """
    length, n = F.length("body"), F.col("repeats")
    fixed = P.ALIAS_FIXED_COST + P.ALIAS_MIN_GAIN
    worth = (
        chosen.where(~F.col("is_error"))
        .groupBy(ID, "body")
        .agg(F.count(F.lit(1)).alias("repeats"), F.min(F.struct("first_no", NO)).alias("seen"))
        .withColumn("most", F.floor((length * (n - 1) - fixed) / (n + 1)))
        .where((n >= P.ALIAS_MIN_REPEATS) & (F.col("most") >= 2))
    )
    left, taken, given = stage(worth, "bodies"), [], 0
    for digits in range(1, 19):
        quota = 9 * 10 ** (digits - 1)
        fits = left.where(F.col("most") >= digits + 1)
        placed = numbered(fits, [ID], ["seen"], F.col("seen.first_no"), size)
        taken.append(placed.where(F.col("idx") < quota).withColumn("alias_no", F.col("idx") + given + 1))
        full = placed.where(F.col("idx") == quota - 1).select(ID, F.col("seen").alias("_cut"))
        if full.isEmpty():
            break
        left = stage(left.join(full, ID).where(F.col("seen") > F.col("_cut")).drop("_cut"), "bodies")
        given += quota
    return reduce(DataFrame.unionByName, taken).select(
        ID, "body", "repeats", "alias_no", F.concat(F.lit("@"), F.col("alias_no").cast("string")).alias("alias")
    )


def reduce_search(lines: DataFrame, profile: str | None = None, size: int = BLOCK) -> DataFrame:
    """Path headings with sampled matches; errors and definitions in small files keep the full line."""
    if profile is not None:
        lines = lines.withColumn("profile", F.lit(profile))
    lines = lines.select(ID, NO, LINE, "profile")
    samples = knob("search_samples")
    # The sample is far smaller than the matches; four branches read it, so it is written once.
    chosen = stage(sample_matches(parse_matches(lines), samples, size), "matches")
    aliases = alias_repeated_bodies(chosen, size).select(ID, "body", "alias_no", "alias")

    named = chosen.join(aliases.select(ID, "body", "alias"), [ID, "body"], "left")
    salient = F.col("is_error") | ((F.col("n_matches") <= samples) & is_symbol_definition("body"))
    short = F.concat(F.col("match_line"), F.col("sep"), F.coalesce("alias", "body"))
    match_rows = emit(
        named, F.array(view_row(F.col("first_no"), 1, F.when(salient, F.col(LINE)).otherwise(short), o3=F.col(NO)))
    )
    per_path = chosen.groupBy(*GROUP).agg(
        F.first("first_no").alias("first_no"), F.first("n_matches").alias("n"), F.count(F.lit(1)).alias("shown")
    )
    hidden = F.col("n") - F.col("shown")
    heading = F.concat(F.lit("## "), F.col("path"), marker(" (", F.col("n"), " matches)"))
    group_rows = emit(
        per_path,
        F.array(
            view_row(F.col("first_no"), 0, heading),
            F.when(hidden > 0, view_row(F.col("first_no"), 2, marker("… ", hidden, " more matches …"), hidden)),
        ),
    )
    alias_rows = emit(
        aliases.withColumn("_first", F.col("alias_no") == 1),
        F.array(
            F.when(F.col("_first"), view_row(-3, 0, F.lit("[match templates]"))),
            view_row(-2, F.col("alias_no"), F.concat("alias", F.lit(" = "), "body")),
            F.when(F.col("_first"), view_row(-1, 0, F.lit(""))),
        ),
    )
    return (
        match_rows.unionByName(group_rows).unionByName(alias_rows).unionByName(unparsed_section(lines)).select(*VIEW)
    )


def unparsed_section(lines: DataFrame) -> DataFrame:
    """Lines that are no match, up to the profile's cap, with a count of the others."""
    cap = knob("search_unparsed")
    other = lines.where(match_head(LINE) == "")
    most = max(P.KNOBS["search_unparsed"].values())
    ranked = other.withColumn("rank", F.row_number().over(Window.partitionBy(ID).orderBy(NO))).where(
        F.col("rank") <= most
    )
    listed = emit(ranked.where(F.col("rank") <= cap), F.array(view_row(END, 2, F.col(LINE), o3=F.col("rank"))))
    more = F.col("n") - cap
    framed = emit(
        other.groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.first("profile").alias("profile")),
        F.array(
            view_row(END, 0, F.lit("")),
            view_row(END, 1, F.lit("[unparsed output]")),
            F.when(more > 0, view_row(END, 3, marker("… ", more, " more unparsed lines …"), more)),
        ),
    )
    return listed.unionByName(framed)


def search_paths(lines: DataFrame) -> DataFrame:
    """Every path must stay visible."""
    return parse_matches(lines.select(ID, LINE)).select(ID, F.col("path").alias(LINE)).distinct()
