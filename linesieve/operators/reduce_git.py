"""Reducers for version-control output: status reports and commit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.predicates import parse_git_status_line
from linesieve.functions.text import strip
from linesieve.operators.chunks import ALL, BEFORE, BLOCK, CHUNK, carry, in_chunk, with_chunk
from linesieve.operators.lines import ID, LINE, NO, VIEW, carry_section, emit, marker, view_row
from linesieve.operators.reduce_text import END
from linesieve.sources.staging import stage


def git_status_rows(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """Each line's role: ``drop``, ``note`` (kept, with ``text``) or ``path`` (with ``label``, ``text``)."""
    bare = strip(LINE)
    starts = lambda prefix: F.startswith(F.lower(F.col("bare")), F.lit(prefix))
    section = (
        F.when(starts("changes to be committed"), "staged")
        .when(starts("changes not staged"), "unstaged")
        .when(starts("untracked files"), "untracked")
        .when(starts("unmerged paths"), "unmerged")
    )
    placed = carry_section(lines.withColumn("bare", bare), [ID], NO, section, size)
    entry = placed.withColumn("_e", parse_git_status_line(LINE))
    role = lambda kind, label, text, guarded: F.struct(
        F.lit(kind).alias("role"), label.cast("string").alias("label"), text.cast("string").alias("text"),
        F.lit(guarded).alias("guarded"),
    )
    none = F.lit(None)
    indented = F.startswith(F.col(LINE), F.lit("\t")) | F.startswith(F.col(LINE), F.lit("  "))
    branch = F.expr("substring(bare, length('On branch ') + 1)")
    parsed = (
        F.when(
            (F.col("bare") == "") | F.col(LINE).rlike(P.GIT_HELP) | starts("no changes added to commit"),
            role("drop", none, none, False),
        )
        .when(starts("on branch "), role("branch", none, branch, True))
        .when(starts("your branch "), role("note", none, F.col("bare"), True))
        .when(section.isin("staged", "unstaged", "untracked"), role("drop", none, none, False))
        .when(starts("unmerged paths") | F.col(LINE).rlike(P.GIT_STATE_NOTE), role("note", none, F.col("bare"), True))
        .when(
            F.col("_e.form") == "porcelain",
            role("path", F.concat(F.lit("porcelain "), F.col("_e.code")), F.col("_e.path"), True),
        )
        .when(
            F.col("_e.form") == "long",
            role(
                "path", F.concat(F.coalesce("section", F.lit("changed")), F.lit(" "), F.col("_e.code")),
                F.col("_e.path"), True,
            ),
        )
        .when((F.col("section") == "untracked") & indented, role("path", F.lit("untracked"), F.col("bare"), True))
        .when(
            F.lower("bare").isin("nothing to commit, working tree clean", "working tree clean"),
            role("note", none, F.col("bare"), True),
        )
        .otherwise(role("note", none, F.col("bare"), False))
    )
    rows = entry.select(ID, NO, parsed.alias("_p")).select(ID, NO, "_p.*")
    return rows.withColumn("label_key", F.coalesce("label", F.lit("")))


def group_git_status(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """Notes first, then every path under its ``[label] n`` heading, labels in first-seen order."""
    rows = git_status_rows(lines.select(ID, NO, LINE), size)
    # Rows without a path share the NULL label; one pass places every row of the view.
    placed = stage(
        carry(with_chunk(rows, NO, size), [ID, "label_key"], {"first_no": (F.min(NO), F.min, ALL)}).drop(CHUNK), "status"
    )
    shown = emit(
        placed,
        F.array(
            F.when(F.col("role") == "note", view_row(0, F.col(NO), F.col("text"))),
            F.when(F.col("role") == "branch", view_row(0, F.col(NO), F.concat(F.lit("branch "), F.col("text")))),
            F.when(
                F.col("role") == "path",
                view_row(1, F.col("first_no"), F.concat(F.lit("  "), F.col("text")), o3=F.col(NO)),
            ),
        ),
    )
    counts = placed.where(F.col("role").isin("path", "drop")).groupBy(ID, "role", "label").agg(
        F.min(NO).alias("first_no"), F.count(F.lit(1)).alias("n")
    )
    heading = F.concat(F.lit("["), F.col("label"), marker("] ", F.col("n"), ""))
    framed = emit(
        counts,
        F.array(
            F.when(F.col("role") == "path", view_row(1, F.col("first_no"), heading, o3=-1)),
            F.when(
                F.col("role") == "drop",
                view_row(END, 0, marker("… ", F.col("n"), " boilerplate/blank lines removed …"), F.col("n")),
            ),
        ),
    )
    return shown.unionByName(framed).select(*VIEW)


def git_status_facts(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """Labels, paths, branch and state notes must stay visible."""
    rows = git_status_rows(lines.select(ID, NO, LINE), size)
    # A filter on ``guarded`` would be moved below the parsing and repeat its patterns for every use of the parsed row.
    held = F.filter(F.array("label", "text"), lambda x: F.col("guarded") & x.isNotNull())
    return rows.select(ID, F.explode(held).alias(LINE)).distinct()


def cap_commit_bodies(lines: DataFrame, size: int = BLOCK, body_lines: int = P.COMMIT_BODY_LINES) -> DataFrame:
    """Commit headers stay, each body keeps its first lines, blank rows are squeezed."""
    is_commit = F.startswith(F.col(LINE), F.lit("commit "))
    is_header = F.col(LINE).rlike(P.GIT_HEADER)
    role = F.when(is_commit, "commit").when(is_header, "header").when(strip(LINE) == "", "blank").otherwise("text")
    cut = with_chunk(lines.select(ID, NO, LINE).withColumn("role", role), NO, size)
    upto = in_chunk([ID], NO).rowsBetween(*(BEFORE[0], 0))
    last = lambda kind: F.max(F.when(F.col("role") == kind, F.col(NO)))
    local = cut.withColumns({"_commit": last("commit").over(upto), "_blank": last("blank").over(upto)})
    linked = carry(
        local, [ID], {"_commit0": (last("commit"), F.max, BEFORE), "_blank0": (last("blank"), F.max, BEFORE)}
    )
    placed = linked.withColumns(
        {
            "_commit": F.coalesce("_commit", "_commit0", F.lit(-1)),
            "_blank": F.coalesce("_blank", "_blank0", F.lit(-1)),
        }
    )
    in_body = (F.col("role") == "text") & (F.col("_blank") > F.col("_commit"))
    placed = placed.select(ID, NO, LINE, "role", F.col("_commit").alias("commit_no"), in_body.alias("in_body"))
    body = placed.where("in_body")
    first_lines = (
        body.withColumn("rank", F.row_number().over(Window.partitionBy(ID, "commit_no").orderBy(NO)))
        .where(F.col("rank") <= body_lines).drop("rank")
    )
    kept = with_chunk(placed.where(~F.col("in_body")).unionByName(first_lines), NO, size)
    prior = kept.withColumn("_prev", F.lag("role").over(in_chunk([ID], NO)))
    prior = carry(prior, [ID], {"_prev0": (F.max(F.struct(NO, "role")), F.max, BEFORE)})
    before = F.coalesce(F.col("_prev"), F.col("_prev0.role"))
    shown = emit(
        prior.where((F.col("role") != "blank") | (before.isNotNull() & (before != "blank"))),
        F.array(view_row(F.col(NO), 0, F.when(F.col("role") == "blank", F.lit("")).otherwise(F.col(LINE)))),
    )
    per_commit = body.groupBy(ID, "commit_no").agg(F.count(F.lit(1)).alias("n"))
    gone = per_commit.groupBy(ID).agg(F.sum(F.greatest(F.lit(0), F.col("n") - body_lines)).alias("n")).where("n > 0")
    closing = emit(
        gone, F.array(view_row(END, 0, marker("… ", F.col("n"), " commit-body lines omitted …"), F.col("n")))
    )
    return shown.unionByName(closing).select(*VIEW)
