"""Line, path, argument and body predicates as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.text import _c, let, strip


def _hinted(folded: Column, words: list[str]) -> Column:
    """Whether one of the words occurs, by plain searches."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(folded, F.lit(word))
    return found


def _behind(x: Column, words: list[str], pattern: str) -> Column:
    """The pattern, only run where one of the words occurs in some case; every match holds one."""
    return _may_hold(x, words) & x.rlike(pattern)


def _may_hold(x: Column, words: list[str]) -> Column:
    # These three match i and s without regard to case but have other lower-case forms.
    for mark, letter in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        x = F.replace(x, F.lit(mark), F.lit(letter))
    return let(F.lower(x), lambda folded: _hinted(folded, words))


def contains_secret(x) -> Column:
    """Looks like a credential. The long pattern only runs where one of its words occurs at all.

    The text is made and folded once, not once for each word, as a filter would do.
    """
    return let(_c(x), lambda v: let(F.lower(F.upper(v)), lambda folded: _hinted(folded, P.SECRET_HINTS)) & v.rlike(P.SECRET))


def is_critical_line(x) -> Column:
    return _c(x).rlike(P.CRITICAL_LINE)


def severity_level(x) -> Column:
    """Leftmost level word in upper case, empty when there is none."""
    return F.upper(F.regexp_extract(_c(x), P.LOG_LEVEL, 1))


def severity_class(x) -> Column:
    """``critical``, ``warning`` or ``other``; stack-trace words make a line critical as well."""
    x = _c(x)
    level = severity_level(x)
    return (
        F.when(level.isin(P.CRITICAL_LEVELS) | x.rlike(P.LOG_TRACE_WORDS), "critical")
        .when(level.isin(P.WARNING_LEVELS), "warning")
        .otherwise("other")
    )


def match_head(x) -> Column:
    """The ``path:line:`` part of a match line; empty when the line has another shape."""
    return F.regexp_extract(_c(x), P.MATCH_HEAD, 0)


def match_parts(line: Column, head: Column) -> dict[str, Column]:
    """Path, line number, second separator and body, cut by position once the head is known."""
    number = F.regexp_extract(head, r"(?U)(\d+).\z", 1)
    return {
        "path": F.substring(head, F.lit(1), F.length(head) - F.length(number) - 2),
        "match_line": number,
        "sep": F.substring(head, -1, 1),
        "body": F.substring(line, F.length(head) + 1, F.length(line)),
    }


def parse_match(x) -> Column:
    """``path:line:body`` (or ``-`` separated) as a struct; NULL when the line has another shape."""
    x = _c(x)
    whole = lambda h: F.when(h != "", F.struct(*[c.alias(n) for n, c in match_parts(x, h).items()]))
    return let(match_head(x), whole)


def is_error_match(body) -> Column:
    return _c(body).rlike(P.ERROR_MATCH)


def is_symbol_definition(body) -> Column:
    return _c(body).rlike(P.SYMBOL_DEFINITION)


def forward_slashes(path) -> Column:
    return F.translate(_c(path), "\\", "/")


def top_component(path) -> Column:
    """Text before the first slash; ``.`` for rooted paths."""
    top = F.substring_index(forward_slashes(path), "/", 1)
    return F.when(top == "", F.lit(".")).otherwise(top)


def base_name(path) -> Column:
    """Last path part; ``.`` parts and trailing slashes do not count."""
    cleaned = F.regexp_replace(forward_slashes(path), r"(?:/\.?)+\z", "")
    name = F.substring_index(cleaned, "/", -1)
    return F.when(name == ".", F.lit("")).otherwise(name)


def suffix(path) -> Column:
    """Lower-cased last-dot suffix; dot files and names ending in a dot count as ``<none>``."""
    tail = F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)\z", 1))
    return F.when(tail == "", F.lit("<none>")).otherwise(tail)


def is_key_file(path) -> Column:
    return F.lower(base_name(path)).isin(P.KEY_FILES)


def is_test_failure(x) -> Column:
    """A failure's word anywhere, or a mark or frame at the start; the words behind plain searches."""
    x = _c(x)
    return _behind(x, P.FAILURE_HINTS, P.TEST_FAILURE_WORD) | x.rlike(P.TEST_FAILURE_START)


def is_test_summary(x) -> Column:
    """A total's head, or a number and what it counts; the latter behind a cheap test."""
    x = strip(x)
    return x.rlike(P.TEST_SUMMARY_HEAD) | (x.rlike(r"(?U)\d\s") & x.rlike(P.TEST_SUMMARY_COUNT))


def is_test_progress(x) -> Column:
    trimmed = strip(x)
    return trimmed.rlike(P.TEST_PROGRESS_ONLY) & (F.length(trimmed) >= P.TEST_PROGRESS_MIN_CHARS)


def is_test_location(x) -> Column:
    return _c(x).rlike(P.TEST_LOCATION)


def is_test_warning(x) -> Column:
    return _behind(_c(x), P.WARNING_HINTS, P.TEST_WARNING)


def is_progress(x) -> Column:
    """Percentages, bars, or a work verb followed by a digit; each part behind a cheap test."""
    x = _c(x)
    return (
        (F.contains(x, F.lit("%")) & x.rlike(P.PROGRESS_PERCENT))
        | (F.contains(x, F.lit("[")) & x.rlike(P.PROGRESS_BAR))
        | (x.rlike(r"(?U)\d") & x.rlike(P.PROGRESS_VERB))
    )


def parse_git_status_line(x) -> Column:
    """Struct(form, code, path): ``porcelain`` XY rows or ``long`` state rows; NULL otherwise."""
    x = _c(x)
    codes = F.create_map(*[F.lit(v) for pair in P.GIT_STATE_CODES.items() for v in pair])
    short = x.rlike(P.GIT_PORCELAIN) & ~F.startswith(x, F.lit("\t"))
    state = F.lower(F.regexp_extract(x, P.GIT_LONG_STATE, 1))
    row = lambda form, code, path: F.struct(
        F.lit(form).alias("form"), code.alias("code"), path.alias("path")
    )
    return F.when(
        short,
        row(
            "porcelain",
            F.translate(F.regexp_extract(x, P.GIT_PORCELAIN, 1), " ", "."),
            F.regexp_extract(x, P.GIT_PORCELAIN, 2),
        ),
    ).when(
        x.rlike(P.GIT_LONG_STATE),
        row("long", F.element_at(codes, state), F.regexp_extract(x, P.GIT_LONG_STATE, 2)),
    )


def redact_command(argv) -> Column:
    """Argument list without credentials.

    A secret flag keeps its name and hides the next argument. An assignment-shaped argument is hidden
    whole, and so is its follower when the assignment has no value. A hidden argument hides nothing.
    The fold carries (arguments so far, hide the next one).
    """
    def step(state, token):
        assigned = token.rlike(P.SECRET_ASSIGNMENT)
        after = F.regexp_replace(token, rf"(?s)^.*?{P.SECRET_ASSIGNMENT}", "")
        shown = F.when(state["hide"], P.REDACTED).when(
            token.rlike(P.SECRET_FLAG), token
        ).when(assigned, P.REDACTED).otherwise(token)
        hide_next = F.when(state["hide"], False).when(token.rlike(P.SECRET_FLAG), True).otherwise(
            assigned & (strip(after) == "")
        )
        return F.struct(F.concat(state["out"], F.array(shown)).alias("out"), hide_next.alias("hide"))

    start = F.struct(
        F.array().cast("array<string>").alias("out"), F.lit(False).alias("hide")
    )
    return F.aggregate(_c(argv), start, step, lambda s: s["out"])
