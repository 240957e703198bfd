"""Text-shape expressions: clean-up, sizes, token estimate, ids, savings and the header line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linesieve.functions import patterns as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps costly parts out of inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_ansi(x) -> Column:
    """Remove terminal escape and OSC sequences; texts without ESC skip the pattern."""
    x = _c(x)
    return F.when(F.contains(x, F.lit("\x1b")), F.regexp_replace(x, P.ANSI, "")).otherwise(x)


def normalize_newlines(x) -> Column:
    """ANSI-free text with ``\\r\\n`` and ``\\r`` turned into ``\\n``, so redraws become lines; texts without ``\\r`` skip the pattern."""
    x = _c(x)
    return F.when(F.contains(x, F.lit("\r")), F.regexp_replace(strip_ansi(x), "\r\n?", "\n")).otherwise(strip_ansi(x))


def normalize_line(x) -> Column:
    return F.regexp_replace(strip_ansi(x), "[\r\n]+\\z", "")


def strip(x) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(_c(x), F.lit(P.WHITE_SPACE))


def has_rare_breaks(x: Column) -> Column:
    """Whether a line break other than ``\\n`` occurs; plain searches, cheaper than the pattern."""
    found = F.lit(False)
    for mark in P.ASCII_BREAKS:
        found = found | F.contains(x, F.lit(mark))
    wide = F.lit(False)
    for mark in P.WIDE_BREAKS:
        wide = wide | F.contains(x, F.lit(mark))
    return found | ((F.octet_length(x) != F.length(x)) & wide)


def split_lines(x) -> Column:
    """All text lines; a final line break opens no extra line."""
    cut = lambda s: F.when(has_rare_breaks(s), F.split(s, P.LINE_BREAK)).otherwise(F.split(s, "\n"))
    whole = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return let(_c(x), lambda s: let(cut(s), whole))


def line_count(x) -> Column:
    """Number of text lines, without building them."""
    x = _c(x)
    breaks = F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    simple = breaks + F.when((x == "") | F.endswith(x, F.lit("\n")), 0).otherwise(1)
    return F.when(has_rare_breaks(x), F.size(split_lines(x))).otherwise(simple).cast("long")


def byte_line_count(raw) -> Column:
    """Lines of the stored bytes: only ``\\n``, ``\\r`` and ``\\r\\n`` end a line."""
    text = F.decode(_c(raw), "ISO-8859-1")
    parts = F.size(F.split(text, "\r\n|\n|\r"))
    open_end = F.when((text == "") | text.rlike("[\\n\\r]\\z"), 1).otherwise(0)
    return (parts - open_end).cast("long")


def is_binary(raw) -> Column:
    """Any NUL byte, or too many control bytes, counted over all bytes."""
    raw = _c(raw)
    chars = F.decode(raw, "ISO-8859-1")
    controls = F.length(chars) - F.length(F.regexp_replace(chars, P.BINARY_CONTROLS, ""))
    share = F.when(chars.rlike(P.BINARY_CONTROLS), controls / F.greatest(F.lit(1), F.length(chars))).otherwise(0.0)
    return F.contains(raw, F.lit(b"\x00")) | (share > P.BINARY_CONTROL_SHARE)


def compact_template(x) -> Column:
    """Mask volatile values so that lines differing only in them share one key."""
    steps = [(P.UUID, "<uuid>"), (P.TIMESTAMP, "<time>"), (P.HEX_ID, "<id>"), (P.NUMBER, "<n>")]
    return reduce(lambda acc, s: F.regexp_replace(acc, s[0], s[1]), steps, strip(strip_ansi(x)))


def token_parts(x) -> tuple[Column, Column, Column]:
    """Additive token counts of a text piece: CJK characters, UTF-8 bytes, structural marks."""
    x = _c(x)
    wide = F.octet_length(x) != F.length(x)
    cjk = F.when(wide, F.length(x) - F.length(F.regexp_replace(x, P.CJK, ""))).otherwise(0)
    marks = F.length(x) - F.length(F.regexp_replace(x, P.STRUCTURAL, ""))
    return cjk, F.octet_length(x), marks


def tokens_from_parts(cjk: Column, n_bytes: Column, marks: Column) -> Column:
    plain = F.greatest(F.lit(0), n_bytes - cjk * 3)
    estimate = F.ceil(cjk + plain / F.lit(4.0) + marks / F.lit(10.0)).cast("long")
    return F.when(n_bytes == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), estimate))


def estimate_tokens(x) -> Column:
    return tokens_from_parts(*token_parts(x))


def content_digest(raw) -> Column:
    return F.sha2(_c(raw), 256)


def content_id(raw) -> Column:
    return F.substring(content_digest(raw), 1, P.ID_LENGTHS[0])


def size_stats(raw_text, view_text) -> list[Column]:
    """The six size columns of a run: bytes, lines and tokens of both sides."""
    raw_text, view_text = _c(raw_text), _c(view_text)
    return [
        F.octet_length(raw_text).cast("long").alias("raw_bytes"),
        F.octet_length(view_text).cast("long").alias("compact_bytes"),
        line_count(raw_text).alias("raw_lines"),
        line_count(view_text).alias("compact_lines"),
        estimate_tokens(raw_text).alias("raw_tokens_est"),
        estimate_tokens(view_text).alias("compact_tokens_est"),
    ]


def saved(raw_n, compact_n) -> Column:
    return F.greatest(F.lit(0), _c(raw_n) - _c(compact_n))


def saved_ratio(raw_n, compact_n) -> Column:
    raw_n = _c(raw_n)
    return F.when(raw_n == 0, F.lit(0.0)).otherwise(saved(raw_n, compact_n) / raw_n)


def portable_exit_code(code) -> Column:
    """Signal deaths (negative codes) become 128 + signal number."""
    code = _c(code)
    return F.when(code < 0, F.lit(128) + F.abs(code)).otherwise(code)


def view_header(kind, artifact_id, exit_code, raw_lines, view_lines, omitted) -> Column:
    """The line above a view; NULL without an id."""
    return F.concat(
        F.lit("[view "), _c(kind), F.lit("; exit="), _c(exit_code).cast("string"),
        F.lit("; lines="), _c(raw_lines).cast("string"), F.lit("->"), _c(view_lines).cast("string"),
        F.lit("; omitted="), _c(omitted).cast("string"), F.lit(" | exact: "), _c(artifact_id), F.lit("]"),
    )


def render_view(text, kind, artifact_id, exit_code, raw_lines, omitted) -> Column:
    """Final view: one header line when an id exists, the body, exactly one final newline."""
    text = _c(text)
    body = F.regexp_replace(text, "\n+\\z", "")
    header = view_header(kind, artifact_id, exit_code, raw_lines, line_count(text), omitted)
    closed = lambda s: F.when((s == "") | F.endswith(s, F.lit("\n")), s).otherwise(F.concat(s, F.lit("\n")))
    return let(body, lambda b: let(F.concat_ws("\n", header, F.when(b != "", b)), closed))


def json_value(x) -> Column:
    return F.try_parse_json(_c(x))


def minify_json(x) -> Column:
    """Same JSON value without white space; keys come out sorted. NULL when it does not parse."""
    return F.to_json(json_value(x))


def is_valid_json(x) -> Column:
    """Starts with an object or array mark and parses."""
    x = _c(x)
    return F.when(x.rlike(r"(?U)^\s*[\{\[]"), json_value(x).isNotNull()).otherwise(F.lit(False))
