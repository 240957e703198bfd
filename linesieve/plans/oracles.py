"""SQL counterparts of the registered queries, over the same tables."""

from __future__ import annotations

# ---- shared pieces ------------------------------------------------------------------------------

CRITICAL = (
    r"(?i)(\b(error|fatal|critical|panic|exception|traceback|failed|failure|assert(ion)?|segfault|denied|timeout)\b"
    r"|(^|\s)(E\s+|F\s+)|(^|\s)([A-Za-z0-9_./\\-]+:\d+(:\d+)?)"
    r"|(exit(ed)?\s+(code|status)\s*[:=]?\s*[1-9]\d*))"
)
SECRET = (
    r"(?i)((api[_-]?key|access[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|private[_-]?key|secret|token"
    r"|password|passwd|authorization|credential|database[_-]?url)\s*[:=]\s*\S+"
    r"|\bauthorization\s*:\s*bearer\s+\S+|\bbearer\s+[A-Za-z0-9._~+/=-]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"|\b(sk|rk)-[A-Za-z0-9_-]{16,}|\bgh[pousr]_[A-Za-z0-9]{20,}|\bgithub_pat_[A-Za-z0-9_]{20,}|\bAKIA[0-9A-Z]{16}\b)"
)
LEVEL = r"(?i)\b(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|FATAL|CRITICAL|PANIC)\b"
TRACE_WORDS = r"(?i)\b(exception|traceback|segfault|stack trace)\b"
PROGRESS = (
    r"(?i)(\b\d{1,3}%\b|\[[#=*>.\- ]{5,}\]|(downloading|uploading|building|compiling|processing)\b.*\d)"
)
MARKS = r"[{}\[\]():,.;<>/=+*|&!`~^%-]"
CJK = r"[\x{3000}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def tokens(x: str) -> str:
    cjk = f"len(regexp_extract_all({x}, {q(CJK)}))"
    marks = f"len(regexp_extract_all({x}, {q(MARKS)}))"
    return (
        f"CASE WHEN {x} = '' THEN 0 ELSE greatest(1, CAST(ceil({cjk} + greatest(0, strlen({x}) - 3 * {cjk}) / 4.0 "
        f"+ {marks} / 10.0) AS BIGINT)) END"
    )


def n_lines(x: str) -> str:
    return (
        f"(length({x}) - length(replace({x}, chr(10), '')) "
        f"+ CASE WHEN {x} = '' OR right({x}, 1) = chr(10) THEN 0 ELSE 1 END)"
    )


DIGITS = "^[-+]?[0-9]+"


def template(x: str) -> str:
    """A line with its volatile values masked. The engine has no look-behind, so the last mask works on tokens:
    letters with the character after them, numbers with the letters after them, single characters."""
    x = f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
    for pattern, label in (
        ("\\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\\b", "<uuid>"),
        ("\\b\\d{4}-\\d{2}-\\d{2}[T ][0-9:.+\\-Z]+\\b|\\b\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?\\b", "<time>"),
        ("\\b(0x)?[0-9a-fA-F]{8,}\\b", "<id>"),
    ):
        x = f"regexp_replace({x}, {q(pattern)}, {q(label)}, 'g')"
    tokens = q(r"[A-Za-z_]+(?s:[^A-Za-z_])?|[-+]?[0-9]+(?:\.[0-9]+)?(?:[A-Za-z_]+(?s:[^A-Za-z_])?)?|(?s:.)")
    # Before a letter a number gives up its last digit, or its one-digit fraction.
    masked = f"""CASE WHEN regexp_full_match(t, '[-+]?[0-9]+([.][0-9]+)?') THEN '<n>'
        WHEN regexp_matches(t, '{DIGITS}[.][0-9][A-Za-z_]') THEN regexp_replace(t, '{DIGITS}', '<n>')
        WHEN regexp_matches(t, '{DIGITS}[.][0-9]+[A-Za-z_]') THEN regexp_replace(t, '{DIGITS}[.][0-9]+([0-9][A-Za-z_])', '<n>\\1')
        WHEN regexp_matches(t, '^[-+]?[0-9]{{2,}}[A-Za-z_]') THEN regexp_replace(t, '{DIGITS}([0-9][A-Za-z_])', '<n>\\1')
        ELSE t END"""
    return f"array_to_string(list_transform(regexp_extract_all({x}, {tokens}), lambda t: {masked}), '')"


def lines_of(source: str, key: str, text: str, extra: str = "") -> str:
    """Rows (output_id, line_no, n_lines, line) of a text column."""
    return f"""
    SELECT {key} AS output_id, {extra} CAST(i - 1 AS BIGINT) AS line_no, CAST(n AS BIGINT) AS n_lines, parts[i] AS line
    FROM (SELECT *, unnest(generate_series(1, n)) AS i
          FROM (SELECT *, len(parts) - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END AS n
                FROM (SELECT *, string_split({text}, chr(10)) AS parts FROM {source}) s1) s2) s3"""


DOC_LINES = lines_of("documents", "doc_id", "text")

# First rows of runs of equal lines, with the length of the run.
DOC_RUNS = f"""
  lines AS ({DOC_LINES}),
  flagged AS (SELECT *, CASE WHEN lag(line) OVER w IS DISTINCT FROM line THEN 1 ELSE 0 END AS starts
              FROM lines WINDOW w AS (PARTITION BY output_id ORDER BY line_no)),
  grouped AS (SELECT *, sum(starts) OVER (PARTITION BY output_id ORDER BY line_no) AS run_no FROM flagged),
  runs AS (SELECT output_id, min(line_no) AS line_no, any_value(line) AS line, count(*) AS run
           FROM grouped GROUP BY output_id, run_no)"""

# View rows after collapsing runs.
DOC_COLLAPSED = f"""{DOC_RUNS},
  collapsed AS (
    SELECT output_id, line_no AS o1, 0 AS o2, line, 0 AS dropped FROM runs
    UNION ALL
    SELECT output_id, line_no, 1, '… previous line repeated ' || (run - 1) || ' more times …', run - 1
    FROM runs WHERE run > 1)"""


def windows(lines: str, covered: str) -> str:
    """View rows: covered lines and markers for the rows between them (CTE names in, SELECT out)."""
    return f"""
    SELECT output_id, line_no AS o1, CAST(-1 AS BIGINT) AS o2, '… ' || gap || ' lines omitted …' AS line, gap AS dropped
    FROM (SELECT output_id, line_no, line_no - coalesce(lag(line_no) OVER w, -1) - 1 AS gap
          FROM (SELECT l.* FROM {lines} l SEMI JOIN {covered} c USING (output_id, line_no)) k
          WINDOW w AS (PARTITION BY output_id ORDER BY line_no)) g WHERE gap > 0
    UNION ALL
    SELECT l.output_id, l.line_no, CAST(0 AS BIGINT), l.line, CAST(0 AS BIGINT)
    FROM {lines} l SEMI JOIN {covered} c USING (output_id, line_no)
    UNION ALL
    SELECT output_id, last_no, CAST(1 AS BIGINT), '… ' || (n_lines - 1 - last_no) || ' lines omitted …', n_lines - 1 - last_no
    FROM (SELECT l.output_id, max(l.line_no) AS last_no, any_value(l.n_lines) AS n_lines
          FROM {lines} l SEMI JOIN {covered} c USING (output_id, line_no) GROUP BY 1) e
    WHERE n_lines - 1 - last_no > 0"""


def cover(hits: str, radius: int) -> str:
    return f"""
    SELECT DISTINCT output_id, unnest(generate_series(greatest(0, line_no - {radius}), least(n_lines - 1, line_no + {radius})))
      AS line_no FROM {hits}"""


# ---- decision on documents (one profile, no command) ----------------------------------------------

def decision(profile: str, min_bytes: int, min_lines: int, min_ratio: float) -> str:
    """CTEs ending in ``decided``: the whole ladder for plain documents.

    The progress rule removes nothing here unless a family has several rows, which the template
    join would need; ``progress_free`` states that it does not, and the query fails otherwise.
    """
    confidence = "0.55" if profile == "strict" else "CASE WHEN removed > 0 THEN 1.0 ELSE 0.85 END"
    ladder = f"""
        CASE WHEN raw_bytes = 0 THEN 'empty output'
             WHEN raw_bytes < {min_bytes} AND raw_lines < {min_lines} THEN 'below compression threshold'
             WHEN removed > 0 AND secret THEN 'probable secret: exact-recovery storage not permitted'
             WHEN {confidence} < 0.72 AND removed > 0
               THEN 'quality guard: format confidence too low for selective omission'
             WHEN view = text THEN 'filter found no safe reduction'
             WHEN new_bytes >= raw_bytes OR ratio < {min_ratio}
               THEN 'net savings ' || printf('%.1f%%', ratio * 100) || ' below minimum {min_ratio * 100:.1f}%' END"""
    return f"""{DOC_COLLAPSED},
  views AS (SELECT output_id, string_agg(line, chr(10) ORDER BY o1, o2) AS view, CAST(sum(dropped) AS BIGINT) AS removed
            FROM collapsed GROUP BY 1),
  base AS (SELECT doc_id AS output_id, text, view, coalesce(removed, 0) AS removed, strlen(text) AS raw_bytes,
                  {n_lines('text')} AS raw_lines, regexp_matches(text, {q(SECRET)}) AS secret,
                  left(sha256(text), 16) AS id, regexp_replace(view, '\\n+$', '') AS body, {n_lines('view')} AS view_lines
           FROM documents LEFT JOIN views ON doc_id = output_id),
  rendered AS (SELECT *, CASE WHEN secret THEN '' ELSE '[view generic; exit=0; lines=' || raw_lines || '->' || view_lines
                  || '; omitted=' || removed || ' | exact: ' || id || ']' || chr(10) END || body || chr(10) AS shown
               FROM base),
  sized AS (SELECT *, strlen(shown) AS new_bytes,
                   CASE WHEN raw_bytes = 0 THEN 0 ELSE greatest(0, raw_bytes - strlen(shown)) / CAST(raw_bytes AS DOUBLE) END AS ratio
            FROM rendered),
  laddered AS (SELECT *, {ladder} AS fallback_reason FROM sized),
  decided AS (SELECT output_id, 'generic' AS kind, fallback_reason IS NULL AS transformed,
                     coalesce(fallback_reason NOT LIKE 'quality guard%', true) AS quality_passed, fallback_reason,
                     CASE WHEN fallback_reason IS NULL AND NOT secret THEN id END AS artifact_id, raw_bytes,
                     CASE WHEN fallback_reason IS NULL THEN new_bytes ELSE raw_bytes END AS compact_bytes,
                     raw_lines, CASE WHEN fallback_reason IS NULL THEN {n_lines('shown')} ELSE raw_lines END AS compact_lines,
                     {tokens('text')} AS raw_tokens_est,
                     CASE WHEN fallback_reason IS NULL THEN {tokens('shown')} ELSE {tokens('text')} END AS compact_tokens_est,
                     CASE WHEN fallback_reason IS NULL THEN removed END AS omitted_lines
              FROM laddered)"""


FREE = ("safe", 0, 0, 0.0)
DEFAULT = ("safe", 2048, 40, 0.08)
TOTALS = (
    "CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes, CAST(sum(compact_bytes) AS BIGINT) AS compact_bytes, "
    "CAST(sum(raw_tokens_est) AS BIGINT) AS raw_tokens_est, CAST(sum(compact_tokens_est) AS BIGINT) AS compact_tokens_est"
)

# ---- events as logs ---------------------------------------------------------------------------------

EVENT_LINES = """
  events_text AS (
    SELECT user_id AS output_id, event_id, ts, event_type, json_extract_string(props, '$.k') AS k,
           CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
           CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS v FROM events),
  lines AS (
    SELECT output_id, event_id, event_type, level, k, row_number() OVER (PARTITION BY output_id ORDER BY ts, event_id) - 1 AS line_no,
           count(*) OVER (PARTITION BY output_id) AS n_lines,
           strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z ' || level || ' ' || event_type || ' value=' || v || ' k=' || k AS line
    FROM events_text)"""
EVENT_FAMILIES = """
  families AS (
    SELECT output_id, '<time> INFO ' || event_type || ' value=<n> k=<n>' AS template, count(*) AS n,
           min(line_no) AS first_no, arg_min(line, line_no) AS first_line, any_value(n_lines) AS n_lines
    FROM lines WHERE level = 'INFO' GROUP BY output_id, event_type)"""

# ---- search -------------------------------------------------------------------------------------------

ERROR_BODY = (
    r"(?i)(\b(fatal|critical|panic|failed|failure|denied|timeout)\b|\b[A-Za-z_][A-Za-z0-9_]*(Error|Exception)\b"
    r"|\berror\b|\bexception\b)"
)
SYMBOL = (
    r"(?i)((^|\b)(async\s+def|def|class|interface|enum|struct|type|func|fn|impl|const|let|var|function)\b)"
)
MATCHES = f"""
  doc_lines AS ({lines_of("documents", "lang", "text", "doc_id, source,")}),
  matches AS (
    SELECT output_id, row_number() OVER (PARTITION BY output_id ORDER BY doc_id, line_no) - 1 AS line_no, source || '/' || doc_id AS path,
           CAST(line_no + 1 AS VARCHAR) AS match_line, ':' AS sep, line AS body,
           source || '/' || doc_id || ':' || (line_no + 1) || ':' || line AS raw
    FROM doc_lines)"""


def anchored(idx: str, n: str, k: int) -> str:
    ordinals = ", ".join(
        f"CAST(round_even(CAST({s} * ({n} - 1) AS DOUBLE) / {k - 1}, 0) AS BIGINT)" for s in range(k)
    )
    return f"({n} <= {k} OR {idx} IN ({ordinals}))"


CHOSEN = f"""{MATCHES},
  placed AS (
    SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER p AS n_matches, min(line_no) OVER p AS first_no,
           regexp_matches(body, {q(ERROR_BODY)}) AS is_error
    FROM matches WINDOW w AS (PARTITION BY output_id, path ORDER BY line_no), p AS (PARTITION BY output_id, path)),
  flagged AS (
    SELECT *, {anchored('idx', 'n_matches', 6)} AS anchor,
           sum(CASE WHEN is_error THEN 1 ELSE 0 END) OVER (PARTITION BY output_id, path) AS n_errors FROM placed),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY output_id, path, is_error ORDER BY line_no) AS spread_no,
           count(*) OVER (PARTITION BY output_id, path, is_error) AS spread_n
    FROM flagged WHERE anchor OR is_error),
  chosen AS (
    SELECT * FROM ranked
    WHERE is_error OR n_errors >= 6 OR n_errors + spread_n <= 6 OR spread_no <= 6 - n_errors)"""
# Aliases of two characters only: the first nine accepted bodies; later ones need three.
ALIASES = f"""{CHOSEN},
  bodies AS (
    SELECT output_id, body, count(*) AS repeats, min(ROW(first_no, line_no)) AS seen,
           floor((length(body) * (count(*) - 1) - 28) / (count(*) + 1)) AS most
    FROM chosen WHERE NOT is_error GROUP BY 1, 2 HAVING count(*) >= 3),
  two AS (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY seen) AS r FROM bodies WHERE most >= 2),
  ninth AS (SELECT output_id, seen AS cut FROM two WHERE r = 9),
  three AS (
    SELECT b.*, row_number() OVER (PARTITION BY b.output_id ORDER BY b.seen) AS r
    FROM bodies b JOIN ninth USING (output_id) WHERE b.seen > ninth.cut AND b.most >= 3),
  ninety AS (SELECT output_id, seen AS cut FROM three WHERE r = 90),
  four AS (
    SELECT b.*, row_number() OVER (PARTITION BY b.output_id ORDER BY b.seen) AS r
    FROM bodies b JOIN ninety USING (output_id) WHERE b.seen > ninety.cut AND b.most >= 4),
  aliases AS (
    SELECT output_id, body, repeats, r AS alias_no FROM two WHERE r <= 9
    UNION ALL SELECT output_id, body, repeats, 9 + r FROM three WHERE r <= 90
    UNION ALL SELECT output_id, body, repeats, 99 + r FROM four WHERE r <= 900)"""

# ---- commit log from conversations -----------------------------------------------------------------------

COMMITS = f"""
  turns AS (
    SELECT conv_id, turn, 'commit ' || turn || chr(10) || 'Author: ' || role || chr(10) || chr(10) || text || chr(10) || chr(10) AS body
    FROM conversations),
  raw_lines AS ({lines_of("turns", "conv_id", "body", "turn,")}),
  lines AS (SELECT output_id, row_number() OVER (PARTITION BY output_id ORDER BY turn, line_no) - 1 AS line_no, line FROM raw_lines),
  roles AS (
    SELECT *, CASE WHEN starts_with(line, 'commit ') THEN 'commit' WHEN regexp_matches(line, '^(Author|Date|Merge):') THEN 'header'
                   WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS role FROM lines),
  marked AS (
    SELECT *, max(CASE WHEN role = 'commit' THEN line_no END) OVER w AS commit_no,
           max(CASE WHEN role = 'blank' THEN line_no END) OVER w AS blank_no
    FROM roles WINDOW w AS (PARTITION BY output_id ORDER BY line_no)),
  bodies AS (SELECT *, role = 'text' AND coalesce(blank_no, -1) > coalesce(commit_no, -1) AS in_body FROM marked),
  counted AS (SELECT *, row_number() OVER (PARTITION BY output_id, commit_no, in_body ORDER BY line_no) AS r FROM bodies),
  kept AS (SELECT *, lag(role) OVER (PARTITION BY output_id ORDER BY line_no) AS prev FROM counted WHERE NOT in_body OR r <= 2),
  gone AS (SELECT output_id, count(*) AS n FROM counted WHERE in_body AND r > 2 GROUP BY 1),
  view AS (
    SELECT output_id, line_no, CASE WHEN role = 'blank' THEN '' ELSE line END AS line, 0 AS dropped FROM kept
    WHERE role <> 'blank' OR (prev IS NOT NULL AND prev <> 'blank')
    UNION ALL SELECT output_id, 2305843009213693952, '… ' || n || ' commit-body lines omitted …', n FROM gone)"""

# ---- records -----------------------------------------------------------------------------------------------

def sampled(source: str, key: str, order: str, critical: str, cap: int, columns: str) -> str:
    return f"""
    SELECT {columns}, _index, total_items, count(*) OVER (PARTITION BY {key}) AS sampled_items FROM (
      SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY hit DESC, _index) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS _index,
               count(*) OVER (PARTITION BY {key}) AS total_items, CASE WHEN {critical} THEN 1 ELSE 0 END AS hit FROM {source}) a
      WHERE total_items <= {cap} OR _index < 3 OR _index >= total_items - 2 OR hit = 1) b
    WHERE rank <= {cap} OR hit = 1"""


# ---- pages ---------------------------------------------------------------------------------------------------

PAGES = """
  lines AS (
    SELECT regexp_extract(url, '^(https?)://', 1) AS output_id, regexp_replace(url, '^https?://', '') AS path,
           row_number() OVER (PARTITION BY regexp_extract(url, '^(https?)://', 1) ORDER BY page_id) - 1 AS line_no FROM pages),
  named AS (SELECT *, regexp_replace(path, '(/\\.?)+$', '') AS bare, split_part(path, '/', 1) AS top FROM lines),
  typed AS (
    SELECT *, string_split(bare, '/')[-1] AS name FROM named),
  items AS (
    SELECT *, CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN lower(regexp_extract(name, '(\\.[^.]+)$', 1)) ELSE '<none>' END AS suffix,
           regexp_replace(path, '/+$', '') <> regexp_replace(top, '/+$', '') AS is_nested FROM typed),
  suffixes AS (
    SELECT output_id, suffix, count(*) AS n, min(line_no) AS first_no FROM items GROUP BY 1, 2),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY n DESC, first_no) AS rank FROM suffixes)"""
LISTING = f"""{PAGES},
  tops AS (
    SELECT output_id, top, count(*) AS n, min(line_no) AS first_no, sum(CASE WHEN is_nested THEN 1 ELSE 0 END) AS n_nested,
           count(*) = 1 AND min(path) = top AS is_alone FROM items GROUP BY 1, 2),
  nested AS (
    SELECT i.*, t.first_no, t.n_nested, row_number() OVER (PARTITION BY i.output_id, i.top ORDER BY line_no) - 1 AS idx
    FROM items i JOIN tops t USING (output_id, top) WHERE i.is_nested AND NOT t.is_alone),
  alone AS (
    SELECT i.output_id, i.path, i.line_no, row_number() OVER (PARTITION BY i.output_id ORDER BY i.line_no) - 1 AS pos,
           count(*) OVER (PARTITION BY i.output_id) AS n_alone
    FROM items i JOIN tops t USING (output_id, top) WHERE t.is_alone),
  alone_kept AS (SELECT * FROM alone WHERE {anchored('pos', 'n_alone', 30)}),
  alone_counts AS (SELECT output_id, any_value(n_alone) AS n, count(*) AS shown FROM alone_kept GROUP BY 1),
  view AS (
    SELECT output_id, 0 AS o1, 0 AS o2, 0 AS o3, 'Filesystem listing: ' || CAST(sum(n) AS BIGINT) || ' entries, ' || count(*) || ' top-level groups' AS line,
           0 AS dropped FROM tops GROUP BY 1
    UNION ALL SELECT output_id, 3, 0, 0, 'Groups:', 0 FROM tops WHERE NOT is_alone GROUP BY 1
    UNION ALL SELECT output_id, 2, -1, 0, 'Top-level entries (' || n || '):', 0 FROM alone_counts
    UNION ALL SELECT output_id, 2, line_no, 0, '  ' || path, 0 FROM alone_kept
    UNION ALL SELECT output_id, 2, 4611686018427387904, 0, '  … ' || (n - shown) || ' more …', n - shown FROM alone_counts WHERE n > shown
    UNION ALL SELECT output_id, 4, first_no, -1, '- ' || top || '/ (' || n || ')', 0 FROM tops WHERE NOT is_alone
    UNION ALL SELECT output_id, 4, first_no, line_no,
        '    ' || CASE WHEN starts_with(path, top || '/') THEN substr(path, length(top) + 2) ELSE path END, 0
      FROM nested WHERE {anchored('idx', 'n_nested', 12)}
    UNION ALL SELECT output_id, 4, first_no, 4611686018427387904, '    … ' || CAST(n - least(n_nested, 12) AS BIGINT) || ' more …',
        n - least(n_nested, 12) FROM tops WHERE NOT is_alone AND n > least(n_nested, 12)
    UNION ALL SELECT output_id, 5, 0, 0, 'Extensions: ' || string_agg(suffix || '=' || n, ', ' ORDER BY rank) FILTER (rank <= 20)
        || CASE WHEN max(rank) > 20 THEN ', … ' || (max(rank) - 20) || ' more suffixes in '
             || CAST(sum(n) FILTER (rank > 20) AS BIGINT) || ' entries …' ELSE '' END, 0
      FROM ranked GROUP BY 1)"""

STATUS = """
  parts AS (
    SELECT o_custkey AS output_id, o_orderkey, p, line FROM (
      SELECT o_custkey, o_orderkey, 0 AS p, CASE o_orderstatus WHEN 'F' THEN 'unstaged' WHEN 'O' THEN 'staged' END AS line FROM orders
      UNION ALL
      SELECT o_custkey, o_orderkey, 2, o_orderstatus FROM orders) u WHERE line IS NOT NULL),
  placed AS (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY o_orderkey, p) - 1 AS line_no FROM parts),
  entries AS (
    SELECT output_id, line_no, 'orders/' || o_orderkey AS path,
           CASE line WHEN 'F' THEN 'unstaged M' WHEN 'O' THEN 'staged A' ELSE 'porcelain ??' END AS label
    FROM placed WHERE p = 2),
  labels2 AS (SELECT output_id, label, min(line_no) AS first_no, count(*) AS n FROM entries GROUP BY 1, 2),
  gone AS (SELECT output_id, count(*) AS n FROM placed WHERE p = 0 GROUP BY 1)"""

TESTS = """
  raw AS (
    SELECT l_suppkey AS output_id, l_orderkey, l_linenumber, l_partkey, l_quantity >= 50 AND l_discount >= 0.1 AS bad,
           'tests/part_' || l_partkey || '.py::order_' || l_orderkey || '_' || l_linenumber
             || CASE WHEN l_quantity >= 50 AND l_discount >= 0.1 THEN ' FAILED' ELSE ' PASSED' END AS line FROM lineitem),
  lines AS (
    SELECT output_id, line, bad, bool_or(bad) OVER (PARTITION BY output_id) AS failed,
           row_number() OVER (PARTITION BY output_id ORDER BY l_orderkey, l_linenumber, l_partkey, line) - 1 AS line_no,
           count(*) OVER (PARTITION BY output_id) AS n_lines FROM raw),
  fail_hits AS (SELECT * FROM lines WHERE failed AND (bad OR line_no < 6 OR line_no >= n_lines - 20)),
  pass_hits AS (SELECT * FROM lines WHERE NOT failed AND (line_no < 5 OR line_no >= n_lines - 12))"""

PUTS = """
  puts AS (SELECT doc_id, sha256(text) AS sha256, source, strlen(text) AS raw_bytes FROM documents),
  newest AS (SELECT sha256, max(doc_id) AS created_at, arg_max(source, doc_id) AS cwd, any_value(raw_bytes) AS raw_bytes
             FROM puts GROUP BY 1)"""

JSON_LINES = """
  parts AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS msgs FROM documents),
  items AS (SELECT doc_id, len(msgs) AS n, unnest(msgs) AS msg, unnest(generate_series(0, len(msgs) - 1)) AS i FROM parts),
  flagged AS (
    SELECT *, regexp_matches(msg, '(?i)\\b(error|fatal|critical|panic|exception|failed|failure|denied|timeout)\\b') AS hit FROM items),
  per_doc AS (
    SELECT doc_id, any_value(n) AS n, bool_or(hit) AS critical, count(DISTINCT CASE WHEN hit THEN msg END) AS found,
           sum(CASE WHEN hit OR i < 3 OR i >= n - 2 THEN 1 ELSE 0 END) AS wanted,
           sum(CASE WHEN hit THEN 1 ELSE 0 END) AS hits FROM flagged GROUP BY 1)"""

WORDS = """
  words(lang, group_no, alternative) AS (VALUES
    ('en', 0, 'the '), ('en', 0, 'and '), ('en', 1, 'tion'), ('fr', 0, 'les '), ('fr', 0, 'eau'), ('fr', 1, 'ment'),
    ('de', 0, 'der '), ('de', 0, 'und '), ('de', 1, 'ung'), ('es', 0, 'que '), ('es', 0, 'los '), ('es', 1, 'cion'), ('es', 1, 'ando')),
  hits AS (
    SELECT d.doc_id, w.group_no, bool_or(contains(lower(d.text), w.alternative)) AS hit
    FROM documents d JOIN words w USING (lang) GROUP BY 1, 2)"""

THREE_PROFILES = " UNION ALL ".join(
    f"(WITH {decision(p, 0, 0, 0.0)} SELECT '{p}' AS profile, * FROM decided)" for p in ("strict", "safe", "max")
)


def route_sizes(kind: str, source: str, block: str, line: str) -> str:
    """Sizes of the outputs put together of a table's rows; JSON arrays are one line in brackets."""
    lines, frame = ("1", 2) if kind == "json" else ("count(*)", 0)
    return f"""SELECT '{kind}-' || ({block}) AS output_id, '{kind}' AS kind,
        CAST(sum(strlen({line})) + count(*) - 1 + {frame} AS BIGINT) AS raw_bytes, CAST({lines} AS BIGINT) AS raw_lines,
        true AS not_longer FROM {source} GROUP BY 1"""


def short_ids(lengths: list[int]) -> str:
    """CTEs ``left0..leftN`` and ``got0..gotN``: prefixes given out length by length, earliest first."""
    parts = ["left0 AS (SELECT sha256, min(created_at) AS created_at FROM puts GROUP BY 1)"]
    for i, n in enumerate(lengths):
        parts.append(
            f"try{i} AS (SELECT *, left(sha256, {n}) AS id, row_number() OVER (PARTITION BY left(sha256, {n}) "
            f"ORDER BY created_at, sha256) AS r FROM left{i})"
        )
        parts.append(f"left{i + 1} AS (SELECT sha256, created_at FROM try{i} WHERE r > 1)")
    last = len(lengths) - 1
    union = " UNION ALL ".join(
        f"SELECT sha256, id, created_at FROM try{i}" + ("" if i == last else " WHERE r = 1") for i in range(len(lengths))
    )
    return f"WITH puts AS (SELECT sha256(text) AS sha256, doc_id AS created_at FROM documents), {', '.join(parts)} {union}"


ORACLES = {
    "doc_line_stats": f"""
        SELECT lang, count(*) AS docs, CAST(sum({n_lines('text')}) AS BIGINT) AS lines, max({n_lines('text')}) AS longest,
               CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang""",
    "doc_token_estimate": f"SELECT doc_id, {tokens('text')} AS tokens FROM documents",
    "doc_content_id": "SELECT doc_id, sha256(text) AS sha256, left(sha256(text), 16) AS id FROM documents",
    "doc_secret_scan": f"SELECT doc_id FROM documents WHERE regexp_matches(text, {q(SECRET)})",
    "doc_critical_lines": f"""
        SELECT output_id, line, min(line_no) AS line_no FROM ({DOC_LINES}) l
        WHERE regexp_matches(line, {q(CRITICAL)}) GROUP BY 1, 2""",
    "doc_dup_runs": f"WITH {DOC_RUNS} SELECT output_id, line_no, line, run FROM runs WHERE run > 1",
    "doc_dup_collapse_view": f"""
        WITH {DOC_COLLAPSED} SELECT output_id, string_agg(line, chr(10) ORDER BY o1, o2) AS view,
               CAST(sum(dropped) AS BIGINT) AS omitted_lines FROM collapsed GROUP BY 1""",
    "doc_grep_context": f"""
        WITH lines AS ({DOC_LINES}), hits AS (SELECT * FROM lines WHERE regexp_matches(line, '[0-9]{{3}}')),
        covered AS ({cover('hits', 2)}),
        kept AS (SELECT l.*, lag(line_no) OVER (PARTITION BY output_id ORDER BY line_no) AS prev
                 FROM (SELECT l.* FROM lines l SEMI JOIN covered c USING (output_id, line_no)) l)
        SELECT output_id, string_agg(CASE WHEN prev < line_no - 1 THEN '--' || chr(10) ELSE '' END
               || (line_no + 1) || ':' || line, chr(10) ORDER BY line_no) AS view FROM kept GROUP BY 1""",
    "doc_window_gaps": f"""
        WITH lines AS ({DOC_LINES}),
        hits AS (SELECT * FROM lines WHERE line_no < 3 OR line_no >= n_lines - 2 OR contains(line, 'error')),
        covered AS ({cover('hits', 1)}) {windows('lines', 'covered')}""",
    "doc_head_tail": f"""
        WITH lines AS ({DOC_LINES})
        SELECT 'head' AS part, output_id, line_no, line FROM lines WHERE line_no < 3
        UNION ALL SELECT 'tail', output_id, line_no, line FROM lines WHERE line_no >= n_lines - 2
        UNION ALL SELECT 'slice', output_id, line_no, line FROM lines WHERE line_no BETWEEN 3 AND 5""",
    "doc_spread_sample": f"""
        SELECT * FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
               count(*) OVER (PARTITION BY source) AS n_items FROM documents) p WHERE {anchored('idx', 'n_items', 12)}""",
    "doc_eligibility": f"""
        SELECT CASE WHEN strlen(text) = 0 THEN 'empty output' WHEN strlen(text) < 2048 AND {n_lines('text')} < 40
                 THEN 'below compression threshold' ELSE 'eligible' END AS outcome,
               count(*) AS docs, CAST(sum({n_lines('text')}) AS BIGINT) AS lines FROM documents GROUP BY 1""",
    "doc_template_counts": f"""
        WITH lines AS ({DOC_LINES}),
        routine AS (SELECT *, {template('line')} AS template FROM lines
                    WHERE upper(regexp_extract(line, {q(LEVEL)}, 1)) NOT IN ('ERROR', 'FATAL', 'CRITICAL', 'PANIC', 'WARN', 'WARNING')
                      AND NOT regexp_matches(line, {q(TRACE_WORDS)}))
        SELECT output_id, template, count(*) AS n, min(line_no) AS first_no, min_by(line, line_no) AS first_line
        FROM routine WHERE template <> '' GROUP BY 1, 2""",
    "doc_generic_reduce": f"""
        WITH {DOC_COLLAPSED} SELECT output_id, string_agg(line, chr(10) ORDER BY o1, o2) AS view,
               CAST(sum(dropped) AS BIGINT) AS omitted_lines FROM collapsed GROUP BY 1""",
    "doc_decision": f"WITH {decision(*FREE)} SELECT * FROM decided",
    "doc_run_totals": f"""
        WITH {decision(*DEFAULT)} SELECT count(*) AS runs, count_if(transformed) AS transformed, {TOTALS},
               count_if(NOT quality_passed) AS guard_failures FROM decided""",
    "doc_savings_by_kind": f"""
        WITH {decision(*DEFAULT)} SELECT kind, count(*) AS runs, CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes,
               CAST(sum(compact_bytes) AS BIGINT) AS compact_bytes FROM decided GROUP BY kind""",
    "doc_corpus_summary": f"""
        WITH {decision(*FREE)}, t AS (
          SELECT count(*) AS cases, count_if(transformed) AS transformed, count_if(quality_passed) AS quality_passed,
                 count(artifact_id) AS artifacts, CAST(sum(raw_tokens_est) AS BIGINT) AS raw_tokens_est,
                 CAST(sum(compact_tokens_est) AS BIGINT) AS compact_tokens_est FROM decided)
        SELECT *, raw_tokens_est - compact_tokens_est AS saved_tokens,
               round((raw_tokens_est - compact_tokens_est) * 100 / CAST(raw_tokens_est AS DOUBLE), 3) AS savings_pct FROM t""",
    "doc_savings_by_profile": f"""
        SELECT profile, kind, CAST(grouping(profile, kind) AS BIGINT) AS level, count(*) AS cases,
               count_if(transformed) AS transformed, CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes,
               CAST(sum(compact_bytes) AS BIGINT) AS compact_bytes,
               round((sum(raw_bytes) - sum(compact_bytes)) / CAST(sum(raw_bytes) AS DOUBLE), 9) AS byte_savings_ratio
        FROM ({THREE_PROFILES}) u GROUP BY ROLLUP (profile, kind)""",
    "doc_containment_check": f"""
        WITH lines AS ({DOC_LINES}),
        needed AS (SELECT DISTINCT output_id, substr(line, 3, 30) AS line FROM lines WHERE regexp_matches(line, '[0-9]{{3}}')),
        shown AS (SELECT output_id, line FROM lines WHERE line_no < 3 OR line_no >= n_lines - 2),
        checked AS (SELECT n.output_id, n.line, bool_or(contains(s.line, n.line)) AS found
                    FROM needed n JOIN shown s USING (output_id) GROUP BY 1, 2)
        SELECT output_id, count(*) AS needed, count_if(NOT found) AS missing, bool_and(found) AS passed FROM checked GROUP BY 1""",
    "doc_containment_whole": f"""
        WITH lines AS ({DOC_LINES}),
        needed AS (SELECT DISTINCT output_id, line FROM lines WHERE line <> ''),
        shown AS (SELECT output_id, '> ' || CASE WHEN line_no % 2 = 0 THEN line ELSE substr(line, 1, length(line) - 1) END || ' <' AS line
                  FROM lines WHERE line_no < 3 OR line_no >= n_lines - 2),
        checked AS (SELECT n.output_id, n.line, bool_or(contains(s.line, n.line)) AS found
                    FROM needed n JOIN shown s USING (output_id) GROUP BY 1, 2)
        SELECT output_id, count(*) AS needed, count_if(NOT found) AS missing, bool_and(found) AS passed FROM checked GROUP BY 1""",
    "doc_label_lookup": f"""
        SELECT quality, toxic, count(*) AS docs, CAST(sum({n_lines('text')}) AS BIGINT) AS lines
        FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""",
    "doc_anchor_gate": f"""
        WITH {WORDS} SELECT doc_id AS "case", count(*) AS anchor_groups, count_if(hit) AS groups_hit, bool_and(hit) AS anchors_ok
        FROM hits GROUP BY 1""",
    "artifact_upsert": f"WITH {PUTS} SELECT left(sha256, 16) AS id, sha256, created_at, cwd, raw_bytes FROM newest",
    "artifact_ids": "SELECT sha256(text) AS sha256, left(sha256(text), 16) AS id, min(doc_id) AS created_at FROM documents GROUP BY 1, 2",
    "artifact_short_ids": short_ids([2, 3, 4, 64]),
    "artifact_prefix_lookup": """
        WITH docs AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS sha FROM documents),
        ids AS (SELECT sha AS id FROM docs UNION SELECT left(sha, 16) FROM docs WHERE sha < '8'),
        asked AS (SELECT DISTINCT CASE WHEN source = 'src1' THEN '%' || source WHEN doc_id % 7 = 0 THEN upper(left(sha, 4 + doc_id % 61))
                    ELSE left(sha, 4 + doc_id % 61) END AS prefix FROM docs),
        met AS (SELECT prefix, count(id) AS n, min(id) AS id, bool_or(id = lower(prefix)) AS exact FROM asked LEFT JOIN ids
                  ON regexp_matches(prefix, '^[0-9a-fA-F]{4,64}$') AND starts_with(id, lower(prefix)) GROUP BY 1)
        SELECT prefix, CASE WHEN NOT regexp_matches(prefix, '^[0-9a-fA-F]{4,64}$') THEN 'invalid' WHEN n = 0 THEN 'not found'
                 WHEN n = 1 OR exact THEN 'found' ELSE 'ambiguous' END AS status,
               CASE WHEN exact THEN lower(prefix) WHEN n = 1 THEN id END AS id, n AS matches FROM met""",
    "store_second_put": """
        WITH puts AS (SELECT sha256(text) AS sha256, 1700000000 + doc_id AS put_at, source FROM documents
            UNION ALL SELECT sha256(text), 1700000000 + doc_id + 86400, source FROM documents WHERE doc_id % 2 = 0)
        SELECT left(sha256, 16) AS id, sha256, max(put_at) AS put_at, arg_max(source, put_at) AS cwd, sha256 AS payload_sha256
        FROM puts GROUP BY sha256""",
    "store_purge": """
        WITH puts AS (SELECT left(sha256(text), 16) AS id, 1700000000 + doc_id * 3600 AS put_at FROM documents),
        kept AS (SELECT * FROM puts WHERE put_at >= (SELECT max(put_at) FROM puts) - 3 * 86400)
        SELECT 'artifact' AS part, id, max(put_at) AS put_at FROM kept GROUP BY id UNION ALL SELECT 'run', id, put_at FROM kept""",
    "artifact_verify": "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}')",
    "artifact_recovery": "SELECT doc_id, left(sha256(text), 16) AS artifact_id, true AS recovered FROM documents",
    "secret_not_stored": f"SELECT doc_id AS output_id, false AS stored FROM documents WHERE regexp_matches(text, {q(SECRET)})",
    "artifact_show": f"""
        WITH texts AS (SELECT left(sha256(text), 16) AS id, any_value(text) AS text FROM documents GROUP BY 1),
        lines AS ({lines_of('texts', 'id', 'text')}),
        hits AS (SELECT * FROM lines WHERE regexp_matches(line, '[0-9]{{3}}')), covered AS ({cover('hits', 1)}),
        kept AS (SELECT l.*, lag(line_no) OVER (PARTITION BY output_id ORDER BY line_no) AS prev
                 FROM (SELECT l.* FROM lines l SEMI JOIN covered c USING (output_id, line_no)) l)
        SELECT output_id, string_agg(CASE WHEN prev < line_no - 1 THEN '--' || chr(10) ELSE '' END
               || (line_no + 1) || ':' || line, chr(10) ORDER BY line_no) AS view FROM kept GROUP BY 1""",
    "artifact_expire": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-12-31' - INTERVAL 365 DAY",
    "newest_orders": """
        SELECT o_orderkey AS id, o_orderstatus AS kind FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""",
    "event_log_lines": f"""
        WITH {EVENT_LINES} SELECT output_id, line_no, event_id, line, level,
               CASE level WHEN 'ERROR' THEN 'critical' WHEN 'WARNING' THEN 'warning' ELSE 'other' END AS class FROM lines""",
    "event_critical_lines": f"""
        WITH {EVENT_LINES} SELECT output_id, substr(line, 26) AS line, min(line_no) AS line_no FROM lines
        WHERE level = 'ERROR' GROUP BY 1, 2""",
    "event_template_counts": f"WITH {EVENT_LINES}, {EVENT_FAMILIES} SELECT output_id, template, n, first_no, first_line FROM families",
    "event_log_reduce": f"""
        WITH {EVENT_LINES}, {EVENT_FAMILIES},
        hits AS (
          SELECT output_id, line_no, n_lines FROM lines WHERE level <> 'INFO' OR line_no < 5 OR line_no >= n_lines - 8
          UNION ALL SELECT output_id, first_no, n_lines FROM families),
        covered AS ({cover('hits', 3)}),
        repeated AS (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY first_no) AS rank FROM families WHERE n > 1)
        {windows('lines', 'covered')}
        UNION ALL SELECT output_id, 2305843009213693952, 0, '', 0 FROM repeated GROUP BY 1
        UNION ALL SELECT output_id, 2305843009213693952, 1, '[repeated log templates]', 0 FROM repeated GROUP BY 1
        UNION ALL SELECT output_id, 2305843009213693952, rank + 2, '×' || n || ' ' || template, 0 FROM repeated WHERE rank <= 40
        UNION ALL SELECT output_id, 2305843009213693953, 0, '… ' || (count(*) - 40) || ' more template groups in artifact …', 0
          FROM repeated GROUP BY 1 HAVING count(*) > 40""",
    "route_ids_conserved": " UNION ALL ".join(
        route_sizes(*part) for part in [
            ("log", "events", "event_id // 200", "'INFO ' || event_type || ' event=' || event_id"),
            ("json", "events", "event_id // 200", "coalesce(props, 'null')"),
            ("test", "lineitem", "l_orderkey // 100", "'tests/part_' || l_partkey || '.py PASSED'"),
            ("tree", "pages", "page_id // 200", "'site' || (page_id % 3) || '/p' || page_id || '.html'"),
            ("search", "orders", "o_orderkey // 400", "'c' || (o_custkey % 7) || '.py:' || o_orderkey || ':pay(x)'"),
            ("git_status", "orders", "o_orderkey // 400", "chr(9) || 'modified:   o/' || o_orderkey"),
            ("git_log", "customer", "c_custkey // 200", "'commit ' || c_custkey"),
            ("git_diff", "supplier", "s_suppkey // 100", "'+' || s_suppkey"),
            ("generic", "part", "p_partkey // 200", "'row ' || p_partkey"),
        ]
    ),
    "event_severity_density": f"""
        WITH {EVENT_LINES}, c AS (SELECT output_id, count(*) AS lines, count_if(level <> 'INFO') AS hits FROM lines GROUP BY 1)
        SELECT *, hits >= greatest(8, lines // 8) AS is_log FROM c""",
    "event_progress_families": f"""
        WITH {EVENT_LINES} SELECT output_id, 'Processing ' || event_type || ' [<n>%]' AS template, min(line_no) AS first_no,
               arg_max('Processing ' || event_type || ' [' || k || '%]', line_no) AS line, count(*) AS n
        FROM lines GROUP BY output_id, event_type""",
    "event_progress_reduce": f"""
        WITH {EVENT_LINES},
        texts AS (SELECT output_id, line_no, event_type, 'Processing ' || event_type || ' [' || k || '%]' AS line FROM lines),
        marked AS (SELECT *, sum(s) OVER (PARTITION BY output_id ORDER BY line_no) AS run_no FROM (
                     SELECT *, CASE WHEN lag(line) OVER (PARTITION BY output_id ORDER BY line_no) IS DISTINCT FROM line THEN 1 ELSE 0 END AS s
                     FROM texts) a),
        runs AS (SELECT output_id, run_no, min(line_no) AS line_no, any_value(line) AS line, any_value(event_type) AS event_type,
                        count(*) AS run FROM marked GROUP BY 1, 2),
        families AS (SELECT output_id, event_type, min(line_no) AS o1, arg_max(line, line_no) AS line, count(*) AS n FROM runs GROUP BY 1, 2),
        rows AS (
          SELECT output_id, o1, 0 AS o2, line, 0 AS dropped FROM families
          UNION ALL SELECT output_id, line_no, 1, '… previous line repeated ' || (run - 1) || ' more times …', run - 1 FROM runs WHERE run > 1
          UNION ALL SELECT output_id, 4611686018427387904, 0, '… ' || CAST(sum(n - 1) AS BIGINT) || ' intermediate progress lines collapsed …', sum(n - 1)
            FROM families GROUP BY 1 HAVING sum(n - 1) > 0)
        SELECT output_id, o1, CAST(o2 AS BIGINT) AS o2, line, CAST(dropped AS BIGINT) AS dropped FROM rows""",
    "event_props_numeric_summary": """
        SELECT event_type, 'k' AS field, count(k) AS n, min(k) AS min, max(k) AS max, round(avg(k), 6) AS mean
        FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) e
        GROUP BY 1 HAVING count(k) >= greatest(3, count(*) // 3)""",
    "event_json_nodes": """
        SELECT event_id AS output_id, 0 AS depth, NULL AS key, replace(props, ' ', '') AS json FROM events
        UNION ALL SELECT event_id, 1, 'k', json_extract_string(props, '$.k') FROM events""",
    "event_json_minify": "SELECT event_id, CAST(json(props) AS VARCHAR) AS props FROM events",
    "event_argv_redact": """
        SELECT event_id, CASE event_type
            WHEN 'click' THEN 'run --password <redacted> --verbose'
            WHEN 'view' THEN 'run <redacted> --verbose'
            WHEN 'purchase' THEN 'run <redacted> <redacted> --verbose'
            WHEN 'signup' THEN 'run <redacted> --token <redacted> --verbose'
            ELSE 'run --user ' || CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) || ' --verbose' END AS command FROM events""",
    "doc_json_reduce": f"""
        WITH {JSON_LINES}
        SELECT doc_id AS output_id, CAST(CASE WHEN n > 12 THEN n - greatest(least(wanted, 12), hits) ELSE 0 END AS BIGINT) AS omitted_lines,
               CAST(CASE WHEN n > 12 THEN greatest(least(wanted, 12), hits) END AS BIGINT) AS sampled_items,
               CAST(CASE WHEN n > 12 THEN greatest(least(wanted, 12), hits) ELSE 0 END AS BIGINT) AS kept, true AS valid FROM per_doc""",
    "doc_json_critical": f"""
        WITH {JSON_LINES} SELECT doc_id AS output_id, critical, found AS critical_values FROM per_doc""",
    "order_record_sample": sampled("orders", "o_custkey", "o_orderkey", "o_orderstatus = 'F'", 12, "o_custkey, o_orderkey"),
    "order_numeric_summary": """
        SELECT o_custkey, 'o_totalprice' AS field, count(*) AS n, min(o_totalprice) AS min, max(o_totalprice) AS max,
               round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1 HAVING count(*) >= greatest(3, count(*) // 3)""",
    "lineitem_record_sample": sampled(
        "lineitem", "l_suppkey", "l_orderkey, l_linenumber, l_partkey, l_returnflag", "l_returnflag = 'R'", 6,
        "l_suppkey, l_orderkey, l_linenumber, l_partkey",
    ),
    "page_url_tree": f"WITH {LISTING} SELECT output_id, o1, o2, o3, line, CAST(dropped AS BIGINT) AS dropped FROM view",
    "page_extension_histogram": f"WITH {PAGES} SELECT output_id, suffix, n, first_no, rank FROM ranked",
    "match_parse": f"WITH {MATCHES} SELECT output_id, line_no, path, match_line, sep, body FROM matches",
    "search_group_sample": f"WITH {CHOSEN} SELECT output_id, path, match_line, idx, n_matches, is_error FROM chosen",
    "search_body_aliases": f"WITH {ALIASES} SELECT output_id, body, repeats, '@' || alias_no AS alias FROM aliases",
    "search_reduce": f"""
        WITH {ALIASES},
        groups AS (SELECT output_id, path, any_value(first_no) AS first_no, any_value(n_matches) AS n, count(*) AS shown FROM chosen GROUP BY 1, 2)
        SELECT c.output_id, c.first_no AS o1, 1 AS o2, c.line_no AS o3,
               CASE WHEN c.is_error OR (c.n_matches <= 6 AND regexp_matches(c.body, {q(SYMBOL)})) THEN c.raw
                    ELSE c.match_line || ':' || CASE WHEN a.alias_no IS NOT NULL THEN '@' || a.alias_no ELSE c.body END END AS line, 0 AS dropped
        FROM chosen c LEFT JOIN aliases a ON a.output_id = c.output_id AND a.body = c.body
        UNION ALL SELECT output_id, first_no, 0, 0, '## ' || path || ' (' || n || ' matches)', 0 FROM groups
        UNION ALL SELECT output_id, first_no, 2, 0, '… ' || (n - shown) || ' more matches …', n - shown FROM groups WHERE n > shown
        UNION ALL SELECT output_id, -3, 0, 0, '[match templates]', 0 FROM aliases GROUP BY 1
        UNION ALL SELECT output_id, -2, alias_no, 0, '@' || alias_no || ' = ' || body, 0 FROM aliases
        UNION ALL SELECT output_id, -1, 0, 0, '', 0 FROM aliases GROUP BY 1""",
    "section_carry": """
        SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
               OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""",
    "commit_body_cap": f"""
        WITH {COMMITS} SELECT output_id, line_no AS o1, line, dropped FROM view""",
    "order_status_report": f"""
        WITH {STATUS}
        SELECT e.output_id, 1 AS o1, l.first_no AS o2, e.line_no AS o3, '  ' || e.path AS line, 0 AS dropped
        FROM entries e JOIN labels2 l ON l.output_id = e.output_id AND l.label = e.label
        UNION ALL SELECT output_id, 1, first_no, -1, '[' || label || '] ' || n, 0 FROM labels2
        UNION ALL SELECT output_id, 2305843009213693952, 0, 0, '… ' || n || ' boilerplate/blank lines removed …', n FROM gone""",
    "supplier_test_reduce": f"""
        WITH {TESTS}, covered AS ({cover('fail_hits', 4)} UNION {cover('pass_hits', 2)}) {windows('lines', 'covered')}""",
    "event_stream_totals": """
        WITH mark AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM events)
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS kind, count(*) AS runs,
               count_if(event_type <> 'error') AS transformed, CAST(sum(CAST(trunc(value) AS BIGINT) + 10) AS BIGINT) AS raw_bytes,
               CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS compact_bytes, count_if(event_type = 'signup') AS guard_failures
        FROM events, mark WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= w GROUP BY 1, 2""",
    "doc_stream_upsert": f"""
        WITH {PUTS} SELECT left(sha256, 16) AS id, sha256, created_at AS put_no, cwd, raw_bytes FROM newest""",
}

_CAPTURES = "(SELECT doc_id // 100 AS capture, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents GROUP BY 1)"
ORACLES["capture_line_table"] = f"""
    SELECT output_id AS capture, count(*) AS lines, max(n_lines) AS n_lines, CAST(sum(strlen(line)) AS BIGINT) AS bytes,
           CAST(sum((line_no + 1) * len(line)) AS BIGINT) AS checksum
    FROM ({lines_of(_CAPTURES, 'capture', 'body')}) GROUP BY 1"""


def _kinds(name: str, source: str, part: str, severe: str, test: str, hunk: str) -> str:
    return f"""SELECT '{name}-' || ({part}) AS output_id, count(*) AS raw_lines, CAST(count_if({severe}) AS BIGINT) AS severe,
        CAST({test} AS INT) AS markers, {hunk} AS hunk FROM {source} GROUP BY 1"""


ORACLES["kinds_by_line_statistics"] = f"""
    WITH c AS ({" UNION ALL ".join([
        _kinds("log", "events", "event_id // 200", "event_id % 40 = 0 OR event_type = 'error'", "0", "false"),
        _kinds("dense", "events", "event_id // 200", "true", "0", "false"),
        _kinds("test", "lineitem", "l_orderkey // 100", "false", "max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) + max(CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END)", "false"),
        _kinds("diff", "supplier", "s_suppkey // 50", "false", "0", "true"),
        _kinds("plain", "part", "p_partkey // 200", "false", "0", "false"),
    ])}),
    d AS (SELECT *, CASE WHEN hunk THEN 'git_diff' WHEN markers >= 2 THEN 'test'
            WHEN severe > 0 AND severe >= greatest(8, raw_lines // 8) THEN 'log' ELSE 'generic' END AS kind FROM c)
    SELECT output_id, kind, CASE kind WHEN 'git_diff' THEN 'diff markers' WHEN 'test' THEN 'test markers' WHEN 'log' THEN 'log severity density'
             ELSE 'no strong format match' END AS detection_reason, kind AS route, raw_lines, severe, markers FROM d"""

_LOG_VIEWS = f"""
    WITH {EVENT_LINES},
    raw AS (SELECT output_id, count(*) AS n, CAST(sum(strlen(line) + 1) AS BIGINT) AS raw_bytes, count_if(level <> 'INFO') AS decisive,
              CAST(count_if(regexp_matches(line, '(?i)\\b(trace|debug|info|warn|warning|error|fatal|critical|panic)\\b')) AS BIGINT) AS severe FROM lines GROUP BY 1),
    rows AS ({ORACLES["event_log_reduce"]}),
    placed AS (SELECT output_id, line, dropped, row_number() OVER (PARTITION BY output_id ORDER BY o1, o2) - 1 AS pos FROM rows),
    sized AS (SELECT output_id, count(*) AS shown, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, CAST(sum(dropped) AS BIGINT) AS omitted FROM placed GROUP BY 1),
    judged AS (SELECT *, len('[view log; exit=0; lines=' || n || '->' || shown || '; omitted=' || omitted || ' | exact: ]') + 16 + 1 AS head,
                 head + bytes < raw_bytes AS done FROM raw JOIN sized USING (output_id))"""
ORACLES["long_log_results"] = _LOG_VIEWS.replace("rows AS", "view_rows AS").replace("FROM rows", "FROM view_rows") + """
    SELECT output_id, 'log' AS kind, CASE WHEN done THEN 'log severity density' END AS detection_reason, done AS transformed, true AS quality_passed, raw_bytes,
           CASE WHEN done THEN CAST(head + bytes AS BIGINT) ELSE raw_bytes END AS compact_bytes, n AS raw_lines,
           CASE WHEN done THEN shown + 1 ELSE n END AS compact_lines, CASE WHEN done THEN omitted END AS omitted_lines FROM judged"""
ORACLES["long_log_parts"] = _LOG_VIEWS.replace("rows AS", "view_rows AS").replace("FROM rows", "FROM view_rows") + """,
    cut AS (SELECT output_id, pos // 20 + 1 AS part, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS body FROM placed GROUP BY 1, 2)
    SELECT cut.output_id, part, CAST(head + coalesce(sum(strlen(body)) OVER (PARTITION BY cut.output_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
             AS "offset", sha256(body) AS text_sha256 FROM cut JOIN judged USING (output_id) WHERE done"""
