"""Registered queries of single rules: text shapes, detection, listings, evaluation, reports; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.predicates import is_key_file
from linesieve.functions.text import compact_template, content_digest, is_binary, normalize_line, normalize_newlines, portable_exit_code, strip_ansi
from linesieve.operators.chunks import numbered
from linesieve.operators.detect import detect_kind
from linesieve.operators.lines import ID, LINE, N, NO
from linesieve.operators.reduce_listing import rebuild_tree_paths
from linesieve.operators.reduce_text import reduce_generic
from linesieve.operators.store import artifact_metadata
from linesieve.plans.catalogue import _put_rows, _stream, _work_dir, doc_results, documents, route_outputs, stored_documents, table
from linesieve.plans.compact import compact_corpus
from linesieve.plans.evaluate import critical_retention, expected_passthrough, required_facts, strict_gate
from linesieve.plans.oracles import ORACLES as BASE
from linesieve.plans.oracles import cover, q, windows
from linesieve.sources.outputs import outputs_from_text
from linesieve.sources.run_partials import RunTable
from linesieve.sources.store_tables import write_report
from linesieve.streaming.jobs import stored_state, stream_compact, stream_store_state

ESC = "\x1b"
#: Base names of the paths that the key-file rule is asked about.
NAMES = ["Makefile", "main.c", "README.md", "notes.txt", "go.mod", ".gitignore", "package.json.bak", "DOCKERFILE", "readme"]


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


# ---- text shapes ---------------------------------------------------------------------------------

def event_text_shapes(spark, sf_dir):
    """Coloured texts with every kind of line end, bytes with NUL or control marks, and exit codes below zero."""
    kind, n = F.col("event_type"), F.col("event_id")
    text = F.concat(F.lit(f"{ESC}[31m"), kind, F.lit(f"{ESC}[0m\r\nid "), n.cast("string"), F.lit("\rend"))
    mark = F.when(n % 5 == 0, F.lit("\0")).when(n % 5 == 1, F.lit("\x01")).otherwise("")
    return _events(spark, sf_dir).select(
        "event_id", strip_ansi(text).alias("plain"), normalize_newlines(text).alias("broken"),
        normalize_line(F.concat(kind, F.lit("\r\n"))).alias("line"), is_binary(F.concat(kind, mark).cast("binary")).alias("binary"),
        portable_exit_code((n % 9 - 4).cast("int")).alias("exit_code"),
    )


def event_mask_templates(spark, sf_dir):
    """Lines with a UUID, a time, a digest and a number: one template per kind of event."""
    h = F.md5(F.col("event_id").cast("string"))
    cut = lambda at, size: F.substring(h, at, size)
    uuid = F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(14, 3)), F.concat(F.lit("a"), cut(18, 3)), cut(21, 12))
    line = F.concat(
        F.lit("req "), uuid, F.lit(" at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" id "), cut(1, 12), F.lit(" took "),
        F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"),
    )
    return _events(spark, sf_dir).groupBy(compact_template(line).alias("template")).agg(F.count(F.lit(1)).alias("n"))


def part_key_files(spark, sf_dir):
    """Which paths are key files, by their base name in any case."""
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    path = F.concat(F.lit("lib"), (F.col("p_partkey") % 7).cast("string"), F.lit("/"), name)
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), is_key_file(path).alias("is_key"))


def page_tree_paths(spark, sf_dir):
    """Paths rebuilt from drawn trees: sites, their pages, and below every fifth page a body."""
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 200).cast("long").alias(ID), "page_id", (F.col("page_id") % 3).alias("site"))
    at = F.col("site") * 4_000_000_000 + 2 * F.col("page_id")
    site = pages.select(ID, "site").distinct().select(
        ID, (F.col("site") * 4_000_000_000 - 1).alias("at"), F.concat(F.lit("├── site"), F.col("site").cast("string")).alias(LINE)
    )
    page = pages.select(ID, at.alias("at"), F.concat(F.lit("│   ├── p"), F.col("page_id").cast("string"), F.lit(".html")).alias(LINE))
    body = pages.where("page_id % 5 = 0").select(ID, (at + 1).alias("at"), F.lit("│   │   └── body").alias(LINE))
    lines = numbered(site.unionByName(page).unionByName(body), [ID], ["at"], "at", 1 << 20, NO, N)
    return rebuild_tree_paths(lines.select(ID, NO, N, LINE)).select(ID, NO, "depth", "value")


def event_generic_max(spark, sf_dir):
    """Logs of a thousand events each under the most reducing profile: edges and decisive lines with their neighbours."""
    line = F.concat(F.when(F.col("event_type") == "error", "ERROR ").otherwise("INFO "), F.col("event_type"), F.lit(" event="), F.col("event_id").cast("string"))
    rows = _events(spark, sf_dir).select(F.floor(F.col("event_id") / 1000).cast("long").alias(ID), "event_id", line.alias(LINE))
    lines = numbered(rows, [ID], ["event_id"], "event_id", 1 << 16, NO, N).select(ID, NO, N, LINE)
    return reduce_generic(lines, "max").select(ID, "o1", "o2", LINE, "dropped")


# ---- detection -----------------------------------------------------------------------------------

def kinds_by_text(spark, sf_dir):
    """Outputs of every route without their command: a third is told by a hint, the others by their text."""
    block = F.regexp_extract(ID, "([0-9]+)$", 1).cast("long")
    bare = route_outputs(spark, sf_dir).withColumns({
        "command": F.array().cast("array<string>"), "kind_hint": F.when(block % 3 == 0, "log"),
    })
    return detect_kind(bare).select(ID, "detection.kind", "detection.confidence", "detection.reason")


# ---- evaluation, reports, listings ---------------------------------------------------------------

def _log_blocks(spark, sf_dir) -> DataFrame:
    """Logs of two hundred events each; every second command failed."""
    line = F.concat(F.when(F.col("event_type") == "error", "ERROR ").otherwise("INFO "), F.col("event_type"), F.lit(" event="), F.col("event_id").cast("string"))
    rows = _events(spark, sf_dir).select(F.floor(F.col("event_id") / 200).cast("long").alias("block"), F.struct("event_id", line.alias(LINE)).alias("r"))
    # A block has two hundred lines.
    text = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r[LINE]), "\n")
    texts = rows.groupBy("block").agg(text.alias("text"))
    return outputs_from_text(
        texts, "block", "text", command=F.array(F.lit("tail"), F.lit("x.log")), exit_code=(F.col("block") % 2).cast("int"),
        min_bytes=0, min_lines=0, min_savings_ratio=0.0,
    )


def log_critical_retention(spark, sf_dir):
    """Failed commands: no decisive line of the log is missing in its view."""
    outputs = _log_blocks(spark, sf_dir)
    return critical_retention(compact_corpus(outputs), outputs)


def log_strict_gate(spark, sf_dir):
    """All conditions of an evaluated case for the logs, and two anchor groups that every view must hold."""
    outputs = _log_blocks(spark, sf_dir)
    cases = outputs.select(ID, F.lit(False).alias("exact_visible"), F.lit(False).alias("sensitive"))
    groups = F.array(*[F.struct(F.lit(g).alias("group_no"), F.lit(w).alias("alternative")) for g, w in ((0, "EVENT="), (0, "none"), (1, "error error"))])
    anchors = outputs.select(F.col(ID).alias("case"), F.explode(groups).alias("a")).select("case", "a.*")
    gate = strict_gate(compact_corpus(outputs), outputs, cases, anchors)
    return gate.select(ID, "kind", "anchors_ok", "exact_ok", "sensitive_ok", "strict_pass", "exact_available")


def doc_required_facts(spark, sf_dir):
    """Function words of each language as anchor groups in the views of all documents."""
    words = {"en": [["The ", "and "], ["tion"]], "fr": [["les ", "eau"], ["ment"]], "de": [["der ", "und "], ["ung"]], "es": [["que ", "los "], ["cion", "ando"]]}
    rows = F.create_map(*[x for lang, groups in words.items() for x in (F.lit(lang), F.array(*[
        F.struct(F.lit(g).alias("group_no"), F.lit(w).alias("alternative")) for g, ws in enumerate(groups) for w in ws
    ]))])
    docs = documents(spark, sf_dir, "lang")
    anchors = docs.select(F.col("doc_id").alias("case"), F.explode(F.element_at(rows, F.col("lang"))).alias("a")).select("case", "a.*")
    return required_facts(doc_results(spark, sf_dir, min_bytes=0, min_lines=0, min_savings_ratio=0.0), anchors)


def diffs_stay(spark, sf_dir):
    """Outputs that must stay as they are, and how many of them were changed: none."""
    outputs = route_outputs(spark, sf_dir).where(F.get("command", F.lit(0)).isin("git", "mytool"))
    results = compact_corpus(outputs)
    cases = outputs.select(ID, (F.array_contains("command", "diff")).alias("expect_passthrough"))
    changed = expected_passthrough(results, cases).select(ID, F.lit(1).alias("changed"))
    return cases.where("expect_passthrough").join(changed, ID, "left").select(ID, F.coalesce("changed", F.lit(0)).alias("changed"))


def report_files(spark, sf_dir):
    """A report written as JSON lines and as CSV, and read back from both."""
    flags = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.array(F.lit("lines"), F.first("l_linestatus")).alias("notes")
    )
    path = _work_dir(spark)
    for fmt in ("json", "csv"):
        write_report(flags, f"{path}/{fmt}", fmt)
    rows = "l_returnflag string, l_linestatus string, n long, quantity long"
    found = spark.read.schema(f"{rows}, notes array<string>").json(f"{path}/json").withColumn("notes", F.array_join("notes", "; "))
    plain = spark.read.schema(f"{rows}, notes string").option("header", True).csv(f"{path}/csv")
    named = lambda df, fmt: df.select(F.lit(fmt).alias("fmt"), "l_returnflag", "l_linestatus", "n", "quantity", "notes")
    return named(found, "json").unionByName(named(plain, "csv"))


def artifact_listing(spark, sf_dir):
    """Everything about the stored texts but their bytes."""
    return artifact_metadata(stored_documents(spark, sf_dir).select("id", "sha256", "created_at", "cwd", "payload"))


def _event_runs(spark, sf_dir) -> DataFrame:
    size = F.col("value").cast("long")
    return _events(spark, sf_dir).select(
        "event_id", F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 2 == 0, "safe").otherwise("max").alias("profile"), (F.col("event_type") != "error").alias("transformed"),
        (F.col("event_type") != "signup").alias("quality_passed"), (size + 10).alias("raw_bytes"), size.alias("compact_bytes"),
        (size + 20).alias("raw_tokens_est"), (size + 1).alias("compact_tokens_est"),
    )


def _three_batches(spark, sf_dir) -> RunTable:
    runs, kept = _event_runs(spark, sf_dir), RunTable(spark, f"{_work_dir(spark)}/runs")
    for k in (0, 1, 2, 1):
        kept.append(runs.where(F.col("event_id") % 3 == k).drop("event_id"), f"b{k}")
    return kept


def run_totals_kept_up(spark, sf_dir):
    """Savings by kind over the last days, from partial aggregates after three appends, one of them made twice."""
    kept = _three_batches(spark, sf_dir)
    last = _events(spark, sf_dir).agg(F.max("ts").cast("timestamp")).first()[0]
    return kept.savings_by_kind(last, 3)


def run_profiles_kept_up(spark, sf_dir):
    """Runs and sizes by profile and kind with subtotals, from partial aggregates."""
    return _three_batches(spark, sf_dir).savings_by_profile().select(
        "profile", "kind", F.col("level").cast("long").alias("level"), "cases", "transformed", "raw_bytes", "compact_bytes",
        F.round("byte_savings_ratio", 9).alias("byte_savings_ratio"),
    )


def run_summary_kept_up(spark, sf_dir):
    """Totals of the last day and a half, from partial aggregates and the rows of the first day."""
    kept = _three_batches(spark, sf_dir)
    last = _events(spark, sf_dir).agg(F.max("ts").cast("timestamp")).first()[0]
    return kept.run_totals(last, 1)


def doc_stream_state(spark, sf_dir):
    """The store after three batches of puts held in state: all documents, later puts of half of them, late puts of a third."""
    docs = documents(spark, sf_dir, "text", "source")
    path = _work_dir(spark)
    for k, (part, shift) in enumerate(((docs, 0), (docs.where("doc_id % 2 = 0"), 100_000), (docs.where("doc_id % 3 = 0"), -50_000))):
        rows = _put_rows(part, F.timestamp_seconds(F.lit(1_700_000_000 + shift) + F.col("doc_id"))).withColumn("cwd", F.concat("cwd", F.lit(f"/{k}")))
        rows.write.parquet(f"{path}/puts/{k}")
        for query in stream_store_state(
            spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{path}/puts"), f"{path}/out", f"{path}/ck"
        ):
            query.awaitTermination()
    return stored_state(spark, f"{path}/out").select(
        "id", "sha256", F.unix_seconds("created_at").alias("put_at"), "cwd", content_digest("payload").alias("payload_sha256")
    )


def doc_stream_compact(spark, sf_dir):
    """Documents that arrive as a stream, compacted batch by batch."""
    docs = _stream(spark, sf_dir, "documents")
    outputs = outputs_from_text(docs, "doc_id", "text", min_bytes=0, min_lines=0, min_savings_ratio=0.0)
    path = _work_dir(spark)
    stream_compact(outputs, f"{path}/out", f"{path}/ck").awaitTermination()
    return spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out").select(
        ID, "kind", "transformed", "quality_passed", "fallback_reason", "artifact_id", "raw_bytes", "compact_bytes", "raw_lines", "compact_lines",
        "raw_tokens_est", "compact_tokens_est", "omitted_lines",
    )


QUERIES = [
    event_text_shapes, event_mask_templates, part_key_files, page_tree_paths, event_generic_max, kinds_by_text, log_critical_retention,
    log_strict_gate, doc_required_facts, diffs_stay, report_files, artifact_listing, doc_stream_compact,
    run_totals_kept_up, run_profiles_kept_up, run_summary_kept_up, doc_stream_state,
]

_LOG_LINE = "CASE event_type WHEN 'error' THEN 'ERROR ' ELSE 'INFO ' END || event_type || ' event=' || event_id"
_NAMES = "[" + ", ".join(q(x) for x in NAMES) + "]"
_KINDS = [
    ("log", "events", "event_id // 200", "CASE WHEN count(*) >= 8 THEN 'log' ELSE 'generic' END"), ("json", "events", "event_id // 200", "'json'"),
    ("test", "lineitem", "l_orderkey // 100", "'generic'"), ("tree", "pages", "page_id // 200", "'generic'"),
    ("search", "orders", "o_orderkey // 400", "'generic'"), ("git_status", "orders", "o_orderkey // 400", "'generic'"),
    ("git_log", "customer", "c_custkey // 200", "'generic'"), ("git_diff", "supplier", "s_suppkey // 100", "'generic'"), ("generic", "part", "p_partkey // 200", "'generic'"),
]

_RUNS = """runs AS (SELECT ts, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'safe' ELSE 'max' END AS profile, event_type <> 'error' AS transformed,
    event_type <> 'signup' AS quality_passed, CAST(trunc(value) AS BIGINT) AS size FROM events),
    late AS (SELECT * FROM runs WHERE ts >= (SELECT max(ts) FROM runs) - INTERVAL (days) DAY)"""

ORACLES = {
    "run_totals_kept_up": f"""
        WITH {_RUNS.replace("(days)", "3")} SELECT kind, count(*) AS runs, CAST(sum(size + 10) AS BIGINT) AS raw_bytes, CAST(sum(size) AS BIGINT) AS compact_bytes
        FROM late GROUP BY kind""",
    "run_profiles_kept_up": f"""
        WITH {_RUNS.replace("(days)", "3")} SELECT profile, kind, CAST(grouping(profile, kind) AS BIGINT) AS level, count(*) AS cases, count_if(transformed) AS transformed,
               CAST(sum(size + 10) AS BIGINT) AS raw_bytes, CAST(sum(size) AS BIGINT) AS compact_bytes,
               round(10 * count(*) / CAST(sum(size + 10) AS DOUBLE), 9) AS byte_savings_ratio
        FROM runs GROUP BY ROLLUP (profile, kind)""",
    "doc_stream_state": """
        WITH puts AS (SELECT sha256(text) AS sha256, 1700000000 + doc_id AS put_at, source || '/0' AS cwd FROM documents
            UNION ALL SELECT sha256(text), 1700100000 + doc_id, source || '/1' FROM documents WHERE doc_id % 2 = 0
            UNION ALL SELECT sha256(text), 1699950000 + doc_id, source || '/2' FROM documents WHERE doc_id % 3 = 0)
        SELECT left(sha256, 16) AS id, sha256, max(put_at) AS put_at, arg_max(cwd, put_at) AS cwd, sha256 AS payload_sha256 FROM puts GROUP BY sha256""",
    "run_summary_kept_up": f"""
        WITH {_RUNS.replace("(days)", "1")} SELECT count(*) AS runs, count_if(transformed) AS transformed, count_if(NOT quality_passed) AS guard_failures,
               CAST(sum(size + 10) AS BIGINT) AS raw_bytes, CAST(sum(size) AS BIGINT) AS compact_bytes,
               CAST(sum(size + 20) AS BIGINT) AS raw_tokens_est, CAST(sum(size + 1) AS BIGINT) AS compact_tokens_est FROM late""",
    "event_text_shapes": """
        SELECT event_id, event_type || chr(13) || chr(10) || 'id ' || event_id || chr(13) || 'end' AS plain,
               event_type || chr(10) || 'id ' || event_id || chr(10) || 'end' AS broken, event_type AS line, event_id % 5 < 2 AS binary,
               CAST(CASE WHEN event_id % 9 < 4 THEN 128 + 4 - event_id % 9 ELSE event_id % 9 - 4 END AS INT) AS exit_code FROM events""",
    "event_mask_templates": "SELECT 'req <uuid> at <time> id <id> took <n> ' || event_type AS template, count(*) AS n FROM events GROUP BY 1",
    "part_key_files": f"""
        SELECT p_partkey, 'lib' || (p_partkey % 7) || '/' || name AS path,
               name IN ('Makefile', 'README.md', 'go.mod', '.gitignore', 'DOCKERFILE') AS is_key
        FROM (SELECT p_partkey, {_NAMES}[CAST(p_partkey % {len(NAMES)} + 1 AS INT)] AS name FROM part)""",
    "page_tree_paths": """
        WITH p AS (SELECT page_id // 200 AS output_id, page_id, page_id % 3 AS site FROM pages),
        r AS (SELECT DISTINCT output_id, site, -1 AS at, 0 AS depth, 'site' || site AS value FROM p
              UNION ALL SELECT output_id, site, 2 * page_id, 1, 'site' || site || '/p' || page_id || '.html' FROM p
              UNION ALL SELECT output_id, site, 2 * page_id + 1, 2, 'site' || site || '/p' || page_id || '.html/body' FROM p WHERE page_id % 5 = 0)
        SELECT output_id, row_number() OVER (PARTITION BY output_id ORDER BY site, "at") - 1 AS line_no, CAST(depth AS BIGINT) AS depth, value FROM r""".replace(" -1 AS at,", ' -1 AS "at",'),
    "event_generic_max": f"""
        WITH lines AS (SELECT event_id // 1000 AS output_id, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS line_no,
              count(*) OVER (PARTITION BY event_id // 1000) AS n_lines, {_LOG_LINE} AS line FROM events),
        long AS (SELECT * FROM lines WHERE n_lines > {P.GENERIC_WINDOW_ABOVE}),
        hits AS (SELECT * FROM long WHERE line_no < {P.GENERIC_HEAD} OR line_no >= n_lines - {P.GENERIC_TAIL} OR line LIKE 'ERROR%'),
        covered AS ({cover('hits', P.GENERIC_RADIUS)})
        {windows('long', 'covered')}
        UNION ALL SELECT output_id, line_no, 0, line, 0 FROM lines WHERE n_lines <= {P.GENERIC_WINDOW_ABOVE}""",
    "kinds_by_text": f"""
        WITH k AS ({" UNION ALL ".join(f"SELECT '{name}-' || ({block}) AS output_id, {block} AS block, {kind} AS kind FROM {source} GROUP BY 1, 2" for name, source, block, kind in _KINDS)})
        SELECT output_id, CASE WHEN block % 3 = 0 THEN 'log' ELSE kind END AS kind,
               CASE WHEN block % 3 = 0 THEN 1.0 WHEN kind = 'log' THEN 0.82 WHEN kind = 'json' THEN 0.99 ELSE 0.55 END::DOUBLE AS confidence,
               CASE WHEN block % 3 = 0 THEN 'explicit hint' WHEN kind = 'log' THEN 'log severity density' WHEN kind = 'json' THEN 'valid JSON'
                    ELSE 'no strong format match' END AS reason FROM k""",
    "log_critical_retention": """
        SELECT DISTINCT event_id // 200 AS output_id, CAST(NULL AS VARCHAR) AS missing_line, true AS retained FROM events WHERE (event_id // 200) % 2 = 1""",
    "log_strict_gate": """
        SELECT event_id // 200 AS output_id, 'log' AS kind, bool_or(event_type = 'error') AS anchors_ok, true AS exact_ok, true AS sensitive_ok,
               bool_or(event_type = 'error') AS strict_pass, true AS exact_available FROM events GROUP BY 1""",
    "doc_required_facts": BASE["doc_anchor_gate"],
    "diffs_stay": "SELECT DISTINCT 'git_diff-' || (s_suppkey // 100) AS output_id, 0 AS changed FROM supplier",
    "report_files": """
        WITH r AS (SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS quantity,
            'lines; ' || l_linestatus AS notes FROM lineitem GROUP BY 1, 2)
        SELECT 'json' AS fmt, * FROM r UNION ALL SELECT 'csv', * FROM r""",
    "artifact_listing": BASE["artifact_upsert"].replace(", raw_bytes FROM newest", " FROM newest"),
    "doc_stream_compact": BASE["doc_decision"],
}
