"""Registered queries: each operator over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.knobs import PROFILES, knob
from linesieve.functions.predicates import (
    contains_secret, parse_match, redact_command, severity_class, severity_level, suffix,
)
from linesieve.functions.text import (
    compact_template, content_digest, content_id, estimate_tokens, json_value, line_count, minify_json,
)
from linesieve.operators.chunks import numbered
from linesieve.operators.containment import anchor_gate, containment_check, label_lookup, recovery_check
from linesieve.operators.detect import eligibility
from linesieve.operators.detect_lines import classify_lines, line_signs
from linesieve.operators.lines import (
    ID, LINE, N, NO, VIEW, anchor_rows, assemble_view, carry_section, collapse_consecutive_duplicates,
    collapse_progress, count_lines, duplicate_runs, expand_windows, extract_critical_lines, grep_context, head_lines,
    progress_families, render_windows, slice_lines, spread_sample, tail_lines,
)
from linesieve.operators.metrics import corpus_summary, recent_artifacts, run_totals, savings_by_kind, savings_by_profile
from linesieve.operators.records import numeric_summary, numeric_summary_of_maps, sample_records
from linesieve.operators.reduce_git import cap_commit_bodies, group_git_status
from linesieve.operators.reduce_json import critical_values, is_critical_json, json_nodes, reduce_json
from linesieve.operators.reduce_listing import extension_histogram, reduce_listing
from linesieve.operators.reduce_search import alias_repeated_bodies, parse_matches, reduce_search, sample_matches
from linesieve.operators.reduce_text import log_template_counts, reduce_generic, reduce_log, reduce_test
from linesieve.operators.store import assign_ids, expire, latest, latest_puts, lookup_artifacts, verify_artifacts
from linesieve.plans.compact import compact_corpus
from linesieve.plans.long_outputs import compact_lines
from linesieve.plans.put import compact_and_store
from linesieve.plans.retention import purge_store
from linesieve.plans.retrieve import show
from linesieve.sources.bucketed_store import BucketedStore
from linesieve.sources.captures import read_capture_lines
from linesieve.sources.outputs import explode_lines, outputs_from_text, spread, with_output_defaults
from linesieve.sources.store_tables import append_runs, read_artifacts, read_runs, write_artifacts
from linesieve.streaming.jobs import current_artifacts, stream_run_totals, stream_upsert_artifacts

HOUR = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir, *columns) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns))


def doc_lines(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir, "text")
    return explode_lines(docs.select(F.col("doc_id").alias(ID), "text"), normalize=True)


def doc_outputs(spark, sf_dir, **values) -> DataFrame:
    return outputs_from_text(spread(table(spark, sf_dir, "documents")), "doc_id", "text", **values)


# ---- documents: shape and single lines ----------------------------------------------------------

def doc_line_stats(spark, sf_dir):
    docs = documents(spark, sf_dir, "lang", "text")
    lines = line_count("text")
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(lines).alias("lines"), F.max(lines).alias("longest"),
        F.sum(F.octet_length("text")).cast("long").alias("bytes"),
    )


def doc_token_estimate(spark, sf_dir):
    return documents(spark, sf_dir, "text").select("doc_id", estimate_tokens("text").alias("tokens"))


def doc_content_id(spark, sf_dir):
    raw = F.col("text").cast("binary")
    return documents(spark, sf_dir, "text").select(
        "doc_id", content_digest(raw).alias("sha256"), content_id(raw).alias("id")
    )


def doc_secret_scan(spark, sf_dir):
    return documents(spark, sf_dir, "text").where(contains_secret("text")).select("doc_id")


def doc_critical_lines(spark, sf_dir):
    return extract_critical_lines(doc_lines(spark, sf_dir))


def doc_dup_runs(spark, sf_dir):
    return duplicate_runs(doc_lines(spark, sf_dir)).where("run > 1").select(ID, NO, LINE, "run")


def doc_dup_collapse_view(spark, sf_dir):
    return assemble_view(collapse_consecutive_duplicates(doc_lines(spark, sf_dir))).drop("tags")


def doc_grep_context(spark, sf_dir):
    return assemble_view(grep_context(doc_lines(spark, sf_dir), "[0-9]{3}", 2)).select(ID, "view")


def doc_window_gaps(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    hits = anchor_rows(lines, 3, 2, F.contains(F.col(LINE), F.lit("error")))
    return render_windows(lines, expand_windows(hits, 1)).select(ID, "o1", "o2", LINE, "dropped")


def doc_head_tail(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    part = lambda df, name: df.select(F.lit(name).alias("part"), ID, NO, LINE)
    return (
        part(head_lines(lines, 3), "head").unionByName(part(tail_lines(lines, 2), "tail"))
        .unionByName(part(slice_lines(lines, 4, 6), "slice"))
    )


def doc_spread_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return spread_sample(docs, ["source"], "doc_id", 12).select("source", "doc_id", "idx", "n_items")


def doc_template_counts(spark, sf_dir):
    counts = log_template_counts(doc_lines(spark, sf_dir))
    return counts.select(ID, "template", "n", "first_no", "first_line")


# ---- documents: reduction and decision -----------------------------------------------------------

def doc_generic_reduce(spark, sf_dir):
    return assemble_view(reduce_generic(doc_lines(spark, sf_dir), "safe")).drop("tags")


def doc_eligibility(spark, sf_dir):
    sized = eligibility(doc_outputs(spark, sf_dir))
    return sized.groupBy(F.coalesce("skip_reason", F.lit("eligible")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("raw_lines").alias("lines")
    )


def doc_results(spark, sf_dir, **values) -> DataFrame:
    return compact_corpus(doc_outputs(spark, sf_dir, **values))


def doc_decision(spark, sf_dir):
    return doc_results(spark, sf_dir, min_bytes=0, min_lines=0, min_savings_ratio=0.0).select(
        ID, "kind", "transformed", "quality_passed", "fallback_reason", "artifact_id", "raw_bytes", "compact_bytes",
        "raw_lines", "compact_lines", "raw_tokens_est", "compact_tokens_est", "omitted_lines",
    )


# Captured outputs made of the tables' rows: kind, command, table, id cut into blocks, block span, order in the block, line.
ROUTE_PARTS = [
    ("log", ["tail", "x.log"], "events", "event_id", 200, "event_id", "concat('INFO ', event_type, ' event=', event_id)"),
    ("json", ["curl", "x"], "events", "event_id", 200, "event_id", "coalesce(props, 'null')"),
    ("test", ["pytest"], "lineitem", "l_orderkey", 100, "l_linenumber", "concat('tests/part_', l_partkey, '.py PASSED')"),
    ("tree", ["find", "."], "pages", "page_id", 200, "page_id", "concat('site', page_id % 3, '/p', page_id, '.html')"),
    ("search", ["rg", "x"], "orders", "o_orderkey", 400, "o_orderkey", "concat('c', o_custkey % 7, '.py:', o_orderkey, ':pay(x)')"),
    ("git_status", ["git", "status"], "orders", "o_orderkey", 400, "o_orderkey", "concat('\tmodified:   o/', o_orderkey)"),
    ("git_log", ["git", "log"], "customer", "c_custkey", 200, "c_custkey", "concat('commit ', c_custkey)"),
    ("git_diff", ["git", "diff"], "supplier", "s_suppkey", 100, "s_suppkey", "concat('+', s_suppkey)"),
    ("generic", ["mytool"], "part", "p_partkey", 200, "p_partkey", "concat('row ', p_partkey)"),
]


def route_outputs(spark, sf_dir) -> DataFrame:
    """Outputs for every route; a block of ids bounds each text."""
    made = []
    for kind, command, source, key, span, order, line in ROUTE_PARTS:
        name = F.concat(F.lit(f"{kind}-"), F.floor(F.col(key) / span).cast("string"))
        rows = table(spark, sf_dir, source).select(
            name.alias("name"), F.struct(F.col(key).alias("a"), F.col(order).alias("b"), F.expr(line).alias("line")).alias("r")
        )
        lines = F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"])
        joined = F.array_join(lines, "," if kind == "json" else "\n")
        text = F.concat(F.lit("["), joined, F.lit("]")) if kind == "json" else joined
        command = F.array(*[F.lit(w) for w in command])
        made.append(rows.groupBy("name").agg(text.alias("text")).select("name", "text", command.alias("command")))
    texts = reduce(DataFrame.unionByName, made)
    return outputs_from_text(
        texts, "name", "text", command=F.col("command"), min_bytes=F.lit(0), min_lines=F.lit(0)
    )


def route_ids_conserved(spark, sf_dir):
    """Every output of every route has one result of the right kind that is no longer than its original."""
    results = compact_corpus(route_outputs(spark, sf_dir))
    return results.select(
        ID, "kind", "raw_bytes", "raw_lines", (F.col("compact_bytes") <= F.col("raw_bytes")).alias("not_longer")
    )


def doc_run_totals(spark, sf_dir):
    return run_totals(doc_results(spark, sf_dir))


def doc_savings_by_kind(spark, sf_dir):
    return savings_by_kind(doc_results(spark, sf_dir))


def doc_corpus_summary(spark, sf_dir):
    return corpus_summary(doc_results(spark, sf_dir, min_bytes=0, min_lines=0, min_savings_ratio=0.0))


def doc_savings_by_profile(spark, sf_dir):
    outputs = doc_outputs(spark, sf_dir, min_bytes=0, min_lines=0, min_savings_ratio=0.0)
    out = savings_by_profile(compact_corpus(outputs, profiles=PROFILES))
    return out.select(
        "profile", "kind", F.col("level").cast("long").alias("level"), "cases", "transformed", "raw_bytes",
        "compact_bytes", F.round("byte_savings_ratio", 9).alias("byte_savings_ratio"),
    )


def doc_containment_check(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    # Parts of lines with numbers: whole-line equality does not settle them.
    needed = lines.where(F.col(LINE).rlike("[0-9]{3}")).select(ID, F.substring(LINE, 3, 30).alias(LINE))
    edges = anchor_rows(lines, 3, 2)
    return containment_check(needed, edges).select(ID, "needed", "missing", "passed")


def doc_containment_whole(spark, sf_dir):
    """All lines that aren't empty, whole, in views of the first and last lines with text around them.

    Every second view line lacks the last character of its line, however long that is.
    """
    lines = doc_lines(spark, sf_dir)
    needed = lines.where(F.col(LINE) != "").select(ID, LINE)
    whole = F.when(F.col(NO) % 2 == 0, F.col(LINE)).otherwise(F.substring(LINE, F.lit(1), F.length(LINE) - 1))
    edges = anchor_rows(lines, 3, 2).withColumn(LINE, F.concat(F.lit("> "), whole, F.lit(" <")))
    return containment_check(needed, edges).select(ID, "needed", "missing", "passed")


def doc_label_lookup(spark, sf_dir):
    docs = documents(spark, sf_dir, "text")
    joined = label_lookup(docs, table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("quality", "toxic").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(line_count("text")).alias("lines")
    )


def doc_anchor_gate(spark, sf_dir):
    """Function words per language as anchor groups: all groups, any alternative."""
    words = {"en": [["The ", "and "], ["tion"]], "fr": [["les ", "eau"], ["ment"]], "de": [["der ", "und "], ["ung"]],
             "es": [["que ", "los "], ["cion", "ando"]]}
    docs = documents(spark, sf_dir, "lang", "text").withColumnRenamed("doc_id", "case")
    rows = [(lang, g, w) for lang, groups in words.items() for g, ws in enumerate(groups) for w in ws]
    by_lang = F.create_map(
        *[
            x for lang in words for x in (
                F.lit(lang),
                F.array(*[F.struct(F.lit(g).alias("group_no"), F.lit(w).alias("alternative")) for l, g, w in rows if l == lang]),
            )
        ]
    )
    anchors = docs.select("case", F.explode(F.element_at(by_lang, F.col("lang"))).alias("a")).select("case", "a.*")
    return anchor_gate(docs.select("case", "text"), anchors)


# ---- documents: store -----------------------------------------------------------------------------

def doc_artifacts(spark, sf_dir) -> DataFrame:
    """Documents as puts; the document number stands for the time of the put."""
    raw = F.col("text").cast("binary")
    return documents(spark, sf_dir, "text", "source").select(
        F.col("doc_id"), content_digest(raw).alias("sha256"), F.col("doc_id").alias("created_at"),
        F.col("source").alias("cwd"), raw.alias("payload"),
    )


def artifact_upsert(spark, sf_dir):
    newest = latest_puts(doc_artifacts(spark, sf_dir))
    return newest.select(
        F.substring("sha256", 1, 16).alias("id"), "sha256", "created_at", "cwd",
        F.octet_length("payload").cast("long").alias("raw_bytes"),
    )


def artifact_ids(spark, sf_dir):
    puts = doc_artifacts(spark, sf_dir).select("sha256", "created_at")
    firsts = puts.groupBy("sha256").agg(F.min("created_at").alias("created_at"))
    return assign_ids(firsts).select("sha256", "id", "created_at")


def artifact_short_ids(spark, sf_dir):
    """The same rule with short prefixes, so that prefixes collide."""
    puts = doc_artifacts(spark, sf_dir).select("sha256", "created_at")
    firsts = puts.groupBy("sha256").agg(F.min("created_at").alias("created_at"))
    return assign_ids(firsts, None, [2, 3, 4, 64]).select("sha256", "id", "created_at")


def stored_documents(spark, sf_dir) -> DataFrame:
    newest = latest_puts(doc_artifacts(spark, sf_dir))
    return newest.withColumn("id", F.substring("sha256", 1, 16))


def artifact_prefix_lookup(spark, sf_dir):
    """Each document asks for its content by the first 4 to 64 characters of its digest, some in capitals, and those of
    one source by no id at all. Contents have their digest as id, and half of them its first 16 characters as well."""
    docs = documents(spark, sf_dir, "text", "source").withColumn("sha256", content_digest(F.col("text").cast("binary")))
    start = F.expr("substring(sha256, 1, 4 + cast(doc_id % 61 as int))")
    asked = docs.select(
        F.when(F.col("source") == "src1", F.concat(F.lit("%"), F.col("source")))
        .when(F.col("doc_id") % 7 == 0, F.upper(start)).otherwise(start).alias("prefix")
    )
    short = docs.where("sha256 < '8'").select(F.substring("sha256", 1, 16).alias("id"))
    return lookup_artifacts(asked, docs.select(F.col("sha256").alias("id")).unionByName(short))


def _put_rows(docs: DataFrame, created_at: Column) -> DataFrame:
    """Documents as rows to put: exact bytes with their facts."""
    raw = F.col("text").cast("binary")
    return docs.select(
        content_digest(raw).alias("sha256"), created_at.alias("created_at"), F.array(F.lit("cat"), F.col("source")).alias("command"),
        F.col("source").alias("cwd"), F.lit(0).alias("exit_code"), F.lit("generic").alias("kind"), F.lit("bytes").alias("encoding"),
        raw.alias("payload"), F.octet_length(raw).cast("long").alias("raw_bytes"), line_count("text").alias("raw_lines"),
    )


def store_second_put(spark, sf_dir):
    """The bucketed store after a put of all documents and one of every second document a day later: contents put again
    keep their id and get the later time."""
    docs = documents(spark, sf_dir, "text", "source")
    first = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    store = BucketedStore(spark, f"{_work_dir(spark)}/store")
    store.put(_put_rows(docs, first))
    store.put(_put_rows(docs.where("doc_id % 2 = 0"), first + F.make_interval(days=F.lit(1))))
    return store.read().select(
        "id", "sha256", F.unix_seconds("created_at").alias("put_at"), "cwd", content_digest("payload").alias("payload_sha256")
    )


def store_purge(spark, sf_dir):
    """What is left of artifacts and runs on disk after those older than three days were purged, twice.

    Documents are put an hour apart by their number; the cut lies inside a day.
    """
    docs = documents(spark, sf_dir, "text", "source")
    path, at = _work_dir(spark), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600)
    rows = _put_rows(docs, at).withColumn("id", F.substring("sha256", 1, 16))
    write_artifacts(rows, f"{path}/artifacts")
    append_runs(
        rows.select(
            "created_at", F.col("id").alias("artifact_id"), "command", "kind", F.lit("safe").alias("profile"), F.lit(True).alias("transformed"),
            F.lit(True).alias("quality_passed"), F.lit(None).cast("string").alias("fallback_reason"), "raw_bytes",
            F.col("raw_bytes").alias("compact_bytes"), "raw_lines", F.col("raw_lines").alias("compact_lines"),
            F.lit(0).cast("long").alias("raw_tokens_est"), F.lit(0).cast("long").alias("compact_tokens_est"),
        ),
        f"{path}/runs",
    )
    last = rows.agg(F.max("created_at")).first()[0]
    for _ in range(2):
        purge_store(spark, f"{path}/artifacts", f"{path}/runs", last, 3)
    stored = read_artifacts(spark, f"{path}/artifacts").select(F.lit("artifact").alias("part"), "id", F.unix_seconds("created_at").alias("put_at"))
    runs = read_runs(spark, f"{path}/runs").select(F.lit("run").alias("part"), F.col("artifact_id").alias("id"), F.unix_seconds("created_at").alias("put_at"))
    return stored.unionByName(runs)


def artifact_verify(spark, sf_dir):
    """Stored bytes whose numbers were blanked no longer have their digest."""
    blanked = F.regexp_replace(F.col("payload").cast("string"), "[0-9]{3}", "###").cast("binary")
    return verify_artifacts(doc_artifacts(spark, sf_dir).withColumn("payload", blanked)).select("doc_id")


def artifact_recovery(spark, sf_dir):
    docs = documents(spark, sf_dir, "text")
    results = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).withColumn("artifact_id", content_id("raw"))
    checked = recovery_check(results, stored_documents(spark, sf_dir))
    return checked.select("doc_id", "artifact_id", "recovered")


def secret_not_stored(spark, sf_dir):
    """Documents with a secret, and whether the store holds them after the whole job has put all documents: it
    does not. The store's rows are counted from its files."""
    outputs = doc_outputs(spark, sf_dir)
    path = _work_dir(spark)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    compact_and_store(outputs, f"{path}/artifacts", f"{path}/runs", at)
    stored = read_artifacts(spark, f"{path}/artifacts", ["sha256"]).withColumn("stored", F.lit(True))
    secret = outputs.where(contains_secret(F.col("raw").cast("string")))
    held = secret.select(ID, content_digest("raw").alias("sha256")).join(stored, "sha256", "left")
    return held.select(ID, F.coalesce("stored", F.lit(False)).alias("stored"))


def artifact_show(spark, sf_dir):
    """Every stored text asked by its id, searched for three-digit numbers with one line of context."""
    stored = stored_documents(spark, sf_dir)
    asked = stored.select(F.col("id").alias("prefix"))
    return assemble_view(show(asked, stored, pattern="[0-9]{3}", context=1)).select(ID, "view")


def artifact_expire(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "created_at")
    as_of = F.lit("1998-12-31 00:00:00").cast("timestamp")
    return expire(orders, as_of, 365).select("o_orderkey")


def newest_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("kind")
    )
    return recent_artifacts(orders, 20).select("id", "kind")


# ---- events as logs -------------------------------------------------------------------------------

def event_level() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "error", "ERROR").when(kind == "signup", "WARNING").otherwise("INFO")


def event_lines(spark, sf_dir) -> DataFrame:
    """One log per user, ordered by time; numbered in blocks of an hour, so a busy user is no long window."""
    text = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z "), event_level(), F.lit(" "), F.col("event_type"),
        F.lit(" value="), F.col("value").cast("decimal(18,2)").cast("string"),
        F.lit(" k="), F.get_json_object("props", "$.k"),
    )
    events = spread(table(spark, sf_dir, "events")).select(
        "user_id", "event_id", "ts", text.alias(LINE), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")
    )
    placed = numbered(events, ["user_id"], ["ts", "event_id"], "at", HOUR, NO, N)
    return placed.select(F.col("user_id").alias(ID), NO, N, LINE, "event_id")


def event_log_lines(spark, sf_dir):
    return event_lines(spark, sf_dir).select(
        ID, NO, "event_id", LINE, severity_level(LINE).alias("level"), severity_class(LINE).alias("class")
    )


def capture_line_table(spark, sf_dir):
    """Captures of a hundred documents each, written as text files and read in byte ranges: lines, bytes and a checksum
    that holds every line to its number."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).cast("long").alias("capture"), "doc_id", "text")
    path = f"{_work_dir(spark)}/captures"
    docs.repartition("capture").sortWithinPartitions("capture", "doc_id").select("capture", "text").write.partitionBy("capture").text(path)
    lines = read_capture_lines(spark, path).withColumn("capture", F.regexp_extract(ID, "capture=([0-9]+)", 1).cast("long"))
    size = F.length(LINE).cast("long")
    return lines.groupBy("capture").agg(
        F.count(F.lit(1)).alias("lines"), F.max(N).alias("n_lines"), F.sum(F.octet_length(LINE).cast("long")).alias("bytes"),
        F.sum((F.col(NO) + 1) * size).alias("checksum"),
    )


def kinds_by_line_statistics(spark, sf_dir):
    """Kind and route of outputs without a telling command, found from counts over their lines."""
    block = lambda key, span: F.floor(F.col(key) / span).cast("string")
    made = [
        ("log", "events", block("event_id", 200), "event_id", F.lit(0), "concat(if(event_id % 40 = 0, 'ERROR ', 'saw '), event_type)"),
        ("dense", "events", block("event_id", 200), "event_id", F.lit(0), "concat('INFO ', event_type)"),
        ("test", "lineitem", block("l_orderkey", 100), "l_orderkey", F.col("l_linenumber"),
         "if(l_linenumber = 1, concat('collected ', l_orderkey, ' items'), concat('Tests: ', l_partkey))"),
        ("diff", "supplier", block("s_suppkey", 50), "s_suppkey", F.lit(0), "concat('@@ -', s_suppkey, ' +1 @@')"),
        ("plain", "part", block("p_partkey", 200), "p_partkey", F.lit(0), "concat('row ', p_partkey)"),
    ]
    rows = []
    for name, source, part, first, second, line in made:
        rows.append(table(spark, sf_dir, source).select(
            F.concat(F.lit(f"{name}-"), part).alias(ID), F.col(first).cast("long").alias("a"), second.cast("long").alias("b"), F.expr(line).alias(LINE)
        ))
    lines = numbered(reduce(DataFrame.unionByName, rows), [ID], ["a", "b"], "a", 1 << 16, NO, N).select(ID, NO, N, LINE)
    facts = with_output_defaults(lines.select(ID).distinct())
    found = classify_lines(facts, line_signs(lines))
    return found.select(ID, "kind", "detection_reason", "route", "raw_lines", "severe", "markers")


def long_log_parts(spark, sf_dir):
    """The logs of all users, given as lines, through the whole job: the parts of the accepted views, 20 lines each, and
    the places of their first bytes."""
    lines = event_lines(spark, sf_dir).select(ID, NO, N, LINE)
    sizes = lines.groupBy(ID).agg(F.sum(F.octet_length(LINE) + 1).cast("long").alias("raw_bytes"))
    facts = with_output_defaults(sizes, min_bytes=0, min_lines=0, min_savings_ratio=0.0)
    _, parts = compact_lines(lines, facts, part_lines=20)
    return parts.where("part > 0").select(ID, "part", "offset", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def long_log_results(spark, sf_dir):
    """Decisions for the logs of all users, given as lines."""
    lines = event_lines(spark, sf_dir).select(ID, NO, N, LINE)
    sizes = lines.groupBy(ID).agg(F.sum(F.octet_length(LINE) + 1).cast("long").alias("raw_bytes"))
    facts = with_output_defaults(sizes, min_bytes=0, min_lines=0, min_savings_ratio=0.0)
    results, _ = compact_lines(lines, facts, part_lines=20)
    return results.select(ID, "kind", "detection_reason", "transformed", "quality_passed", "raw_bytes", "compact_bytes", "raw_lines", "compact_lines", "omitted_lines")


def event_critical_lines(spark, sf_dir):
    """Decisive lines of each user's log, without the time stamps (which would all count as places)."""
    bare = event_lines(spark, sf_dir).withColumn(LINE, F.expr("substring(line, 26)"))
    return extract_critical_lines(bare)


def event_log_reduce(spark, sf_dir):
    return reduce_log(event_lines(spark, sf_dir).drop("event_id"), "safe").select(ID, "o1", "o2", LINE, "dropped")


def event_template_counts(spark, sf_dir):
    counts = log_template_counts(event_lines(spark, sf_dir).drop("event_id"))
    return counts.select(ID, "template", "n", "first_no", "first_line")


def event_severity_density(spark, sf_dir):
    """The log rule of the detector per user: severity words against the number of lines."""
    lines = event_lines(spark, sf_dir)
    hits = F.count_if(F.col(LINE).rlike(P.SEVERITY_WORDS) & (severity_class(LINE) != "other"))
    counts = lines.groupBy(ID).agg(F.count(F.lit(1)).alias("lines"), hits.alias("hits"))
    return counts.withColumn("is_log", F.col("hits") >= F.greatest(F.lit(8), F.floor(F.col("lines") / 8)))


def progress_lines(spark, sf_dir) -> DataFrame:
    text = F.concat(
        F.lit("Processing "), F.col("event_type"), F.lit(" ["), F.get_json_object("props", "$.k"), F.lit("%]")
    )
    lines = event_lines(spark, sf_dir).drop(LINE)
    events = table(spark, sf_dir, "events").select("event_id", text.alias(LINE))
    return lines.join(events, "event_id").drop("event_id")


def event_progress_families(spark, sf_dir):
    rows = progress_lines(spark, sf_dir).select(
        ID, F.col(NO).alias("o1"), F.lit(0).cast("long").alias("o2"), F.lit(0).cast("long").alias("o3"), LINE,
        F.lit(0).cast("long").alias("dropped"), F.lit(None).cast("string").alias("tag"),
    )
    return progress_families(rows).select(ID, "template", F.col("first_pos.o1").alias("first_no"), LINE, "n")


def event_progress_reduce(spark, sf_dir):
    return reduce_generic(progress_lines(spark, sf_dir), "safe").select(ID, "o1", "o2", LINE, "dropped")


def event_props_numeric_summary(spark, sf_dir):
    events = spread(table(spark, sf_dir, "events"))
    record = F.try_variant_get(F.try_parse_json("props"), "$", "map<string,variant>")
    out = numeric_summary_of_maps(events, ["event_type"], record)
    return out.select("event_type", "field", "n", "min", "max", F.round("mean", 6).alias("mean"))


def event_json_nodes(spark, sf_dir):
    events = spread(table(spark, sf_dir, "events")).select(F.col("event_id").alias(ID), F.col("props").alias("text"))
    return json_nodes(events).select(ID, "depth", "key", "json")


def event_json_minify(spark, sf_dir):
    return spread(table(spark, sf_dir, "events")).select("event_id", minify_json("props").alias("props"))


def event_argv_redact(spark, sf_dir):
    """Calls with credentials in four forms, one form per event type."""
    value, kind = F.col("value").cast("decimal(18,2)").cast("string"), F.col("event_type")
    call = lambda *a: F.array(F.lit("run"), *a, F.lit("--verbose"))
    argv = (
        F.when(kind == "click", call(F.lit("--password"), value))
        .when(kind == "view", call(F.concat(F.lit("token="), value)))
        .when(kind == "purchase", call(F.lit("Authorization:"), value))
        .when(kind == "signup", call(F.concat(F.lit("https://h/p?api_key="), value), F.lit("--token"), F.lit("password")))
        .otherwise(call(F.lit("--user"), value))
    )
    return spread(table(spark, sf_dir, "events")).select(
        "event_id", F.array_join(redact_command(argv), " ").alias("command")
    )


# ---- JSON texts from documents ---------------------------------------------------------------------

def doc_json(spark, sf_dir) -> DataFrame:
    """Each document as a JSON text with one object per line."""
    docs = documents(spark, sf_dir, "text")
    items = F.transform(
        F.filter(F.split("text", "\n"), lambda x: x != ""),
        lambda x, i: F.struct(i.alias("i"), F.length(x).alias("chars"), x.alias("message")),
    )
    body = F.to_json(F.struct(F.col("doc_id").alias("doc"), items.alias("lines")))
    return docs.select(F.col("doc_id").alias(ID), body.alias("text"))


def doc_json_reduce(spark, sf_dir):
    out = reduce_json(doc_json(spark, sf_dir), "safe")
    sampled = F.regexp_extract("view", r'"sampled_items": (\d+)', 1)
    kept = F.size(F.regexp_extract_all("view", F.lit(r'"_index": (\d+)'), F.lit(1)))
    return out.select(
        ID, "omitted_lines", F.when(sampled == "", None).otherwise(sampled).cast("long").alias("sampled_items"),
        kept.cast("long").alias("kept"), json_value("view").isNotNull().alias("valid"),
    )


def doc_json_critical(spark, sf_dir):
    docs = doc_json(spark, sf_dir).withColumn("compact", F.to_json(json_value("text")))
    found = critical_values("compact")
    return docs.select(
        ID, is_critical_json(F.col("compact")).alias("critical"), F.size(found).cast("long").alias("critical_values")
    )


# ---- records ----------------------------------------------------------------------------------------

def order_record_sample(spark, sf_dir):
    orders = spread(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"))
    out = sample_records(orders, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "F", 12)
    return out.select("o_custkey", "o_orderkey", "_index", "total_items", "sampled_items")


def order_numeric_summary(spark, sf_dir):
    out = numeric_summary(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_totalprice"])
    return out.select("o_custkey", "field", "n", "min", "max", F.round("mean", 6).alias("mean"))


def lineitem_record_sample(spark, sf_dir):
    items = spread(
        table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"]
    out = sample_records(items, ["l_suppkey"], order, F.col("l_returnflag") == "R", 6)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "_index", "total_items", "sampled_items")


# ---- listings ---------------------------------------------------------------------------------------

def page_lines(spark, sf_dir) -> DataFrame:
    """One listing per scheme, hosts as top components."""
    pages = spread(table(spark, sf_dir, "pages")).select(
        "page_id", F.regexp_extract("url", "^(https?)://", 1).alias(ID), F.regexp_replace("url", "^https?://", "").alias(LINE)
    )
    return numbered(pages, [ID], ["page_id"], "page_id", index=NO, total=N).select(ID, NO, N, LINE)


def page_url_tree(spark, sf_dir):
    return reduce_listing(page_lines(spark, sf_dir), "safe").select(ID, "o1", "o2", "o3", LINE, "dropped")


def page_extension_histogram(spark, sf_dir):
    items = page_lines(spark, sf_dir).withColumnRenamed(LINE, "value")
    return extension_histogram(items, [ID]).select(ID, "suffix", "n", "first_no", F.col("rank").cast("long").alias("rank"))


# ---- search -----------------------------------------------------------------------------------------

def match_lines(spark, sf_dir) -> DataFrame:
    """All document lines as search matches, one output per language."""
    docs = documents(spark, sf_dir, "lang", "source", "text")
    lines = explode_lines(docs, normalize=True)
    path = F.concat_ws("/", "source", "doc_id")
    rows = lines.select(
        F.col("lang").alias(ID), "doc_id", F.col(NO).alias("at"),
        F.concat(path, F.lit(":"), (F.col(NO) + 1).cast("string"), F.lit(":"), F.col(LINE)).alias(LINE),
    )
    return numbered(rows, [ID], ["doc_id", "at"], "doc_id", 4096, NO, N).select(ID, NO, LINE)


MATCH_SPAN = 1 << 16


def match_parse(spark, sf_dir):
    return parse_matches(match_lines(spark, sf_dir)).select(ID, NO, "path", "match_line", "sep", "body")


def chosen_matches(spark, sf_dir) -> DataFrame:
    return sample_matches(parse_matches(match_lines(spark, sf_dir)), F.lit(6), MATCH_SPAN)


def search_group_sample(spark, sf_dir):
    return chosen_matches(spark, sf_dir).select(ID, "path", "match_line", "idx", "n_matches", "is_error")


def search_body_aliases(spark, sf_dir):
    return alias_repeated_bodies(chosen_matches(spark, sf_dir), MATCH_SPAN).select(ID, "body", "repeats", "alias")


def search_reduce(spark, sf_dir):
    return reduce_search(match_lines(spark, sf_dir), "safe", MATCH_SPAN).select(ID, "o1", "o2", "o3", LINE, "dropped")


# ---- sections, reports and test runs ------------------------------------------------------------------

def section_carry(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    header = F.when(F.col("role") == "user", F.col("text"))
    return carry_section(turns, ["conv_id"], "turn", header).select("conv_id", "turn", "section")


def commit_lines(spark, sf_dir) -> DataFrame:
    """Each conversation as a commit log, one commit per turn."""
    turns = spread(table(spark, sf_dir, "conversations"))
    head = F.concat(
        F.lit("commit "), F.col("turn").cast("string"), F.lit("\nAuthor: "), F.col("role"), F.lit("\n\n"), F.col("text"),
        F.lit("\n\n"),
    )
    lines = explode_lines(turns.select("conv_id", "turn", head.alias("text")), normalize=True)
    rows = lines.withColumnRenamed(NO, "at").drop(N)
    placed = numbered(rows, ["conv_id"], ["turn", "at"], "turn", 64, NO, N)
    return placed.select(F.col("conv_id").alias(ID), NO, N, LINE)


def commit_body_cap(spark, sf_dir):
    return cap_commit_bodies(commit_lines(spark, sf_dir)).select(ID, "o1", LINE, "dropped")


def order_status_report(spark, sf_dir):
    """Each customer's orders as a status report: staged, unstaged and untracked entries."""
    state = F.col("o_orderstatus")
    line = (
        F.when(state == "F", F.concat(F.lit("\tmodified:   orders/"), F.col("o_orderkey").cast("string")))
        .when(state == "O", F.concat(F.lit("\tnew file:   orders/"), F.col("o_orderkey").cast("string")))
        .otherwise(F.concat(F.lit("?? orders/"), F.col("o_orderkey").cast("string")))
    )
    orders = spread(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"))
    parts = F.array(
        F.when(state == "F", F.lit("Changes not staged for commit:")),
        F.when(state == "O", F.lit("Changes to be committed:")),
        line,
    )
    rows = orders.select("o_custkey", "o_orderkey", F.posexplode(parts).alias("p", LINE)).where(F.col(LINE).isNotNull())
    rows = rows.withColumn("at", F.col("o_orderkey") * 3 + F.col("p"))
    placed = numbered(rows, ["o_custkey"], ["at"], "at", index=NO, total=N)
    report = group_git_status(placed.select(F.col("o_custkey").alias(ID), NO, N, LINE))
    return report.select(ID, "o1", "o2", "o3", LINE, "dropped")


def supplier_test_lines(spark, sf_dir) -> DataFrame:
    """Each supplier's items as a test run, large discounted orders as failures."""
    bad = (F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.1)
    line = F.concat(
        F.lit("tests/part_"), F.col("l_partkey").cast("string"), F.lit(".py::order_"), F.col("l_orderkey").cast("string"),
        F.lit("_"), F.col("l_linenumber").cast("string"), F.when(bad, F.lit(" FAILED")).otherwise(F.lit(" PASSED")),
    )
    rows = spread(
        table(spark, sf_dir, "lineitem").select(
            "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", line.alias(LINE), F.lit(0).alias("exit_code")
        )
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", LINE]
    placed = numbered(rows, ["l_suppkey"], order, "l_orderkey", index=NO, total=N)
    return placed.select(F.col("l_suppkey").alias(ID), NO, N, LINE, "exit_code")


def supplier_test_reduce(spark, sf_dir):
    return reduce_test(supplier_test_lines(spark, sf_dir), "safe").select(ID, "o1", "o2", LINE, "dropped")


# ---- streams ------------------------------------------------------------------------------------------

def _stream(spark, sf_dir, name: str) -> DataFrame:
    """The files of a table as a stream: those of its folder, or the table's one file among its neighbours."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    read = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return read.parquet(f"{sf_dir}/{name}.parquet")
    # Spark takes the path for a base of partitions, which a file can't be.
    return read.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _work_dir(spark) -> str:
    from linesieve.sources.staging import shared_dir
    import uuid
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def event_stream_totals(spark, sf_dir):
    """Daily totals of a stream of runs; the last days stay open behind the watermark."""
    events = _stream(spark, sf_dir, "events")
    size = F.col("value").cast("long")
    runs = events.select(
        F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("kind"),
        (F.col("event_type") != "error").alias("transformed"), (F.col("event_type") != "signup").alias("quality_passed"),
        (size + 10).alias("raw_bytes"), size.alias("compact_bytes"),
    )
    path = _work_dir(spark)
    query = (
        stream_run_totals(runs).writeStream.outputMode("append").option("checkpointLocation", f"{path}/ck")
        .trigger(availableNow=True).format("parquet").start(f"{path}/out")
    )
    query.awaitTermination()
    totals = spark.read.parquet(f"{path}/out")
    return totals.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def doc_stream_upsert(spark, sf_dir):
    """The store after a stream of puts: newest row per content."""
    docs = _stream(spark, sf_dir, "documents")
    raw = F.col("text").cast("binary")
    puts = docs.select(
        content_digest(raw).alias("sha256"), F.timestamp_seconds("doc_id").alias("created_at"),
        F.array().cast("array<string>").alias("command"), F.col("source").alias("cwd"), F.lit(0).alias("exit_code"),
        F.lit("generic").alias("kind"), F.lit("bytes").alias("encoding"), raw.alias("payload"),
        F.octet_length(raw).cast("long").alias("raw_bytes"), line_count("text").alias("raw_lines"),
    )
    path = _work_dir(spark)
    stream_upsert_artifacts(puts, f"{path}/out", f"{path}/ck").awaitTermination()
    now = current_artifacts(spark, f"{path}/out")
    return now.select("id", "sha256", F.unix_seconds("created_at").alias("put_no"), "cwd", "raw_bytes")


QUERIES = [
    doc_line_stats, doc_token_estimate, doc_content_id, doc_secret_scan, doc_critical_lines, doc_dup_runs,
    doc_dup_collapse_view, doc_grep_context, doc_window_gaps, doc_head_tail, doc_spread_sample, doc_template_counts,
    doc_generic_reduce, doc_eligibility, doc_decision, doc_run_totals, doc_savings_by_kind, doc_corpus_summary,
    doc_savings_by_profile, doc_containment_check, doc_containment_whole, doc_label_lookup, doc_anchor_gate, artifact_upsert,
    artifact_ids, artifact_short_ids, artifact_prefix_lookup, artifact_verify, artifact_recovery, secret_not_stored, artifact_show,
    store_second_put, store_purge, capture_line_table, kinds_by_line_statistics, long_log_parts, long_log_results,
    artifact_expire, newest_orders, event_log_lines, event_critical_lines, event_log_reduce, event_template_counts, event_severity_density,
    event_progress_families, event_progress_reduce, event_props_numeric_summary, event_json_nodes, event_json_minify,
    event_argv_redact, doc_json_reduce, doc_json_critical, order_record_sample, order_numeric_summary,
    lineitem_record_sample, page_url_tree, page_extension_histogram, match_parse, search_group_sample,
    search_body_aliases, search_reduce, section_carry, commit_body_cap, order_status_report, supplier_test_reduce,
    event_stream_totals, doc_stream_upsert, route_ids_conserved,
]
