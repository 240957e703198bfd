"""Views made inside the row of their text: equal to those of line tables, and no text is exchanged for them."""

from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from linesieve.functions.knobs import PROFILES
from linesieve.operators.detect import under_profiles
from linesieve.operators.lines import ID, assemble_view
from linesieve.operators.reduce_text import reduce_generic, reduce_generic_cell
from linesieve.plans import compact
from linesieve.plans.compact import compact_corpus
from linesieve.plans.put import compact_and_store
from linesieve.sources.outputs import explode_lines, with_output_defaults
from linesieve.sources.staging import shared_dir
from linesieve.sources.store_tables import read_artifacts, read_runs

LINES = [
    "alpha", "alpha", "Downloading 12%", "Downloading 55%", "[####  ]", "[##### ]", "Building 3 of 9", "Building 4 of 9", "10%", "a%", "",
    "ERROR: bad", "fetch 7", "x 2024-01-01T10:00:00Z", "error", "my errors", "\x1b[31mred\x1b[0m", "last",
]
RULES = {"min_bytes": 0, "min_lines": 0, "min_savings_ratio": 0.0}


def made(spark, n, most=100):
    """Texts with equal neighbours, progress of several families, both kinds of line breaks, and without any line."""
    words = F.array(*[F.lit(x) for x in LINES])
    pick = lambda i: F.get(words, F.pmod(F.xxhash64("id", F.floor(i / (F.col("id") % 4 + 1))), F.lit(len(LINES))).cast("int"))
    rows = F.transform(F.sequence(F.lit(0), F.pmod(F.xxhash64("id"), F.lit(most)).cast("int")), pick)
    text = F.when(F.col("id") % 7 == 0, F.array_join(rows, "\r\n")).otherwise(F.array_join(rows, "\n"))
    end = F.when(F.col("id") % 3 == 0, "\n").otherwise("")
    return spark.range(n).select(F.col("id").cast("string").alias(ID), F.when(F.col("id") > 1, F.concat(text, end)).when(F.col("id") == 1, "\n").alias("text"))


def counted(df):
    tidy = df.withColumns({"notes": F.sort_array("notes")})
    return Counter(str(r) for r in tidy.select(*sorted(tidy.columns)).collect())


def files_of_tasks(spark):
    """Bytes of the session's shuffle files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()))


def wide(spark, n=160, rows=600):
    """Texts of digests, which compress badly, with one run of equal lines each."""
    line = lambda i: F.sha2(F.concat_ws("-", "id", F.greatest(i, F.lit(9)).cast("string")), 256)
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(rows)), line), "\n")
    return with_output_defaults(spark.range(n).select(F.col("id").cast("string").alias(ID), text.cast("binary").alias("raw")), **RULES)


def test_a_cells_view_is_that_of_its_lines(spark):
    texts = made(spark, 200)
    for profile in PROFILES:
        lines = explode_lines(texts, normalize=True).withColumn("profile", F.lit(profile))
        by_lines = {r[ID]: (r.view, r.omitted_lines, sorted(r.tags)) for r in assemble_view(reduce_generic(lines)).collect()}
        clean = texts.select(ID, F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\x1b\\[[0-9]*m", "").alias("text"))
        cells = clean.select(ID, reduce_generic_cell(F.col("text"), F.lit(profile)).alias("v")).where("v is not null")
        assert by_lines == {r[ID]: (r.v.view, r.v.omitted_lines, sorted(r.v.tags)) for r in cells.collect()}
        tags = {t for v in by_lines.values() for t in v[2]}
        assert tags == ({"duplicate"} if profile == "strict" else {"duplicate", "progress"})


def test_results_are_those_of_line_tables_whatever_the_ids(spark, monkeypatch):
    ids = F.when(F.col(ID).isin("5", "6"), None).when(F.col(ID).cast("int") % 10 == 1, "same").otherwise(F.col(ID))
    for n, name in ((300, F.col(ID)), (90, ids)):
        rows = made(spark, n, 200).select(name.alias(ID), F.col("text").cast("binary").alias("raw"), (F.col(ID).cast("int") % 2).alias("exit_code"))
        outputs = with_output_defaults(rows.cache(), profile=F.get(F.array(*[F.lit(p) for p in PROFILES]), F.length("raw") % 3), **RULES)
        now = counted(compact_corpus(outputs))
        with monkeypatch.context() as all_by_lines:
            all_by_lines.setattr(compact, "may_need_windows", lambda n_lines, profile: F.lit(True))
            assert now == counted(compact_corpus(outputs))
        assert any("transformed=True" in r for r in now)


def test_a_put_writes_texts_once_and_exchanges_none(spark, tmp_path):
    outputs = wide(spark)
    outputs.select("raw").write.parquet(str(tmp_path / "texts"))
    size = sum(f.stat().st_size for f in (tmp_path / "texts").rglob("*.parquet"))
    before = files_of_tasks(spark)
    results = compact_and_store(outputs, str(tmp_path / "artifacts"), str(tmp_path / "runs"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert results.where("transformed").count() == 160
    stored = read_artifacts(spark, str(tmp_path / "artifacts"), ["sha256"])
    assert stored.columns == ["sha256"] and stored.distinct().count() == 160
    assert files_of_tasks(spark) - before < 0.2 * size


def test_texts_under_several_profiles_are_written_once(spark, tmp_path):
    outputs = wide(spark, 700, 100)
    outputs.select("raw").write.parquet(str(tmp_path / "texts"))
    size = sum(f.stat().st_size for f in (tmp_path / "texts").rglob("*.parquet"))
    known = set(Path(shared_dir(spark)).glob("linesieve-*"))
    before = files_of_tasks(spark)
    results = compact_corpus(outputs, profiles=PROFILES)
    counts = {r.profile: (r.n, r.done) for r in results.groupBy("profile").agg(F.count("raw_bytes").alias("n"), F.count_if("transformed").alias("done")).collect()}
    assert counts == {"strict": (700, 0), "safe": (700, 700), "max": (700, 700)}
    written = sum(f.stat().st_size for d in set(Path(shared_dir(spark)).glob("linesieve-*")) - known for f in d.rglob("*.parquet"))
    assert written < 1.3 * size and files_of_tasks(spark) - before < 0.2 * size


def test_profiles_together_are_profiles_apart(spark):
    ids = F.when(F.col(ID) == "5", None).when(F.col(ID).isin("7", "17"), "same").otherwise(F.col(ID))
    rows = made(spark, 60, 200).select(ids.alias(ID), F.col("text").cast("binary").alias("raw"))
    outputs = with_output_defaults(rows.cache(), **RULES | {"min_bytes": 40})
    assert counted(compact_corpus(outputs, profiles=PROFILES)) == counted(compact_corpus(under_profiles(outputs)))


def test_a_put_of_repeated_ids(spark, tmp_path):
    raw = lambda x: bytearray(("head\n" + "same line\n" * 40 + x).encode())
    rows = [("a", raw("1")), ("a", raw("1")), ("b", raw("1")), ("c", raw("2")), (None, raw("3"))]
    outputs = with_output_defaults(spark.createDataFrame(rows, "output_id string, raw binary"), **RULES)
    paths = str(tmp_path / "artifacts"), str(tmp_path / "runs")
    results = compact_and_store(outputs, *paths, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    # Results of an id meet all its originals; without an id there is none.
    assert Counter(r.output_id for r in results.collect()) == {"a": 4, "b": 1, "c": 1}
    assert read_runs(spark, paths[1]).count() == 6
    rows = spark.read.parquet(paths[0]).select("id", "payload").collect()
    assert sorted(bytes(r.payload)[-1:] for r in rows) == [b"1", b"2"] and len({r.id for r in rows}) == 2
