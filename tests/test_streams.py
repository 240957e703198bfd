"""Streamed queries over tables that are folders of files, as Spark writes them, and over single files."""

import os

import pytest

from linesieve.plans import catalogue, rules_catalogue

TEXTS = ["one\ntwo\ntwo\n", "one\ntwo\ntwo\n", "a line\n" * 40, "", None, "last"]


@pytest.mark.parametrize("one_file", [False, True])
def test_streams_of_documents(spark, tmp_path, one_file):
    rows = [(k, "web" if k % 2 else "book", "en", text) for k, text in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    if one_file:
        docs.coalesce(1).write.parquet(str(tmp_path / "made"))
        made = next(f for f in os.listdir(tmp_path / "made") if f.endswith(".parquet"))
        (tmp_path / "documents.parquet").write_bytes((tmp_path / "made" / made).read_bytes())
    else:
        docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs.limit(1).write.parquet(str(tmp_path / "other.parquet"))
    put = catalogue.doc_stream_upsert(spark, str(tmp_path)).collect()
    newest = {}
    for k, _, _, text in rows:
        newest[text] = k
    assert sorted(r.put_no for r in put if r.sha256 is not None) == sorted(k for text, k in newest.items() if text is not None)
    if one_file:
        return
    streamed = {tuple(r) for r in rules_catalogue.doc_stream_compact(spark, str(tmp_path)).collect()}
    assert streamed == {tuple(r) for r in catalogue.doc_decision(spark, str(tmp_path)).collect()}
    assert {r[0] for r in streamed} == set(range(len(TEXTS)))
