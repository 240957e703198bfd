"""The pipeline stage by stage over a small folder of tables, against its parts."""

from __future__ import annotations

import random

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    texts = [f"Plain text number {k} with words of its own: " + " ".join(f"t{k}x{j}" for j in range(30)) for k in range(30)]
    texts += [texts[0], "  ".join(texts[1].split(" ")), texts[2].replace("t2x29", "other"), None, ""]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids.append({r.doc_id for r in docs.collect()})
    assert set(range(30)) <= ids[0]
    assert ids[1] == ids[0] - {30, 31, 34}
    assert ids[2] == ids[1] - {32}
    assert ids[3] == ids[2]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids[3]


def test_stages_after_deduplication_on_shared_passages(spark, tmp_path):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    common = letters(60)
    rows = [(k, letters(200) + common + letters(200)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, "")
    assert {(r.doc_id, r.text) for r in docs.collect()} == set(rows)


def test_no_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_at_the_general_threshold(spark):
    words = [f"w{k}" for k in range(50)]
    rows = []
    for k in range(20):
        base = [f"{k}{w}" for w in words]
        # One word in 50 changed: 41 of 51 shingles are common. Two words: 36 of 56.
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base[:25], "other", *base[26:]]))]
        rows += [(10 * k + 2, " ".join([*base[:15], "other", *base[16:35], "other", *base[36:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {10 * k + j for k in range(20) for j in (0, 2)}
