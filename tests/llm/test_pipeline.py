"""The pipeline's decisions on a small set with planted cases."""

import hashlib

import numpy as np

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    key = hashlib.sha1(b"p").hexdigest()
    item = text(30)
    rows = [(i, text(80), "en", f"s{i % 3}", 0) for i in range(30)]
    rows += [(50, rows[4][1] + " more", "en", "s0", 0), (51, f"{text(30)} {item} {text(30)}", "en", "s1", 0), (52, f'{text(40)} token = "{key}" {text(5)}', "en", "s2", 0), (53, "12345 !!", "en", "s0", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path)).cache()
        steps[name] = {r.doc_id for r in kept.collect()}
        if name != "source_mix":
            assert kept.columns == docs.columns
    clean = set(range(30)) | {52}
    assert steps["language_id"] == clean | {50, 51} and steps["near_duplicates"] == clean | {51} and steps["decontamination"] == clean == steps["secret_scan"]
    assert steps["source_mix"] <= clean
    assert corpus_pipeline.run(spark, str(tmp_path)).where(f"text like '%{key}%'").count() == 0
