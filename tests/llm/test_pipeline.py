import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tagloom.llm.queries import ORACLES, QUERIES


def test_stages(spark, frame, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(1000)) for _ in range(n))
    item, base = text(14), text(300)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    secret = 'token = "Zk3Jq9Xw2Lm8Pv5Tn7Rb"'
    docs = frame(
        (1, base, "a"), (2, base, "b"), (3, base + " more", "a"), (4, None, "a"), (5, "12 !", "a"), (6, text(40) + " " + item + " " + text(40), "a"),
        (7, f"é {secret} {text(30)}", "a"), (8, "secret=EXAMPLEexample " + text(30), "a"), (9, "secret=EXAMPLEexample " + text(30), "b"), (10, text(50), "b"),
    )
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    docs = cp.known_language(spark, docs, "")
    assert ids(docs) == [1, 2, 3, 6, 7, 8, 9, 10]
    docs = cp.one_of_each(spark, docs, "")
    assert ids(docs) == [1, 6, 7, 8, 9, 10]
    docs = cp.without_benchmark(spark, docs, str(tmp_path))
    assert ids(docs) == [1, 7, 8, 9, 10] and docs.columns == list(cp.COLUMNS)
    docs = cp.without_live_secrets(spark, docs, "").cache()
    found = {r.doc_id: r for r in docs.collect()}
    assert found[7].text.startswith('é [SECRET]" ') and found[7].n_chars == len(found[7].text) and "EXAMPLE" in found[8].text and len(found) == 5
    out = cp.mixed_by_source(spark, docs, "").collect()
    assert out and all(r.text == found[r.doc_id].text and 1 <= r.copy <= 3 for r in out)


def test_secret_of_two_sources_is_redacted(spark, frame):
    docs = frame((1, "token=Zk3Jq9Xw2Lm8Pv5Tn7Rb one", "a"), (2, "two token=Zk3Jq9Xw2Lm8Pv5Tn7Rb", "b"))
    assert sorted(r.text for r in cp.without_live_secrets(spark, docs, "").collect()) == ["[SECRET] one", "two [SECRET]"]


def test_redaction(spark):
    rows = spark.createDataFrame([("0é23456789", [(1, 3), (2, 5), (8, 10)]), ("abc", [(0, 3)]), ("abc", [])], "t string, s array<struct<start:int,end:int>>")
    assert [r[0] for r in rows.select(cp.redacted("t", "s")).collect()] == ["0[SECRET]567[SECRET]", "[SECRET]", "abc"]


def test_empty_documents(spark, frame, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame()
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_rows_without_values_pass_or_go(spark, frame, tmp_path):
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame((None, "some words here", None), (None, "other words there", None), (1, None, None)).withColumn("n_chars", F.lit(None).cast("long"))
    for _, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(r.text for r in docs.collect()) == ["other words there", "some words here"]


def test_documents_without_labels(spark, frame, tmp_path):
    """lang is null in all rows: texts with a letter pass every stage."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame((1, "some words here"), (2, "\u00e9\u0442\u043e other 12"), (3, None), (4, "12 !"), (5, "")).withColumn("lang", F.lit(None).cast("string"))
    for _, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert sorted((r.doc_id, r.lang) for r in docs.collect()) == [(1, None), (2, None)]
    assert {r.doc_id for r in cp.mixed_by_source(spark, docs, "").collect()} <= {1, 2}


def test_prediction_fills_missing_labels(spark, frame):
    docs = frame((1, "the cat and the dog and the bird", "a", "en"), (2, "le chat et le chien et la souris", "a", "fr"), (3, "le chien et le chat", "a"), (4, "the dog and the cat", "a"), (5, "12", "a"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") < 3, F.col("lang")))
    assert sorted((r.doc_id, r.lang) for r in cp.known_language(spark, docs, "").collect()) == [(1, "en"), (2, "fr"), (3, "fr"), (4, "en")]


def test_columns_of_any_names(spark, frame, tmp_path):
    spark.createDataFrame([(1, "x", 0)], "item_id long, text string, words int").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame((1, "some words and token=Zk3Jq9Xw2Lm8Pv5Tn7Rb", "a"), (2, "other words here", "b"))
    for name in ("live", "k", "text_key", "lang_pred", "class_id", "copies", "size", "spans", "row", "n_hit", "has_letter", "target"):
        docs = docs.withColumn(name, F.lit(7))
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(cp.COLUMNS) and {r.doc_id for r in out.collect()} == {1, 2}
    assert {r.doc_id for r in cp.mixed_by_source(spark, docs, str(tmp_path)).collect()} <= {1, 2}


def test_all_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} and set(ORACLES) <= set(QUERIES)
    assert "pipeline" in entry.queries() and set(QUERIES) <= set(entry.queries())
