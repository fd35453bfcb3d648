import zlib

import pytest

from pyspark.sql import functions as F

from tagloom.llm import language_id as li
from tagloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = QUERIES["op6_language_id"](spark, sf).collect()
    assert len(out) == len(lang) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_edges(frame):
    labelled = frame((1, "the cat sat on the mat", "s", "en"), (2, "der Hund und die Katze", "s", "de"), (3, None, "s", "fr")).filter("text is not null")
    rows = frame((1, "The hat"), (1, "The hat"), (2, "und der"), (3, None), (4, ""), (5, "12 34 !?"), (None, "the mat " * 50_000), (6, "\U0001d504")).withColumn("score", F.lit("clash"))
    out = [(r.doc_id, r.lang_pred, r.score) for r in li.identify_language(rows, labelled).collect()]
    assert [x[:2] for x in out] == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (6, "de")] or out[7][1] in ("en", "de")
    assert all((s == 0) == (p == "und") for _, p, s in out) and out[0] == out[1]
    assert [r.lang_pred for r in li.identify_language(frame((1, "a")), frame()).collect()] == ["und"]
    assert li.identify_language(frame(), labelled).collect() == []


def test_pieces_do_not_change_results(frame, monkeypatch):
    data = frame(*[(i, t, "s", t[0]) for i, t in enumerate(["aa ab ba", "bb bc cb", "aab", "cbb"] * 5)])
    whole = [(r.lang_pred, r.score) for r in li.identify_language(data, data).collect()]
    monkeypatch.setattr(li, "PIECE", 3)
    assert [(r.lang_pred, pytest.approx(r.score, rel=1e-6)) for r in li.identify_language(data, data).collect()] == whole


def test_many_languages_need_fewer_slots():
    assert li.slots_for(4) == li.SLOTS and li.slots_for(4000) * 4000 * 4 <= li.MATRIX_BYTES
