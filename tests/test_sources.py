"""Files in and out."""

import pytest
from pyspark.sql import functions as F

from tagloom.session import is_small_scan, scratch_path
from tagloom.sources import datasets as DS
from tagloom.sources import documents as JS
from tagloom.sources import files as FS

NASTY = ['plain', 'comma, "quote" and \'single\'', "two\nlines", "back\\slash", "ünï 日本", ""]


def test_csv_keeps_text(spark, tmp_path):
    d = spark.createDataFrame(list(enumerate(NASTY)), "id int, t string")
    DS.write_csv(d, str(tmp_path / "c"))
    got = {r["id"]: r["t"] for r in DS.read_csv(spark, str(tmp_path / "c"), "id int, t string").collect()}
    assert got == dict(enumerate(NASTY))


def test_split_files(spark, tmp_path):
    d = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "id int, split string")
    DS.write_splits(d, str(tmp_path / "s"))
    back = DS.read_splits(spark, {s: str(tmp_path / "s" / f"split={s}") for s in ("train", "test")}, "id int", fill=None)
    assert {(r["id"], r["split"]) for r in back.collect()} == {(1, "train"), (2, "test"), (3, "train")}
    assert DS.read_csv(spark, str(tmp_path / "s"), "id int").count() == 3


def test_publish_and_prune(spark, tmp_path):
    rows = [(1, "train", ["default", "10pct"]), (2, "test", ["default"])]
    root = str(tmp_path / "p")
    DS.publish(spark.createDataFrame(rows, "id int, split string, configs array<string>"), root)
    assert DS.read_dataset(spark, root, "default").count() == 2
    one = DS.read_dataset(spark, root, "10pct", "train").select("id")
    assert [r["id"] for r in one.collect()] == [1]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(config" in plan


def test_files(spark, tmp_path):
    for genre, name in (("rock", "a.wav"), ("rock", "b.mp3"), ("jazz", "c.wav"), ("jazz", "notes.txt")):
        (tmp_path / genre).mkdir(exist_ok=True)
        (tmp_path / genre / name).write_bytes(name.encode())
    files = FS.list_files(spark, str(tmp_path))
    assert {(r["label"], r["file_name"]) for r in files.collect()} == {("rock", "a.wav"), ("rock", "b.mp3"), ("jazz", "c.wav")}
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    rows = spark.createDataFrame([(1, "a.wav"), (2, "gone.wav")], "id int, filename string")
    assert [r["id"] for r in FS.rows_with_file(rows, files, "filename").collect()] == [1]
    assert FS.missing_file_count(rows, files, "filename").first()[0] == 1
    full = FS.attach_binary(files.select("path", "file_name"), str(tmp_path))
    assert {r["file_name"]: bytes(r["content"]) for r in full.collect()} == {n: n.encode() for n in ("a.wav", "b.mp3", "c.wav")}


def test_metrics_json(spark, tmp_path):
    d = spark.createDataFrame([("r", "b", 2), ("r", "a", 1)], "run string, name string, value int")
    out = JS.metrics_json(d, "run", "name", "value")
    JS.write_json_text(out, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == '{"a":1,"b":2}'


def test_scratch_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and (base is None or a.startswith(base))


def test_small_scan(spark):
    assert is_small_scan(spark.range(10).coalesce(1)) and not is_small_scan(spark.range(10).repartition(64))
