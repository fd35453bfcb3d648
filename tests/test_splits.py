"""Exact splits: sizes, disjointness, nesting, repeated keys."""

import pytest
from pyspark.sql import functions as F

from tagloom.operators import splits as R
from tagloom.operators.ordered import small_side


def sizes(df, col="split"):
    return {r[col]: r["n"] for r in df.groupBy(col).agg(F.count("*").alias("n")).collect()}


def test_published_sizes(spark):
    df = spark.range(21_433)
    full = R.assign_splits(df, "id", 42, R.ranks_balanced(0.7, 0.15, 0.15)).cache()
    assert sizes(full) == {"train": 15_003, "validation": 3_215, "test": 3_215}
    assert full.select("id").distinct().count() == 21_433
    quarter = R.keep_first(full, "id", "s", lambda n: F.floor(F.lit(0.25) * n), ["split"])
    tenth = R.keep_first(full, "id", "s", lambda n: F.floor(F.lit(0.10) * n), ["split"])
    assert sizes(quarter) == {"train": 3_750, "validation": 803, "test": 803}
    assert sizes(tenth) == {"train": 1_500, "validation": 321, "test": 321}
    assert tenth.join(quarter, ["id", "split"], "left_anti").count() == 0


def test_hold_out_sizes(spark):
    assert sizes(R.assign_splits(spark.range(1001), "id", 1, R.ranks_hold_out(0.1, 0.5))) == {"train": 900, "validation": 50, "test": 51}


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_tiny_tables(spark, n):
    out = R.assign_splits(spark.range(n), "id", 1, R.ranks_balanced(0.7, 0.15, 0.15))
    train = int(0.7 * n)
    valid = int(0.5 * (n - train))
    want = {"train": train, "validation": valid, "test": n - train - valid}
    assert sizes(out) == {k: v for k, v in want.items() if v}


def test_empty_table(spark):
    assert R.assign_splits(spark.range(0), "id", 1, R.ranks_balanced(0.7, 0.15, 0.15)).count() == 0


def test_string_ids_and_groups(spark):
    df = spark.range(300).select(F.concat(F.lit("k"), "id").alias("id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = R.stratified_split(df, "id", 5, 0.2, ["y"])
    got = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert got == {(0, "train"): 160, (0, "test"): 40, (1, "train"): 80, (1, "test"): 20}


def test_hot_key_stays_together(spark):
    """A third of the rows share one id: nothing is lost and the copies are not torn apart."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"))
    out = R.assign_splits(df, "id", 2, R.ranks_balanced(0.7, 0.15, 0.15)).cache()
    assert out.count() == 3000
    assert out.where("id = -1").select("split").distinct().count() == 1
    assert out.groupBy("id").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0


def test_repeated_splits_differ(spark):
    df = spark.range(100).withColumn("y", (F.col("id") < 25).cast("int"))
    out = R.repeated_splits(df, "id", 4, 0.2, ["y"]).cache()
    per = out.where("split = 'test'").groupBy("run", "y").count().collect()
    assert {(r["run"], r["y"]): r["count"] for r in per} == {(k, y): (5 if y else 15) for k in range(4) for y in (0, 1)}
    tests = [frozenset(r["id"] for r in out.where(f"split = 'test' AND run = {k}").collect()) for k in range(4)]
    assert len(set(tests)) == 4


def test_null_groups_and_totals(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("y"))
    out = R.keep_first(df, "id", 1, lambda n: F.floor(n / 5), ["y"])
    assert out.count() == 20 and out.where("y is null").count() == 5
    nine = R.stratified_split(spark.range(9).withColumn("y", F.col("id") % 3), "id", 1, 0.2, ["y"])
    assert sizes(nine) == {"train": 7, "test": 2}
    twice = spark.createDataFrame([(i % 700,) for i in range(1400)], "id long")
    assert R.sample_n(twice, "id", 101, 1).count() == 102


def test_sample_n_both_ways(spark):
    small = {r["id"] for r in R.sample_n(spark.range(12_000), "id", 50, 3).collect()}
    large = {r["id"] for r in R.sample_n(spark.range(12_000), "id", 11_000, 3).collect()}
    assert len(small) == 50 and len(large) == 11_000 and small <= large


def test_large_side_is_not_broadcast(spark):
    df = spark.range(50)
    assert small_side(df, 10) is df
    assert small_side(df, 50).count() == 50


def test_many_groups(spark, monkeypatch):
    """More groups than may be broadcast: refused by name, and the same splits by a shuffled join."""
    df = spark.range(400).withColumn("y", F.col("id") % 40)
    want = {(r["id"], r["part"]) for r in R.with_part(df, "id", 3, lambda n: [n / 2], ["y"]).select("id", "part").collect()}
    monkeypatch.setattr(R, "BROADCAST_GROUPS", 30)
    with pytest.raises(Exception, match="more than 30 split groups"):
        R.with_part(df, "id", 3, lambda n: [n / 2], ["y"]).collect()
    assert {(r["id"], r["part"]) for r in R.with_part(df, "id", 3, lambda n: [n / 2], ["y"], many_groups=True).select("id", "part").collect()} == want


def test_keys_of_one_prefix(spark, monkeypatch):
    """A million ids whose hashes begin alike: the descent goes on inside the bucket, sizes stay exact."""
    plain = R.hash_key
    monkeypatch.setattr(R, "hash_key", lambda *a: F.concat(F.lit("abc"), F.substring(plain(*a), 4, 29)))
    out = R.assign_splits(spark.range(1_000_000), "id", 7, R.ranks_balanced(0.7, 0.15, 0.15))
    assert sizes(out) == {"train": 700_000, "validation": 150_000, "test": 150_000}


def test_nothing_runs_while_built(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("built", "")
    split = R.assign_splits(spark.range(1000), "id", 42, R.ranks_balanced(0.7, 0.15, 0.15))
    R.keep_first(split, "id", "s", lambda n: F.floor(F.lit(0.25) * n), ["split"])
    R.repeated_splits(split.withColumn("y", F.col("id") % 2), "id", 3, 0.2, ["y"])
    assert len(tracker.getJobIdsForGroup("built")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rows_are_not_shuffled(spark):
    plan = R.assign_splits(spark.range(1000), "id", 1, R.ranks_balanced(0.7, 0.15, 0.15))._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.splitlines() if ":" not in line.split("+-")[0]]  # lines of the search for the cuts begin with a colon
    assert any("Range" in line for line in rows) and not any("Exchange" in line or "Join" in line for line in rows)
