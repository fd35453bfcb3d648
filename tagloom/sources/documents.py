"""JSON results: reading nested scores and writing metric summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT_TYPE = "map<string,map<string,struct<cav_accuracy:double,genre_scores:map<string,double>>>>"


def results_long(df: DataFrame, json_col: str, keys: list[str] | None = None) -> DataFrame:
    """``(category, concept, cav_accuracy, genre, score)`` of nested result text."""
    keys = keys or []
    parsed = df.select(*keys, F.explode(F.map_entries(F.from_json(json_col, RESULT_TYPE))).alias("c"))
    concepts = parsed.select(*keys, F.col("c.key").alias("category"), F.explode(F.map_entries("c.value")).alias("k"))
    accuracy = F.col("k.value.cav_accuracy")
    scores = F.explode(F.map_entries("k.value.genre_scores")).alias("s")
    return concepts.select(*keys, "category", F.col("k.key").alias("concept"), accuracy.alias("cav_accuracy"), scores).select(
        *keys, "category", "concept", "cav_accuracy", F.col("s.key").alias("genre"), F.col("s.value").alias("score")
    )


def metrics_json(df: DataFrame, group: str, name: str, value: str) -> DataFrame:
    """One JSON object ``{name: value}`` per group; names are few per group by nature of a summary."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), F.col(value).alias("value"))))
    return df.groupBy(group).agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def write_json_text(df: DataFrame, path: str, json_col: str = "json") -> None:
    df.select(json_col).write.text(path)
