"""Key joins and set operations between datasets and models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.tags import top_per_group


def cap_per_split(df: DataFrame, split: str, order: str, caps: Mapping[str, int]) -> DataFrame:
    """The first rows of every capped split; splits without a cap stay whole and are not shuffled."""
    free = df.where(~F.col(split).isin(*caps) | F.col(split).isNull())
    parts = [top_per_group(df.where(F.col(split) == s), [split], [F.col(order)], n, "_rn").drop("_rn") for s, n in caps.items()]
    return reduce(DataFrame.unionByName, parts, free)


def zip_by_id(left: DataFrame, *others: DataFrame, id_col: str = "id") -> DataFrame:
    """Put columns of several tables side by side by key; a missing partner leaves NULL."""
    return reduce(lambda a, b: a.join(b, id_col, "left"), others, left)


def common_ids(df: DataFrame, model_col: str, id_col: str, models: Sequence[str]) -> DataFrame:
    """Ids that every model has, in one pass over all of them."""
    flags = [F.max(F.when(F.col(model_col) == m, 1).otherwise(0)) for m in models]
    hits = reduce(lambda a, b: a + b, flags)
    return df.where(F.col(model_col).isin(*models)).groupBy(id_col).agg(hits.alias("_k")).where(F.col("_k") == len(models)).select(id_col)


def compare_models(df: DataFrame, model_col: str, id_col: str, value_col: str, models: Sequence[str]) -> DataFrame:
    """One row per id with the value of every model, for ids that all models have."""
    values = [F.min(F.when(F.col(model_col) == m, F.col(value_col))).alias(m) for m in models]
    out = df.where(F.col(model_col).isin(*models)).groupBy(id_col).agg(*values)
    return out.where(reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in models]))


def vocab_union(a: DataFrame, b: DataFrame, tags_col: str) -> DataFrame:
    vocab = lambda d: d.select(F.explode(tags_col).alias("tag")).distinct()
    return vocab(a).unionByName(vocab(b)).distinct()


def concept_vs_random(concept: DataFrame, random: DataFrame) -> DataFrame:
    """Concept rows labelled 1 over random rows labelled 0."""
    return concept.withColumn("y", F.lit(1)).unionByName(random.withColumn("y", F.lit(0)))
