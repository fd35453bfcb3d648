"""Mixing sources to target weights by whole repetitions and one seeded draw for the fraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.hashing import hash_uniform
from tagloom.llm.base import WORD, bounded

#: Most repetitions of a document.
MOST = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A table of sources up to this size is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float = 1.0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to a table of ``source`` and ``source_size``.

    Sources, by code point and null last, have the weights in turn and share ``share`` of all sizes. A target
    stops at ``most`` times its source's size; what is over is shared again by weight until none is above.
    In order of the cap per weight the sources that stop are the first ones, so one running total finds them.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    everything = Window.partitionBy(F.lit(0))
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    out = (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
        .withColumn("cap", cap)
        .withColumn("all_size", F.floor(F.sum("source_size").over(everything) * F.lit(float(share))).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("left_size", F.col("all_size") - F.coalesce(F.sum("cap").over(by_cap), none))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(by_cap), none))
        .withColumn("stops", F.col("left_size") * F.col("weight") > F.col("cap") * F.col("left_weight"))
        .withColumn("free_size", F.col("all_size") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(none)).over(everything))
        .withColumn("free_weight", F.col("all_weight") - F.sum(F.when(F.col("stops"), F.col("weight")).otherwise(none)).over(everything))
    )
    return out.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("free_size") * F.col("weight") / F.col("free_weight")).alias("target"))


def mixed_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    share: float = 1.0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 10,
) -> DataFrame:
    """Each row with ``size`` (words), ``source_size``, ``target`` and ``copies``.

    A source's rate is target / size; a document is taken floor(rate) times, and once more if the hash of seed
    and id is below the fraction. Draws depend on the id alone, so reruns and lost tasks give the same mix, and
    rows that share an id share the draw. A null text has size 0, a null source is a source, a null id draws
    like the empty id. Rows of a source without words are taken no time. Input columns of the result's names
    are replaced.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    sized = docs.select(F.struct(*keep).alias("row"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most)
    targets = bounded(sources.withColumnRenamed("source", "of"), BROADCAST_SOURCES, "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    draw = hash_uniform("mix", seed, F.coalesce(F.col(f"row.{id_col}").cast("string"), F.lit("")))
    out = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return out.select("row.*", "size", "source_size", "target", copies.cast("int").alias("copies"))
