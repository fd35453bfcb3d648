"""Two-sample statistics from counts per distinct value.

The samples are the rows whose side is ``a`` or ``b``; NULL and NaN are no values and do not count. A sample without
values makes the result NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.operators.ordered import RANGE_ROWS, with_value_range


def _cumulative(df: DataFrame, value: str, side: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(v, na, nb, ca, cb, next_v, n, m)``: counts of both sides per distinct value with running totals.

    The input is read for the borders of the value ranges and for the counts. Running totals are built inside the
    ranges, about one for each ``range_rows`` rows, and carried through the table of ranges.
    """
    v = F.col(value).cast("double")
    values = df.where(F.col(side).isin("a", "b") & v.isNotNull() & ~F.isnan(v)).select(v.alias("v"), F.col(side).alias("side"))
    ranged = with_value_range(values, "v", range_rows=range_rows)
    counts = ranged.groupBy("range", "v").agg(F.count(F.when(F.col("side") == "a", 1)).alias("na"), F.count(F.when(F.col("side") == "b", 1)).alias("nb"))
    every = W.partitionBy(F.lit(0))
    totals = counts.groupBy("range").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.min("v").alias("start"))
    over = every.orderBy("range")
    totals = totals.select(
        "range", (F.sum("ta").over(over) - F.col("ta")).alias("oa"), (F.sum("tb").over(over) - F.col("tb")).alias("ob"),
        F.lead("start").over(over).alias("next_start"), F.sum("ta").over(every).alias("n"), F.sum("tb").over(every).alias("m"),
    )
    w = W.partitionBy("range").orderBy("v")
    return counts.join(F.broadcast(totals), "range").select(  # a row per range, at most MAX_RANGES
        "v", "na", "nb", (F.sum("na").over(w) + F.col("oa")).alias("ca"), (F.sum("nb").over(w) + F.col("ob")).alias("cb"),
        F.coalesce(F.lead("v").over(w), F.col("next_start")).alias("next_v"), "n", "m",
    )


def _gap():
    return F.abs(F.try_divide("ca", "n") - F.try_divide("cb", "m"))


def ks_statistic(df: DataFrame, value: str, side: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Largest gap between the two empirical distribution functions."""
    return _cumulative(df, value, side, range_rows).agg(F.max(_gap()).alias("ks"))


def mann_whitney_u(df: DataFrame, value: str, side: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """U of side ``a``, ties counted half."""
    c = _cumulative(df, value, side, range_rows)
    below = F.col("cb") - F.col("nb")
    return c.agg(F.sum(F.col("na") * (below + F.col("nb") / F.lit(2.0))).alias("u"), F.max("n").alias("n"), F.max("m").alias("m"))


def wasserstein_1d(df: DataFrame, value: str, side: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    c = _cumulative(df, value, side, range_rows)
    last = F.col("next_v").isNull()
    width = F.when(last, F.when(_gap().isNotNull(), F.lit(0.0))).otherwise(F.col("next_v") - F.col("v"))
    return c.agg(F.sum(_gap() * width).alias("wasserstein"))
