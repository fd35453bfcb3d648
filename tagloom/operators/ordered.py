"""Work on ordered data without ordering a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_RANGES, FINE = 1024, 32
RANGE_ROWS = 100_000
SMALL_ROWS = 100_000  # tables up to this many rows are joined by broadcast


def join_null_safe(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key meets a NULL key; the keys come from the left side."""
    names = {b: f"_right_{i}" for i, b in enumerate(by)}
    renamed = right.withColumnsRenamed(names)
    same = [F.col(b).eqNullSafe(F.col(n)) for b, n in names.items()]
    return left.join(renamed, same, how).drop(*names.values())


def checked_small(df: DataFrame, max_rows: int, what: str) -> DataFrame:
    """The rows, which may be broadcast: a table of more than ``max_rows`` fails when the query runs."""
    rows = F.count("*").over(W.partitionBy(F.lit(0)))
    small = df.limit(max_rows + 1).withColumn("_rows", rows)
    message = F.concat(F.lit(f"more than {max_rows} {what}: use the form that joins by shuffle, rows "), F.col("_rows").cast("string"))
    return small.where(F.when(F.col("_rows") > max_rows, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_rows")


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Read a table that should be small. If it proves so it comes back as a counted local relation to be
    broadcast; otherwise it comes back unchanged and the join shuffles."""
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def with_value_range(df: DataFrame, col: str, name: str = "range", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the index of the value range a row lies in, ranges of about ``range_rows`` rows, at most ``MAX_RANGES``.

    The borders come from a mergeable quantile sketch, so ranges hold about the same number of rows whatever the
    distribution. A row finds its range in two steps, in every ``FINE``-th border and then in those that follow, so
    the work per row goes with the square root of the number of ranges. Equal values share a range; NULL and NaN lie
    in the last one.
    """
    x = F.col(col).cast("double")
    share = F.lit(np.arange(1, MAX_RANGES) / MAX_RANGES)
    every = F.ceil(F.lit(float(MAX_RANGES)) / F.greatest(F.ceil(F.count("*") / F.lit(float(range_rows))), F.lit(1.0))).cast("int")
    sketch = df.agg(F.percentile_approx(x, share, F.lit(10 * MAX_RANGES)).alias("all"), every.alias("every"))
    chosen = F.array_distinct(F.filter("all", lambda b, i: (i + 1) % F.col("every") == 0))
    sketch = sketch.select(F.coalesce(chosen, F.array().cast("array<double>")).alias("fine"))
    coarse = F.filter("fine", lambda b, i: i % FINE == FINE - 1)
    borders = sketch.select(F.struct("fine", coarse.alias("coarse")).alias("b")).scalar()
    below = lambda list_of: F.size(F.filter(list_of, lambda b: ~(x < b)))
    at = F.col("_coarse") * FINE
    placed = df.withColumn("_borders", borders).withColumn("_coarse", below(F.col("_borders.coarse")))
    inside = below(F.slice(F.col("_borders.fine"), at + 1, F.lit(FINE)))
    return placed.withColumn(name, F.coalesce(at + inside, F.lit(MAX_RANGES))).drop("_borders", "_coarse")


def with_step_range(df: DataFrame, key: str, step: str, per_range: int = RANGE_ROWS) -> DataFrame:
    """Add the index of the part of its group that a row lies in: even cuts between the first and the last step, as
    many as the group has rows for. ``key`` is a column that is never NULL, such as a struct."""
    x = F.col(step).cast("double")
    size = df.groupBy(key).agg(F.count("*").alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    parts = F.ceil(F.col("_n") / F.lit(per_range))
    at = F.coalesce(F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    placed = df.join(size, key).withColumn("range", F.least(F.floor(at * parts), parts - 1))
    return placed.drop("_n", "_lo", "_hi")
