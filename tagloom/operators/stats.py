"""Descriptive statistics: counts, quantiles, histograms, densities, shares."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.operators.moments import key_types, padded
from tagloom.operators.ordered import SMALL_ROWS, checked_small, join_null_safe
from tagloom.operators.taxonomy import Taxonomy


ALL = "_all"  # the key of a table that is one group


def describe(df: DataFrame, col: str, by: Sequence[str] = (), probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample deviation, extremes and interpolated quantiles of a small-integer column.

    Values are first counted per distinct value, so the exact quantiles read a short table.
    """
    per_value = df.groupBy(*by, F.col(col).alias("_v")).agg(F.count("*").alias("_c"))
    v, c = F.col("_v"), F.col("_c")
    n, s, ss = F.sum(c), F.sum(c * v), F.sum(c * v * v)
    quantiles = [F.percentile("_v", F.lit(float(p)), c).alias(f"q{round(p * 100)}") for p in probs]
    n_d = n.cast("double")
    var = F.try_divide(ss - s * s / n_d, n_d - 1)
    return per_value.groupBy(*by).agg(
        n.alias("n"), (s / n_d).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"),
        F.min("_v").alias("min"), F.max("_v").alias("max"), *quantiles,
    )


def category_dataset_stats(df: DataFrame, tax: Taxonomy, dataset_col: str, tags_col: str) -> DataFrame:
    """Statistics of the number of tags per row for every (dataset, category) and over all tags.

    Each row gives one count per category, zeros included, and one overall count; no join is needed to
    find the empty categories.
    """
    tags = F.col(tags_col)
    counts = [
        F.struct(F.lit(c).alias("category"), F.size(F.filter(tags, _in(tax.tags(c)))).alias("n_tags")) for c in tax.categories
    ]
    counts.append(F.struct(F.lit("All Tags").alias("category"), F.size(tags).alias("n_tags")))
    long = df.select(dataset_col, F.inline(F.array(*counts)))
    return describe(long, "n_tags", [dataset_col, "category"])


def _in(names: Sequence[str]):
    return lambda t: t.isin(*names)


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, col).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the common minimum and maximum of all groups, the last one closed.

    ``density`` is the count over group size and bin width, NULL if all values are equal; those lie in bin 0. NULL
    and NaN are no values: they lie in no bin and do not count in the group size.
    """
    values = df.select(*by, F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    lim = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    counted = values.groupBy(*by, "v").agg(F.count("*").alias("c"))
    placed = counted.withColumn("_lim", lim.select(F.struct("lo", "hi").alias("s")).scalar())
    placed = placed.select(*by, "c", "v", F.col("_lim.lo").alias("lo"), ((F.col("_lim.hi") - F.col("_lim.lo")) / F.lit(float(bins))).alias("w"))
    at = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("w")), F.lit(0.0))
    placed = placed.withColumn("bin", F.least(F.floor(at), F.lit(bins - 1)).cast("bigint"))
    binned = placed.groupBy(*by, "bin", "lo", "w").agg(F.sum("c").alias("n"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    density = F.try_divide(F.col("n"), F.sum("n").over(group) * F.col("w"))
    left = F.col("lo") + F.col("bin") * F.col("w")
    return binned.select(*by, "bin", left.alias("left_edge"), "n", density.alias("density"))


def _bandwidths(df: DataFrame, col: str, by: list[str], cut: float) -> tuple[DataFrame, DataFrame]:
    """The values (by..., v), NaN as NULL, and (by..., n, h, a, b): numbers, Scott's bandwidth and ends of the grid of
    each group; h is NULL without a spread."""
    v = F.col(col).cast("double")
    values = df.select(*[F.lit(0).alias(b) if b == ALL else b for b in by], F.when(~F.isnan(v), v).alias("v"))
    per_group = values.groupBy(*by).agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    h = F.when(F.col("sd") > 0, F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    margin = cut * F.coalesce(h, F.lit(0.0))
    return values, per_group.select(*by, "n", h.alias("h"), (F.col("lo") - margin).alias("a"), (F.col("hi") + margin).alias("b"))


def _with_group(values: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    spread = groups.where("h is not null").drop("n")
    return join_null_safe(values, F.broadcast(checked_small(spread, SMALL_ROWS, "groups of a density")), by)


def _density(sums: DataFrame, groups: DataFrame, by: list[str], points: int) -> DataFrame:
    """(by..., i, x, density) for every group, from the sums of kernels (by..., i, s)."""
    grid = groups.select(*by, "n", "h", "a", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("i"))
    density = F.try_divide("s", F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
    return join_null_safe(grid, sums, [*by, "i"], "left").select(*by, "i", _point(points).alias("x"), density.alias("density")).drop(ALL)


def _point(points: int) -> Column:
    return F.col("a") + F.col("i") * ((F.col("b") - F.col("a")) / F.lit(float(points - 1)))


def kde_grid(df: DataFrame, col: str, by: Sequence[str] = (), points: int = 200, cut: float = 3.0) -> DataFrame:
    """``(by..., i, x, density)``: exact Gaussian density with Scott's bandwidth at evenly spaced points.

    A task adds the kernels of its distinct values up to one vector over the grid of a group, in numpy; no row is
    made for a value and a point. NULL and NaN are no values. A group without a spread, of one value or of equal
    ones, has ``points`` rows at that value with a NULL density; a group without a value has NULL for both.
    """
    by = list(by) or [ALL]
    values, groups = _bandwidths(df, col, by, cut)
    counted = _with_group(values.where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("c")), groups, by)
    lead, kinds = key_types(values, by)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            v, c, h, a, b = (batch.column(len(by) + k).to_numpy().astype(np.float64) for k in range(5))
            index: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*[batch.column(k).to_pylist() for k in range(len(by))])):
                index.setdefault(key, []).append(at)
            for key, rows in index.items():
                at = rows[0]
                x = a[at] + np.arange(points) * ((b[at] - a[at]) / (points - 1))
                total = held.setdefault(key, np.zeros(points))
                for some in np.array_split(rows, -(-len(rows) // 4096)):
                    total += c[some] @ np.exp(-0.5 * ((x[None, :] - v[some, None]) / h[at]) ** 2)
        for key, total in held.items():
            columns = [pa.array([k] * points, kind) for k, kind in zip(key, kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(points), pa.int64()), pa.array(total)], names=[*by, "i", "s"])

    parts = counted.select(*by, "v", "c", "h", "a", "b").mapInArrow(partial, f"{lead}i bigint, s double")
    return _density(parts.groupBy(*by, "i").agg(F.sum("s").alias("s")), groups, by, points)


def kde_binned(df: DataFrame, col: str, by: Sequence[str] = (), points: int = 200, cut: float = 3.0, cells: int = 4096) -> DataFrame:
    """:func:`kde_grid` from linear binning: every value is shared between its two neighbours of ``cells`` fixed nodes
    on the map side, and one convolution of the nodes with the kernel gives the density. What is shuffled does not grow
    with the values; the error is about (width of a cell / bandwidth) squared / 8."""
    by = list(by) or [ALL]
    values, groups = _bandwidths(df, col, by, cut)
    placed = _with_group(values.where("v is not null"), groups, by)
    width = (F.col("b") - F.col("a")) / F.lit(float(cells - 1))
    at = (F.col("v") - F.col("a")) / width
    node = F.least(F.floor(at), F.lit(cells - 2))
    ends = F.array(F.struct(node.alias("node"), (1 - (at - node)).alias("w")), F.struct((node + 1).alias("node"), (at - node).alias("w")))
    nodes = placed.select(*by, "h", "a", "b", F.inline(ends)).groupBy(*by, "h", "a", "b", "node").agg(F.sum("w").alias("w"))
    u = (_point(points) - (F.col("a") + F.col("node") * width)) / F.col("h")
    spots = nodes.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("i"))  # cells x points a group
    sums = spots.groupBy(*by, "i").agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * u * u)).alias("s"))
    return _density(sums, groups, by, points)


def tag_share(freq: DataFrame, a: str, b: str, dataset_col: str = "dataset") -> DataFrame:
    """Counts and within-category percentages of two datasets side by side, missing tags as zero.

    ``freq`` holds ``(dataset, category, tag, n)``.
    """
    side = lambda d: F.coalesce(F.sum(F.when(F.col(dataset_col) == d, F.col("n"))), F.lit(0)).cast("bigint")
    both = freq.where(F.col(dataset_col).isin(a, b)).groupBy("category", "tag").agg(side(a).alias(f"{a}_count"), side(b).alias(f"{b}_count"))
    w = W.partitionBy("category")
    pct = lambda d: F.coalesce(F.try_divide(F.col(f"{d}_count") * 100.0, F.sum(f"{d}_count").over(w)), F.lit(0.0)).alias(f"{d}_pct")
    return both.select("category", "tag", f"{a}_count", f"{b}_count", pct(a), pct(b))


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Interpolated quantiles of a continuous column without holding a group in one buffer.

    A mergeable sketch brackets every quantile; then only the values inside the narrow bracket are counted
    one by one, while the rest collapse to two rows per task. The result is exact.
    """
    by, slack = list(by), 2.0 / accuracy
    edges = [e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))]
    values = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("v"))
    sketch = values.groupBy(*by).agg(
        F.count("*").alias("n"), F.percentile_approx("v", F.array(*[F.lit(e) for e in edges]), F.lit(accuracy)).alias("e")
    )
    plans = F.array(*[
        F.struct(F.lit(float(p)).alias("p"), F.get("e", F.lit(2 * i)).alias("lo"), F.get("e", F.lit(2 * i + 1)).alias("hi"))
        for i, p in enumerate(probs)
    ])
    table = sketch.select(*by, "n", plans.alias("plans"))
    if by:
        seen = join_null_safe(values, F.broadcast(checked_small(table, SMALL_ROWS, "groups of quantiles")), by)
    else:
        seen = values.withColumn("_plan", table.select(F.struct("n", "plans").alias("s")).scalar()).select("v", "_plan.n", "_plan.plans")
    seen = seen.select(*by, "v", "n", F.inline("plans"))
    v = F.col("v")
    zone = F.when(v < F.col("lo"), -1).when(v > F.col("hi"), 1).otherwise(0)
    cells = seen.withColumn("zone", zone).groupBy(*by, "p", "n", "zone", F.when(F.col("zone") == 0, v).alias("at")).agg(
        F.count("*").alias("c"), F.min("v").alias("first"), F.max("v").alias("last")
    )
    return _interpolated(cells, by)


def _interpolated(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by..., p, value)`` from counts ``c`` of n values: those below and above a bracket together (zone -1 and 1), those
    in it (zone 0) one by one at their value."""
    order = W.partitionBy(*by, "p").orderBy("zone", "at")
    cells = cells.withColumn("upto", F.sum("c").over(order))
    rank = F.col("p") * (F.col("n") - 1)
    k, frac = F.floor(rank) + 1, rank - F.floor(rank)
    before = F.col("upto") - F.col("c")
    edge = F.when(F.col("zone") < 0, F.col("last")).otherwise(F.col("first"))
    pick = lambda r: F.max(F.when((r > before) & (r <= F.col("upto")), edge))
    out = cells.groupBy(*by, "p").agg(
        pick(k).alias("x0"), pick(F.least(k + 1, F.col("n"))).alias("x1"), F.max(frac).alias("f")
    )
    return out.select(*by, "p", (F.col("x0") + F.col("f") * (F.col("x1") - F.col("x0"))).alias("value"))


def vector_quantiles(df: DataFrame, vec: str, probs: Sequence[float], accuracy: int = 2_000) -> DataFrame:
    """``(dim, p, value)``: exact interpolated quantiles of every dimension; NULL and NaN elements do not count.

    As :func:`exact_quantiles`, but no element becomes a row: a sketch for each dimension brackets its quantiles, in
    one aggregate; then a task compares whole batches with the brackets and sends, for each dimension and quantile,
    two counts and the values inside. The number of dimensions is taken from the longest vector.
    """
    slack = 2.0 / accuracy
    edges = [e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))]
    width = df.agg(F.max(F.size(vec))).first()[0] or 0
    number = lambda x: F.when(~F.isnan(x), x)
    at = lambda i: number(F.get(F.col(vec), F.lit(i)).cast("double"))
    sketch = [F.percentile_approx(at(i), F.lit(np.array(edges)), F.lit(accuracy)).alias(f"d{i}") for i in range(width)]
    brackets = df.agg(*sketch).select(F.array(*[f"d{i}" for i in range(width)]).alias("b")) if width else None
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    schema = "dim int, p double, zone int, at double, c bigint, first double, last double"
    if brackets is None:
        return df.sparkSession.createDataFrame([], "dim int, p double, value double")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if low is None:
                ends = [e if e else [math.nan] * len(edges) for e in batch.column(1)[0].as_py()]
                low, high = np.array(ends, float)[:, 0::2], np.array(ends, float)[:, 1::2]
            x, there = padded(batch.column(0))
            there &= ~np.isnan(x)
            for d in range(x.shape[1]):
                v = np.sort(x[there[:, d], d])
                if not len(v):
                    continue
                for q, p in enumerate(probs):
                    a, b = np.searchsorted(v, low[d, q], "left"), np.searchsorted(v, high[d, q], "right")
                    value, count = np.unique(v[a:b], return_counts=True)
                    rows = [(-1, None, a, v[0], v[a - 1])] if a else []
                    rows += [(0, w, c, w, w) for w, c in zip(value.tolist(), count.tolist())]
                    rows += [(1, None, len(v) - b, v[b], v[-1])] if b < len(v) else []
                    zone, spot, c, least, most = zip(*rows)
                    size = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d] * size, pa.int32()), pa.array([float(p)] * size), pa.array(zone, pa.int32()), pa.array(spot, pa.float64()), pa.array(c, pa.int64()), pa.array(least, pa.float64()), pa.array(most, pa.float64())],
                        names=["dim", "p", "zone", "at", "c", "first", "last"],
                    )

    rows = df.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>"), F.when(first, brackets.scalar()).alias("_b"))
    cells = rows.mapInArrow(inside, schema).groupBy("dim", "p", "zone", "at").agg(F.sum("c").alias("c"), F.min("first").alias("first"), F.max("last").alias("last"))
    cells = cells.withColumn("n", F.sum("c").over(W.partitionBy("dim", "p")))
    return _interpolated(cells, ["dim"])


def dataset_profile(df: DataFrame, id_col: str, temperature_col: str) -> DataFrame:
    """Row count, distinct temperatures and the first row by id, as ``sample``. Temperatures are a setting with few values."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.array_join(F.array_sort(F.collect_set(temperature_col)).cast("array<string>"), ", ").alias("temperatures"),
        F.min(id_col).alias("first_id"), F.min_by(F.struct(*df.columns), id_col).alias("sample"),
    )
