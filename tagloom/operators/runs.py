"""Training-run logs: ``(run, step, name, value)``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.operators.ordered import RANGE_ROWS, with_step_range
from tagloom.operators.tags import top_per_group


def epoch_metrics(log: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Mean of batch values weighted by batch size."""
    v, w = F.col(value), F.col(weight)
    return log.groupBy(*keys).agg(F.try_divide(F.sum(v * w), F.sum(w)).alias("value"))


def latest_metrics(log: DataFrame, keys: Sequence[str], step: str = "step", value: str = "value") -> DataFrame:
    """Last value written under every key."""
    return log.groupBy(*keys).agg(F.max(step).alias(step), F.max_by(value, step).alias(value))


def flatten_metrics(df: DataFrame, keys: Sequence[str], json_col: str) -> DataFrame:
    """``(keys..., name, value)`` of metric JSON: numbers as they are, lists as the mean of
    their numbers, one nested level as ``name_sub`` with numbers and lists treated alike; anything else is left out."""

    def number(text: Column) -> Column:
        listed = F.array_compact(F.from_json(text, "array<double>"))
        mean = F.try_divide(F.aggregate(listed, F.lit(0.0), lambda s, x: s + x), F.size(listed).cast("double"))
        return F.when(text.startswith("["), mean).otherwise(text.try_cast("double"))

    top = df.select(*keys, F.explode(F.map_entries(F.from_json(json_col, "map<string,string>"))).alias("e"))
    name, text = F.col("e.key"), F.col("e.value")
    one = F.array(F.struct(name.alias("name"), number(text).alias("value")))
    sub = F.transform(
        F.map_entries(F.from_json(text, "map<string,string>")),
        lambda s: F.struct(F.concat_ws("_", name, s["key"]).alias("name"), number(s["value"]).alias("value")),
    )
    rows = top.select(*keys, F.inline(F.when(text.startswith("{"), sub).otherwise(one)))
    return rows.where(F.col("value").isNotNull())


def best_checkpoints(log: DataFrame, by: Sequence[str], k: int, value: str = "value", step: str = "step", mode: str = "min") -> DataFrame:
    """Best ``k`` steps of every run by a monitored value, the earlier step first among equals."""
    order = F.col(value).asc() if mode == "min" else F.col(value).desc()
    return top_per_group(log, by, [order, F.col(step)], k)


def best_run(log: DataFrame, run: str = "run", value: str = "value", mode: str = "min") -> DataFrame:
    """The run of a sweep with the best value of the metric; the smaller run id among equals."""
    best = log.groupBy(run).agg((F.min if mode == "min" else F.max)(value).alias(value))
    return best.orderBy(F.col(value).asc() if mode == "min" else F.col(value).desc(), run).limit(1)


def early_stop_step(
    log: DataFrame, run: str = "run", step: str = "step", value: str = "value", patience: int = 3, mode: str = "min",
    min_delta: float = 0.0, stopping: float | None = None, divergence: float | None = None, per_range: int = RANGE_ROWS,
) -> DataFrame:
    """``(run, stop_step)`` of one monitored metric: the first check with ``patience`` checks in a row that are not
    better than the best so far by more than ``min_delta``, or whose value is not finite, is better than
    ``stopping`` or worse than ``divergence``; NULL when a run is never stopped. A NULL run is a run.

    A run is cut into ranges of about ``per_range`` checks. Without ``min_delta`` the best value, the position and the
    last improvement are running totals that are carried over the ranges. With one, a new best depends on the one kept
    before it; what a range does to the best that enters it is a step function, these are chained in order, and then
    every range is folded from its own entering state.
    """
    v = F.col(value) if mode == "min" else -F.col(value)
    bound = lambda b: F.lit(None).cast("double") if b is None else F.lit(float(b if mode == "min" else -b))
    d = log.select(F.struct(F.col(run).alias("run")).alias("key"), F.col(step).alias("step"), v.alias("v"))
    d = d.withColumn("hard", F.isnan("v") | (F.abs("v") == float("inf")) | F.coalesce(F.col("v") < bound(stopping), F.lit(False)) | F.coalesce(F.col("v") > bound(divergence), F.lit(False)))
    if min_delta:
        return _chained(d, min_delta, patience, per_range)
    rows = _carried(d, per_range)
    stopped = (F.col("pos") - F.col("last") >= patience) | F.col("hard")
    return rows.groupBy("key").agg(F.min(F.when(stopped, F.col("step"))).alias("stop_step")).select(F.col("key.run").alias("run"), "stop_step")


def _carried(d: DataFrame, per_range: int) -> DataFrame:
    """Adds the position of each check and of the last improvement; a run is worked on in as many parts as it has ranges."""
    ranged = with_step_range(d, "key", "step", per_range)
    inside = W.partitionBy("key", "range").orderBy("step")
    earlier = W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    best = F.min("v").over(inside.rowsBetween(W.unboundedPreceding, -1))
    parts = ranged.groupBy("key", "range").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    parts = parts.select("key", "range", F.min("m").over(earlier).alias("m0"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"))
    rows = ranged.join(parts, ["key", "range"]).withColumns({"best": F.least("m0", best), "pos": F.col("c0") + F.row_number().over(inside).cast("bigint")})
    better = F.col("best").isNull() | (F.col("v") < F.col("best"))
    rows = rows.withColumn("improved", F.when(better, F.col("pos")))
    carried = rows.groupBy("key", "range").agg(F.max("improved").alias("i"))
    carried = carried.select("key", "range", F.max("i").over(earlier).alias("i0"))
    return rows.join(carried, ["key", "range"]).withColumn("last", F.greatest("i0", F.max("improved").over(inside)))


def _chained(d: DataFrame, min_delta: float, patience: int, per_range: int) -> DataFrame:
    """``(run, stop_step)`` with a least improvement. A group is the checks of a range, or the ranges of a run."""
    ranged = with_step_range(d, "key", "step", per_range).withColumn("range", F.col("range").cast("bigint"))
    kind = f"key {d.schema['key'].dataType.simpleString()}, range bigint"

    def effect(t: pa.Table) -> pa.Table:
        """Which best and last improvement leave a range, by the best that enters: the first value below it by more
        than the least improvement is a record of the range, and all that follows depends on that record alone."""
        t = t.sort_by("step")
        v = t["v"].to_numpy().astype(np.float64)
        low = np.where(np.isnan(v), np.inf, v)
        before = np.minimum.accumulate(np.append(np.inf, low))[:-1]
        at = np.flatnonzero(low < before)
        record = low[at]
        after = np.searchsorted(-record, -(record - min_delta), "right")  # the next improvement after each record
        end = np.arange(len(at))
        for k in range(len(at) - 1, -1, -1):
            end[k] = end[after[k]] if after[k] < len(at) else k
        last = np.append(end[1:] != end[:-1], True)[: len(at)]  # equal ends share a step, down to its lowest record
        column = lambda x, kind: pa.array([x], pa.list_(kind))
        cols = [t["key"].slice(0, 1), t["range"].slice(0, 1), column(record[last], pa.float64()), column(record[end[last]], pa.float64()), column(at[end[last]] + 1, pa.int64()), pa.array([len(v)], pa.int64())]
        return pa.table(cols, names=["key", "range", "below", "best", "last", "n"])

    def chain(t: pa.Table) -> pa.Table:
        """The best, the checks and the last improvement with which each range of a run begins."""
        t = t.sort_by("range")
        best, last, pos, rows = np.inf, 0, 0, []
        for r in range(t.num_rows):
            rows.append((None if best == np.inf else float(best), last, pos))
            below = t["below"][r].values.to_numpy()
            k = int(np.searchsorted(-below, -(best - min_delta), "right"))
            if k < len(below):
                best, last = t["best"][r].values[k].as_py(), pos + t["last"][r].values[k].as_py()
            elif best == np.inf:
                last = pos + t["n"][r].as_py()  # no value yet
            pos += t["n"][r].as_py()
        cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.float64(), pa.int64(), pa.int64()))]
        return pa.table([t["key"], t["range"], *cols], names=["key", "range", "best", "last", "pos"])

    steps = ranged.groupBy("key", "range").applyInArrow(effect, f"{kind}, below array<double>, best array<double>, last array<bigint>, n bigint")
    entering = steps.groupBy("key").applyInArrow(chain, f"{kind}, best double, last bigint, pos bigint")
    checks = ranged.groupBy("key", "range").agg(F.array_sort(F.collect_list(F.struct("step", "v", "hard"))).alias("checks"))
    none = F.lit(None).cast(d.schema["step"].dataType)

    def fold(s: Column, x: Column) -> Column:
        new = s["best"].isNull() | F.coalesce(x["v"] < s["best"] - F.lit(float(min_delta)), F.lit(False))
        last = F.when(new, s["pos"] + 1).otherwise(s["last"])
        stop = s["stop"].isNull() & (x["hard"] | (s["pos"] + 1 - last >= patience))
        return F.struct(F.when(new, x["v"]).otherwise(s["best"]).alias("best"), (s["pos"] + 1).alias("pos"), last.alias("last"), F.when(stop, x["step"]).otherwise(s["stop"]).alias("stop"))

    folded = F.aggregate("checks", F.struct("best", "pos", "last", none.alias("stop")), fold, lambda s: s["stop"])
    rows = checks.join(entering, ["key", "range"]).select("key", folded.alias("stop"))
    return rows.groupBy("key").agg(F.min("stop").alias("stop_step")).select(F.col("key.run").alias("run"), "stop_step")
