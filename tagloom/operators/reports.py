"""Reports made of several metrics: a list of metrics over text pairs, and the store that a run writes as JSON."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators import textmetrics as M


def _long(one_row: DataFrame) -> DataFrame:
    return one_row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in one_row.columns])))


def _bleu(pairs: DataFrame) -> DataFrame:
    share = F.try_divide(F.col("matches"), F.col("possible"))
    return _long(M.corpus_bleu(pairs)).unionByName(M.bleu_precisions(pairs).agg(F.lit("precisions").alias("name"), F.avg(F.coalesce(share, F.lit(0.0))).alias("value")))


def _rouge(pairs: DataFrame, orders: Sequence[int] = (1, 2), lcs: bool = True) -> DataFrame:
    out = M.rouge_n(pairs, orders).select(F.col("metric").alias("name"), F.col("f1").alias("value"))
    if not lcs:
        return out
    return out.unionByName(_long(M.rouge_l(pairs).select(F.col("rouge_l").alias("rougeL"), F.col("rouge_lsum").alias("rougeLsum"))))


def _meteor(pairs: DataFrame, **kwargs) -> DataFrame:
    return M.meteor_rows(pairs, **kwargs).agg(F.lit("meteor").alias("name"), F.avg("meteor").alias("value"))


def _bertscore(pairs: DataFrame, tokens: DataFrame, **kwargs) -> DataFrame:
    rows = M.bertscore_rows(tokens, **kwargs)
    return _long(rows.agg(*[F.avg(c).alias(c) for c in rows.columns if c != "id"]))


def _mauve(pairs: DataFrame, vectors: DataFrame, vec: str, side: str, clusters: int, **kwargs) -> DataFrame:
    return _long(M.mauve(vectors, vec, side, clusters, **kwargs))


#: Each metric gives (name, value) rows; a metric of one's own is added here or passed in ``extra``.
METRICS: dict[str, Callable[..., DataFrame]] = {"bleu": _bleu, "rouge": _rouge, "meteor": _meteor, "bertscore": _bertscore, "mauve": _mauve}


def text_metric_report(pairs: DataFrame, metrics: Sequence[dict], extra: dict[str, Callable[..., DataFrame]] | None = None) -> DataFrame:
    """``(name, value)`` of a list of ``{"name": ..., "kwargs": {...}}`` over ``(id, prediction, reference)``.

    Result names carry the metric's as a prefix; results that are lists come as their mean. An unknown metric is
    a ValueError before anything runs.
    """
    known = METRICS | (extra or {})
    if unknown := [m["name"] for m in metrics if m["name"] not in known]:
        raise ValueError(f"unknown metrics {unknown}")
    parts = [
        known[m["name"]](pairs, **m.get("kwargs", {})).select(F.concat(F.lit(m["name"] + "_"), "name").alias("name"), F.col("value").cast("double").alias("value"))
        for m in metrics
    ]
    return reduce(DataFrame.unionByName, parts)


def quality_metrics(rows: DataFrame, split: str, columns: Sequence[str]) -> DataFrame:
    """``(split, name, value)``: mean, standard deviation and extremes of the finite values of each column in a split.

    Names are ``split/column_statistic``. A column without a finite value in a split has no rows there, and the lists
    of the rows themselves are left out.
    """
    statistics = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    found = rows.groupBy(split).agg(*[fn(finite(c)).alias(f"{c}_{name}") for c in columns for name, fn in statistics.items()])
    pairs = F.array(*[F.struct(F.concat_ws("/", split, F.lit(f"{c}_{name}")).alias("name"), F.col(f"{c}_{name}").alias("value")) for c in columns for name in statistics])
    return found.select(split, F.inline(pairs)).where("value is not null")


def _quoted(text: Column) -> Column:
    """A JSON string."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def metric_store_json(
    updates: DataFrame, by: Sequence[str] = (), order: str = "step", stages: Sequence[str] = ("train", "val", "test"), config: Column | None = None,
) -> DataFrame:
    """``(by..., json)``: stage, name and value of all updates ``(by..., stage, name, value, order)``, the last one of each name.

    ``value`` is text: numbers are written as such, all else as strings. The usual stages are there even if empty.
    With ``config``, a JSON column of the updates, the text is ``{"config": ..., "metrics": ...}``.
    A run writes few names, so one row holds them.
    """
    by = list(by)
    keep = [F.first(config).alias("_config")] if config is not None else []
    last = updates.groupBy(*by, "stage", "name").agg(F.max_by("value", order).alias("value"), *keep)
    number = F.col("value").try_cast("double")
    text = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")) & F.col("value").rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.col("value"))
    entry = F.struct("name", F.concat(_quoted(F.col("name")), F.lit(": "), F.coalesce(text, _quoted(F.col("value")), F.lit("null"))).alias("t"))
    object_of = lambda entries: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: e["t"]), ", "), F.lit("}"))
    per_stage = last.groupBy(*by, "stage").agg(object_of(F.collect_list(entry)).alias("o"), *[F.first("_config").alias("_config")] * bool(keep))
    found = F.map_from_entries(F.collect_list(F.struct("stage", "o")))
    usual = F.array(*[F.lit(s) for s in stages])
    names = lambda m: F.concat(usual, F.array_sort(F.array_except(F.map_keys(m), usual)))
    line = lambda m: F.transform(names(m), lambda s: F.concat(_quoted(s), F.lit(": "), F.coalesce(F.try_element_at(m, s), F.lit("{}"))))
    out = per_stage.groupBy(*by).agg(found.alias("_m"), *[F.first("_config").alias("_config")] * bool(keep))
    metrics = F.concat(F.lit("{"), F.array_join(line(F.col("_m")), ", "), F.lit("}"))
    if keep:
        metrics = F.concat(F.lit('{"config": '), F.coalesce("_config", F.lit("{}")), F.lit(', "metrics": '), metrics, F.lit("}"))
    return out.select(*by, metrics.alias("json"))
