"""Text metrics over ``(id, prediction, reference)`` rows.

Every pair is scored inside its own row; only the sums over pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.functions.bind import let
from tagloom.functions.text import multiset_overlap, ngrams, tokens_mteval, tokens_rouge, words
from tagloom.operators.alignment import matched_words, portions, sizes_of, summary_hits

MAX_ORDER = 4


def bleu_precisions(pairs: DataFrame) -> DataFrame:
    """``(n, matches, possible, pred_len, ref_len)`` summed over the corpus, one reference per prediction."""

    def row(v: Column) -> Column:
        per_order = [
            F.struct(
                F.lit(n).alias("n"), multiset_overlap(ngrams(v["p"], n), ngrams(v["r"], n)).alias("m"),
                F.greatest(F.size(v["p"]) - (n - 1), F.lit(0)).cast("bigint").alias("c"),
                F.size(v["p"]).cast("bigint").alias("pl"), F.size(v["r"]).cast("bigint").alias("rl"),
            )
            for n in range(1, MAX_ORDER + 1)
        ]
        return F.array(*per_order)

    scored = pairs.select(F.inline(let(row, p=tokens_mteval("prediction"), r=tokens_mteval("reference"))))
    return scored.groupBy(F.col("n").cast("bigint").alias("n")).agg(
        F.sum("m").alias("matches"), F.sum("c").alias("possible"), F.sum("pl").alias("pred_len"), F.sum("rl").alias("ref_len")
    )


def corpus_bleu(pairs: DataFrame) -> DataFrame:
    """Geometric mean of the four n-gram precisions times the brevity penalty."""
    p = F.coalesce(F.try_divide(F.col("matches"), F.col("possible")), F.lit(0.0))
    s = bleu_precisions(pairs).withColumn("p", p).agg(
        F.min("p").alias("lowest"), F.avg(F.ln(F.greatest(F.col("p"), F.lit(1e-300)))).alias("log_p"),
        F.max("pred_len").alias("translation_length"), F.max("ref_len").alias("reference_length"),
    )
    ratio = F.try_divide(F.col("translation_length"), F.col("reference_length"))
    bp = F.when(ratio > 1.0, F.lit(1.0)).when(ratio == 0.0, F.lit(0.0)).otherwise(F.exp(1.0 - F.try_divide(F.lit(1.0), ratio)))
    mean = F.when(F.col("lowest") > 0, F.exp("log_p")).otherwise(F.lit(0.0))
    return s.select(
        (mean * bp).alias("bleu"), bp.alias("brevity_penalty"), ratio.alias("length_ratio"), "translation_length", "reference_length"
    )


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * p * r, p + r), F.lit(0.0))


def rouge_n_rows(pairs: DataFrame, orders=(1, 2)) -> DataFrame:
    """Precision, recall and F1 of every pair and order."""

    def row(v: Column) -> Column:
        out = []
        for n in orders:
            a, b = F.size(v["p"]) - (n - 1), F.size(v["r"]) - (n - 1)
            m = multiset_overlap(ngrams(v["p"], n), ngrams(v["r"], n))
            p, r = m / F.greatest(a, F.lit(1)), m / F.greatest(b, F.lit(1))
            out.append(F.struct(F.lit(f"rouge{n}").alias("metric"), p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1")))
        return F.array(*out)

    return pairs.select("id", F.inline(let(row, p=tokens_rouge("prediction"), r=tokens_rouge("reference"))))


def rouge_n(pairs: DataFrame, orders=(1, 2)) -> DataFrame:
    return rouge_n_rows(pairs, orders).groupBy("metric").agg(F.avg("f1").alias("f1"))


def rouge_l_rows(pairs: DataFrame) -> DataFrame:
    """``(id, rouge_l, rouge_lsum)``: longest common subsequence F1 of whole texts and of line-split texts.

    A NULL text has no tokens, like an empty one, and scores 0.
    """
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), tokens_rouge), lambda s: F.size(s) > 0)

    def f1(hits: np.ndarray, n_pred: np.ndarray, n_ref: np.ndarray) -> pa.Array:
        return pa.array(np.divide(2.0 * hits, n_pred + n_ref, out=np.zeros(len(hits)), where=hits > 0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, hits, n_pred, n_ref = summary_hits(b.column(1), b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), f1(whole, n_pred, n_ref), f1(hits, n_pred, n_ref)], names=["id", "rouge_l", "rouge_lsum"])

    d = pairs.select("id", split(F.col("prediction")).alias("p"), split(F.col("reference")).alias("r"))
    return d.mapInArrow(score, f"id {pairs.schema['id'].dataType.simpleString()}, rouge_l double, rouge_lsum double")


def rouge_l(pairs: DataFrame) -> DataFrame:
    return rouge_l_rows(pairs).agg(F.avg("rouge_l").alias("rouge_l"), F.avg("rouge_lsum").alias("rouge_lsum"))


def meteor_rows(pairs: DataFrame, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> DataFrame:
    """``(id, meteor)`` from exact matches; a text that is NULL or has no words scores 0."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(some.start, some.stop - some.start) for b in batches for some in portions(sizes_of(b.column(1)) + sizes_of(b.column(2)))):
            m, chunks, n_pred, n_ref = (x.astype(float) for x in matched_words(b.column(1), b.column(2)))
            some = m > 0
            p, r = (np.divide(m, n, out=np.zeros(len(m)), where=some) for n in (n_pred, n_ref))
            f = np.divide(p * r, alpha * p + (1 - alpha) * r, out=np.zeros(len(m)), where=some)
            apart = np.divide(chunks, m, out=np.zeros(len(m)), where=some)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((1 - gamma * apart**beta) * f)], names=["id", "meteor"])

    tokens = lambda c: words(F.lower(F.coalesce(c, F.lit(""))))
    d = pairs.select("id", tokens(F.col("prediction")).alias("p"), tokens(F.col("reference")).alias("r"))
    return d.mapInArrow(score, f"id {pairs.schema['id'].dataType.simpleString()}, meteor double")


def bertscore_rows(tokens: DataFrame, block: int = 1024) -> DataFrame:
    """Greedy embedding match of every pair from given token vectors.

    ``tokens`` holds ``(id, side, n, vec)``: the distinct tokens of each side of a pair with how often they
    occur. The tokens of one text pair meet in one group and are compared in blocks, so memory follows the
    length of one text.
    """

    def score(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        unit = {}
        for side in ("p", "r"):
            part = d[d["side"] == side]
            x = np.array(part["vec"].tolist(), dtype=np.float64).reshape(len(part), len(d["vec"].iloc[0]))
            n = np.linalg.norm(x, axis=1, keepdims=True)
            unit[side] = (np.divide(x, n, out=np.zeros_like(x), where=n > 0), part["n"].to_numpy(dtype=np.float64))
        (p, cp), (r, cr) = unit["p"], unit["r"]
        if not len(p) or not len(r):
            return pd.DataFrame({"id": [key[0]], "precision": [0.0], "recall": [0.0], "f1": [0.0]})
        best_p, best_r = np.full(len(p), -np.inf), np.full(len(r), -np.inf)
        for i in range(0, len(p), block):
            for j in range(0, len(r), block):
                sims = p[i : i + block] @ r[j : j + block].T
                best_p[i : i + block] = np.maximum(best_p[i : i + block], sims.max(axis=1))
                best_r[j : j + block] = np.maximum(best_r[j : j + block], sims.max(axis=0))
        precision, recall = float(best_p @ cp / cp.sum()), float(best_r @ cr / cr.sum())
        total = precision + recall
        f1 = 2 * precision * recall / total if total else 0.0
        return pd.DataFrame({"id": [key[0]], "precision": [precision], "recall": [recall], "f1": [f1]})

    id_type = tokens.schema["id"].dataType.simpleString()
    return tokens.groupBy("id").applyInPandas(score, f"id {id_type}, precision double, recall double, f1 double")


def mauve_curve(clusters: DataFrame, cluster: str, side: str, points: int = 25, scale: float = 5.0) -> DataFrame:
    """``(i, x, y)``: the divergence frontier of two cluster histograms, its two end points included.

    The histograms have one row per cluster; each adds its two divergence terms to every mixture weight.
    """
    hist = clusters.groupBy(cluster).agg(F.count(F.when(F.col(side) == "p", 1)).alias("np"), F.count(F.when(F.col(side) == "q", 1)).alias("nq"))
    everything = W.partitionBy(F.lit(0))
    hist = hist.select((F.col("np") / F.sum("np").over(everything)).alias("p"), (F.col("nq") / F.sum("nq").over(everything)).alias("q"))
    low = 1e-6
    step = (1.0 - 2 * low) / (points - 1)
    grid = hist.select("p", "q", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("i")).withColumn("w", F.lit(low) + (F.col("i") - 1) * F.lit(step))
    r = F.col("w") * F.col("p") + (1 - F.col("w")) * F.col("q")
    term = lambda s: F.when(F.col(s) > 0, F.col(s) * F.ln(F.col(s) / r)).otherwise(F.lit(0.0))
    curve = grid.groupBy(F.col("i").cast("bigint").alias("i")).agg(
        F.exp(-scale * F.sum(term("q"))).alias("x"), F.exp(-scale * F.sum(term("p"))).alias("y")
    )
    ends = curve.sparkSession.createDataFrame([(0, 1.0, 0.0), (points + 1, 0.0, 1.0)], "i bigint, x double, y double")
    return curve.unionByName(ends)


def mauve_from_curve(curve: DataFrame) -> DataFrame:
    """Area under the frontier: the mean of the trapezoid areas taken along either axis."""
    everything = W.partitionBy(F.lit(0))
    along = lambda a, b: everything.orderBy(a, F.desc(b))
    d = curve.withColumns({
        "ax": (F.col("x") - F.lag("x").over(along("x", "y"))) * (F.col("y") + F.lag("y").over(along("x", "y"))) / 2,
        "ay": (F.col("y") - F.lag("y").over(along("y", "x"))) * (F.col("x") + F.lag("x").over(along("y", "x"))) / 2,
    })
    return d.agg((F.lit(0.5) * (F.sum("ax") + F.sum("ay"))).alias("mauve"))


def mauve(vectors: DataFrame, vec: str, side: str, clusters: int, seed: int = 25) -> DataFrame:
    """MAUVE of two sets of text vectors: common k-means clusters, then the frontier area."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    x = vectors.select(side, array_to_vector(F.col(vec).cast("array<double>")).alias("raw"))
    x = Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(x).select(side, "features")
    model = KMeans(k=clusters, seed=seed, maxIter=50, initMode="k-means||").fit(x)
    return mauve_from_curve(mauve_curve(model.transform(x).select(side, "prediction"), "prediction", side))


def perplexity(tokens: DataFrame, seq: str, pos: str, logp: str) -> DataFrame:
    """``exp`` of the mean negative log-probability per sequence; the first token is not predicted."""
    return tokens.where(F.col(pos) > 0).groupBy(seq).agg(F.exp(-F.avg(logp)).alias("perplexity"))


def perplexity_stats(scores: DataFrame, col: str) -> DataFrame:
    """Summary of the finite scores."""
    from tagloom.operators.stats import exact_quantiles

    finite = scores.where(F.col(col) < F.lit(float("inf")))
    stats = finite.agg(
        F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max")
    )
    return stats.withColumn("median", exact_quantiles(finite, col, [0.5]).select("value").scalar())


def judge_stats(scores: DataFrame, col: str) -> DataFrame:
    """Summary of judge scores; zeros when there are none."""
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return scores.agg(zero(F.avg(col), "mean"), zero(F.stddev_pop(col), "std"), zero(F.min(col), "min"), zero(F.max(col), "max"))
