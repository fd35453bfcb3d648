"""Scoring with given weights of the tag autoencoder, and tag-set generation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import render_tag_literal
from tagloom.operators import splits
from tagloom.operators import tags as T
from tagloom.operators.taxonomy import Taxonomy
from tagloom.operators.vectors import batch_scores, matrix

Weights = Mapping[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _norm(h: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """Batch normalisation with stored statistics, where the weights have it."""
    if f"{name}_mean" not in w:
        return h
    return (h - w[f"{name}_mean"]) / np.sqrt(w[f"{name}_var"] + 1e-5) * w[f"{name}_weight"] + w[f"{name}_bias"]


def decoder_logits(z: np.ndarray, w: Weights) -> np.ndarray:
    return _norm(np.maximum(z @ w["w3"] + w["b3"], 0.0), w, "bn2") @ w["w4"] + w["b4"]


def encode(x: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    h = _norm(np.maximum(x @ w["w1"] + w["b1"], 0.0), w, "bn1")
    return h @ w["w_mu"] + w["b_mu"], h @ w["w_logvar"] + w["b_logvar"]


def score_decoder(df: DataFrame, keys: Sequence[str], z: str, w: Weights, temperature: float = 1.0) -> DataFrame:
    """``probs`` of every latent vector."""
    return batch_scores(df, keys, z, lambda x: {"probs": _sigmoid(decoder_logits(x, w) / temperature)}, ["probs"])


def score_encoder(df: DataFrame, keys: Sequence[str], x: str, w: Weights) -> DataFrame:
    """``mu`` and ``logvar`` of every multi-hot vector."""

    def run(batch: np.ndarray) -> dict[str, np.ndarray]:
        mu, logvar = encode(batch, w)
        return {"mu": mu, "logvar": logvar}

    return batch_scores(df, keys, x, run, ["mu", "logvar"])


def reconstruct(df: DataFrame, keys: Sequence[str], x: str, w: Weights) -> DataFrame:
    """``probs`` decoded from the latent mean, without sampling."""
    return batch_scores(df, keys, x, lambda v: {"probs": _sigmoid(decoder_logits(encode(v, w)[0], w))}, ["probs"])


def decode_grid(
    df: DataFrame, keys: Sequence[str], z: str, seeds: str, w: Weights, temperatures: Sequence[float], threshold: float,
    ranges: Sequence[tuple[int, int]], min_categories: int, apply_sigmoid: int = 2, free: Sequence[float] = (),
) -> DataFrame:
    """``(keys..., seeded, temperature, slots, idx)``: positions at or above the threshold, or seeded, at every
    temperature, and at those of ``free`` without the seeds.

    A temperature that is listed several times is decoded once; ``slots`` are its places in the list, those of ``free``
    counted on from the end of the first. Sets that touch fewer than ``min_categories`` of the index ranges are left
    out before they leave the task.
    """
    keys = list(keys)
    lead = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    wanted: dict[tuple[bool, float], list[int]] = {}
    for slot, (with_seeds, t) in enumerate([(True, float(t)) for t in temperatures] + [(False, float(t)) for t in free]):
        wanted.setdefault((with_seeds, t), []).append(slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw = decoder_logits(matrix(batch.column(len(keys))), w)
            raw = _sigmoid(raw) if apply_sigmoid == 2 else raw
            lists = batch.column(len(keys) + 1)
            forced = np.zeros(raw.shape, dtype=bool)
            sizes = np.diff(lists.offsets.to_numpy())
            forced[np.repeat(np.arange(n), sizes), lists.flatten().to_numpy(zero_copy_only=False)] = True
            for (with_seeds, t), slots in wanted.items():
                on = _sigmoid(raw / t) >= threshold
                on = on | forced if with_seeds else on
                touched = sum(on[:, lo:hi].any(axis=1).astype(int) for lo, hi in ranges)
                rows = np.nonzero(touched >= min_categories)[0]
                on = on[rows]
                offsets = np.concatenate([[0], on.sum(axis=1).cumsum()]).astype(np.int32)
                idx = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(on)[1].astype(np.int32)))
                cols = [batch.column(i).take(pa.array(rows)) for i in range(len(keys))]
                cols += [pa.array([with_seeds] * len(rows), pa.bool_()), pa.array([t] * len(rows), pa.float64()), pa.array([slots] * len(rows), pa.list_(pa.int32())), idx]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "seeded", "temperature", "slots", "idx"])

    schema = f"{lead}seeded boolean, temperature double, slots array<int>, idx array<int>"
    return df.select(*keys, F.col(z).cast("array<double>"), F.col(seeds).cast("array<int>")).mapInArrow(run, schema)


def generate_tag_sets(
    df: DataFrame, tax: Taxonomy, w: Weights, latent_dim: int, temperatures: Sequence[float], threshold: float,
    seed: int = 0, min_categories: int = 3, seed_categories: Sequence[str] = ("genre", "instrument", "mood"),
) -> DataFrame:
    """New tag sets from ``(id, tags)`` samples, row by row and without a shuffle.

    Every sample is decoded at every temperature twice: around seed tags drawn from its own categories, and
    from the same latent vector without seeds, which is recorded with an empty original list at the last
    temperature. Sets that cover too few categories are dropped. ``aspect_list`` is sorted, ``idx`` holds
    the same tags as taxonomy positions.
    """
    base = T.categorize_tags(df.select("id", "tags"), tax)
    picks = T.seed_tags([c + "_tags" for c in seed_categories], "id", seed)
    base = tax.encode(base.select("id", "tags", picks.alias("seeds")), "seeds").withColumnRenamed("tag_idx", "seed_idx")
    base = splits.latent_normal(base.select("id", render_tag_literal("tags").alias("original"), "seed_idx"), "id", latent_dim, seed, "z")
    spans: dict[str, list[int]] = {}
    for category, _, _, _, idx in tax.rows:
        spans.setdefault(category, [idx, idx])[1] = idx + 1
    ranges = [(lo, hi) for lo, hi in spans.values()]
    free = [temperatures[-1]] * len(temperatures)
    sets = decode_grid(base, ["id", "original"], "z", "seed_idx", w, temperatures, threshold, ranges, min_categories, free=free)
    original = F.when(F.col("seeded"), F.col("original")).otherwise(F.lit("[]"))
    key = F.md5(F.concat_ws("_", F.col("id").cast("string"), original, F.col("temperature").cast("string")))
    sets = sets.select("id", "slots", "temperature", "idx", F.array_sort(tax.decode("idx")).alias("aspect_list"), key.alias("key"))
    return sets.select("id", F.explode("slots").alias("slot"), "temperature", "idx", "aspect_list", "key")
