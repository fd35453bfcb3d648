"""Removal of long word sequences that a smaller document has too, found by difference-cover anchors.

Positions modulo ``period`` are sampled at a difference cover: for any two positions some shift below the
period takes both to sampled ones. Two equal runs of ``window`` words therefore share an anchor of
``window - period + 1`` words that starts at a sampled position of both documents, so hashing 3 of 7
positions finds every match. Anchors of a single document, nearly all, go no further. Around the others
every window is extended to its full length and compared by an 88-bit hash.

Data flow: the text is dealt out by id once and that exchange is used three times. An anchor is grouped
only for the documents that are the first of their chunk of input to have it. The others of the chunk
travel as one list per document, so a sequence with a third of all documents makes one row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.base import WordHashes, batch, id_key, lists, mixed, texts, window_hashes, words_of

WINDOW = 13
PERIOD = 7
#: A perfect difference set modulo 7.
COVER = (1, 2, 4)
#: Anchors only select, so fewer bits than a full hash do: a chance match costs work, not truth.
ANCHOR_BITS = np.uint64((1 << 64) - (1 << 16))
#: What a window's second hash adds to the 64 bits of its first.
MORE_BITS = np.uint64((1 << 64) - (1 << 40))
CHUNK = 1_500_000


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Anchors:
    """Anchor positions and window hashes of one document."""

    def __init__(self, window: int, period: int, cover: tuple[int, ...]):
        self.window, self.period, self.anchor = window, period, window - period + 1
        self.sampled = np.isin(np.arange(period), cover)
        self.hashes = WordHashes()

    def anchors(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = window_hashes(h, self.anchor) & ANCHOR_BITS
        at = np.flatnonzero(np.resize(self.sampled, len(a)))
        return at, a[at]

    def candidates(self, h: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor which another document has."""
        at, a = self.anchors(h)
        marks = np.zeros(len(h) + 1, np.int32)
        marks[at[np.isin(_upper(a), alive)] + 1] = 1
        seen = np.cumsum(marks)
        starts = np.arange(len(h) - self.window + 1)
        return starts[seen[starts + self.period] > seen[starts]]


def _grouped(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the distinct (key, id), which of them start a key, and how many ids the key has."""
    order = np.lexsort((ids, *reversed(keys)))
    new_key = np.ones(len(order), bool)
    new_key[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    new = new_key.copy()
    new[1:] |= ids[order[1:]] != ids[order[:-1]]
    order, first = order[new], new_key[new]
    start = np.flatnonzero(first)
    return order, first, np.repeat(np.diff(np.append(start, len(order))), np.diff(np.append(start, len(order))))


def _upper(h: np.ndarray) -> np.ndarray:
    return (h.view(np.int64) >> 32).astype(np.int32)


def _per_id(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids[start], lists(values, np.diff(np.append(start, len(ids))))


def _emit(g: np.ndarray, g2: np.ndarray, k: np.ndarray, hs: pa.Array) -> pa.RecordBatch:
    return batch(g2=g2.view(np.int64), g=g.view(np.int64), k=k, hs=hs)


def _witnesses(h: np.ndarray, h2: np.ndarray, k: np.ndarray, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk: one for each key, grouped over the corpus; and lists of what is already known, one for each id.

    ``keep_first``: a key of two ids is news for both of them, not only for the larger. Such keys only select, so
    lists of them hold their upper halves.
    """
    if not len(h):
        return
    order, first, count = _grouped([h, h2], k)
    h, h2, k = h[order], h2[order], k[order]
    lead = np.flatnonzero(first)
    lead = lead[np.argsort(k[lead], kind="stable")]  # rows of one id together compress best
    yield _emit(h[lead], h2[lead], k[lead], pa.nulls(len(lead), pa.list_(pa.int32() if keep_first else pa.int64())))
    known = (count > 1) if keep_first else ~first
    ids, hs = _per_id(k[known], _upper(h[known]) if keep_first else h[known].view(np.int64))
    if len(ids):
        yield _emit(mixed(ids.view(np.uint64)), np.zeros(len(ids), np.uint64), ids, hs)


def _chunked(rows: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, int]]], keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, h2 = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            k = np.repeat(np.array([p[2] for p in parts], np.int64), [len(p[0]) for p in parts])
            yield from _witnesses(h, h2, k, keep_first)

        for b in batches:
            for part in rows(b):
                if len(part[0]):
                    parts.append(part)
                    size += len(part[0])
                if size >= CHUNK:
                    yield from flush()
                    parts, size = [], 0
        if parts:
            yield from flush()

    return run


_ROWS = "g2 long, g long, k long, hs array<%s>"


def _known(rows: DataFrame, larger_only: bool) -> DataFrame:
    """(k, hs): per id the keys that another id has, or that a smaller id has."""
    over = Window.partitionBy("g", "g2")
    low, high = F.min("k").over(over), F.max("k").over(over)
    found = (low < F.col("k")) if larger_only else (low < high)
    one = F.col("g") if larger_only else F.shiftright("g", 32).cast("int")
    return (
        rows.withColumn("found", found).filter("found or hs is not null")
        .select("k", "hs", F.when(F.col("hs").isNull(), one).alias("one"))
        .groupBy("k").agg(F.concat(F.collect_list("one"), F.flatten(F.collect_list("hs"))).alias("hs"))
    )


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER,
) -> DataFrame:
    """Each row with ``n_words``, ``n_removed`` and ``kept_text``, the words left, joined by one space.

    A word goes if a run of ``window`` words around it also occurs in a document with a smaller id. Runs are
    judged on the input. A null text has no words and the kept text ''; a null id counts as larger than all
    ids, so such rows lose words and take none from others. Rows that share an id are one document: each keeps
    its own words and none makes another of them lose any. Repeated rows stay. Input columns are kept as they
    are; one that has the name of a result is replaced by it.
    """
    if not is_cover(cover, period) or period >= window:
        raise ValueError("cover must be a difference cover modulo period, and period smaller than window")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    data = docs.select(F.struct(*names).alias("row"), id_key(id_col).alias("k")).repartition("k")

    def anchors(b: pa.RecordBatch):
        tool = _tool()
        for k, text in zip(b.column("k").to_pylist(), texts(b.column("row").field(text_col)), strict=True):
            w = words_of(text)
            if len(w) >= window:
                _, a = tool.anchors(tool.hashes.of(w))
                yield a, np.zeros(len(a), np.uint64), k

    def windows(b: pa.RecordBatch):
        tool = _tool()
        hs = b.column("hs")
        for i, (k, text) in enumerate(zip(b.column("k").to_pylist(), texts(b.column("row").field(text_col)), strict=True)):
            w = words_of(text)
            if len(w) >= window:
                h = tool.hashes.of(w)
                at = tool.candidates(h, hs[i].values.to_numpy())
                yield window_hashes(h, window)[at], window_hashes(h, window, 2)[at] & MORE_BITS, k

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool()
        for b in batches:
            n_words, n_removed, kept = [], [], []
            hs = b.column("hs")
            for i, text in enumerate(texts(b.column("row").field(text_col))):
                w = words_of(text)
                gone = 0
                if hs[i].is_valid and len(w) >= window:
                    hit = np.isin(window_hashes(tool.hashes.of(w), window), hs[i].values.to_numpy().view(np.uint64))
                    edge = np.zeros(len(w) + 1, np.int32)
                    edge[: len(hit)] += hit
                    edge[window : window + len(hit)] -= hit
                    out = np.cumsum(edge[:-1]) > 0
                    gone = int(out.sum())
                    kept.append(b" ".join([x for x, o in zip(w, out.tolist(), strict=True) if not o]))
                else:
                    kept.append(b" ".join(w))
                n_words.append(len(w))
                n_removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["row", "n_words", "n_removed", "kept_text"],
            )

    cached: list[_Anchors] = []

    def _tool() -> _Anchors:
        if not cached:
            cached.append(_Anchors(window, period, cover))
        return cached[0]

    shared = _known(data.mapInArrow(_chunked(anchors, True), _ROWS % "int"), False)
    smaller = _known(data.join(shared, "k").mapInArrow(_chunked(windows, False), _ROWS % "long"), True)
    row_type = data.schema["row"].dataType.simpleString()
    out = data.join(smaller, "k", "left").mapInArrow(removed, f"row {row_type}, n_words long, n_removed long, kept_text string")
    return out.select("row.*", "n_words", "n_removed", "kept_text")
