"""Mergeable centred moments of vectors: counts, means and squared deviations, per dimension or as a matrix.

A task sums up its rows in numpy and sends one row per group (and block of matrix rows). Those meet in a tree: first
at most ``FAN_IN`` of them in a node, then the nodes. Every merge shifts by the difference of the means, so nothing
cancels; a merging task reads sorted rows and keeps one sum at a time, however many arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

FAN_IN = 256
#: Numbers of a block of matrix rows, and sums that a task holds before it sends them on.
BLOCK_CELLS, HELD_CELLS = 1 << 16, 1 << 23

Sums = tuple[np.ndarray, np.ndarray, np.ndarray]


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix, and where it has a number: shorter lists and NULL elements have none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    width = int(sizes.max(initial=0))
    x, there = np.zeros((len(column), width)), np.zeros((len(column), width), bool)
    place = np.arange(width)[None, :] < sizes[:, None]
    there[place] = flat.is_valid().to_numpy(zero_copy_only=False)
    x[place] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    return x, there


def merge(a: Sums, b: Sums) -> Sums:
    """Counts, means and squared deviations per dimension of two disjoint sets of rows; shorter ones have counts of 0."""
    width = max(len(a[0]), len(b[0]))
    (n0, m0, s0), (n1, m1, s1) = ([np.pad(x, (0, width - len(x))) for x in side] for side in (a, b))
    n = n0 + n1
    share = np.divide(n1, n, out=np.zeros(width), where=n > 0)
    shift = m1 - m0
    return n, m0 + shift * share, s0 + s1 + shift * shift * n0 * share


def _per_group(keys: int, start: Callable, add: Callable, rows_of: Callable):
    """For each group of a task one running sum, sent on when the sums of all groups take too much room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, object] = {}
        for b in batches:
            b = b.filter(pc.is_valid(b.column(keys)))
            index: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*[b.column(i).to_pylist() for i in range(keys)]) if keys else [()] * len(b)):
                index.setdefault(key, []).append(at)
            for key, rows in index.items():
                part = start(b.column(keys).take(pa.array(rows)))
                held[key] = add(held[key], part) if key in held else part
            if sum(sum(x.size for x in s) for s in held.values()) > HELD_CELLS:
                yield from rows_of(held)
                held = {}
        yield from rows_of(held)

    return run


def _merged(keys: int, read: Callable, add: Callable, rows_of: Callable):
    """Adds up consecutive rows of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for b in batches:
            names = list(zip(*[b.column(i).to_pylist() for i in range(keys)])) if keys else [()] * len(b)
            for r, key in enumerate(names):
                part = read(b, r)
                if total is not None and key == last:
                    total = add(total, part)
                else:
                    if total is not None:
                        yield from rows_of({last: total})
                    last, total = key, part
        if total is not None:
            yield from rows_of({last: total})

    return run


def _tree(parts: DataFrame, keys: Sequence[str], combine: Callable, schema: str) -> DataFrame:
    """Merges the rows of equal keys, at most FAN_IN of the tasks that made them at a time, then the results."""
    for at in ([*keys, "node"], list(keys)):
        dealt = parts.repartition(*at) if at else parts.repartition(1)
        parts = dealt.sortWithinPartitions(*at).mapInArrow(combine, schema) if at else dealt.mapInArrow(combine, schema)
    return parts


def key_types(df: DataFrame, by: Sequence[str]) -> tuple[str, list[pa.DataType]]:
    """The columns as the start of a schema text, and their Arrow types."""
    return "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by), [to_arrow_type(df.schema[b].dataType) for b in by]


def vector_moments(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., n, mean, m2)``, arrays with an entry per dimension: numbers, their mean, squared deviations from it.

    NULL vectors and NULL elements do not count; vectors may differ in length. No row without a vector.
    """
    by = list(by)
    lead, kinds = key_types(df, by)
    names = [*by, "node", "n", "mean", "m2"]

    def start(column: pa.Array) -> Sums:
        x, there = padded(column)
        n = there.sum(axis=0).astype(np.float64)
        mean = np.divide(x.sum(axis=0), n, out=np.zeros(len(n)), where=n > 0)
        gap = np.where(there, x - mean, 0.0)
        return n, mean, (gap * gap).sum(axis=0)

    def rows_of(held: dict) -> Iterator[pa.RecordBatch]:
        if held:
            columns = [pa.array([key[i] for key in held], kind) for i, kind in enumerate(kinds)]
            columns.append(pa.array([TaskContext.get().partitionId() // FAN_IN] * len(held), pa.int32()))
            columns += [pa.array([s[k] for s in held.values()], pa.list_(pa.float64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    read = lambda b, r: tuple(b.column(len(by) + 1 + k)[r].values.to_numpy() for k in range(3))
    schema = f"{lead}node int, n array<double>, mean array<double>, m2 array<double>"
    parts = df.select(*by, F.col(vec).cast("array<double>")).mapInArrow(_per_group(len(by), start, merge, rows_of), schema)
    return _tree(parts, by, _merged(len(by), read, merge, rows_of), schema).drop("node")


def matrix_moments(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., first, n, mean, m2)``: blocks of consecutive rows of the matrix of squared deviations, from row
    ``first``; ``m2`` holds them one after the other. Vectors have one length and no NULL element; NULL vectors do not
    count. A task holds a matrix for each group, so ``by`` names columns with few values."""
    by = list(by)
    lead, kinds = key_types(df, by)
    names = [*by, "first", "node", "n", "mean", "m2"]

    def start(column: pa.Array) -> Sums:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        mean = x.mean(axis=0)
        gap = x - mean
        return np.array([float(len(x))]), mean, gap.T @ gap

    def add(a: tuple, b: tuple, first: int = 0) -> tuple:
        n, shift = a[0] + b[0], b[1] - a[1]
        rows = shift[first : first + len(a[2])]
        return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(rows, shift) * (a[0] * b[0] / n)

    def send(entries: list) -> Iterator[pa.RecordBatch]:
        for key, first, (n, mean, m2) in entries:
            columns = [pa.array([k], kind) for k, kind in zip(key, kinds)]
            columns += [pa.array([first], pa.int32()), pa.array([TaskContext.get().partitionId() // FAN_IN], pa.int32()), pa.array([n[0]])]
            columns += [pa.array([x], pa.list_(pa.float64())) for x in (mean, m2.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def whole(held: dict) -> Iterator[pa.RecordBatch]:
        for key, (n, mean, m2) in held.items():
            if not len(mean):
                continue
            size = max(1, BLOCK_CELLS // len(mean))
            yield from send([(key, at, (n, mean, m2[at : at + size])) for at in range(0, len(mean), size)])

    def read(b: pa.RecordBatch, r: int) -> tuple:
        k = len(by)
        mean = b.column(k + 3)[r].values.to_numpy()
        return np.array([b.column(k + 2)[r].as_py()]), mean, b.column(k + 4)[r].values.to_numpy().reshape(-1, len(mean)), b.column(k)[r].as_py()

    def join(a: tuple, b: tuple) -> tuple:
        return (*add(a[:3], b[:3], a[3]), a[3])

    schema = f"{lead}first int, node int, n double, mean array<double>, m2 array<double>"
    parts = df.select(*by, F.col(vec).cast("array<double>")).mapInArrow(_per_group(len(by), start, add, whole), schema)
    blocks = lambda held: send([(key[:-1], key[-1], s[:3]) for key, s in held.items()])
    return _tree(parts, [*by, "first"], _merged(len(by) + 1, read, join, blocks), schema).drop("node")
