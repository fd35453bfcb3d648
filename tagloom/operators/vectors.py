"""Statistics and scores over embedding vectors.

Matrix work happens per Arrow batch in numpy; what is shuffled are small partial sums.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tagloom.functions.vectors import cosine, squared_distance
from tagloom.operators.moments import matrix_moments, vector_moments
from tagloom.session import scratch_path

#: Numbers of the vectors of a strip and of a block that a strip reads, and distances that a task computes at a time.
STRIP_CELLS, BLOCK_CELLS, TILE_CELLS = 1 << 22, 1 << 20, 1 << 18


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a 2-D array."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def paired_cosine(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """Cosine of the two vectors that share an id; rows without a partner keep a NULL score."""
    joined = left.select(id_col, F.col("vec").alias("a")).join(right.select(id_col, F.col("vec").alias("b")), id_col, "left")
    return joined.select(id_col, cosine("a", "b").alias("score"))


def score_summary(scores: DataFrame, col: str = "score") -> DataFrame:
    return scores.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))


def mean_vector(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean per dimension, in order. NULL vectors and elements do not count; a dimension without a number is NULL."""
    out = vector_moments(df, vec, by)
    return out.select(*by, F.zip_with("n", "mean", lambda n, m: F.when(n > 0, m)).alias("mean"))


def variances(n: str, m2: str) -> Column:
    """Sample variance per dimension, NULL for fewer than two numbers."""
    return F.zip_with(n, m2, lambda k, s: F.when(k > 1, s / (k - 1)))


def covariance(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., i, n, mean, cov)``: row ``i`` of the sample covariance matrix of every group, NaN for a single row.

    ``by`` names columns with few values. NULL vectors are left out; the others have one length and no NULL element.
    """
    out = matrix_moments(df, vec, by)
    width = F.size("mean")
    cells = F.transform("m2", lambda x: F.coalesce(F.try_divide(x, F.col("n") - 1), F.lit(math.nan)))
    rows = F.transform(
        F.sequence(F.lit(0), (F.size("m2") / width).cast("int") - 1),
        lambda r: F.struct((F.col("first") + r).alias("i"), F.slice("_cells", r * width + 1, width).alias("cov")),
    )
    return out.withColumn("_cells", cells).select(*by, F.col("n").cast("bigint").alias("n"), "mean", F.inline(rows)).select(*by, "i", "n", "mean", "cov")


def frechet(mu1: np.ndarray, s1: np.ndarray, mu2: np.ndarray, s2: np.ndarray, eps: float = 1e-6) -> float:
    """Fréchet distance of two normal distributions from symmetric eigenvalues."""

    def trace_root(a: np.ndarray, b: np.ndarray) -> float:
        w, v = np.linalg.eigh(a)
        root = (v * np.sqrt(np.clip(w, 0, None))) @ v.T
        return float(np.sqrt(np.clip(np.linalg.eigvalsh(root @ b @ root), 0, None)).sum())

    t = trace_root(s1, s2)
    if not np.isfinite(t):
        offset = np.eye(len(s1)) * eps
        t = trace_root(s1 + offset, s2 + offset)
    d = mu1 - mu2
    return float(d @ d + np.trace(s1) + np.trace(s2) - 2 * t)


def frechet_distance(generated: DataFrame, reference: DataFrame, vec: str = "vec") -> DataFrame:
    """One row with the distance; infinite when a side is empty. A side of one row has covariance zero.

    Means and covariances are distributed sums. The last step sees only the ``2 * dim`` matrix rows.
    """
    sides = generated.select(F.lit("g").alias("side"), vec).unionByName(reference.select(F.lit("r").alias("side"), vec))
    rows = covariance(sides, vec, ["side"])

    def last(d: pd.DataFrame) -> pd.DataFrame:
        part = {s: g.sort_values("i") for s, g in d.groupby("side")}
        if not {"g", "r"} <= part.keys():
            return pd.DataFrame({"frechet_distance": [math.inf]})
        mu = {s: np.asarray(g["mean"].iloc[0]) for s, g in part.items()}
        cov = {s: np.nan_to_num(np.stack(g["cov"].to_list())) for s, g in part.items()}  # one row has no spread
        return pd.DataFrame({"frechet_distance": [frechet(mu["g"], cov["g"], mu["r"], cov["r"])]})

    out = rows.groupBy().applyInPandas(last, "frechet_distance double")
    return out.groupBy().agg(F.coalesce(F.max("frechet_distance"), F.lit(math.inf)).alias("frechet_distance"))


def per_sample_frechet(generated: DataFrame, reference: DataFrame, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """Squared distance to the reference mean plus the trace of the reference covariance."""
    found = vector_moments(reference, vec)
    trace = F.aggregate(variances("n", "m2"), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    stats = found.select(F.struct("mean", F.when(F.exists("n", lambda n: n > 1), trace).alias("trace")).alias("s"))
    d = generated.withColumn("_s", stats.scalar())
    return d.select(id_col, (squared_distance(vec, F.col("_s.mean")) + F.col("_s.trace")).alias("score"))


def silhouette(df: DataFrame, id_col: str, vec: str, label: str, block_rows: int = 1 << 15, exclude_self: bool = False) -> DataFrame:
    """Mean silhouette with Euclidean distances.

    Rows are put in order of their labels once, in strips of about ``block_rows`` (fewer of wide vectors), three for each core at least.
    The strips are kept on the executors' disks, as blocks. The task of a strip keeps its rows and reads all blocks, one at a time;
    so it holds one sum per row of the strip and label that is not yet read to its end, whatever the numbers of rows and
    labels, and what leaves it is one row. No row is shuffled a second time, so disk goes with the rows. The definition
    itself needs all distances, so the time grows with the square of the rows. Rows count one by one, whether or
    not they share an id; rows without a vector or a label (NULL) are left out.
    """
    spark = df.sparkSession
    d = df.select(F.col(vec).cast("array<double>").alias("v"), F.col(label).cast("bigint").alias("label")).where("v is not null and label is not null")
    path = scratch_path(spark, "points")
    d.withColumn("uid", F.monotonically_increasing_id()).write.parquet(path)
    d = spark.read.parquet(path)
    n, width = d.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    strips = max(math.ceil(n / block_rows), math.ceil(n * width / STRIP_CELLS), min(3 * cores, math.ceil(n / 64)), 1)
    ordered = d.select("label", "uid", "v").repartitionByRange(strips, "label", "uid").sortWithinPartitions("label", "uid")
    packed = ordered.mapInArrow(_blocks(max(min(block_rows, BLOCK_CELLS // max(width, 1)), 1)), "ends array<struct<label: bigint, n: bigint>>, rows binary")
    blocks = packed.rdd.persist(StorageLevel.DISK_ONLY)
    shared = _shared_labels(blocks.map(lambda b: [(e["label"], e["n"]) for e in b["ends"]]).collect())
    pairs = blocks.glom().cartesian(blocks.coalesce(1))  # a partition for each strip, which reads all blocks after one another
    scores = spark.createDataFrame(pairs.mapPartitions(_pair_scores(exclude_self, shared)), "s double, n bigint")
    return scores.agg(F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("silhouette"))


def _blocks(rows: int):
    """Rows that are in order of their labels, as blocks of so many, each with its first and last label and their rows in it."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        label = table.column("label").to_numpy()
        ends = [{"label": int(x), "n": int((label == x).sum())} for x in dict.fromkeys((label[0], label[-1]))]
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        kind = pa.list_(pa.struct([("label", pa.int64()), ("n", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([ends], kind), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["ends", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            while len(b):
                parts.append(b.slice(0, rows - held))
                held += len(parts[-1])
                b = b.slice(len(parts[-1]))
                if held == rows:
                    yield block(parts)
                    parts, held = [], 0
        if parts:
            yield block(parts)

    return run


def _shared_labels(ends: Iterable[list[tuple[int, int]]]) -> dict[int, int]:
    """The labels that are in several blocks, and their rows; such a label begins or ends each block that it is in."""
    blocks, rows = Counter(), Counter()
    for label, n in (e for block in ends for e in block):
        blocks[label] += 1
        rows[label] += n
    return {label: n for label, n in rows.items() if blocks[label] > 1}


def _pair_scores(exclude_self: bool, shared: Mapping[int, int]):
    """The scores of a strip from pairs of all its blocks and one block of all rows; the strip is the same in each pair."""

    def batch(own: bool, block: Row) -> pa.RecordBatch:
        b = pa.ipc.open_stream(block["rows"]).read_all().combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b), np.int32)), pa.array(np.full(len(b), own)), *b.columns], names=["strip", "own", *b.schema.names])

    def batches(pairs: Iterator[tuple[list[Row], Row]]) -> Iterator[pa.RecordBatch]:
        for k, (strip, block) in enumerate(pairs):
            if not k:
                yield from (batch(True, b) for b in strip)
            yield batch(False, block)

    def run(pairs: Iterator[tuple[list[Row], Row]]) -> Iterator[tuple[float, int]]:
        for b in _strip_scores(exclude_self, shared)(batches(pairs)):
            yield b.column(0)[0].as_py(), b.column(1)[0].as_py()

    return run


class Strip:
    """The rows of a strip, and of each the sum of its distances to each label that is being read.

    ``shared`` are the labels that come in several parts, in any order, and their rows; each begins or ends what is read at a time.
    Without it rows come in order of their labels.
    """

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], exclude_self: bool, shared: Mapping[int, int] | None = None):
        self.x, self.label, uid = (np.concatenate(p) for p in zip(*parts))
        self.norm, self.exclude_self, self.shared = (self.x**2).sum(axis=1), exclude_self, shared
        self.order = np.argsort(uid)
        self.uid = uid[self.order]
        self.a, self.b = np.zeros(len(self.x)), np.full(len(self.x), np.nan)
        self.other = np.zeros(len(self.x), bool)
        self.sums: dict[int, np.ndarray] = {}
        self.counts: Counter[int] = Counter()

    def read(self, x: np.ndarray, label: np.ndarray, uid: np.ndarray) -> None:
        """The next rows, by label."""
        start = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        labels, counts = label[start], np.diff(np.append(start, len(label)))
        ends = {j: int(labels[j]) for j in (0, len(labels) - 1)}
        if self.shared is None:
            self.close(self.sums.keys() - {ends[0]})
        kept = {j: k for j, k in ends.items() if (j == len(labels) - 1 or k in self.sums if self.shared is None else k in self.shared)}
        for j, k in kept.items():
            self.sums.setdefault(k, np.zeros(len(self.x)))
            self.counts[k] += int(counts[j])
        inner = slice(int(0 in kept), len(labels) - (len(labels) - 1 in kept))
        at = np.minimum(np.searchsorted(self.uid, uid), len(self.uid) - 1)
        cols = np.flatnonzero(self.uid[at] == uid)
        rows = self.order[at[cols]]
        norm, xt = (x**2).sum(axis=1), np.ascontiguousarray(x.T)
        step = max(1, TILE_CELLS // len(x))
        sq, dot = np.empty((step, len(x))), np.empty((step, len(x)))
        for lo in range(0, len(self.x), step):
            part = slice(lo, min(lo + step, len(self.x)))
            m = part.stop - lo
            np.add(self.norm[part, None], norm, out=sq[:m])
            np.matmul(2.0 * self.x[part], xt, out=dot[:m])
            np.subtract(sq[:m], dot[:m], out=sq[:m])
            here = (rows >= lo) & (rows < part.stop)
            sq[rows[here] - lo, cols[here]] = 0.0  # a row is at no distance from itself
            np.sqrt(np.maximum(sq[:m], 0.0, out=sq[:m]), out=sq[:m])
            sums = np.add.reduceat(sq[:m], start, axis=1)
            for j, k in kept.items():
                self.sums[k][part] += sums[:, j]
            if inner.start < inner.stop:
                self.take(part, labels[inner], counts[inner], sums[:, inner])
        self.close({k for k in kept.values() if (k != ends[len(labels) - 1] if self.shared is None else self.counts[k] == self.shared[k])})

    def take(self, part: slice, labels: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Labels that were read to their end."""
        same = self.label[part, None] == labels
        i, j = np.nonzero(same)
        size = counts[j] - 1 if self.exclude_self else counts[j]
        self.a[part.start + i] = np.where(counts[j] > 1, sums[i, j] / np.maximum(size, 1), 0.0)
        self.b[part] = np.fmin(self.b[part], np.fmin.reduce(np.where(same, np.nan, sums / counts), axis=1))
        self.other[part] |= ~same.all(axis=1)

    def close(self, labels: Iterable[int]) -> None:
        for k in labels:
            self.take(slice(0, len(self.x)), np.array([k]), np.array([self.counts.pop(k)]), self.sums.pop(k)[:, None])

    def score(self) -> float:
        if self.shared is not None and self.sums:
            raise RuntimeError(f"{len(self.sums)} labels were not read to their end")
        self.close(list(self.sums))
        top = np.maximum(self.a, self.b)
        return float(np.divide(self.b - self.a, top, out=np.zeros(len(top)), where=self.other & (top != 0)).sum())


def _strip_scores(exclude_self: bool, shared: Mapping[int, int] | None = None):
    """For each strip the sum of its rows' silhouettes, and its rows; the strip's own rows come first, then all (see :class:`Strip`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, strip = None, [], None

        def ended() -> Iterator[pa.RecordBatch]:
            if strip is not None:
                yield pa.RecordBatch.from_pydict({"s": pa.array([strip.score()], pa.float64()), "n": pa.array([len(strip.x)], pa.int64())})

        for b in batches:
            numbers, own = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (own[1:] != own[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
                if lo == hi:
                    continue
                if numbers[lo] != number:
                    yield from ended()
                    number, parts, strip = numbers[lo], [], None
                x, label, uid = matrix(b.column(4).slice(lo, hi - lo)), b.column(2).to_numpy()[lo:hi], b.column(3).to_numpy()[lo:hi]
                if own[lo]:
                    parts.append((x, label, uid))
                    continue
                if strip is None and parts:
                    strip, parts = Strip(parts, exclude_self, shared), []
                if strip is not None:
                    strip.read(x, label, uid)
        yield from ended()

    return run


def robust_scale(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """Subtract the median and divide by the interquartile range of every dimension; a flat one is only centred."""
    from tagloom.operators.stats import vector_quantiles

    q = vector_quantiles(df, vec, [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    per_dim = q.groupBy("dim").agg(at(0.5).alias("m"), (at(0.75) - at(0.25)).alias("r"))
    dims = per_dim.agg(F.array_sort(F.collect_list(F.struct("dim", "m", F.when(F.col("r") != 0, F.col("r")).otherwise(F.lit(1.0)).alias("r")))).alias("d"))
    scaled = F.zip_with(F.col(vec).cast("array<double>"), F.col("_dims"), lambda x, d: (x - d["m"]) / d["r"])
    return df.withColumn("_dims", dims.select("d").scalar()).select(id_col, scaled.alias("scaled"))


def project_2d(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """First two principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    out = PCA(k=2, inputCol="features", outputCol="pc").fit(x).transform(x).select(id_col, vector_to_array("pc").alias("pc"))
    return out.select(id_col, F.get("pc", F.lit(0)).alias("x"), F.get("pc", F.lit(1)).alias("y"))


def accuracy(df: DataFrame, predicted: Column, label: Column) -> DataFrame:
    return df.agg(F.avg((predicted == label).cast("double")).alias("accuracy"))


def batch_scores(df: DataFrame, keys: Sequence[str], vec: str, score: Callable[[np.ndarray], dict[str, np.ndarray]], outputs: Sequence[str]) -> DataFrame:
    """Apply a numpy model to every Arrow batch of vectors; each output is one array column."""
    keys = list(keys)
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"{o} array<double>" for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = score(matrix(batch.column(len(keys))))
            lists = [pa.array(list(out[o]), pa.list_(pa.float64())) for o in outputs]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keys))] + lists, names=[*keys, *outputs])

    return df.select(*keys, F.col(vec).cast("array<double>")).mapInArrow(run, schema)
