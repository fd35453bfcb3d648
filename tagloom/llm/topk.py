"""Exact top-k inner products by distributed histogram selection.

All scores are integers. For every query a histogram over a range of scores is summed over all tasks; the bin
that holds the k-th largest becomes the next range, until a bin is a single value. A last pass keeps what is
above that value, and of the ties the smallest ids. A task sends only the bins down to its own k-th score: the
global k-th is never below it, so nothing that counts is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.base import LAST_ID, batch, id_key, stored
from tagloom.session import scratch_path

BINS = 1024
#: Queries handled at once, in one broadcast. More queries make more passes over the candidates.
QUERY_BLOCK = 4096
#: Candidates times queries scored at once in a task.
SCORES = 4_000_000
EXACT = 1 << 53


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows with a null or non-finite one are left out."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf))
    return (
        vectors.select(id_key(id_col).alias("id"), x.alias("x")).filter(F.col("x").isNotNull() & ~F.exists("x", bad))
        .select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
    )


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def scored(batches: Iterator[pa.RecordBatch], queries: np.ndarray, query_ids: np.ndarray, exact_double: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, scores, own): blocks of candidates against all queries; ``own`` marks rows with the query's id."""
    kind = np.float64 if exact_double else np.int64
    other = np.ascontiguousarray(queries.T.astype(kind))
    step = max(1, SCORES // max(1, len(queries)))
    for b in batches:
        rows, ids = matrix(b.column("v"), queries.shape[1]).astype(kind), b.column("id").to_numpy()
        for a in range(0, len(rows), step):
            yield ids[a : a + step], (rows[a : a + step] @ other).astype(np.int64), ids[a : a + step, None] == query_ids[None, :]


def _histograms(shared, bins: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_ids, low, high, width, exact = shared.value
        n = len(queries)
        total = np.zeros(n * bins, np.int64)
        for _, score, own in scored(batches, queries, query_ids, exact):
            at = (score - low[None, :]) // width
            use = ~own & (score >= low[None, :]) & (score <= high[None, :])
            total += np.bincount((at + np.arange(n)[None, :] * bins)[use], minlength=n * bins)
        total = total.reshape(n, bins)
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
        q, at = np.nonzero((total > 0) & (above < k))
        yield batch(q=q.astype(np.int32), bin=at.astype(np.int32), n=total[q, at])

    return run


def _kept(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_ids, kth, exact = shared.value
        ties: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for ids, score, own in scored(batches, queries, query_ids, exact):
            c, q = np.nonzero((score > kth[None, :]) & ~own)
            yield batch(q=q.astype(np.int32), id=ids[c], score=score[c, q])
            c, q = np.nonzero((score == kth[None, :]) & ~own)
            q, tied = np.append(ties[0], q), np.append(ties[1], ids[c])
            order = np.lexsort((tied, q))
            q, tied = q[order], tied[order]
            start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
            place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
            ties = q[place < k], tied[place < k]
        yield batch(q=ties[0].astype(np.int32), id=ties[1], score=kth[ties[0]])

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best rows of ``vectors`` without those of its own id.

    Vectors that are null or hold a null or non-finite component take no part; shorter vectors end in zeros; an
    empty vector scores 0. Ties go to the smaller id, null ids last; rows that repeat an id each count, except
    that a query skips all rows of its own id. Fewer than k candidates are all returned. Scores are whole
    numbers up to 63 bits. Queries are handled in blocks of bounded size, each in a few passes.
    """
    spark = vectors.sparkSession
    data = quantised(vectors, id_col, vec_col, scale)
    asked = stored(quantised(queries, id_col, vec_col, scale), "queries")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    width, longest = data.agg(F.max(F.size("v")), F.max(size)).first()
    n, most = asked.agg(F.count("*"), F.max(size)).first()
    blocks = -(-n // QUERY_BLOCK)
    path = scratch_path(spark, "topk")
    bound = int(math.ceil((longest or 0.0) * (most or 0.0) * 1.001)) + 1
    for b in range(max(blocks, 1)):
        part = asked.filter(F.pmod(F.xxhash64("id", "v"), F.lit(max(blocks, 1))) == b).toArrow()
        _block(data, part, width or 0, bound, k, b).write.mode("append").parquet(path)
    best = Window.partitionBy("query", "copy").orderBy(F.desc("score"), "id")
    hidden = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return (
        spark.read.schema("query long, copy long, id long, score long").parquet(path)
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select(hidden("query").alias("query_id"), "rank", hidden("id").alias("vec_id"), "score")
    )


def _block(data: DataFrame, part: pa.Table, width: int, bound: int, k: int, block: int) -> DataFrame:
    """The rows of the k best and more ties, for a block of queries."""
    spark = data.sparkSession
    ids = part["id"].to_numpy()
    queries = matrix(part["v"].combine_chunks(), width) if len(ids) else np.zeros((0, width), np.int64)
    exact = bound < EXACT
    low, high = np.full(len(ids), -bound), np.full(len(ids), bound)
    need = np.full(len(ids), k)
    more = len(ids) > 0
    while more:
        step = max(1, -(-int((high - low + 1).max()) // BINS))
        shared = spark.sparkContext.broadcast((queries, ids, low.copy(), high.copy(), step, exact))
        counts = data.mapInArrow(_histograms(shared, BINS, k), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        # per query the one bin in which the running count from above reaches what is wanted
        wanted = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(ids)), pa.int32()), "need": need}))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        found = counts.withColumn("upto", F.sum("n").over(down)).join(wanted, "q").filter("upto >= need and upto - n < need").select("q", "bin", (F.col("upto") - F.col("n")).alias("above")).toArrow()
        q, at = found["q"].to_numpy(), found["bin"].to_numpy().astype(np.int64)
        few = np.ones(len(ids), bool)  # fewer than wanted in the range: all of it is in
        few[q] = False
        low[q] += at * step
        need[q] -= found["above"].to_numpy()
        high = np.where(few, low, low + step - 1)
        more = step > 1
        shared.unpersist()
    shared = spark.sparkContext.broadcast((queries, ids, low, exact))
    out = data.mapInArrow(_kept(shared, k), "q int, id long, score long")
    own = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(ids)), pa.int32()), "query": pa.array(ids, pa.int64())}))
    # a query's rows are at most k of each task; the number of the query in its block keeps repeated ids apart
    return out.join(F.broadcast(own), "q").select("query", (F.lit(block << 32) + F.col("q")).alias("copy"), "id", "score")
