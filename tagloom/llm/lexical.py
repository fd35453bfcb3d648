"""Ranked lexical search for many queries at once, with sums that queries share computed once.

A block of queries is a set of term sets. Terms that occur in the same queries are one shared set; then the two
sets that most queries hold together are joined again and again, until no two sets share two queries. That gives a
graph of sums: each node adds two others, every query is a node. For a block of documents a node's accumulator is an
array of whole-number scores, made once and used by every query above it. Whole numbers add up the same in any order,
so sharing changes no score.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.base import LAST_ID, batch, bounded, id_key, lists, stored, texts
from tagloom.session import scratch_path

#: Queries handled at once, in one broadcast. More queries make more passes over the documents.
QUERY_BLOCK = 1024
#: Accumulators (nodes times documents) held at once in a task.
ACCUMULATORS = 4_000_000
#: A table of query ids up to this size is broadcast, a larger one joined by shuffle.
BROADCAST_ITEMS = 200_000
#: Percent of a document's length that counts, and tenths of the saturation (fixed values).
LENGTH_PART, SATURATION = 90, 8
#: A term is a run of ASCII letters, digits and anything beyond ASCII; only A-Z is lower-cased.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for b in batches:
            keep, length, term, count, size = [], [], [], [], []
            for i, text in enumerate(texts(b.column("text"))):
                words = terms_of(text)
                if words:
                    found = [(vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary]
                    keep.append(i)
                    length.append(len(words))
                    size.append(len(found))
                    term += [t for t, _ in found]
                    count += [c for _, c in found]
            sizes = np.array(size, np.int64)
            yield batch(
                id=b.column("id").take(pa.array(keep, pa.int64())), length=np.array(length, np.int64),
                term=lists(np.array(term, np.int32), sizes), tf=lists(np.array(count, np.int64), sizes),
            )

    return run


def _frequencies(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            total += np.bincount(b.column("term").flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(total)
        yield batch(term=at.astype(np.int32), df=total[at])

    return run


class SharedSums:
    """A graph of sums. Nodes 0..n_terms-1 are terms; node ``n_terms + i`` adds ``left[i]`` and ``right[i]``, both
    smaller. ``roots[q]`` is the node of query q, -1 for one without terms."""

    def __init__(self, queries: list[set[int]], n_terms: int):
        self.n_terms, self.left, self.right = n_terms, [], []
        holders: dict[int, list[int]] = defaultdict(list)
        for q, terms in enumerate(queries):
            for t in terms:
                holders[t].append(q)
        together: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for t in sorted(holders):
            together[tuple(holders[t])].append(t)
        sets: list[set[int]] = [set() for _ in queries]
        for members, terms in together.items():
            node = self.chain(terms)
            for q in members:
                sets[q].add(node)
        self.share(sets)
        self.roots = np.array([self.chain(sorted(s)) if s else -1 for s in sets], np.int64)

    @property
    def n_nodes(self) -> int:
        return self.n_terms + len(self.left)

    def add(self, a: int, b: int) -> int:
        self.left.append(a)
        self.right.append(b)
        return self.n_nodes - 1

    def chain(self, nodes: list[int]) -> int:
        node = nodes[0]
        for other in nodes[1:]:
            node = self.add(node, other)
        return node

    def share(self, sets: list[set[int]]) -> None:
        """Replaces, most shared first, two nodes that at least two queries hold by their sum, until there are none."""
        pairs: dict[tuple[int, int], set[int]] = defaultdict(set)
        for q, nodes in enumerate(sets):
            ordered = sorted(nodes)
            for i, a in enumerate(ordered):
                for b in ordered[i + 1 :]:
                    pairs[a, b].add(q)
        heap = [(-len(held), pair) for pair, held in pairs.items() if len(held) > 1]
        heapq.heapify(heap)
        while heap:
            n, pair = heapq.heappop(heap)
            held = pairs.get(pair, set())
            if len(held) != -n:
                if len(held) > 1:
                    heapq.heappush(heap, (-len(held), pair))
                continue
            new = self.add(*pair)
            touched = set()
            for q in sorted(held):
                for gone in pair:
                    sets[q].discard(gone)
                    for other in sets[q]:
                        pairs[min(gone, other), max(gone, other)].discard(q)
                for other in sets[q]:
                    pairs[other, new].add(q)
                    touched.add((other, new))
                sets[q].add(new)
            del pairs[pair]
            for key in sorted(touched):
                if len(pairs[key]) > 1:
                    heapq.heappush(heap, (-len(pairs[key]), key))

    def evaluate(self, leaves: np.ndarray) -> np.ndarray:
        """(queries, documents): every node's accumulator is made once; ``leaves`` has a row for each node, terms filled."""
        for i, (a, b) in enumerate(zip(self.left, self.right), self.n_terms):
            np.add(leaves[a], leaves[b], out=leaves[i])
        return leaves[self.roots]


def _best(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weight, n_docs, all_terms = shared.value
        n_queries = len(sums.roots)
        q_best, id_best, s_best = (np.zeros(0, np.int64) for _ in range(3))
        least = np.ones(n_queries, np.int64)  # scores below this can't be among the k best any more
        step = max(1, ACCUMULATORS // max(1, sums.n_nodes))
        for whole in batches:
            for at in range(0, len(whole), step):
                b = whole.slice(at, step)
                ids, length = b.column("id").to_numpy(), b.column("length").to_numpy()
                sizes = np.diff(b.column("term").offsets.to_numpy())
                term, tf, doc = b.column("term").flatten().to_numpy(), b.column("tf").flatten().to_numpy(), np.repeat(np.arange(len(b)), sizes)
                m = 100 - LENGTH_PART + LENGTH_PART * length * n_docs // all_terms
                leaves = np.zeros((sums.n_nodes, len(b)), np.int64)
                leaves[term, doc] = weight[term] * (1_000_000_000 * tf // (1000 * tf + SATURATION * m[doc]))
                scores = sums.evaluate(leaves)
                q, d = np.nonzero(scores >= least[:, None])
                q_best, id_best, s_best = np.append(q_best, q), np.append(id_best, ids[d]), np.append(s_best, scores[q, d])
                order = np.lexsort((id_best, -s_best, q_best))
                q_best, id_best, s_best = q_best[order], id_best[order], s_best[order]
                first = np.searchsorted(q_best, np.arange(n_queries + 1))
                place = np.arange(len(q_best)) - first[q_best]
                full = np.flatnonzero(place == k - 1)
                least[q_best[full]] = np.maximum(s_best[full], 1)
                kept = place < k
                q_best, id_best, s_best = q_best[kept], id_best[kept], s_best[kept]
        yield batch(q=q_best.astype(np.int32), id=id_best, score=s_best)

    return run


def _block(docs: DataFrame, part: pa.Table, k: int) -> DataFrame:
    """(uid, id, score): of each task the k best documents of each query of a block."""
    spark = docs.sparkSession
    words = [set(terms_of(t)) for t in texts(part["text"].combine_chunks())]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    shared = spark.sparkContext.broadcast(vocabulary)
    postings = stored(docs.mapInArrow(_postings(shared), "id long, length long, term array<int>, tf array<long>"), "postings")
    n_docs, all_terms = postings.agg(F.count("*"), F.sum("length")).first()
    counted = postings.select("term").mapInArrow(_frequencies(len(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    weight = np.zeros(len(vocabulary), np.int64)
    for t, df in zip(counted["term"].to_pylist(), counted["df"].to_pylist()):
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    asked = [q for q, w in enumerate(words) if w]
    sums = SharedSums([{vocabulary[w] for w in words[q]} for q in asked], len(vocabulary))
    plan = spark.sparkContext.broadcast((sums, weight, n_docs, all_terms or 1))
    uids = spark.createDataFrame(pa.table({"q": pa.array(range(len(asked)), pa.int32()), "uid": part["uid"].combine_chunks().take(pa.array(asked, pa.int64()))}))
    return postings.mapInArrow(_best(plan, k), "q int, id long, score long").join(F.broadcast(uids), "q").select("uid", "id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item, rank, doc_id, score): for each row of ``items`` the k documents with the highest scores above 0.

    A score sums, over the distinct terms of the item, the term's weight times its saturated frequency, in whole
    numbers; weights and lengths come from all documents that have a term. Equal scores go by ascending id, null ids
    last. Rows that repeat an id are documents, or items, of their own. Null and empty texts have no terms; an item
    without terms, or whose terms no document holds, has no rows. Only the id and text columns are read.
    """
    spark = docs.sparkSession
    rows = docs.select(id_key(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = stored(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).withColumn("uid", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    path = scratch_path(spark, "search")
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).select("uid", "text").toArrow()
        _block(rows, part, k).write.mode("append").parquet(path)
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "id")
    found = spark.read.schema("uid long, id long, score long").parquet(path).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = bounded(asked.select("uid", "item"), BROADCAST_ITEMS, "items")
    return found.join(names, "uid").select("item", "rank", F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "score")
