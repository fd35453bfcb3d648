"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded and then verified.

1. Document frequencies of all shingles are kept in a count sketch of fixed size: it covers every document,
   is summed by block, and the same for all documents, so equal shingles weigh the same everywhere.
2. A text's signature is, for each hash function, the smallest key of Ioffe's sampling over its weighted
   shingles; two signatures agree with the probability of the weighted Jaccard similarity. Runs of ROWS
   keys are bands. Equal texts are one from here on.
3. In a bucket of equal bands all members are compared with one of them, the pivot. Groups of copies are of one
   class then, whatever their size. In buckets that still hold several classes, every member outside the largest
   one is compared with all members of other classes, by signatures inside the join, and by their texts if the
   keys that agree may mean a similarity at the threshold (fewest_keys). That is done twice, for likely links
   first, as these leave few classes. In a large bucket blocks of members are compared inside a task instead, which
   emits only links that join classes. So each pair of a bucket is compared or in one class, and the rows made
   grow with the members of a bucket, not with its pairs.
4. Classes are the connected components of pairs whose weighted Jaccard similarity reaches the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.base import LAST_ID, WordHashes, batch, bounded, lists, mixed, odd_multipliers, stored, texts, window_hashes, words_of
from tagloom.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
IDF_RANGE = 0.25
#: How seldom a pair at the threshold may fail the comparison of signatures.
MISSED = 2e-4
SKETCH_ROWS, SKETCH_WIDTH, SKETCH_BLOCK = 3, 1 << 17, 1 << 12
#: Shingles sampled at once.
PIECE = 60_000
#: Shingles of texts kept while pairs are compared.
CACHED_SHINGLES = 3_000_000
#: Ids of texts to compare are broadcast up to so many, else joined by shuffle.
BROADCAST_IDS = 500_000
#: Buckets of up to so many members are compared pair by pair, larger ones in blocks.
SMALL_BUCKET = 16
#: Members of a block, and weights of their shingles.
BLOCK, BLOCK_WEIGHT = 512, 500_000
#: Documents for each file of a stored table.
FILE_DOCUMENTS = 10_000
#: Ids from here on stand for rows without one.
NO_ID = LAST_ID - (1 << 44)


def fewest_keys(n: int, threshold: float) -> int:
    """So many of n keys agree for all but MISSED of the pairs at the threshold (28 of 48 at 0.8, where 38 are expected)."""
    below, m = 0.0, 0
    while (below := below + math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)) <= MISSED:
        m += 1
    return m


def shingles(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and how often each occurs; fewer than n words are one shingle."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(window_hashes(h, min(n, len(h))), return_counts=True)


class Sketch:
    """Document frequencies: per row of the sketch a count with the mean noise taken off, and of these the smallest."""

    def __init__(self, counts: np.ndarray, documents: int):
        self.counts, self.documents = counts, documents
        self.total = counts.sum(axis=1)

    @staticmethod
    def places(h: np.ndarray) -> np.ndarray:
        return np.stack([((h >> np.uint64(17 * r + 5)) & np.uint64(SKETCH_WIDTH - 1)).astype(np.int64) for r in range(SKETCH_ROWS)])

    def frequency(self, h: np.ndarray) -> np.ndarray:
        found = np.full(len(h), np.inf)
        for row, total, at in zip(self.counts, self.total, self.places(h), strict=True):
            found = np.minimum(found, row[at] - (total - row[at]) / (SKETCH_WIDTH - 1))
        return np.clip(found, 1, max(self.documents, 1))

    def weights(self, h: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Times the smoothed inverse document frequency: 1 for what is in all documents, 1 + IDF_RANGE in one.

        The range is narrow, so that copies of which there are thousands are as similar as a single pair is.
        """
        n = np.log(self.documents + 1.0)
        return times * (1 + IDF_RANGE * (n - np.log(self.frequency(h))) / n)


def _count(text_col: str, n: int) -> Callable:
    blocks = SKETCH_WIDTH // SKETCH_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros((SKETCH_ROWS, SKETCH_WIDTH), np.int64), WordHashes()
        for b in batches:
            for text in texts(b.column(text_col)):
                h, _ = shingles(hashes.of(words_of(text)), n)
                for row, at in zip(total, Sketch.places(h), strict=True):
                    np.add.at(row, at, 1)
        flat = total.ravel()
        yield batch(block=np.arange(SKETCH_ROWS * blocks, dtype=np.int32), n=lists(flat, np.full(SKETCH_ROWS * blocks, SKETCH_BLOCK)))

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, n in zip(b.column("block").to_pylist(), b.column("n"), strict=True):
            part = n.values.to_numpy()
            total[block] = total[block] + part if block in total else part
    for block, n in total.items():
        yield batch(block=np.array([block], np.int32), n=lists(n, np.array([len(n)])))


def document_frequencies(docs: DataFrame, text_col: str, n: int) -> Sketch:
    """The sketch over all documents; its size does not depend on them."""
    count = SKETCH_ROWS * SKETCH_WIDTH // SKETCH_BLOCK
    parts = docs.select(text_col).mapInArrow(_count(text_col, n), "block int, n array<long>").repartition(min(count, 32), "block").mapInArrow(_sum, "block int, n array<long>").toArrow()
    counts = np.zeros((count, SKETCH_BLOCK), np.int64)
    for block, part in zip(parts["block"].to_pylist(), parts["n"], strict=True):
        counts[block] = part.values.to_numpy()
    return Sketch(counts.reshape(SKETCH_ROWS, SKETCH_WIDTH), docs.count())


@cache
def gamma_quantiles() -> np.ndarray:
    """65536 quantiles of the gamma distribution of shape 2, by Newton steps from those of its tails."""
    p = (np.arange(65536) + 0.5) / 65536
    x = np.maximum(np.sqrt(2 * p), -np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 2)
    return x


class Sampler:
    """Keys of improved consistent weighted sampling, from tables of the quantiles of its distributions."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.r, self.ln_c = gamma_quantiles().astype(np.float32), np.log(gamma_quantiles()).astype(np.float32)
        self.seeds, self.factors = odd_multipliers(bands * rows, 4), odd_multipliers(rows, 5)

    def keys(self, h: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bands and single keys of each text; ``starts`` are the texts' first shingles, no text is without."""
        ln_w = np.log(weights).astype(np.float32)
        out = np.zeros((len(starts), self.bands), np.uint64)
        single = np.empty((len(starts), len(self.seeds)), np.int32)
        z, high, r, t, c, beta = np.empty_like(h), np.empty_like(h), *(np.empty(len(h), np.float32) for _ in range(4))
        parts = z.view(np.uint16).reshape(-1, 4)  # independent draws from one hash
        for k, seed in enumerate(self.seeds):
            np.bitwise_xor(h, seed, out=z)
            np.multiply(z, seed, out=z)
            np.right_shift(z, np.uint64(32), out=high)
            np.bitwise_xor(z, high, out=z)
            np.multiply(z, np.uint64(0xD6E8FEB86659FD93), out=z)
            np.take(self.r, parts[:, 0], out=r, mode="clip")
            np.take(self.ln_c, parts[:, 3], out=c, mode="clip")
            np.multiply(parts[:, 1], np.float32(1 / 65536), out=beta)
            np.divide(ln_w, r, out=t)
            np.add(t, beta, out=t)
            np.floor(t, out=t)
            # ln c - r (t - beta + 1)
            np.subtract(t, beta, out=t)
            np.add(t, np.float32(1), out=t)
            np.multiply(t, r, out=t)
            np.subtract(c, t, out=c)
            key = np.minimum.reduceat(c, starts)
            single[:, k] = key.view(np.int32)
            band, row = divmod(k, self.rows)
            out[:, band] += (key.view(np.uint32).astype(np.uint64) + np.uint64(1)) * self.factors[row]
        return mixed(out + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), single


def _signatures(shared, text_col: str, n: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sampler, sketch = WordHashes(), Sampler(bands, rows), shared.value
        for b in batches:
            ks, tks = b.column("k").to_pylist(), b.column("tk").to_pylist()
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def flush() -> Iterator[pa.RecordBatch]:
                sizes = np.array([len(h) for _, h, _ in held])
                h, times = (np.concatenate([x[i] for x in held]) for i in (1, 2))
                weights = sketch.weights(h, times)
                starts = np.cumsum(sizes) - sizes
                keys, single = sampler.keys(h, weights, starts)
                yield batch(
                    k=pa.array([ks[i] for i, _, _ in held], pa.int64()), tk=pa.array([tks[i] for i, _, _ in held]), weight=np.add.reduceat(weights, starts),
                    bands=lists(keys.view(np.int64).ravel(), np.full(len(held), bands)), keys=lists(single.ravel(), np.full(len(held), bands * rows)),
                )

            size = 0
            for i, text in enumerate(texts(b.column(text_col))):
                h, times = shingles(hashes.of(words_of(text)), n)
                if len(h):
                    held.append((i, h, times))
                    size += len(h)
                if size >= PIECE:
                    yield from flush()
                    held.clear()
                    size = 0
            if held:
                yield from flush()

    return run


def similarity(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float]) -> float:
    """Weighted Jaccard of (shingles in order, weights, sum of weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    both = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return both / (a[2] + b[2] - both)


def _verified(shared, n: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, held = WordHashes(), {}, {"n": 0}

        def weighed(key: int, text: bytes):
            if key not in last:
                h, times = shingles(hashes.of(words_of(text)), n)
                w = shared.value.weights(h, times)
                held["n"] += len(h)
                if held["n"] > CACHED_SHINGLES:
                    last.clear()
                    held["n"] = len(h)
                last[key] = h, w, float(w.sum())
            return last[key]

        for b in batches:
            a, p = b.column("a").to_pylist(), b.column("p").to_pylist()
            found = [similarity(weighed(x, s), weighed(y, t)) for x, s, y, t in zip(a, texts(b.column("text_a")), p, texts(b.column("text_p")), strict=True)]
            yield batch(a=pa.array(a, pa.int64()), b=pa.array(p, pa.int64()), similarity=np.array(found, np.float64)).filter(pa.array(np.array(found) >= threshold, pa.bool_()))

    return run


def _live(member: DataFrame, unique: DataFrame, labels: DataFrame, files: int) -> DataFrame:
    """The members of buckets with several classes, with the bucket's size, its largest class, and in how many blocks that and the others go."""
    now = member.join(labels, F.col("node") == F.col("k"), "left").select("band", "place", "node", "weight", F.coalesce("label", "node").alias("label"))
    several = now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band")
    live = stored(now.join(several, "band").join(unique.select("node", "keys").dropDuplicates(["node"]), "node"), "live", files)
    classes = live.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    buckets = classes.groupBy("band").agg(F.max(F.struct("n", "label", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_WEIGHT))
    top = lambda c: F.col(f"top.{c}")
    buckets = buckets.select(
        "band", "n", top("label").alias("largest"), blocks(F.col("n") - top("n"), F.col("w") - top("w")).alias("others"), blocks(top("n"), top("w")).alias("tops")
    )
    return live.join(buckets, "band")


def _across_classes(live: DataFrame, threshold: float, rows: int, least: int) -> DataFrame:
    """Pairs of a bucket and of different classes of which ``least`` keys agree, one end outside the bucket's largest class.

    A pair comes from the first band that it shares only. Of the members of one class none are paired.
    """
    other = live.filter("label <> largest").select("band", *[F.col(c).alias(f"{c}_p") for c in ("node", "weight", "label", "keys")])
    same = F.zip_with("keys", "keys_p", lambda x, y: x == y)
    earlier = F.exists(F.sequence(F.lit(0), F.col("place")), lambda j: (j < F.col("place")) & F.forall(F.slice(same, j * rows + 1, rows), lambda x: x))
    alike = F.least("weight", "weight_p") >= F.lit(threshold) * F.greatest("weight", "weight_p")
    once = (F.col("label") == F.col("largest")) | (F.col("node") < F.col("node_p"))
    pairs = live.join(other, "band").filter((F.col("label") != F.col("label_p")) & once & alike & (F.size(F.filter(same, lambda x: x)) >= least) & ~earlier)
    return pairs.select(F.greatest("node", "node_p").alias("a"), F.least("node", "node_p").alias("p")).distinct()


def _links(shared, n: int, threshold: float, rows: int, least: int) -> Callable:
    """Compares two blocks of a bucket as pairs are by ``_across_classes`` and ``_verified``, and gives the links that join
    classes: fewer than there are members, whatever the pairs."""

    def run(table: pa.Table) -> pa.Table:
        hashes, held, found = WordHashes(), {}, []
        node, weight, block = (table[c].to_numpy() for c in ("node", "weight", "block"))
        i, j, place = (table[c][0].as_py() for c in ("i", "j", "place"))
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        group, text = np.unique(table["label"].to_numpy(), return_inverse=True)[1], texts(table["text"].combine_chunks())

        def weighed(k: int):
            if k not in held:
                h, times = shingles(hashes.of(words_of(text[k])), n)
                w = shared.value.weights(h, times)
                held[k] = h, w, float(w.sum())
            return held[k]

        others = np.flatnonzero(block == j)
        for a in np.flatnonzero(block == i).tolist():
            right = others[(group[others] != group[a]) & (others > a if i == j else True)]
            right = right[np.minimum(weight[right], weight[a]) >= threshold * np.maximum(weight[right], weight[a])]
            same = keys[right] == keys[a]
            agreed = same.sum(axis=1)
            earlier = same[:, : place * rows].reshape(len(right), place, rows).all(axis=2).any(axis=1)
            wanted = np.flatnonzero((agreed >= least) & ~earlier)
            for b in right[wanted[np.argsort(-agreed[wanted], kind="stable")]].tolist():
                if group[b] != group[a] and similarity(weighed(a), weighed(b)) >= threshold:
                    found.append((node[a], node[b]))
                    group[group == group[b]] = group[a]
        left, right = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _block_links(live: DataFrame, text: DataFrame, links: Callable, files: int) -> DataFrame:
    """Links in large buckets: the members outside the largest class are dealt to blocks, those in it to others, and each
    two blocks of which one is outside meet in one task. No row is made for a pair."""
    outside = F.col("label") != F.col("largest")
    spot = lambda blocks: F.pmod(F.xxhash64("node", "band"), F.col(blocks))
    rows = live.withColumn("block", F.when(outside, spot("others")).otherwise(F.col("others") + spot("tops")))
    rows = rows.join(text, "node").withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1 + F.when(outside, F.col("tops")).otherwise(0))))
    rows = rows.select("band", F.least("block", "meets").alias("i"), F.greatest("block", "meets").alias("j"), "block", "place", "node", "weight", "label", "keys", "text")
    return stored(rows.groupBy("band", "i", "j").applyInArrow(links, "a long, b long").repartition(files), "links")


def text_key(text_col: str) -> Column:
    return F.md5(F.coalesce(text_col, F.lit("")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """With ``k``, the id or else a number beyond all ids for each text, and ``tk``, a hash of the text."""
    none = F.lit(NO_ID) + F.pmod(F.xxhash64(text_col), F.lit(LAST_ID - NO_ID))
    return docs.withColumn("k", F.coalesce(F.col(id_col).cast("long"), none)).withColumn("tk", text_key(text_col))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(id_col, text_key, class_id, first) for each row: the smallest id of its class of near-duplicates, and whether it is the row's.

    Texts are in one class if they are equal or joined by a chain of pairs that share a band and have a weighted
    Jaccard similarity of at least ``threshold`` over shingles of ``n`` words. Fewer words are one shingle. Null
    texts and texts without a word are in no class but their own, also if equal. Rows without an id count as
    larger than all others, by text; a class of only such rows has the class id null. Rows with one id and
    different texts are judged by their own texts. Repeated rows stay.
    """
    spark = docs.sparkSession
    data = keyed(docs, id_col, text_col).select(F.col(id_col).alias("id"), "k", F.col(text_col).alias("text"), "tk")
    sketch = document_frequencies(data, "text", n)
    shared, files = spark.sparkContext.broadcast(sketch), sketch.documents // FILE_DOCUMENTS + 1
    signed = data.select("k", "tk", "text").mapInArrow(_signatures(shared, "text", n, bands, rows), "k long, tk string, weight double, bands array<long>, keys array<int>")
    unique = signed.groupBy("tk").agg(F.min("k").alias("id_of"), F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("keys").alias("keys"))
    unique = stored(unique.withColumn("node", F.xxhash64("tk")), "signatures", files)  # a node is a text

    member = unique.select("node", "id_of", "weight", F.posexplode("bands").alias("place", "band"))
    many = member.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    member = stored(member.join(many, "band"), "buckets", files)
    wanted = bounded(member.select(F.col("node").alias("of"), "id_of").distinct(), BROADCAST_IDS, "members", files)
    rows_of = data.select("k", "text", F.xxhash64("tk").alias("node"))
    text = rows_of.join(wanted, (F.col("node") == F.col("of")) & (F.col("k") == F.col("id_of")), "left_semi")
    text = stored(text.dropDuplicates(["node"]).select("node", "text"), "texts", files)

    def verify(pairs: DataFrame) -> DataFrame:
        left = pairs.join(text.withColumnRenamed("text", "text_a"), F.col("a") == F.col("node")).drop("node")
        both = left.join(text.withColumnRenamed("text", "text_p"), F.col("p") == F.col("node")).select("a", "text_a", "p", "text_p")
        return stored(both.mapInArrow(_verified(shared, n, threshold), "a long, b long, similarity double").repartition(files), "pairs")

    near = lambda: F.least("weight", "pivot_weight") >= F.lit(threshold) * F.greatest("weight", "pivot_weight")
    pivot = member.groupBy("band").agg(F.min("node").alias("p"), F.min_by("weight", "node").alias("pivot_weight"))
    pairs = member.join(pivot, "band").filter(F.col("node") != F.col("p")).filter(near()).select(F.col("node").alias("a"), "p").distinct()
    edges = verify(pairs).select("a", "b")
    labels = components(edges, files)
    # what is left: buckets with several classes. First the pairs that look like links, then all that may be one
    for least in (math.ceil(threshold * bands * rows), fewest_keys(bands * rows, threshold)):
        live = _live(member, unique, labels, files)
        found = verify(_across_classes(live.filter(F.col("n") <= SMALL_BUCKET), threshold, rows, least)).select("a", "b")
        found = found.union(_block_links(live.filter(F.col("n") > SMALL_BUCKET), text, _links(shared, n, threshold, rows, least), files))
        if not found.isEmpty():
            edges = edges.union(found)
            labels = components(edges, files)
    label = unique.join(labels, F.col("node") == F.col("k"), "left").select("tk", "id_of", F.coalesce("label", "node").alias("label"))
    classes = label.join(label.groupBy("label").agg(F.min("id_of").alias("class_id")), "label").select("tk", "class_id")
    out = data.select("id", "k", "tk").join(classes, "tk", "left")
    found = F.coalesce("class_id", "k")
    return out.select(F.col("id").alias(id_col), F.col("tk").alias("text_key"), F.when(found < NO_ID, found).alias("class_id"), (F.col("k") == found).alias("first"))


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that have the smallest id of their class; rows that repeat an id and text stay once."""
    chosen = near_duplicates(docs, id_col, text_col, **options).filter("first").select(F.col(id_col).alias("i"), F.col("text_key").alias("t")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("i"), text_key(text_col).alias("t")).dropDuplicates(["i", "t"])
    return rows.join(chosen, rows["i"].eqNullSafe(chosen["i"]) & (rows["t"] == chosen["t"]), "left_semi").select("row.*")
