"""Concept activation vectors: training, aggregation, scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.functions.hashing import hash_key
from tagloom.functions.vectors import l2_normalize
from tagloom.operators import splits
from tagloom.operators.ordered import join_null_safe
from tagloom.operators.tags import top_per_group
from tagloom.operators.vectors import matrix, mean_vector

# Acceptance of a single run, of a concept, and the alignment threshold of a score.
MIN_RUN_ACCURACY = 0.60
MIN_CONCEPT_ACCURACY = 0.65
ALIGNED = 0.1
MAX_CONCEPTS = 10_000
MAX_GROUP = 4_000
ROWS_PER_TASK = 20_000
BETWEEN = "\x01"  # between a category and a concept in one name


def train_cav(df: DataFrame, vec: str, y: str, c: float = 0.1, max_iter: int = 30) -> DataFrame:
    """Unit normal of a class-balanced linear SVM over any number of rows, trained on the cluster.

    One row: ``(cav, intercept, accuracy, converged)`` with the accuracy on the rows given; ``converged`` is false if the
    solver used up ``max_iter``. Rows without a vector or a class (1 or 0) are left out. Rows of a single class, or none,
    have no plane between them: all columns are NULL.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vec).isNotNull() & F.col(y).isin(0, 1))
    counts = {int(r[y]): r["count"] for r in rows.groupBy(y).count().collect()}  # two classes
    if len(counts) < 2:
        return df.sparkSession.createDataFrame([(None, None, None, None)], "cav array<double>, intercept double, accuracy double, converged boolean")
    n = sum(counts.values())
    weight = F.when(F.col(y) == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    x = rows.select(array_to_vector(l2_normalize(vec)).alias("features"), F.col(y).cast("double").alias("label"), weight.alias("w"))
    x = x.coalesce(n // ROWS_PER_TASK + 1)  # every step is a pass over all tasks
    svm = LinearSVC(maxIter=max_iter, tol=1e-4, regParam=1.0 / (c * n), standardization=False, weightCol="w")
    model = svm.fit(x)
    coef = np.asarray(model.coefficients.toArray())
    unit = coef / (np.linalg.norm(coef) + 1e-8)
    right = model.transform(x).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
    done = model.summary().totalIterations < max_iter
    return right.select(F.lit([float(v) for v in unit]).alias("cav"), F.lit(float(model.intercept)).alias("intercept"), "accuracy", F.lit(done).alias("converged"))


def largest_eigenvalue(gram: np.ndarray, steps: int = 100) -> float:
    """An upper estimate by power iteration: the last quotient with a margin, never above the trace."""
    v = np.ones(len(gram)) + np.arange(len(gram)) / max(len(gram), 1)
    found = 0.0
    for _ in range(steps):
        w = gram @ v
        size = float(np.linalg.norm(w))
        if size == 0.0 or abs(size - found) <= 1e-9 * size:
            break
        v, found = w / size, size
    return min(float(np.trace(gram)), 1.01 * max(found, float(np.linalg.norm(gram @ v))))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float, steps: int = 1000, bias: float = 10.0) -> np.ndarray:
    """Weights of a class-balanced hinge-loss SVM; the last one is the intercept.

    The dual is a quadratic over a box, solved by accelerated projected gradient steps. The intercept is the
    weight of a constant feature large enough to be left almost unpenalised.
    """
    signed = np.hstack([x, np.full((len(x), 1), bias)]) * y[:, None]
    cost = np.where(y > 0, len(y) / (2.0 * max((y > 0).sum(), 1)), len(y) / (2.0 * max((y < 0).sum(), 1))) * c
    gram = signed @ signed.T
    rate = 1.0 / max(largest_eigenvalue(gram), 1e-12)
    alpha = ahead = np.zeros(len(y))
    momentum = 1.0
    for _ in range(steps):
        new = np.clip(ahead - rate * (gram @ ahead - 1.0), 0.0, cost)
        faster = (1.0 + np.sqrt(1.0 + 4.0 * momentum**2)) / 2.0
        ahead = new + (momentum - 1.0) / faster * (new - alpha)
        done = np.abs(new - alpha).max() < 1e-7
        alpha, momentum = new, faster
        if done:
            break
    w = signed.T @ alpha
    w[-1] *= bias
    return w


def fit_means(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the plane halfway between the means of both classes; the last one is the intercept."""
    a, b = x[y > 0].mean(axis=0), x[y < 0].mean(axis=0)
    return np.append(a - b, -(a - b) @ (a + b) / 2)


def train_cavs(
    concepts: DataFrame, random: DataFrame, runs: int, test: float = 0.2, c: float = 0.1, max_rows: int = MAX_GROUP, method: str = "svm"
) -> DataFrame:
    """``(concept, run, cav, accuracy)``: repeated stratified fits of every concept against the random set.

    ``concepts`` is ``(concept, id, vec)`` with a fixed number of samples per concept, ``random`` is
    ``(id, vec)``. Both come from the samplers, so a fit sees a bounded number of rows, ``max_rows`` at most: its
    solver holds a matrix of rows by rows. Larger sets belong to :func:`train_cav`. ``method`` is ``svm``, on features
    scaled by quartiles and to unit length, or ``means``, the difference of the class means on the features as they
    are. A fit without rows of both classes to train on has accuracy 0 and a vector of zeros.
    """
    names = concepts.select("concept").distinct().withColumn("_all", F.lit(1))
    # every concept meets the whole random set: one side has a row per concept, the other a bounded sample
    packed = random.groupBy().agg(F.collect_list(F.struct("id", "vec")).alias("sample"))
    against = names.withColumn("sample", packed.select("sample").scalar()).select("concept", F.inline("sample"), F.lit(0).alias("y"))
    rows = concepts.select("concept", "id", "vec", F.lit(1).alias("y")).unionByName(against)
    many = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    held = splits.held_per_stratum(many, test, ["concept", "y"], ["run"])
    # a fit sees all rows of its strata, so it ranks them itself, by the same keys as a split of a table
    parts = join_null_safe(many.withColumn("key", hash_key("run", F.col("run"), F.col("concept"), F.col("y"), F.col("id"))), held, ["run", "concept", "y"])

    def fit(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        if len(d) > max_rows:
            raise ValueError(f"more than {max_rows} rows in a fit: use train_cav")
        d = d.sort_values(["y", "key", "id"])
        x, y = np.stack(d["vec"].to_list()).astype(float), np.where(d["y"].to_numpy() == 1, 1.0, -1.0)
        side = d.groupby("y")["key"]
        train = (side.cumcount() < side.transform("size") - d["held"]).to_numpy()
        if len(set(y[train])) < 2:
            return pd.DataFrame({"concept": [key[0]], "run": [key[1]], "cav": [np.zeros(x.shape[1])], "accuracy": [0.0]})
        if method == "means":
            w = fit_means(x[train], y[train])
        else:
            q1, mid, q3 = np.quantile(x[train], [0.25, 0.5, 0.75], axis=0)
            scale = np.where(q3 - q1 == 0, 1.0, q3 - q1)
            x = (x - mid) / scale
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            w = fit_svm(x[train], y[train], c)
        held = ~train
        hit = np.where(x[held] @ w[:-1] + w[-1] > 0, 1.0, -1.0) == y[held]
        cav = w[:-1] / (np.linalg.norm(w[:-1]) + 1e-8)
        return pd.DataFrame({"concept": [key[0]], "run": [key[1]], "cav": [cav], "accuracy": [float(hit.mean()) if len(hit) else 0.0]})

    kind = concepts.schema["concept"].dataType.simpleString()
    return parts.groupBy("concept", "run").applyInPandas(fit, f"concept {kind}, run int, cav array<double>, accuracy double")


def aggregate_cavs(runs: DataFrame, min_accuracy: float = MIN_RUN_ACCURACY) -> DataFrame:
    """Mean unit vector over accepted runs; a concept without any gets a failure row of zeros."""
    good = runs.where(F.col("accuracy") > min_accuracy)
    stats = runs.groupBy("concept").agg(
        F.coalesce(F.avg(F.when(F.col("accuracy") > min_accuracy, F.col("accuracy"))), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.stddev_pop(F.when(F.col("accuracy") > min_accuracy, F.col("accuracy"))), F.lit(0.0)).alias("accuracy_std"),
        F.count(F.when(F.col("accuracy") > min_accuracy, 1)).alias("num_successful_runs"),
    )
    means = mean_vector(good, "cav", ["concept"]).select("concept", l2_normalize("mean", 1e-8).alias("cav"))
    width = runs.agg(F.max(F.size("cav")).alias("d")).scalar()
    joined = join_null_safe(stats, means, ["concept"], "left").withColumn("_d", width)
    return joined.withColumn("cav", F.coalesce("cav", F.array_repeat(F.lit(0.0), F.col("_d")))).drop("_d")


def concept_gate(aggregated: DataFrame, found: DataFrame, n_samples: int, min_accuracy: float = MIN_CONCEPT_ACCURACY) -> DataFrame:
    """Concepts with enough samples and a good enough mean accuracy. ``found`` is ``(concept, n)``."""
    return aggregated.join(found, "concept").where((F.col("n") >= n_samples) & (F.col("accuracy") >= min_accuracy))


def _with_cavs(rows: DataFrame, keep: Sequence[Column], cavs: DataFrame, block: int, blocks: int, most: int) -> DataFrame:
    """The rows with a column of all ``(concept, cav)`` of a block, filled in the first row of every task only.

    The vectors are a scalar subquery, found when the query runs. More than ``most`` of them in a block fail.
    """
    mine = cavs.where(F.col("cav").isNotNull() & (F.pmod(F.xxhash64("concept"), F.lit(blocks)) == block)).limit(most + 1)
    packed = mine.groupBy().agg(F.collect_list(F.struct("concept", F.col("cav").cast("array<double>").alias("cav"))).alias("m"))
    fits = F.when(F.size("m") > most, F.raise_error(F.lit(f"more than {most} concept vectors in a block: ask for more blocks"))).otherwise(F.col("m"))
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    return rows.select(*keep, F.when(first, packed.select(fits.alias("m")).scalar()).alias("_cavs"))


class _Cavs:
    """The concepts and their vectors as a matrix, once the first row of a task has come by."""

    def __init__(self):
        self.names, self.vectors = pa.nulls(0), None

    def seen(self, column: pa.Array) -> bool:
        if self.vectors is None and column[0].is_valid:
            entries = column[0].values
            self.names = entries.field("concept")
            self.vectors = matrix(entries.field("cav")) if len(entries) else None
        return self.vectors is not None


def tcav_scores(
    acts: DataFrame, cavs: DataFrame, vec: str, cls: str, threshold: float = ALIGNED, max_concepts: int = MAX_CONCEPTS, blocks: int = 1
) -> DataFrame:
    """``(concept, class, n, score)``: share of activations aligned with each concept vector.

    The concept vectors travel with the task as one matrix; a task ships two counts per concept and class. Nothing
    runs before the result is asked for. More concepts than fit in a task are dealt to ``blocks``, each a pass over
    the activations.
    """
    name_type, cls_type = cavs.schema["concept"].dataType, acts.schema[cls].dataType
    arrow = pa.schema([("concept", to_arrow_type(name_type)), ("class", to_arrow_type(cls_type)), ("n", pa.int64()), ("hits", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hits, totals = _Cavs(), {}, {}
        for batch in batches:
            if not batch.num_rows or not known.seen(batch.column(2)):
                continue
            c = known.vectors / (np.linalg.norm(known.vectors, axis=1, keepdims=True) + 1e-8)
            x = matrix(batch.column(1))
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            aligned = x @ c.T > threshold
            keys = np.asarray(batch.column(0).to_pylist(), dtype=object)
            for k in set(keys.tolist()):
                mine = keys == k
                hits[k] = hits.get(k, 0) + aligned[mine].sum(axis=0)
                totals[k] = totals.get(k, 0) + int(mine.sum())
        for k, n in totals.items():
            size = len(known.names)
            yield pa.RecordBatch.from_arrays([known.names, pa.array([k] * size, arrow.field("class").type), pa.array([n] * size), pa.array(hits[k])], schema=arrow)

    schema = f"concept {name_type.simpleString()}, class {cls_type.simpleString()}, n bigint, hits bigint"
    keep = [F.col(cls), F.col(vec).cast("array<double>").alias("_x")]
    parts = [_with_cavs(acts, keep, cavs, b, blocks, max_concepts).mapInArrow(count, schema) for b in range(blocks)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("concept", "class").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return sums.select("concept", "class", "n", (F.col("hits") / F.col("n")).alias("score"))


def directional_derivative(grads: DataFrame, cavs: DataFrame, id_col: str, grad: str, max_concepts: int = MAX_CONCEPTS, blocks: int = 1) -> DataFrame:
    """``(id, concept, derivative)``: gradient times concept vector; blocks as in :func:`tcav_scores`."""
    id_type, name_type = grads.schema[id_col].dataType, cavs.schema["concept"].dataType

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Cavs()
        for batch in batches:
            if not batch.num_rows or not known.seen(batch.column(2)):
                continue
            size = len(known.names)
            d = matrix(batch.column(1)) @ known.vectors.T
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), size)))
            names = known.names.take(pa.array(np.tile(np.arange(size), batch.num_rows)))
            yield pa.RecordBatch.from_arrays([ids, names, pa.array(d.ravel())], names=["id", "concept", "derivative"])

    schema = f"id {id_type.simpleString()}, concept {name_type.simpleString()}, derivative double"
    keep = [F.col(id_col), F.col(grad).cast("array<double>").alias("_x")]
    parts = [_with_cavs(grads, keep, cavs, b, blocks, max_concepts).mapInArrow(dot, schema) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def concept_analysis(
    tagged: DataFrame, vectors: DataFrame, top: int = 15, n_samples: int = 50, n_random: int = 150, runs: int = 40, seed=0,
    min_accuracy: float = MIN_CONCEPT_ACCURACY, method: str = "svm",
) -> DataFrame:
    """``(category, concept, cav_accuracy, genre, n, score)``: which genres a concept points to, from start to end.

    ``tagged`` is ``(id, category, concept)``, ``vectors`` is ``(id, genre, vec)`` with one row for each id. The ``top``
    concepts of every category by frequency are taken, their first ``n_samples`` rows by id, and ``n_random`` rows of
    all; a vector is fitted in each of ``runs`` splits, concepts with enough rows and a mean accuracy of at least
    ``min_accuracy`` stay, and each is scored on all rows of every genre.
    """
    counts = tagged.groupBy("category", "concept").agg(F.count("*").alias("n"))
    chosen = top_per_group(counts, ["category"], [F.desc("n"), F.col("concept")], top).select("category", "concept", "n")
    # one name for both parts; a row for each chosen concept, their number is that of the categories times ``top``
    whole = F.concat(F.col("category"), F.lit(BETWEEN), F.col("concept")).alias("concept")
    rows = tagged.join(F.broadcast(chosen.select("category", "concept")), ["category", "concept"]).select(whole, "id")
    samples = top_per_group(rows, ["concept"], [F.col("id")], n_samples).select("concept", "id").join(vectors.select("id", "vec"), "id")
    samples = samples.select("concept", F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), "vec")
    random = splits.sample_n(vectors.select("id", "vec"), "id", n_random, seed).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), "vec")
    fitted = aggregate_cavs(train_cavs(samples, random, runs, method=method))
    passed = concept_gate(fitted, chosen.select(whole, "n"), n_samples, min_accuracy)
    # the accuracy goes along in the name, so that the vectors are fitted once
    out = tcav_scores(vectors, passed.select(F.struct("concept", "accuracy").alias("concept"), "cav"), "vec", "genre")
    name = F.split("concept.concept", BETWEEN, 2)
    return out.select(name[0].alias("category"), name[1].alias("concept"), F.col("concept.accuracy").alias("cav_accuracy"), F.col("class").alias("genre"), "n", "score")


def score_matrix(scores: DataFrame, genres: Sequence[str]) -> DataFrame:
    """Concept by genre table; a missing score is zero."""
    wide = scores.groupBy("category", "concept").pivot("genre", list(genres)).agg(F.first("score"))
    return wide.na.fill(0.0, list(genres))


def nested_results(scores: DataFrame, accuracy: Column) -> DataFrame:
    """The published JSON, a line for each concept: category, concept, then accuracy and scores per genre. A reader
    that merges the lines of a category has the nested object; no category is gathered in one row."""
    per_concept = scores.groupBy("category", "concept").agg(
        F.max(accuracy).alias("cav_accuracy"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("genre", "score")))).alias("genre_scores")
    )
    return per_concept.select(F.to_json(F.create_map("category", F.create_map("concept", F.struct("cav_accuracy", "genre_scores")))).alias("json"))
