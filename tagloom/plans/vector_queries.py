"""Queries over embedding vectors, concept vectors and model scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tagloom.functions import vectors as V
from tagloom.functions.hashing import hash_uniform
from tagloom.operators import concepts as C
from tagloom.operators import models as M
from tagloom.operators import sets as J
from tagloom.operators import splits as R
from tagloom.operators import tags as T
from tagloom.operators import vectors as O
from tagloom.plans.registry import ORACLES, query
from tagloom.plans.split_queries import held
from tagloom.plans.stat_queries import rounded
from tagloom.plans.tag_queries import SEED_SQL, TEMPS, joined
from tagloom.plans.views import captions, embeddings, samples, table, taxonomy, with_views
from tagloom.session import scratch_path
from tagloom.sources import documents as JS

DOT = "list_dot_product({0}, {1})"
COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
UNIT = "list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0})))"


@query("l2_normalize", with_views("vecs", "SELECT id, round(vec[1] / (n + 1e-8::DOUBLE), 6) AS first, round(vec[64] / (n + 1e-8::DOUBLE), 6) AS last, round(n / (n + 1e-8::DOUBLE), 6) AS length FROM (SELECT id, vec, sqrt(list_dot_product(vec, vec)) AS n FROM vecs)"))
def l2_normalize(spark, sf):
    d = embeddings(spark, sf).select("id", V.l2_normalize("vec", 1e-8).alias("u"))
    return d.select("id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(63)), 6).alias("last"), F.round(V.norm("u"), 6).alias("length"))


@query("argmax_label", with_views("vecs", "SELECT id, (list_position(vec, list_max(vec)) - 1)::BIGINT AS label FROM vecs"))
def argmax_label(spark, sf):
    return embeddings(spark, sf).select("id", V.argmax("vec").alias("label"))


@query("reparameterize", with_views("vecs", """SELECT id, round(list_sum(list_transform(range(1, 65), lambda j: vec[j] + (('0x' || substr(md5(id || ':' || j), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * exp(0.5::DOUBLE * vec[65 - j]))), 5) AS total FROM vecs"""))
def reparameterize(spark, sf):
    eps = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: hash_uniform(F.col("id"), j))
    d = embeddings(spark, sf).select("id", V.reparameterize("vec", F.reverse("vec"), eps).alias("z"))
    return d.select("id", F.round(V.total("z"), 5).alias("total"))


def next_vectors(spark, sf):
    return embeddings(spark, sf).select((F.col("id") - 1).alias("id"), "vec")


@query("paired_cosine", with_views("vecs", f"SELECT a.id, round({COS.format('a.vec', 'b.vec')}, 6) AS score FROM vecs a LEFT JOIN vecs b ON b.id = a.id + 1"))
def paired_cosine(spark, sf):
    return rounded(O.paired_cosine(embeddings(spark, sf), next_vectors(spark, sf)), "score")


@query("paired_cosine_stats", with_views("vecs", f"SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round(min(s), 6) AS min, round(max(s), 6) AS max FROM (SELECT {COS.format('a.vec', 'b.vec')} AS s FROM vecs a JOIN vecs b ON b.id = a.id + 1)"))
def paired_cosine_stats(spark, sf):
    out = O.score_summary(O.paired_cosine(embeddings(spark, sf), next_vectors(spark, sf)))
    return rounded(out, *out.columns)


@query("mean_vector", with_views("vecs", "SELECT label, dim::BIGINT AS dim, round(avg(x), 6) AS x FROM (SELECT label, unnest(vec) AS x, unnest(range(64)) AS dim FROM vecs) GROUP BY 1, 2"))
def mean_vector(spark, sf):
    d = O.mean_vector(embeddings(spark, sf), "vec", ["label"])
    return d.select("label", F.posexplode("mean").alias("dim", "x")).select("label", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


@query("covariance", with_views("vecs", """SELECT a.dim::BIGINT AS i, b.dim::BIGINT AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS cov FROM d a JOIN d b ON a.id = b.id GROUP BY 1, 2""", "d AS (SELECT id, unnest(vec) AS x, unnest(range(64)) AS dim FROM vecs)"))
def covariance(spark, sf):
    rows = O.covariance(embeddings(spark, sf), "vec").select(F.col("i").cast("bigint").alias("i"), F.posexplode("cov").alias("j", "c"))
    return rows.select("i", F.col("j").cast("bigint").alias("j"), (F.round("c", 6) + 0.0).alias("cov"))


def halves(spark, sf):
    d = embeddings(spark, sf)
    return d.where("id % 2 = 0"), d.where("id % 2 = 1")


@query("frechet_distance")
def frechet_distance(spark, sf):
    return rounded(O.frechet_distance(*halves(spark, sf)), "frechet_distance")


@query("per_sample_frechet", with_views("vecs", """SELECT g.id, round(sum((g.x - s.m) ** 2) + (SELECT sum(v) FROM s), 6) AS score FROM d g JOIN s ON s.dim = g.dim WHERE g.id % 2 = 0 GROUP BY 1""",
    "d AS (SELECT id, unnest(vec) AS x, unnest(range(64)) AS dim FROM vecs), s AS (SELECT dim, avg(x) AS m, var_samp(x) AS v FROM d WHERE id % 2 = 1 GROUP BY 1)"))
def per_sample_frechet(spark, sf):
    return rounded(O.per_sample_frechet(*halves(spark, sf)), "score")


@query("frechet_two_sums", with_views("vecs", """SELECT round((g.mx - r.mx) ** 2 + (g.my - r.my) ** 2 + g.xx + g.yy + r.xx + r.yy
      - 2 * sqrt(g.xx * r.xx + 2 * g.xy * r.xy + g.yy * r.yy + 2 * sqrt((g.xx * g.yy - g.xy ** 2) * (r.xx * r.yy - r.xy ** 2))), 6) AS frechet_distance
    FROM m g, m r WHERE g.side = 0 AND r.side = 1""", """f AS (SELECT id % 2 AS side, list_sum(vec[1:32]::DOUBLE[]) AS x, list_sum(vec[33:64]::DOUBLE[]) AS y FROM vecs),
    m AS (SELECT side, avg(x) AS mx, avg(y) AS my, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM f GROUP BY side)"""))
def frechet_two_sums(spark, sf):
    """The distance on vectors folded to two sums, where the square root of the covariances has a closed form."""
    half = lambda a: V.total(F.slice(F.col("vec").cast("array<double>"), a, 32))
    d = embeddings(spark, sf).select("id", F.array(half(1), half(33)).alias("vec"))
    return rounded(O.frechet_distance(d.where("id % 2 = 0"), d.where("id % 2 = 1")), "frechet_distance")


@query("silhouette", with_views("vecs", """SELECT round(avg(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (
    SELECT id, max(m) FILTER (own = label) AS a, min(m) FILTER (own <> label) AS b FROM (
      SELECT x.id, x.label AS own, y.label, avg(list_distance(x.vec, y.vec)) AS m FROM vecs x, vecs y GROUP BY 1, 2, 3) GROUP BY id)"""))
def silhouette(spark, sf):
    return rounded(O.silhouette(embeddings(spark, sf), "id", "vec", "label"), "silhouette")


@query("accuracy", with_views("vecs", "SELECT round(avg((((list_position(vec, list_max(vec)) - 1) % 10) = label)::INT), 6) AS accuracy FROM vecs"))
def accuracy(spark, sf):
    return rounded(O.accuracy(embeddings(spark, sf), V.argmax("vec") % 10, F.col("label")), "accuracy")


@query("robust_scale", with_views("vecs", """SELECT id, round(sum((d.x - q.m) / CASE WHEN q.r = 0 THEN 1 ELSE q.r END), 5) AS total FROM d JOIN q ON q.dim = d.dim GROUP BY 1""",
    "d AS (SELECT id, unnest(vec) AS x, unnest(range(64)) AS dim FROM vecs), q AS (SELECT dim, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS r FROM d GROUP BY 1)"))
def robust_scale(spark, sf):
    d = O.robust_scale(embeddings(spark, sf), "id", "vec")
    return d.select("id", F.round(V.total("scaled"), 5).alias("total"))


def powers(name: str, matrix: str) -> str:
    """SQL: the projector on the first principal direction, by squaring the covariance until nothing else is left."""
    return f"""{name}_pow AS (SELECT 0 AS k, i, j, c / (SELECT sum(c) FROM {matrix} WHERE i = j) AS c FROM {matrix}
      UNION ALL SELECT k + 1, i, j, c / sum(CASE WHEN i = j THEN c END) OVER () FROM (SELECT a.k, a.i, b.j, sum(a.c * b.c) AS c FROM {name}_pow a JOIN {name}_pow b ON a.j = b.i WHERE a.k < 16 GROUP BY ALL)),
    {name} AS (SELECT i, j, c FROM {name}_pow WHERE k = 16)"""


@query("project_2d", with_views("vecs", """SELECT x.id, round(sqrt(greatest(x.s, 0)), 4) AS x, round(sqrt(greatest(y.s, 0)), 4) AS y FROM
    (SELECT a.id, sum(a.x * p.c * b.x) AS s FROM d a JOIN one p ON p.i = a.dim JOIN d b ON b.id = a.id AND b.dim = p.j GROUP BY 1) x JOIN
    (SELECT a.id, sum(a.x * p.c * b.x) AS s FROM d a JOIN two p ON p.i = a.dim JOIN d b ON b.id = a.id AND b.dim = p.j GROUP BY 1) y ON y.id = x.id""",
    "d AS (SELECT id, unnest(vec) AS x, unnest(range(64)) AS dim FROM vecs), cov AS (SELECT a.dim AS i, b.dim AS j, covar_samp(a.x, b.x) AS c FROM d a JOIN d b ON a.id = b.id GROUP BY 1, 2), "
    + powers("one", "cov") + ", rest AS (SELECT c.i, c.j, c.c - (SELECT sum(a.c * b.c) FROM cov a JOIN one b ON a.i = b.j AND a.j = b.i) * o.c AS c FROM cov c JOIN one o ON o.i = c.i AND o.j = c.j), "
    + powers("two", "rest"), recursive=True))
def project_2d(spark, sf):
    """Coordinates without their sign, which no definition fixes."""
    d = O.project_2d(embeddings(spark, sf), "id", "vec")
    return d.select("id", F.round(F.abs("x"), 4).alias("x"), F.round(F.abs("y"), 4).alias("y"))


@query("scored_predictions", f"""SELECT d.doc_id AS id, md5(d.text) AS reference, md5(n.text) AS prediction, c.score AS similarity, f.score AS distance
    FROM documents d JOIN ({ORACLES['paired_cosine']}) c ON c.id = d.doc_id LEFT JOIN documents n ON n.doc_id = d.doc_id + 1 LEFT JOIN ({ORACLES['per_sample_frechet']}) f ON f.id = d.doc_id""")
def scored_predictions(spark, sf):
    """The per-sample table: texts, similarity of each pair and distance to the reference set, joined by id and written."""
    d = captions(spark, sf)
    similarity = O.paired_cosine(embeddings(spark, sf), next_vectors(spark, sf))
    distance = O.per_sample_frechet(*halves(spark, sf))
    rows = d.join(embeddings(spark, sf).select("id"), "id", "left_semi").select("id", F.md5("caption").alias("reference"))
    predictions = d.select((F.col("id") - 1).alias("id"), F.md5("caption").alias("prediction"))
    out = J.zip_by_id(rows, predictions, similarity.withColumnRenamed("score", "similarity"), distance.withColumnRenamed("score", "distance"))
    path = scratch_path(spark, "scored")
    out.write.parquet(path)
    return rounded(spark.read.schema(out.schema).parquet(path), "similarity", "distance")


CONCEPT = 3


@query("concept_vs_random", with_views("vecs", """SELECT id, 1::INTEGER AS y FROM vecs WHERE label = 3 UNION ALL
    SELECT * FROM (SELECT id, 0::INTEGER AS y FROM vecs WHERE label <> 3 ORDER BY md5('2:' || id), id LIMIT 150)"""))
def concept_vs_random(spark, sf):
    d = embeddings(spark, sf)
    random = R.sample_n(d.where(F.col("label") != CONCEPT), "id", 150, 2)
    return J.concept_vs_random(d.where(F.col("label") == CONCEPT).select("id"), random.select("id"))


@query("train_cav")
def train_cav(spark, sf):
    d = embeddings(spark, sf)
    both = J.concept_vs_random(d.where(F.col("label") == CONCEPT).select("vec"), d.where(F.col("label") != CONCEPT).select("vec"))
    out = C.train_cav(both, "vec", "y")
    return out.select(F.round(V.norm("cav"), 4).alias("length"), F.round("accuracy", 6).alias("accuracy"))


N_CONCEPT, N_RANDOM, N_RUNS = 50, 150, 40  # samples per concept, random samples and runs of a published analysis


@query("train_cavs")
def train_cavs(spark, sf):
    d = embeddings(spark, sf).withColumnRenamed("label", "concept")
    concepts = T.top_per_group(d, ["concept"], [F.col("id")], N_CONCEPT).drop("rnk")
    random = R.sample_n(d.select((F.col("id") + 1_000_000_000).alias("id"), "vec"), "id", N_RANDOM, 4)
    runs = C.train_cavs(concepts, random, N_RUNS)
    out = C.aggregate_cavs(runs)
    return out.select("concept", F.round("accuracy", 6).alias("accuracy"), F.round("accuracy_std", 6).alias("accuracy_std"), "num_successful_runs")


RUNS = "SELECT label AS concept, id AS run, vec AS cav, (('0x' || substr(md5('acc:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * 0.4::DOUBLE + 0.4::DOUBLE AS accuracy FROM vecs"


def cav_runs(spark, sf):
    acc = hash_uniform(F.lit("acc"), F.col("id")) * 0.4 + 0.4
    return embeddings(spark, sf).select(F.col("label").alias("concept"), F.col("id").alias("run"), F.col("vec").alias("cav"), acc.alias("accuracy"))


AGG = f"""runs AS ({RUNS}), stats AS (SELECT concept, coalesce(avg(accuracy) FILTER (accuracy > 0.6), 0) AS accuracy, coalesce(stddev_pop(accuracy) FILTER (accuracy > 0.6), 0) AS accuracy_std, count(*) FILTER (accuracy > 0.6) AS num_successful_runs FROM runs GROUP BY 1),
    m AS (SELECT concept, dim, avg(x) AS x FROM (SELECT concept, unnest(cav) AS x, unnest(range(64)) AS dim FROM runs WHERE accuracy > 0.6) GROUP BY 1, 2),
    cavs AS (SELECT concept, list(x ORDER BY dim) AS raw, sqrt(sum(x * x)) + 1e-8::DOUBLE AS len FROM m GROUP BY 1)"""


@query("aggregate_cavs", with_views("vecs", "SELECT s.concept, round(accuracy, 6) AS accuracy, round(accuracy_std, 6) AS accuracy_std, num_successful_runs, round(raw[1] / len, 6) AS first FROM stats s LEFT JOIN cavs c ON c.concept = s.concept", AGG))
def aggregate_cavs(spark, sf):
    out = C.aggregate_cavs(cav_runs(spark, sf)).withColumn("first", F.get("cav", F.lit(0))).drop("cav")
    return rounded(out, "accuracy", "accuracy_std", "first")


@query("concept_gate", with_views("vecs", "SELECT s.concept, round(s.accuracy, 6) AS accuracy, n FROM stats s JOIN (SELECT label AS concept, count(*) AS n FROM vecs GROUP BY 1) f ON f.concept = s.concept WHERE n >= 50 AND s.accuracy >= 0.65", AGG))
def concept_gate(spark, sf):
    found = embeddings(spark, sf).groupBy(F.col("label").alias("concept")).agg(F.count("*").alias("n"))
    out = C.concept_gate(C.aggregate_cavs(cav_runs(spark, sf)), found, N_CONCEPT)
    return rounded(out.select("concept", "accuracy", "n"), "accuracy")


CAV_COS = "list_dot_product(v.vec, c.raw) / (sqrt(list_dot_product(v.vec, v.vec)) * (c.len))"


def cavs(spark, sf):
    return C.aggregate_cavs(cav_runs(spark, sf)).select("concept", "cav")


@query("tcav_score", with_views("vecs", f"SELECT c.concept, round(avg(({CAV_COS} > 0.1)::INT), 6) AS score FROM vecs v, cavs c GROUP BY 1", AGG))
def tcav_score(spark, sf):
    acts = embeddings(spark, sf).select(F.lit(0).alias("all"), "vec")
    return rounded(C.tcav_scores(acts, cavs(spark, sf), "vec", "all").select("concept", "score"), "score")


@query("concept_genre_scores", with_views("vecs", f"SELECT c.concept, v.label AS class, count(*) AS n, round(avg(({CAV_COS} > 0.1)::INT), 6) AS score FROM vecs v, cavs c GROUP BY 1, 2", AGG))
def concept_genre_scores(spark, sf):
    return rounded(C.tcav_scores(embeddings(spark, sf), cavs(spark, sf), "vec", "label"), "score")


@query("directional_derivative", with_views("vecs", "SELECT v.id, c.concept, round(list_dot_product(v.vec, c.raw) / c.len, 6) + 0.0 AS derivative FROM vecs v, cavs c", AGG))
def directional_derivative(spark, sf):
    out = C.directional_derivative(embeddings(spark, sf), cavs(spark, sf), "id", "vec")
    return out.withColumn("derivative", F.round("derivative", 6) + 0.0)


# The splits of a run: rows of all its strata (concept and side), 20 % of them held back by largest remainder.
ANALYSIS = """tg AS (SELECT doc_id AS id, 'lang' AS category, lang AS concept FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents),
    v AS (SELECT vec_id AS id, label % 3 AS genre, list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN i <= 8 THEN d.shift[i] ELSE 0 END) AS vec FROM embeddings e
      JOIN (SELECT doc_id, list_transform(range(8), lambda i: CASE WHEN ascii(substr(md5(lang || source), 1 + i::INT, 1)) % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END) AS shift FROM documents) d ON d.doc_id = e.vec_id),
    n AS (SELECT category, concept, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, concept) AS rnk FROM tg JOIN v USING (id) GROUP BY 1, 2),
    sm AS (SELECT category || chr(1) || concept AS concept, 'c' || id AS id, 1 AS y, vec FROM (SELECT tg.*, v.vec, row_number() OVER (PARTITION BY tg.category, tg.concept ORDER BY tg.id) AS r FROM tg JOIN v USING (id) JOIN n USING (category, concept) WHERE rnk <= 4) WHERE r <= 20),
    z AS (SELECT 'r' || id AS id, vec FROM v ORDER BY md5('0:' || id), id LIMIT 60)"""


def analysed(spark, sf):
    """Documents by language and source as concepts, vectors moved by both, and three genres."""
    d = table(spark, sf, "documents")
    pair = F.concat("lang", "source")
    moved = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.when(F.ascii(F.substring(F.md5(pair), i, F.lit(1))) % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3).cast("bigint").alias("genre"), "embedding")
    both = e.join(d.select(F.col("doc_id").alias("id"), moved.alias("shift"), "lang", "source"), "id")
    vec = F.transform("embedding", lambda x, i: x.cast("double") + F.coalesce(F.get("shift", i), F.lit(0.0)))
    concepts = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("concept")) for c in ("lang", "source")])
    return both.select("id", F.inline(concepts)), both.select("id", "genre", vec.alias("vec"))


ANALYSIS_SQL = f"""WITH {ANALYSIS},
    e AS (SELECT concept, id, y, vec, run FROM (SELECT concept, id, y, vec FROM sm UNION ALL SELECT c.concept, z.id, 0, z.vec FROM z, (SELECT DISTINCT concept FROM sm) c), (SELECT unnest(range(3)) AS run)),
    {held('e', 'concept, y', 'run')},
    m AS (SELECT *, r <= cnt - held AS train FROM (SELECT *, row_number() OVER (PARTITION BY run, concept, y ORDER BY md5('run:' || run || ':' || concept || ':' || y || ':' || id), id) AS r,
      count(*) OVER (PARTITION BY run, concept, y) AS cnt FROM e) JOIN h USING (run, concept, y)),
    w AS (SELECT run, concept, list(a - b ORDER BY dim) AS w, -sum((a - b) * (a + b) / 2) AS w0 FROM (SELECT run, concept, dim, avg(x) FILTER (y = 1) AS a, avg(x) FILTER (y = 0) AS b
      FROM (SELECT run, concept, y, unnest(vec) AS x, unnest(range(64)) AS dim FROM m WHERE train) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    runs AS (SELECT run, concept, any_value(w) AS w, avg(((list_dot_product(m.vec, w.w) + w0 > 0) = (y = 1))::INT) AS accuracy FROM m JOIN w USING (run, concept) WHERE NOT train GROUP BY 1, 2),
    cavs AS (SELECT concept, list(x ORDER BY dim) AS cav, any_value(accuracy) AS accuracy FROM (SELECT concept, dim, avg(x / (len + 1e-8::DOUBLE)) AS x, avg(accuracy) AS accuracy FROM (
      SELECT concept, accuracy, sqrt(list_dot_product(w, w)) AS len, unnest(w) AS x, unnest(range(64)) AS dim FROM runs WHERE accuracy > 0.6) GROUP BY 1, 2) GROUP BY 1),
    passed AS (SELECT n.category, n.concept, c.cav, c.accuracy FROM cavs c JOIN n ON c.concept = n.category || chr(1) || n.concept WHERE n.n >= 20 AND c.accuracy >= 0.65)
    SELECT category, concept, round(accuracy, 6) AS cav_accuracy, genre, count(*) AS n, round(avg((list_dot_product(vec, cav) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(cav, cav))) > 0.1)::INT), 6) AS score
    FROM passed, v GROUP BY category, concept, accuracy, genre"""


def analysis(spark, sf):
    tagged, vectors = analysed(spark, sf)
    return C.concept_analysis(tagged, vectors, top=4, n_samples=20, n_random=60, runs=3, method="means")


@query("concept_analysis", ANALYSIS_SQL)
def concept_analysis(spark, sf):
    return rounded(analysis(spark, sf), "cav_accuracy", "score")


@query("concept_results", f"SELECT category, concept, cav_accuracy, genre::VARCHAR AS genre, score FROM ({ANALYSIS_SQL})")
def concept_results(spark, sf):
    """The same results written as nested JSON text and read back."""
    path = scratch_path(spark, "results")
    JS.write_json_text(C.nested_results(analysis(spark, sf).withColumn("genre", F.col("genre").cast("string")), F.col("cav_accuracy")), path)
    return rounded(JS.results_long(spark.read.text(path), "value"), "cav_accuracy", "score")


def small_weights(rows: int, cols: int, a: int, b: int) -> np.ndarray:
    """Weights by rule, so that SQL can state them: ``((a*i + b*j) % 11 - 5) / 10``."""
    i, j = np.arange(rows)[:, None], np.arange(cols)[None, :]
    return ((a * i + b * j) % 11 - 5) / 10.0


def weights(latent: int, hidden: int, out: int) -> dict[str, np.ndarray]:
    bias = lambda n, a: ((a * np.arange(n)) % 7 - 3) / 10.0
    return {
        "w1": small_weights(out, hidden, 3, 5), "b1": bias(hidden, 2), "w_mu": small_weights(hidden, latent, 2, 7), "b_mu": bias(latent, 3),
        "w_logvar": small_weights(hidden, latent, 5, 3), "b_logvar": bias(latent, 4), "w3": small_weights(latent, hidden, 7, 3), "b3": bias(hidden, 5),
        "w4": small_weights(hidden, out, 4, 9), "b4": bias(out, 6),
    }


def w_sql(i: str, j: str, a: int, b: int) -> str:
    return f"((({a} * ({i}) + {b} * ({j})) % 11 - 5) / 10.0::DOUBLE)"


def b_sql(j: str, a: int) -> str:
    return f"((({a} * ({j})) % 7 - 3) / 10.0::DOUBLE)"


def layer_sql(src: str, x: str, n_in: int, n_out: int, a: int, b: int, bias: int, relu: bool, keep: str = "id") -> str:
    """SQL of one dense layer over the list ``x`` as a new list of the same name."""
    cell = f"list_sum(list_transform(range({n_in}), lambda i: {x}[i + 1] * {w_sql('i', 'j', a, b)})) + {b_sql('j', bias)}"
    if relu:
        cell = f"greatest({cell}, 0)"
    return f"SELECT {keep}, list_transform(range({n_out}), lambda j: {cell}) AS {x} FROM ({src})"


HID, OUT = 6, 16
DEC_H = layer_sql("SELECT id, vec AS z FROM vecs", "z", 64, HID, 7, 3, 5, True)
DEC_SQL = layer_sql(DEC_H, "z", HID, OUT, 4, 9, 6, False)


@query("score_decoder", with_views("vecs", f"SELECT id, round(1 / (1 + exp(-z[1] / 0.75::DOUBLE)), 6) AS first, round(list_sum(list_transform(z, lambda x: 1 / (1 + exp(-x / 0.75::DOUBLE)))), 6) AS total FROM ({DEC_SQL})"))
def score_decoder(spark, sf):
    d = M.score_decoder(embeddings(spark, sf), ["id"], "vec", weights(64, HID, OUT), 0.75)
    return d.select("id", F.round(F.get("probs", F.lit(0)), 6).alias("first"), F.round(V.total("probs"), 6).alias("total"))


ENC_H = layer_sql("SELECT id, vec AS x FROM vecs", "x", 64, HID, 3, 5, 2, True)
LAT = 4


@query("score_encoder", with_views("vecs", f"""SELECT m.id, round(list_sum(m.x), 6) AS mu, round(list_sum(l.x), 6) AS logvar, round(list_sum(list_transform(r.x, lambda v: 1 / (1 + exp(-v)))), 6) AS probs
    FROM ({layer_sql(ENC_H, 'x', HID, LAT, 2, 7, 3, False)}) m JOIN ({layer_sql(ENC_H, 'x', HID, LAT, 5, 3, 4, False)}) l ON l.id = m.id
    JOIN ({layer_sql(layer_sql(layer_sql(ENC_H, 'x', HID, LAT, 2, 7, 3, False), 'x', LAT, HID, 7, 3, 5, True), 'x', HID, 64, 4, 9, 6, False)}) r ON r.id = m.id"""))
def score_encoder(spark, sf):
    w, x = weights(LAT, HID, 64), embeddings(spark, sf)
    d = M.score_encoder(x, ["id"], "vec", w).join(M.reconstruct(x, ["id"], "vec", w), "id")
    return d.select("id", *[F.round(V.total(c), 6).alias(c) for c in ("mu", "logvar", "probs")])


NORMAL = """sqrt(-2.0::DOUBLE * ln((('0x' || substr(md5('17:' || id || ':' || j), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE)) * cos(2.0::DOUBLE * pi() * (('0x' || substr(md5('17:' || id || ':' || j), 9, 8))::BIGINT / 4294967296.0::DOUBLE))"""
Z = f"SELECT id, list_transform(range({LAT}), lambda j: {NORMAL}) AS z FROM samples"
GEN_LOGITS = layer_sql(layer_sql(Z, "z", LAT, HID, 7, 3, 5, True), "z", HID, 64, 4, 9, 6, False)
GEN_T = ", ".join(map(str, TEMPS))


@query("generate_tag_sets", with_views("wide taxonomy kept", f"""SELECT id, slot::BIGINT AS slot, temperature, array_to_string(list_sort(list_distinct(list(tag))), ', ') AS aspect_list, any_value(key) AS key FROM (
      SELECT g.id, g.slot, g.temperature, t.tag, t.category, md5(g.id || '_' || g.original || '_' || g.temperature) AS key FROM grid g JOIN logits l ON l.id = g.id, taxonomy t
      WHERE 1 / (1 + exp(-(1 / (1 + exp(-l.z[t.tag_idx + 1]))) / g.temperature)) >= 0.62 OR list_contains(g.seeds, t.tag))
    GROUP BY 1, 2, 3 HAVING count(DISTINCT category) >= 3""",
    f"""logits AS ({GEN_LOGITS}), seeded AS (SELECT id, '[' || array_to_string(list_transform(tags, lambda t: '''' || t || ''''), ', ') || ']' AS original, [s FOR s IN [
      {SEED_SQL.format(c='genre').replace("'7:'", "'17:'")}, {SEED_SQL.format(c='instrument').replace("'7:'", "'17:'")}, {SEED_SQL.format(c='mood').replace("'7:'", "'17:'")}] IF s IS NOT NULL] AS seeds
      FROM (SELECT id, tags, genre AS genre_tags, instrument AS instrument_tags, mood AS mood_tags FROM wide)),
    grid AS (SELECT id, original, seeds, slot, temperature FROM seeded, (SELECT unnest([{GEN_T}]::DOUBLE[]) AS temperature, unnest(range({len(TEMPS)})) AS slot)
      UNION ALL SELECT id, '[]', [], slot, 2.0::DOUBLE FROM seeded, (SELECT unnest(range({len(TEMPS)}, {2 * len(TEMPS)})) AS slot))"""))
def generate_tag_sets(spark, sf):
    d = M.generate_tag_sets(samples(spark, sf), taxonomy(spark, sf), weights(LAT, HID, taxonomy(spark, sf).size), LAT, TEMPS, 0.62, seed=17)
    return d.select("id", F.col("slot").cast("bigint").alias("slot"), "temperature", joined("aspect_list").alias("aspect_list"), "key")
