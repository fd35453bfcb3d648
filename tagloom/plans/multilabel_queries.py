"""Queries for multi-label prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions.hashing import hash_normal
from tagloom.operators import cooccurrence as co
from tagloom.operators import multilabel as M
from tagloom.plans.registry import ORACLES, query
from tagloom.plans.stat_queries import rounded
from tagloom.plans.tag_queries import SEED_SQL, joined, wide
from tagloom.operators import tags as T
from tagloom.plans.views import sql_prob, tagged, taxonomy, with_probs, with_views


def predictions(spark, sf):
    return with_probs(tagged(spark, sf), taxonomy(spark, sf).size)


@query("hamming_loss", with_views("scored", "SELECT round(avg(((prob > 0.5)::INT <> y)::INT), 6) AS hamming_loss FROM scored"))
def hamming_loss(spark, sf):
    return rounded(M.hamming_loss(predictions(spark, sf)), "hamming_loss")


@query("jaccard_micro", with_views("scored", "SELECT round(sum(((prob > 0.5) AND y = 1)::INT) / sum(((prob > 0.5) OR y = 1)::INT)::DOUBLE, 6) AS jaccard_index FROM scored"))
def jaccard_micro(spark, sf):
    return rounded(M.jaccard_micro(predictions(spark, sf)), "jaccard_index")


AU = """SELECT count(*) FILTER (s > {0}) AS num_active_units, round(count(*) FILTER (s > {0}) * 100.0::DOUBLE / count(*), 6) AS pct_active_units, count(*) AS total_units,
    round(avg(v), 6) AS mean_variance, round(min(v), 6) AS min_variance, round(max(v), 6) AS max_variance, round(avg(s), 6) AS mean_std
    FROM (SELECT dim, var_samp(x) AS v, stddev_samp(x) AS s FROM (SELECT unnest(vec) AS x, unnest(range(64)) AS dim FROM vecs) GROUP BY dim)"""
AU_COLS = ("pct_active_units", "mean_variance", "min_variance", "max_variance", "mean_std")


@query("active_units", with_views("vecs", AU.format(0.12)))
def active_units(spark, sf):
    from tagloom.plans.views import embeddings

    return rounded(M.active_units(embeddings(spark, sf), "vec", 0.12), *AU_COLS)


@query("distinct_combinations", with_views("tagged", "SELECT combo, count(*) AS n FROM (SELECT array_to_string(tag_idx, ',') AS combo FROM tagged) GROUP BY 1"))
def distinct_combinations(spark, sf):
    return M.distinct_combinations(tagged(spark, sf), F.col("tag_idx"))


DIV = """SELECT count(*) AS unique_combinations, round(count(*) / any_value(t)::DOUBLE * 100, 6) AS pct_unique_combinations,
    round(-sum(n / t::DOUBLE * ln(n / t::DOUBLE + 1e-10::DOUBLE)), 6) AS entropy,
    round(2.0::DOUBLE * sum(r * n) / (count(*) * any_value(t)::DOUBLE) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini_coefficient
    FROM (SELECT n, sum(n) OVER () AS t, row_number() OVER (ORDER BY n) AS r FROM (SELECT combo, count(*) AS n FROM ({0}) GROUP BY 1))"""


@query("combination_diversity", with_views("tagged", DIV.format("SELECT array_to_string(tag_idx, ',') AS combo FROM tagged")))
def combination_diversity(spark, sf):
    combos = M.distinct_combinations(tagged(spark, sf), F.col("tag_idx"))
    return rounded(M.combination_diversity(combos), "pct_unique_combinations", "entropy", "gini_coefficient")


def cmp_ctes(t: float) -> str:
    return f"""guess AS (SELECT id, tag_idx FROM probs WHERE prob > {t}),
    p AS (SELECT a.tag_idx AS a, b.tag_idx AS b, count(*)::DOUBLE AS n FROM guess a JOIN guess b ON a.id = b.id GROUP BY 1, 2),
    o AS (SELECT a.tag_idx AS a, b.tag_idx AS b, count(*)::DOUBLE AS n FROM kept a JOIN kept b ON a.id = b.id GROUP BY 1, 2),
    grid AS (SELECT x.tag_idx AS a, y.tag_idx AS b FROM taxonomy x, taxonomy y),
    c AS (SELECT coalesce(p.n, 0) AS p, coalesce(o.n, 0) AS o FROM grid g LEFT JOIN p ON p.a = g.a AND p.b = g.b LEFT JOIN o ON o.a = g.a AND o.b = g.b),
    u AS (SELECT p, o, p / (sum(p) OVER () + 1e-10::DOUBLE) AS pn, o / (sum(o) OVER () + 1e-10::DOUBLE) AS qn FROM c),
    cmp AS (SELECT sum(pn * qn) / (sqrt(sum(pn * pn)) * sqrt(sum(qn * qn)) + 1e-10::DOUBLE) AS cosine_similarity,
      sum(qn * ln((qn + 1e-10::DOUBLE) / (pn + 1e-10::DOUBLE))) AS kl_divergence,
      sqrt(0.5::DOUBLE * sum((sqrt(pn) - sqrt(qn)) ** 2)) AS hellinger_distance, coalesce(corr(p, o), 0) AS pearson_correlation FROM u)"""


@query("cooccurrence_compare", with_views("probs kept taxonomy", "SELECT round(cosine_similarity, 6) AS cosine_similarity, round(kl_divergence, 6) AS kl_divergence, round(hellinger_distance, 6) AS hellinger_distance, round(pearson_correlation, 6) AS pearson_correlation FROM cmp", cmp_ctes(0.9)))
def cooccurrence_compare(spark, sf):
    d, n = predictions(spark, sf).withColumn("guess", M.predicted("probs", 0.9)), taxonomy(spark, sf).size
    pairs = co.cooccurrence_of(d, n, {"predicted": "guess", "original": "tag_idx"})
    out = co.compare_cooccurrence(pairs, n, "predicted", "original")
    return rounded(out, *out.columns)


RECON = """SELECT 'hamming_loss' AS name, avg(((prob > 0.9)::INT <> y)::INT) AS value FROM scored
    UNION ALL SELECT 'jaccard_index', sum(((prob > 0.9) AND y = 1)::INT) / sum(((prob > 0.9) OR y = 1)::INT)::DOUBLE FROM scored
    UNION ALL SELECT unnest(['active_units_num_active_units', 'active_units_pct_active_units', 'active_units_total_units', 'active_units_mean_variance', 'active_units_min_variance', 'active_units_max_variance', 'active_units_mean_std']),
      unnest([num_active_units, pct_active_units, total_units, mean_variance, min_variance, max_variance, mean_std]::DOUBLE[]) FROM au
    UNION ALL SELECT unnest(['diversity_unique_combinations', 'diversity_pct_unique_combinations', 'diversity_entropy', 'diversity_gini_coefficient']),
      unnest([unique_combinations, pct_unique_combinations, entropy, gini_coefficient]::DOUBLE[]) FROM dv
    UNION ALL SELECT 'silhouette_score', avg(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) FROM (
      SELECT id, max(m) FILTER (own = label) AS a, min(m) FILTER (own <> label) AS b FROM (SELECT x.id, x.label AS own, y.label, avg(list_distance(x.z, y.z)) AS m FROM lat x, lat y GROUP BY 1, 2, 3) GROUP BY id)
    UNION ALL SELECT unnest(['cooccurrence_cosine_similarity', 'cooccurrence_kl_divergence', 'cooccurrence_hellinger_distance', 'cooccurrence_pearson_correlation']),
      unnest([cosine_similarity, kl_divergence, hellinger_distance, pearson_correlation]) FROM cmp"""
LATENT = """(SELECT id, unnest(range(8)) AS dim, unnest(list_transform(range(8), lambda j: sqrt(-2.0::DOUBLE * ln((('0x' || substr(md5('21:' || id || ':' || j), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE))
      * cos(2.0::DOUBLE * pi() * (('0x' || substr(md5('21:' || id || ':' || j), 9, 8))::BIGINT / 4294967296.0::DOUBLE)))) AS x FROM tagged)"""


@query("recon_metrics", with_views("scored probs kept taxonomy tagged", f"SELECT name, round(value, 5) AS value FROM ({RECON})",
    cmp_ctes(0.9) + f", au AS ({AU.format(0).replace('(SELECT unnest(vec) AS x, unnest(range(64)) AS dim FROM vecs)', LATENT)}), dv AS ({DIV.format('SELECT t.id, string_agg(g.tag_idx::VARCHAR, chr(44) ORDER BY g.tag_idx) AS combo FROM tagged t LEFT JOIN guess g ON g.id = t.id GROUP BY 1')}), lat AS (SELECT l.id, list(l.x ORDER BY l.dim) AS z, any_value(t.tag_idx[1]) AS label FROM {LATENT} l JOIN tagged t ON t.id = l.id GROUP BY 1)"))
def recon_metrics(spark, sf):
    z = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: hash_normal(F.lit(21), F.col("id"), j))
    d = predictions(spark, sf).withColumn("latent", z)
    return M.recon_metrics(d, taxonomy(spark, sf), "latent", 0.9).select("name", F.round("value", 5).alias("value"))


@query("sampling_stats", with_views("probs", """SELECT round(avg(k), 6) AS avg_tags_per_sample, round(stddev_samp(k), 6) AS std_tags_per_sample, min(k)::DOUBLE AS min_tags_per_sample, max(k)::DOUBLE AS max_tags_per_sample,
    count(DISTINCT combo) AS unique_combinations, round(count(DISTINCT combo) / count(*)::DOUBLE, 6) AS diversity_ratio,
    (SELECT round(avg(prob), 6) FROM probs) AS mean_probability, (SELECT round(stddev_samp(prob), 6) FROM probs) AS std_probability, round(avg(h), 6) AS avg_entropy, count(*) AS num_samples
    FROM (SELECT id, count(*) FILTER (prob > 0.5) AS k, string_agg(tag_idx::VARCHAR, ',' ORDER BY tag_idx) FILTER (prob > 0.5) AS combo,
      sum(-(prob * ln(prob + 1e-8::DOUBLE) + (1 - prob) * ln(1 - prob + 1e-8::DOUBLE))) AS h FROM probs GROUP BY 1)"""))
def sampling_stats(spark, sf):
    cols = ("avg_tags_per_sample", "std_tags_per_sample", "diversity_ratio", "mean_probability", "std_probability", "avg_entropy")
    return rounded(M.sampling_stats(predictions(spark, sf)), *cols)


LATENT_STATS = AU.format(0.01).replace("(SELECT unnest(vec) AS x, unnest(range(64)) AS dim FROM vecs)", LATENT)


@query("sampling_report", f"""SELECT s.*, 1.0::DOUBLE AS temperature, 0.5::DOUBLE AS threshold, {', '.join(f'a.{c} AS latent_{c}' for c in ('num_active_units', 'total_units', *AU_COLS))}
    FROM ({ORACLES['sampling_stats']}) s, ({with_views('tagged', LATENT_STATS)}) a""")
def sampling_report(spark, sf):
    z = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: hash_normal(F.lit(21), F.col("id"), j))
    out = M.sampling_report(predictions(spark, sf).withColumn("z", z), 1.0)
    whole = ("min_tags_per_sample", "max_tags_per_sample", "unique_combinations", "num_samples", "latent_num_active_units", "latent_total_units", "temperature", "threshold")
    return rounded(out, *[c for c in out.columns if c not in whole])


SILHOUETTE = """SELECT round(avg(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (
    SELECT id, max(m) FILTER (own = label) AS a, min(m) FILTER (own <> label) AS b FROM (
      SELECT x.id, x.label AS own, y.label, avg(list_distance(x.vec, y.vec)) AS m FROM l x, l y GROUP BY 1, 2, 3) GROUP BY id)"""


@query("silhouette_multi_hot", with_views("vecs", SILHOUETTE, "l AS (SELECT id, vec, id % 7 AS label FROM vecs WHERE id % 7 < 5)"))
def silhouette_multi_hot(spark, sf):
    from tagloom.plans.views import embeddings

    first = F.col("id") % 7
    tags = F.when(first < 5, F.array(first, first + 3)).otherwise(F.array().cast("array<bigint>"))
    return rounded(M.silhouette_multi_hot(embeddings(spark, sf).withColumn("tag_idx", tags), "id", "vec"), "silhouette")


@query("vae_loss_terms", with_views("scored tagged", f"""SELECT round(bce + 0.5::DOUBLE * kld, 3) AS loss, round(bce, 3) AS bce, round(kld, 3) AS kld FROM
    (SELECT sum(CASE WHEN y = 1 THEN -greatest(ln(CASE WHEN prob <= 0 THEN 1e-300 ELSE prob END), -100) ELSE -greatest(ln(1 - prob), -100) END) AS bce FROM scored),
    (SELECT -0.5::DOUBLE * sum(1 + lv - m * m - exp(lv)) AS kld FROM (SELECT {sql_prob('j', 5)} AS m, {sql_prob('j', 7)} - 0.5::DOUBLE AS lv FROM tagged, (SELECT unnest(range(8)) AS j)))"""))
def vae_loss_terms(spark, sf):
    d = with_probs(predictions(spark, sf).withColumnRenamed("probs", "p"), 8, 5).withColumnRenamed("probs", "mu")
    d = with_probs(d, 8, 7).withColumn("logvar", F.transform("probs", lambda x: x - 0.5)).drop("probs").withColumnRenamed("p", "probs")
    out = M.vae_loss_terms(d, "mu", "logvar", beta=0.5)
    return out.select(*[F.round(c, 3).alias(c) for c in out.columns])


@query("decode_tags", with_views("samples taxonomy wide", f"""SELECT p.id, coalesce(string_agg(t.tag, ', ' ORDER BY t.tag_idx) FILTER ({sql_prob('t.tag_idx', id_col='p.id')} >= 0.9 OR list_contains(p.seeds, t.tag)), '') AS tags FROM
    (SELECT id, tags, [s FOR s IN [{SEED_SQL.format(c='genre')}, {SEED_SQL.format(c='instrument')}, {SEED_SQL.format(c='mood')}] IF s IS NOT NULL] AS seeds
     FROM (SELECT id, tags, genre AS genre_tags, instrument AS instrument_tags, mood AS mood_tags FROM wide)) p, taxonomy t GROUP BY 1"""))
def decode_tags(spark, sf):
    tax = taxonomy(spark, sf)
    d = with_probs(wide(spark, sf), tax.size).withColumn("seeds", T.seed_tags(["genre_tags", "instrument_tags", "mood_tags"], "id", 7))
    out = d.select("id", M.decode_tags(d, tax, "probs", "seeds", 0.9).alias("t"))
    return out.select("id", joined("t").alias("tags"))


@query("sigmoid_temperature", with_views("vecs", """SELECT id, round(1 / (1 + exp(-vec[1] / 0.75::DOUBLE)), 6) AS first, round(list_sum(list_transform(vec, lambda x: 1 / (1 + exp(-x / 0.75::DOUBLE)))), 5) AS once,
    round(list_sum(list_transform(vec, lambda x: 1 / (1 + exp(-(1 / (1 + exp(-x))) / 0.75::DOUBLE)))), 5) AS twice FROM vecs"""))
def sigmoid_temperature(spark, sf):
    from tagloom.functions.vectors import total
    from tagloom.plans.views import embeddings

    once, twice = M.score_tags("vec", 0.75), M.score_tags("vec", 0.75, apply_sigmoid=2)
    d = embeddings(spark, sf).select("id", once.alias("once"), twice.alias("twice"))
    return d.select("id", F.round(F.get("once", F.lit(0)), 6).alias("first"), F.round(total("once"), 5).alias("once"), F.round(total("twice"), 5).alias("twice"))
