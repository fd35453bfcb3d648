"""Queries for descriptive and two-sample statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.operators import distributions as D
from tagloom.operators import stats as S
from tagloom.operators import tags as T
from tagloom.plans.registry import query
from tagloom.plans.tag_queries import TAG_COLS, TEMPS, wide
from tagloom.sources.files import label_from_path
from tagloom.plans.views import captions, model_scores, samples, sql_words, table, taxonomy, with_views


def rounded(df, *cols):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


DESC = """count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v)::BIGINT AS min, max(v)::BIGINT AS max"""


def sql_q(p: float) -> str:
    return f"round(quantile_cont(v::DOUBLE, {p}), 6) AS q{round(p * 100)}"


PROBS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@query("describe_tag_counts", with_views("wide", f"""SELECT category, {DESC}, {', '.join(map(sql_q, PROBS))} FROM (
    SELECT 'tempo_tags' AS category, len(tempo) AS v FROM wide UNION ALL SELECT 'genre_tags', len(genre) FROM wide
    UNION ALL SELECT 'mood_tags', len(mood) FROM wide UNION ALL SELECT 'instrument_tags', len(instrument) FROM wide
    UNION ALL SELECT 'aspect_list', len(tempo) + len(genre) + len(mood) + len(instrument) FROM wide) GROUP BY 1"""))
def describe_tag_counts(spark, sf):
    d = wide(spark, sf).withColumn("aspect_list", T.combined_tags(TAG_COLS))
    counts = F.array(*[F.struct(F.lit(c).alias("category"), F.size(c).cast("bigint").alias("v")) for c in [*TAG_COLS, "aspect_list"]])
    out = S.describe(d.select(F.inline(counts)), "v", ["category"], PROBS)
    return rounded(out, "mean", "std", *[f"q{round(p * 100)}" for p in PROBS])


@query("category_dataset_stats", with_views("wide", f"""SELECT dataset, category, {DESC}, {', '.join(map(sql_q, (.25, .5, .75)))} FROM (
    SELECT CASE WHEN id % 2 = 0 THEN 'generated' ELSE 'source' END AS dataset, u.category, u.v FROM wide,
    LATERAL (SELECT unnest(['tempo', 'genre', 'mood', 'instrument', 'All Tags']) AS category,
                    unnest([len(tempo), len(genre), len(mood), len(instrument), len(tags)]) AS v) u) GROUP BY 1, 2"""))
def category_dataset_stats(spark, sf):
    dataset = F.when(F.col("id") % 2 == 0, "generated").otherwise("source")
    d = samples(spark, sf).withColumn("dataset", dataset)
    out = S.category_dataset_stats(d, taxonomy(spark, sf), "dataset", "tags")
    return rounded(out, "mean", "std", "q25", "q50", "q75").withColumns({c: F.col(c).cast("bigint") for c in ("min", "max")})


@query("tag_count_distribution", with_views("samples", "SELECT len(tags)::BIGINT AS n_tags, count(*) AS n FROM samples GROUP BY 1 ORDER BY 1"))
def tag_count_distribution(spark, sf):
    return S.value_counts(samples(spark, sf).select(F.size("tags").cast("bigint").alias("n_tags")), "n_tags").orderBy("n_tags")


WORDS = f"SELECT lang, len({sql_words('text')})::BIGINT AS v FROM documents"


@query("histogram", f"""SELECT bin::BIGINT AS bin, round(lo + bin * w, 6) AS left_edge, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * w), 9) AS density FROM (
    SELECT lo, w, least(floor((v - lo) / w), 29) AS bin FROM ({WORDS}), (SELECT min(v)::DOUBLE AS lo, (max(v) - min(v)) / 30.0::DOUBLE AS w FROM ({WORDS}))) GROUP BY bin, lo, w""")
def histogram(spark, sf):
    d = captions(spark, sf).select(X.word_count("caption").alias("v"))
    return S.histogram(d, "v", 30).select("bin", F.round("left_edge", 6).alias("left_edge"), "n", F.round("density", 9).alias("density"))


@query("shared_bins_histogram", f"""SELECT lang, bin::BIGINT AS bin, round(lo + bin * w, 6) AS left_edge, count(*) AS n,
    round(count(*) / (sum(count(*)) OVER (PARTITION BY lang) * w), 9) AS density FROM (
    SELECT lang, lo, w, least(floor((v - lo) / w), 38) AS bin FROM ({WORDS}), (SELECT min(v)::DOUBLE AS lo, (max(v) - min(v)) / 39.0::DOUBLE AS w FROM ({WORDS}))) GROUP BY lang, bin, lo, w""")
def shared_bins_histogram(spark, sf):
    d = captions(spark, sf).select(F.col("split").alias("lang"), X.word_count("caption").alias("v"))
    out = S.histogram(d, "v", 39, ["lang"])  # 40 edges
    return out.select("lang", "bin", F.round("left_edge", 6).alias("left_edge"), "n", F.round("density", 9).alias("density"))


@query("kde_grid", with_views("model_scores", """SELECT g.model, i::BIGINT AS i, round(x, 6) AS x, round(sum(exp(-0.5::DOUBLE * ((x - s.score) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
    FROM (SELECT model, n, h, i, a + i * ((b - a) / 199.0::DOUBLE) AS x FROM (
        SELECT model, n, h, lo - 3 * h AS a, hi + 3 * h AS b FROM (
          SELECT model, count(*) AS n, stddev_samp(score) * count(*)::DOUBLE ** -0.2::DOUBLE AS h, min(score) AS lo, max(score) AS hi FROM model_scores GROUP BY 1)),
        (SELECT unnest(range(200)) AS i)) g
    JOIN model_scores s ON s.model = g.model GROUP BY g.model, i, x"""))
def kde_grid(spark, sf):
    return rounded(S.kde_grid(model_scores(spark, sf), "score", ["model"]), "x", "density")


@query("caption_lengths", f"SELECT doc_id AS id, len({sql_words('text')})::BIGINT AS n_words, length(text)::BIGINT AS n_chars FROM documents")
def caption_lengths(spark, sf):
    return captions(spark, sf).select("id", X.word_count("caption").alias("n_words"), X.char_count("caption").alias("n_chars"))


@query("avg_caption_length", f"SELECT lang AS split, round(avg(len({sql_words('text')})), 6) AS avg_words, round(avg(length(text)), 6) AS avg_chars FROM documents GROUP BY 1")
def avg_caption_length(spark, sf):
    d = captions(spark, sf)
    out = d.groupBy("split").agg(F.avg(X.word_count("caption")).alias("avg_words"), F.avg(X.char_count("caption")).alias("avg_chars"))
    return rounded(out, "avg_words", "avg_chars")


@query("tag_share", with_views("kept", """SELECT category, tag, source_count, generated_count,
    round(source_count * 100.0::DOUBLE / sum(source_count) OVER (PARTITION BY category), 6) AS source_pct,
    round(generated_count * 100.0::DOUBLE / sum(generated_count) OVER (PARTITION BY category), 6) AS generated_pct
    FROM (SELECT category, tag, count(*) FILTER (id % 3 <> 0) AS source_count, count(*) FILTER (id % 3 = 0) AS generated_count FROM kept GROUP BY 1, 2)"""))
def tag_share(spark, sf):
    dataset = F.when(F.col("id") % 3 == 0, "generated").otherwise("source")
    freq = T.tag_frequency(samples(spark, sf).withColumn("dataset", dataset), by=["dataset"])
    known = taxonomy(spark, sf).join_long(freq, "tag")
    return rounded(S.tag_share(known, "source", "generated"), "source_pct", "generated_pct")


@query("files_per_class", "SELECT lang AS label, count(*) AS n_files FROM documents GROUP BY 1")
def files_per_class(spark, sf):
    path = F.concat(F.lit("/audio/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    labels = table(spark, sf, "documents").select(label_from_path(path).alias("label"))
    return S.value_counts(labels, "label").withColumnRenamed("n", "n_files")


@query("dataset_profile", with_views("samples", f"""SELECT count(*) AS n_rows, string_agg(DISTINCT temperature::VARCHAR, ', ' ORDER BY temperature::VARCHAR) AS temperatures, min(id) AS first_id, min(id) AS sample_id
    FROM samples, (SELECT unnest([{', '.join(map(str, TEMPS))}]::DOUBLE[]) AS temperature)"""))
def dataset_profile(spark, sf):
    grid = samples(spark, sf).select("id", F.explode(F.array(*[F.lit(t) for t in TEMPS])).alias("temperature"))
    return S.dataset_profile(grid, "id", "temperature").select("n_rows", "temperatures", "first_id", F.col("sample.id").alias("sample_id"))


TWO = "SELECT CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS side, len(" + sql_words("text") + ")::DOUBLE AS v FROM documents"
CDF = f"two AS ({TWO}), tot AS (SELECT count(*) FILTER (side='a') AS n, count(*) FILTER (side='b') AS m FROM two), c AS (SELECT v, count(*) FILTER (side='a') AS na, count(*) FILTER (side='b') AS nb FROM two GROUP BY v), cum AS (SELECT v, na, nb, sum(na) OVER (ORDER BY v) AS ca, sum(nb) OVER (ORDER BY v) AS cb, lead(v) OVER (ORDER BY v) AS nx FROM c)"


def two_samples(spark, sf):
    side = F.when(F.col("split") == "en", "a").otherwise("b")
    return captions(spark, sf).select(side.alias("side"), X.word_count("caption").alias("v"))


@query("ks_statistic", f"WITH {CDF} SELECT round(max(abs(ca / n::DOUBLE - cb / m::DOUBLE)), 6) AS ks FROM cum, tot")
def ks_statistic(spark, sf):
    return rounded(D.ks_statistic(two_samples(spark, sf), "v", "side"), "ks")


@query("mann_whitney_u", f"WITH {CDF} SELECT round(sum(na * (cb - nb + nb / 2.0::DOUBLE)), 6) AS u, max(n) AS n, max(m) AS m FROM cum, tot")
def mann_whitney_u(spark, sf):
    return rounded(D.mann_whitney_u(two_samples(spark, sf), "v", "side"), "u")


@query("wasserstein_1d", f"WITH {CDF} SELECT round(sum(abs(ca / n::DOUBLE - cb / m::DOUBLE) * (nx - v)), 6) AS wasserstein FROM cum, tot")
def wasserstein_1d(spark, sf):
    return rounded(D.wasserstein_1d(two_samples(spark, sf), "v", "side"), "wasserstein")
