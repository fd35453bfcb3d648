"""Queries over run logs, model outputs, files and published results."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.functions import text as X
from tagloom.operators import concepts as C
from tagloom.operators import runs as R
from tagloom.operators import sets as J
from tagloom.operators import tags as T
from tagloom.plans.registry import query
from tagloom.plans.stat_queries import rounded
from tagloom.plans.views import captions, kept, metric_log, samples, table, text_pairs, with_views
from tagloom.session import scratch_path
from tagloom.sources import datasets as DS
from tagloom.sources import documents as JS
from tagloom.sources import files as FS


@query("epoch_metrics", with_views("metric_log", "SELECT run, epoch, name, round(sum(value * w) / sum(w), 9) AS value FROM (SELECT run, step // 1000 AS epoch, name, value, step % 16 + 1 AS w FROM metric_log) GROUP BY 1, 2, 3"))
def epoch_metrics(spark, sf):
    d = metric_log(spark, sf).withColumns({"epoch": F.floor(F.col("step") / 1000).cast("bigint"), "w": F.col("step") % 16 + 1})
    return R.epoch_metrics(d, ["run", "epoch", "name"], "value", "w").withColumn("value", F.round("value", 9))


@query("latest_metrics", with_views("metric_log", "SELECT run, name, max(step) AS step, arg_max(value, step) AS value FROM metric_log GROUP BY 1, 2"))
def latest_metrics(spark, sf):
    return R.latest_metrics(metric_log(spark, sf), ["run", "name"])


@query("flatten_metrics", with_views("metric_log", """SELECT step, name, round(value, 6) AS value FROM (
    SELECT step, 'bleu' AS name, value FROM metric_log UNION ALL SELECT step, 'precisions', (value + 1 + 3) / 3 FROM metric_log
    UNION ALL SELECT step, 'rouge_one', value * 2 FROM metric_log WHERE step % 3 = 0
    UNION ALL SELECT step, 'rouge_all', (value + 0.5) / 2 FROM metric_log WHERE step % 3 = 0)"""))
def flatten_metrics(spark, sf):
    v = F.col("value").cast("string")
    nested = F.when(F.col("step") % 3 == 0, F.concat(F.lit(', "rouge": {"one": '), (F.col("value") * 2).cast("string"), F.lit(', "all": ['), v, F.lit(', 0.5], "kind": "text"}'))).otherwise(F.lit(""))
    text = F.concat(F.lit('{"bleu": '), v, F.lit(', "precisions": ['), v, F.lit(', 1.0, 3.0], "note": "abc"'), nested, F.lit("}"))
    return rounded(R.flatten_metrics(metric_log(spark, sf).select("step", text.alias("json")), ["step"], "json"), "value")


@query("early_stop_step", with_views("metric_log", """SELECT run, min(step) FILTER (idx - best_idx >= 10) AS stop_step FROM (
    SELECT run, step, idx, max(CASE WHEN m IS NULL OR value < m THEN idx END) OVER (PARTITION BY run ORDER BY step) AS best_idx FROM (
      SELECT run, step, value, row_number() OVER (PARTITION BY run ORDER BY step) AS idx, min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM metric_log WHERE name = 'view')) GROUP BY run"""))
def early_stop_step(spark, sf):
    return R.early_stop_step(metric_log(spark, sf).where("name = 'view'"), patience=10)


@query("best_checkpoints", with_views("metric_log", "SELECT run, step, value, rnk FROM (SELECT run, step, value, row_number() OVER (PARTITION BY run ORDER BY value, step) AS rnk FROM metric_log WHERE name = 'view') WHERE rnk <= 3"))
def best_checkpoints(spark, sf):
    log = metric_log(spark, sf).where("name = 'view'").select("run", "step", "value")
    return R.best_checkpoints(log, ["run"], 3)


@query("best_run", with_views("metric_log", "SELECT run, min(value) AS value FROM metric_log WHERE name = 'error' GROUP BY 1 ORDER BY value, run LIMIT 1"))
def best_run(spark, sf):
    return R.best_run(metric_log(spark, sf).where("name = 'error'"))


@query("metrics_json", with_views("metric_log", """SELECT run, '{' || string_agg('"' || name || '":' || n, ',' ORDER BY name) || '}' AS json FROM (SELECT run, name, count(*) AS n FROM metric_log GROUP BY 1, 2) GROUP BY 1"""))
def metrics_json(spark, sf):
    root = scratch_path(spark, "metrics")
    counts = metric_log(spark, sf).groupBy("run", "name").agg(F.count("*").alias("n"))
    summary = JS.metrics_json(counts, "run", "name", "n")
    JS.write_json_text(summary.select(F.to_json(F.struct("run", "json")).alias("json")), root)
    return spark.read.text(root).select(F.from_json("value", "run bigint, json string").alias("r")).select("r.run", "r.json")


@query("metric_store_json", with_views("metric_log", """SELECT run, '{' || string_agg('"' || stage || '": {' || coalesce(o, '') || '}', ', ' ORDER BY pos) || '}' AS json FROM (
    SELECT r.run, s.stage, s.pos, string_agg('"' || v.name || '": ' || v.value, ', ' ORDER BY v.name) AS o
    FROM (SELECT DISTINCT run FROM metric_log) r CROSS JOIN (SELECT unnest(['train', 'val', 'test']) AS stage, unnest([0, 1, 2]) AS pos) s
    LEFT JOIN (SELECT run, stage, name, CASE WHEN name = 'error' THEN '"at ' || max(step) || '"' ELSE max(step)::VARCHAR END AS value
      FROM (SELECT *, CASE step % 3 WHEN 0 THEN 'train' ELSE 'test' END AS stage FROM metric_log) GROUP BY 1, 2, 3) v ON v.run = r.run AND v.stage = s.stage
    GROUP BY 1, 2, 3) GROUP BY run"""))
def metric_store_json(spark, sf):
    from tagloom.operators.reports import metric_store_json as store

    step = F.col("step").cast("string")
    d = metric_log(spark, sf).withColumn("stage", F.when(F.col("step") % 3 == 0, "train").otherwise("test"))
    return store(d.withColumn("value", F.when(F.col("name") == "error", F.concat(F.lit("at "), step)).otherwise(step)), ["run"])


GENRES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")  # order priorities stand for genres
SCORES = "SELECT k.category, k.tag AS concept, o.o_orderpriority AS genre, avg((o.o_totalprice > 200000)::INT) AS score FROM kept k JOIN orders o ON o.o_orderkey = k.id WHERE k.category IN ('tempo', 'instrument') GROUP BY 1, 2, 3"


def concept_scores(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("genre"), (F.col("o_totalprice") > 200000).cast("double").alias("hit"))
    k = kept(spark, sf).where(F.col("category").isin("tempo", "instrument")).select("id", "category", F.col("tag").alias("concept"))
    return k.join(o, "id").groupBy("category", "concept", "genre").agg(F.avg("hit").alias("score"))


def published_results(spark, sf):
    """Nested result text as it is published, then read back into rows."""
    nested = C.nested_results(concept_scores(spark, sf), F.lit(0.5) + F.length("concept") / F.lit(100.0))
    return JS.results_long(nested, "json")


@query("results_long", with_views("kept", f"SELECT category, concept, round(0.5::DOUBLE + length(concept) / 100.0::DOUBLE, 6) AS cav_accuracy, genre, round(score, 6) AS score FROM ({SCORES})"))
def results_long(spark, sf):
    return rounded(published_results(spark, sf), "cav_accuracy", "score")


@query("cav_accuracy_by_concept", with_views("kept", "SELECT DISTINCT category, tag AS concept, round(0.5::DOUBLE + length(tag) / 100.0::DOUBLE, 6) AS cav_accuracy FROM kept WHERE category IN ('tempo', 'instrument')"))
def cav_accuracy_by_concept(spark, sf):
    return rounded(published_results(spark, sf).groupBy("category", "concept").agg(F.first("cav_accuracy").alias("cav_accuracy")), "cav_accuracy")


@query("score_matrix", with_views("kept", "SELECT category, concept, " + ", ".join(f"""round(coalesce(max(score) FILTER (genre = '{g}'), 0), 6)::DOUBLE AS "{g}" """ for g in GENRES) + f" FROM ({SCORES}) WHERE score > 0.4 GROUP BY 1, 2"))
def score_matrix(spark, sf):
    m = C.score_matrix(concept_scores(spark, sf).where("score > 0.4"), GENRES)
    return m.select("category", "concept", *[F.round(F.col(f"`{g}`"), 6).alias(g) for g in GENRES])


@query("rank_concepts_by_genre", with_views("kept", f"SELECT genre, concept, round(score, 6) AS score, row_number() OVER (PARTITION BY genre ORDER BY round(score, 9), concept) AS rnk FROM ({SCORES})"))
def rank_concepts_by_genre(spark, sf):
    d = concept_scores(spark, sf).withColumn("order_score", F.round("score", 9))
    ranked = d.withColumn("rnk", F.row_number().over(W.partitionBy("genre").orderBy("order_score", "concept")))
    return ranked.select("genre", "concept", F.round("score", 6).alias("score"), "rnk")


@query("predictions_table", with_views("pairs", "SELECT id, md5(reference) AS reference, md5(prediction) AS prediction FROM pairs"))
def predictions_table(spark, sf):
    root = scratch_path(spark, "predictions")
    d = text_pairs(spark, sf)
    DS.write_csv(J.zip_by_id(d.select("id", "reference"), d.select("id", "prediction")), root)
    back = DS.read_csv(spark, root, "id string, reference string, prediction string")
    return back.select("id", F.md5("reference").alias("reference"), F.md5("prediction").alias("prediction"))


@query("zip_by_id", "SELECT d.doc_id AS id, d.lang, l.quality::BIGINT AS quality, length(d.text)::BIGINT AS n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def zip_by_id(spark, sf):
    d = table(spark, sf, "documents")
    scores = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("bigint").alias("quality"))
    left = d.select(F.col("doc_id").alias("id"), "lang")
    return J.zip_by_id(left, scores, d.select(F.col("doc_id").alias("id"), X.char_count("text").alias("n_chars")))


ROLES = ("system", "user", "assistant")


@query("common_ids", "SELECT conv_id AS id FROM conversations GROUP BY 1 HAVING count(DISTINCT role) FILTER (role IN ('system', 'user', 'assistant')) = 3")
def common_ids(spark, sf):
    d = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "role")
    return J.common_ids(d, "role", "id", ROLES)


@query("compare_models", """SELECT * FROM (SELECT conv_id AS id, min(md5(text)) FILTER (role = 'system') AS system, min(md5(text)) FILTER (role = 'user') AS "user", min(md5(text)) FILTER (role = 'assistant') AS assistant
    FROM conversations GROUP BY 1) WHERE system IS NOT NULL AND "user" IS NOT NULL AND assistant IS NOT NULL""")
def compare_models(spark, sf):
    d = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "role", F.md5("text").alias("text"))
    return J.compare_models(d, "role", "id", "text", ROLES)


@query("vocab_union", with_views("item_tags", "SELECT DISTINCT tag FROM item_tags WHERE (id % 2 = 0 AND category <> 'mood') OR (id % 2 = 1 AND category <> 'genre')"))
def vocab_union(spark, sf):
    d = samples(spark, sf)
    no = lambda c: F.filter("tags", lambda t: ~t.startswith("brand#")) if c == "mood" else F.filter("tags", lambda t: ~F.array_contains(genres, t))
    genres = F.array(*[F.lit(g) for g in ("economy", "standard", "promo", "small", "medium", "large")])
    even = d.where("id % 2 = 0").select(no("mood").alias("tags"))
    odd = d.where("id % 2 = 1").select(no("genre").alias("tags"))
    return J.vocab_union(even, odd, "tags")


@query("label_encode", "SELECT doc_id AS id, lang, (list_position(['de', 'en', 'es', 'fr'], lang) - 1)::BIGINT AS label, list_extract(['de', 'en', 'es', 'fr'], list_position(['de', 'en', 'es', 'fr'], lang)) AS back FROM documents")
def label_encode(spark, sf):
    names = F.array(*[F.lit(c) for c in ("de", "en", "es", "fr")])
    d = captions(spark, sf).select("id", F.col("split").alias("lang"))
    d = d.withColumn("label", (F.array_position(names, F.col("lang")) - 1).cast("bigint"))
    return d.withColumn("back", F.get(names, F.col("label").cast("int")))


@query("file_metadata", "SELECT doc_id AS id, lang, doc_id || '.wav' AS filename FROM documents")
def file_metadata(spark, sf):
    root = scratch_path(spark, "metadata")
    d = captions(spark, sf).select("id", F.col("split").alias("lang"), F.format_string("%s.wav", F.col("id").cast("string")).alias("filename"))
    DS.write_csv(d, root)
    return DS.read_csv(spark, root, "id bigint, lang string, filename string")


def audio_listing(spark, sf):
    """A file listing: there is a file for every labelled document."""
    path = F.concat(F.lit("/audio/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    return table(spark, sf, "labels").select(path.alias("path")).select(FS.file_name("path").alias("file_name"))


def audio_rows(spark, sf):
    return captions(spark, sf).select("id", F.concat(F.col("id").cast("string"), F.lit(".wav")).alias("filename"))


@query("rows_with_file", "SELECT doc_id AS id, doc_id || '.wav' AS filename FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def rows_with_file(spark, sf):
    return FS.rows_with_file(audio_rows(spark, sf), audio_listing(spark, sf), "filename").select("id", "filename")


@query("missing_file_count", "SELECT count(*) AS n_missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_file_count(spark, sf):
    return FS.missing_file_count(audio_rows(spark, sf), audio_listing(spark, sf), "filename")


def text_files(spark, sf) -> str:
    """Documents written as text files, one folder per language."""
    root = scratch_path(spark, "files")
    table(spark, sf, "documents").select("lang", "text").write.option("maxRecordsPerFile", 10_000).partitionBy("lang").text(root)
    return root


@query("file_label_listing", "SELECT lang AS label, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY 1")
def file_label_listing(spark, sf):
    files = FS.list_files(spark, text_files(spark, sf), "*.txt")
    return files.groupBy("label").agg(F.sum("length").alias("bytes"))


@query("attach_binary", "SELECT lang AS label, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY 1")
def attach_binary(spark, sf):
    root = text_files(spark, sf)
    rows = FS.list_files(spark, root, "*.txt").select("label", "path")
    full = FS.attach_binary(rows, root, "path", "*.txt")
    return full.groupBy("label").agg(F.sum(F.octet_length("content")).alias("bytes"))
