"""Queries for splits, samples, and the dataset layouts written from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.operators import splits as R
from tagloom.operators import tags as T
from tagloom.plans.registry import query
from tagloom.plans.tag_queries import joined
from tagloom.plans.views import captions, samples, table, taxonomy, with_views
from tagloom.session import scratch_path
from tagloom.sources import datasets as DS


def ranked(seed: str, tbl: str = "orders", id_col: str = "o_orderkey", by: str = "", cols: str = "") -> str:
    """SQL: rows with their hashed rank ``r`` and the row count ``n`` of their group."""
    part = f"PARTITION BY {by}" if by else ""
    key = f"md5('{seed}:' || {by + ' || chr(58) || ' if by else ''}{id_col})"
    return f"SELECT {id_col} AS id{', ' + cols if cols else ''}, row_number() OVER ({part} ORDER BY {key}, {id_col}) AS r, count(*) OVER ({part}) AS n FROM {tbl}"


def orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")


HOLD = "n - ceil(0.1::DOUBLE * n)"
HOLD_TEST = "n - ceil(0.5::DOUBLE * ceil(0.1::DOUBLE * n))"
TRAIN = "floor(0.7::DOUBLE * n)"
VALID = f"{TRAIN} + floor(0.5::DOUBLE * (n - {TRAIN}))"


@query("split_90_5_5", f"SELECT id, CASE WHEN r <= {HOLD} THEN 'train' WHEN r <= {HOLD_TEST} THEN 'validation' ELSE 'test' END AS split FROM ({ranked('42')})")
def split_90_5_5(spark, sf):
    return R.assign_splits(orders(spark, sf).select("id"), "id", 42, R.ranks_hold_out(0.1, 0.5))


@query("split_70_15_15", f"SELECT id, CASE WHEN r <= {TRAIN} THEN 'train' WHEN r <= {VALID} THEN 'validation' ELSE 'test' END AS split FROM ({ranked('42')})")
def split_70_15_15(spark, sf):
    return R.assign_splits(orders(spark, sf).select("id"), "id", 42, R.ranks_balanced(0.7, 0.15, 0.15))


SPLIT3 = f"SELECT id, CASE WHEN r <= {TRAIN} THEN 'train' WHEN r <= {VALID} THEN 'validation' ELSE 'test' END AS split FROM ({{0}})"


@query("subset_pct", f"WITH s AS ({SPLIT3.format(ranked('42'))}) SELECT id, split, r <= floor(0.1::DOUBLE * n) AS in_10pct FROM ({ranked('subset', 's', 'id', 'split', 'split')}) WHERE r <= floor(0.25::DOUBLE * n)")
def subset_pct(spark, sf):
    split = R.assign_splits(orders(spark, sf).select("id"), "id", 42, R.ranks_balanced(0.7, 0.15, 0.15))
    shares = lambda n: [F.floor(F.lit(0.10) * n), F.floor(F.lit(0.25) * n)]
    d = R.with_part(split, "id", "subset", shares, ["split"]).where("part < 2")
    return d.select("id", "split", (F.col("part") == 0).alias("in_10pct"))


N_TEST, N_VALID = "floor(n * 0.1::DOUBLE)", "floor((n - floor(n * 0.1::DOUBLE)) * 0.2::DOUBLE)"


@query("split_shuffle", f"SELECT id, CASE WHEN r <= n - {N_VALID} - {N_TEST} THEN 'train' WHEN r <= n - {N_TEST} THEN 'validation' ELSE 'test' END AS split FROM ({ranked('1')})")
def split_shuffle(spark, sf):
    return R.assign_splits(orders(spark, sf).select("id"), "id", 1, R.ranks_truncated(0.1, 0.2))


def held(source: str, by: str, within: str = "") -> str:
    """SQL: the test rows of each stratum, 20 % in all, by largest remainder."""
    lead, over = (f"{within}, ", f"PARTITION BY {within}") if within else ("", "")
    return f"""s AS (SELECT {lead}{by}, count(*) AS c FROM {source} GROUP BY ALL),
    t AS (SELECT *, sum(c) OVER ({over}) AS nn, ceil(0.2::DOUBLE * sum(c) OVER ({over})) AS total FROM s),
    q AS (SELECT *, floor(total * c / nn) AS whole, round(total * c / nn - floor(total * c / nn), 9) AS rest FROM t),
    h AS (SELECT {lead}{by}, whole + (row_number() OVER ({over} ORDER BY rest DESC, c DESC, {by}) <= total - sum(whole) OVER ({over}))::INT AS held FROM q)"""


@query("split_stratified", f"WITH {held('orders', 'o_orderstatus')} SELECT id, o_orderstatus, CASE WHEN r <= n - held THEN 'train' ELSE 'test' END AS split FROM ({ranked('9', by='o_orderstatus', cols='o_orderstatus')}) JOIN h USING (o_orderstatus)")
def split_stratified(spark, sf):
    d = orders(spark, sf).select("id", "o_orderstatus")
    return R.stratified_split(d, "id", 9, 0.2, ["o_orderstatus"])


@query("repeated_splits", f"""WITH e AS (SELECT label::BIGINT AS label, run FROM embeddings, (SELECT unnest(range(5)) AS run)), {held('e', 'label', 'run')}
    SELECT id, label, run::BIGINT AS run, CASE WHEN r <= n - held THEN 'train' ELSE 'test' END AS split FROM (
    SELECT id, label, run, row_number() OVER (PARTITION BY run, label ORDER BY md5('run:' || run || ':' || label || ':' || id), id) AS r, count(*) OVER (PARTITION BY run, label) AS n
    FROM (SELECT vec_id AS id, label::BIGINT AS label, run FROM embeddings, (SELECT unnest(range(5)) AS run))) JOIN h USING (run, label)""")
def repeated_splits(spark, sf):
    d = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"))
    out = R.repeated_splits(d, "id", 5, 0.2, ["label"])
    return out.select("id", "label", F.col("run").cast("bigint").alias("run"), "split")


@query("sample_fraction", f"SELECT id FROM ({ranked('11')}) WHERE r <= round_even(0.25::DOUBLE * n, 0)")
def sample_fraction(spark, sf):
    return R.sample_fraction(orders(spark, sf).select("id"), "id", 0.25, 11)


@query("sample_fraction_hashed", "SELECT o_orderkey AS id FROM orders WHERE (('0x' || substr(md5('11:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE) < 0.25::DOUBLE")
def sample_fraction_hashed(spark, sf):
    return R.sample_fraction(orders(spark, sf).select("id"), "id", 0.25, 11, exact=False)


@query("sample_n", "SELECT o_orderkey AS id FROM orders ORDER BY md5('5:' || o_orderkey), o_orderkey LIMIT 150")
def sample_n(spark, sf):
    return R.sample_n(orders(spark, sf).select("id"), "id", 150, 5)


@query("latent_normal", """SELECT id, round(z0, 6) AS z0, round(z7, 6) AS z7, round(list_sum(z), 6) AS total FROM (SELECT id, z[1] AS z0, z[8] AS z7, z FROM (
    SELECT id, list_transform(range(8), lambda j: sqrt(-2.0::DOUBLE * ln((('0x' || substr(md5('13:' || id || ':' || j), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE))
      * cos(2.0::DOUBLE * pi() * (('0x' || substr(md5('13:' || id || ':' || j), 9, 8))::BIGINT / 4294967296.0::DOUBLE))) AS z
    FROM (SELECT o_orderkey AS id FROM orders)))""")
def latent_normal(spark, sf):
    d = R.latent_normal(orders(spark, sf).select("id"), "id", 8, 13)
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + x)
    return d.select("id", F.round(F.get("z", F.lit(0)), 6).alias("z0"), F.round(F.get("z", F.lit(7)), 6).alias("z7"), F.round(total, 6).alias("total"))


@query("split_sizes", f"""WITH s AS ({SPLIT3.format(ranked('42'))}), b AS ({ranked('subset', 's', 'id', 'split', 'split')})
    SELECT config, split, count(*) AS n FROM (SELECT 'default' AS config, split FROM b
      UNION ALL SELECT '25pct', split FROM b WHERE r <= floor(0.25::DOUBLE * n) UNION ALL SELECT '10pct', split FROM b WHERE r <= floor(0.1::DOUBLE * n)) GROUP BY 1, 2""")
def split_sizes(spark, sf):
    return with_configs(orders(spark, sf).select("id")).select(F.explode("configs").alias("config"), "split").groupBy("config", "split").agg(F.count("*").alias("n"))


def with_configs(df, audio: bool = False):
    """Add the split and the list of configurations a row is published in."""
    split = R.assign_splits(df, "id", 42, R.ranks_balanced(0.7, 0.15, 0.15))
    shares = lambda n: [F.floor(F.lit(0.10) * n), F.floor(F.lit(0.25) * n)]
    part = R.with_part(split, "id", "subset", shares, ["split"])
    names = [(2, "default"), (1, "25pct"), (0, "10pct")]
    if audio:
        names += [(2, "audio"), (1, "25pct-audio"), (0, "10pct-audio")]
    configs = F.array_compact(F.array(*[F.when(F.col("part") <= limit, F.lit(name)) for limit, name in names]))
    return part.withColumn("configs", configs).drop("part")


@query("publish_configs", f"""WITH s AS ({SPLIT3.format(ranked('42', 'documents', 'doc_id'))}), b AS (SELECT b.*, d.text FROM ({ranked('subset', 's', 'id', 'split', 'split')}) b JOIN documents d ON d.doc_id = b.id)
    SELECT config, split, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM (
      SELECT c AS config, split, text FROM b, (SELECT unnest(['default', 'audio']) AS c)
      UNION ALL SELECT c, split, text FROM b, (SELECT unnest(['25pct', '25pct-audio']) AS c) WHERE r <= floor(0.25::DOUBLE * n)
      UNION ALL SELECT c, split, text FROM b, (SELECT unnest(['10pct', '10pct-audio']) AS c) WHERE r <= floor(0.1::DOUBLE * n)) GROUP BY 1, 2""")
def publish_configs(spark, sf):
    root = scratch_path(spark, "published")
    DS.publish(with_configs(captions(spark, sf).select("id", "caption"), audio=True), root)
    d = DS.read_dataset(spark, root)
    return d.groupBy("config", "split").agg(F.count("*").alias("n"), F.sum(F.char_length("caption")).alias("n_chars"))


@query("dataset_split_read", f"""WITH s AS ({SPLIT3.format(ranked('42', 'documents', 'doc_id'))})
    SELECT id, r.split FROM ({ranked('subset', 's', 'id', 'split', 'split')}) r WHERE r.r <= floor(0.25::DOUBLE * r.n) AND r.split = 'test'""")
def dataset_split_read(spark, sf):
    root = scratch_path(spark, "dataset")
    DS.publish(with_configs(captions(spark, sf).select("id", "caption")), root)
    return DS.read_dataset(spark, root, "25pct", "test").select("id", "split")


@query("csv_roundtrip", "SELECT doc_id AS id, lang, md5(text) AS digest, length(text)::BIGINT AS n_chars FROM documents")
def csv_roundtrip(spark, sf):
    root = scratch_path(spark, "csv")
    DS.write_csv(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text"), root)
    d = DS.read_csv(spark, root, "id bigint, lang string, text string")
    return d.select("id", "lang", F.md5("text").alias("digest"), F.char_length("text").cast("bigint").alias("n_chars"))


@query("split_write_roundtrip", f"""WITH s AS (SELECT id, CASE WHEN r <= {HOLD} THEN 'train' WHEN r <= {HOLD_TEST} THEN 'validation' ELSE 'test' END AS split FROM ({ranked('42', 'documents', 'doc_id')}))
    SELECT x.part, count(*) AS n, sum(length(d.text))::BIGINT AS n_chars FROM (SELECT id, split AS part FROM s UNION ALL SELECT id, 'all' FROM s) x JOIN documents d ON d.doc_id = x.id GROUP BY 1""")
def split_write_roundtrip(spark, sf):
    root = scratch_path(spark, "splits")
    d = R.assign_splits(captions(spark, sf).select("id", "caption"), "id", 42, R.ranks_hold_out(0.1, 0.5))
    DS.write_splits(d, root)
    schema = "id bigint, caption string"
    per_split = DS.read_splits(spark, {s: f"{root}/split={s}" for s in ("train", "validation", "test")}, schema)
    everything = DS.read_csv(spark, root, schema).withColumn("split", F.lit("all"))
    both = per_split.unionByName(everything)
    return both.groupBy(F.col("split").alias("part")).agg(F.count("*").alias("n"), F.sum(F.char_length("caption")).alias("n_chars"))


@query("union_splits", "SELECT lang AS split, doc_id AS id FROM documents WHERE lang <> 'en' UNION ALL SELECT lang, doc_id FROM documents WHERE lang = 'en'")
def union_splits(spark, sf):
    d = captions(spark, sf).select("split", "id")
    return d.where("split <> 'en'").unionByName(d.where("split = 'en'"))


@query("published_schema", with_views("wide", """SELECT id::VARCHAR AS id, 'caption of ' || id AS caption,
    '[' || array_to_string(list_transform(tags, lambda t: '''' || t || ''''), ', ') || ']' AS aspect_list,
    array_to_string(genre, ', ') AS genre_aspects, array_to_string(mood, ', ') AS mood_aspects,
    array_to_string(instrument, ', ') AS instrument_aspects, array_to_string(tempo, ', ') AS tempo_aspects, id || '.wav' AS file_name FROM wide"""))
def published_schema(spark, sf):
    d = T.categorize_tags(samples(spark, sf), taxonomy(spark, sf), suffix="_aspects")
    key = F.col("id").cast("string")
    d = d.withColumns({
        "id": key, "prediction": F.concat(F.lit("caption of "), key), "aspect_list": X.render_tag_literal("tags"),
        "file_name": F.concat(key, F.lit(".wav")),
    })
    out = DS.published_schema(d.withColumnRenamed("prediction", "caption"), with_file=True)
    return out.withColumns({c: joined(c) for c in out.columns if c.endswith("_aspects")})


@query("head_per_model", with_views("model_scores", "SELECT model, id, rnk FROM (SELECT model, id, row_number() OVER (PARTITION BY model ORDER BY id) AS rnk FROM model_scores) WHERE rnk <= 500"))
def head_per_model(spark, sf):
    from tagloom.plans.views import model_scores

    return T.top_per_group(model_scores(spark, sf).select("model", "id"), ["model"], [F.col("id")], 500)


CAPS = {"en": 1500, "fr": 40, "de": 7}  # test, validation and train caps of an inference run


@query("cap_per_split", "SELECT split, id FROM (SELECT lang AS split, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= CASE split WHEN 'en' THEN 1500 WHEN 'fr' THEN 40 WHEN 'de' THEN 7 ELSE r END")
def cap_per_split(spark, sf):
    from tagloom.operators.sets import cap_per_split as cap

    return cap(captions(spark, sf).select("split", "id"), "split", "id", CAPS)


@query("filter_temperature", with_views("samples", "SELECT id, t AS temperature FROM samples, (SELECT unnest([0.25, 0.5, 0.75, 1.0, 1.25]::DOUBLE[]) AS t) WHERE t = 1.0"))
def filter_temperature(spark, sf):
    grid = samples(spark, sf).select("id", F.explode(F.array(*[F.lit(t) for t in (0.25, 0.5, 0.75, 1.0, 1.25)])).alias("temperature"))
    return grid.where(F.col("temperature") == 1.0)
