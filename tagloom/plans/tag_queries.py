"""Queries over tag lists and the taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.operators import cooccurrence as co
from tagloom.operators import tags as T
from tagloom.operators.taxonomy import taxonomy_summary
from tagloom.plans.registry import ORACLES, query
from tagloom.plans.views import kept, samples, table, tagged, taxonomy, with_views
from tagloom.session import scratch_path
from tagloom.sources import datasets as DS

CATS = ("tempo", "genre", "mood", "instrument")
TAG_COLS = [c + "_tags" for c in CATS]


def joined(col, sep: str = ", "):
    return F.array_join(col, sep)


def wide(spark, sf):
    """Samples with one sorted array column per category."""
    return T.categorize_tags(samples(spark, sf), taxonomy(spark, sf))


@query("taxonomy_dim", with_views("taxonomy", "SELECT category, cat_pos::BIGINT AS cat_pos, tag, tag_pos::BIGINT AS tag_pos, tag_idx::BIGINT AS tag_idx FROM taxonomy"))
def taxonomy_dim(spark, sf):
    dim = taxonomy(spark, sf).frame
    return dim.select("category", F.col("cat_pos").cast("bigint"), "tag", F.col("tag_pos").cast("bigint"), F.col("tag_idx").cast("bigint"))


@query("tag_index", with_views("taxonomy", "SELECT tag, tag_idx::BIGINT AS tag_idx FROM taxonomy"))
def tag_index(spark, sf):
    return taxonomy(spark, sf).frame.select("tag", F.col("tag_idx").cast("bigint"))


@query("category_ranges", with_views("taxonomy", "SELECT category, min(tag_idx)::BIGINT AS start, (max(tag_idx)+1)::BIGINT AS end_excl FROM taxonomy GROUP BY 1"))
def category_ranges(spark, sf):
    return taxonomy(spark, sf).ranges()


@query("taxonomy_summary", with_views("taxonomy", """SELECT category, count(*) AS n_tags,
    string_agg(tag, ', ' ORDER BY tag_pos) FILTER (tag_pos < 3) AS examples FROM taxonomy GROUP BY 1"""))
def taxonomy_summary_q(spark, sf):
    return taxonomy_summary(taxonomy(spark, sf).frame)


@query("parse_tag_literal", with_views("samples", r"""SELECT id, len(tags)::BIGINT AS n_tags, array_to_string(tags, '|') AS tags
    FROM (SELECT id, list_transform(list_append(tags, 'it''s'), lambda t: t) AS tags FROM samples WHERE id % 11 <> 3)"""))
def parse_tag_literal(spark, sf):
    lit = F.when(F.col("id") % 11 == 3, F.lit("['open")).otherwise(X.render_tag_literal(F.concat("tags", F.array(F.lit("it's")))))
    raw = samples(spark, sf).select("id", lit.alias("aspect_list"))
    parsed = T.parse_tag_lists(raw, "aspect_list", on_error="drop")
    return parsed.select("id", F.size("aspect_list").cast("bigint").alias("n_tags"), joined("aspect_list", "|").alias("tags"))


@query("split_tags", with_views("samples", """SELECT id, len(tags)::BIGINT AS n_tags, array_to_string(tags, '|') AS tags,
    (CASE WHEN id % 5 = 0 THEN 1 ELSE len(tags) END)::BIGINT AS n_legacy
    FROM (SELECT id, CASE WHEN id % 5 = 0 THEN [] ELSE tags END AS tags FROM samples)"""))
def split_tags(spark, sf):
    raw = F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(joined("tags", " , "))
    d = samples(spark, sf).select("id", raw.alias("text"))
    return d.select(
        "id",
        F.size(X.split_tags("text", ",")).cast("bigint").alias("n_tags"),
        joined(X.split_tags("text", ","), "|").alias("tags"),
        F.size(X.split_tags("text", ",", legacy_empty=True)).cast("bigint").alias("n_legacy"),
    )


@query("normalize_tags", with_views("", """SELECT p_partkey, lower(p_type) || '|' || lower(p_brand) || '|' || lower(p_name) AS tags FROM part"""))
def normalize_tags(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.array("p_type", "p_brand", "p_name").alias("tags"))
    return raw.select("p_partkey", joined(F.transform("tags", F.lower), "|").alias("tags"))


@query("canonical_tags", with_views("", """SELECT l_orderkey AS id, array_to_string(list_sort(list_distinct(list(tag))), '|') AS tags
    FROM (SELECT l_orderkey, 'size ' || p_size AS tag FROM lineitem JOIN part ON l_partkey = p_partkey
          UNION ALL SELECT l_orderkey, lower(p_type) FROM lineitem JOIN part ON l_partkey = p_partkey
          UNION ALL SELECT l_orderkey, lower(p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey
          UNION ALL SELECT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1"""))
def canonical_tags(spark, sf):
    doubled = samples(spark, sf).select("id", F.concat(F.reverse("tags"), F.col("tags")).alias("tags"))
    return doubled.select("id", joined(T.canonical_tags("tags"), "|").alias("tags"))


WIDE_SQL = "array_to_string(tempo, ', ') AS tempo_tags, array_to_string(genre, ', ') AS genre_tags, array_to_string(mood, ', ') AS mood_tags, array_to_string(instrument, ', ') AS instrument_tags"


@query("extract_tags", with_views("wide", f"SELECT id, {WIDE_SQL} FROM wide"))
def extract_tags(spark, sf):
    d = T.extract_tags(samples(spark, sf), taxonomy(spark, sf))
    return d.select("id", *[joined(c).alias(c) for c in TAG_COLS])


@query("categorize_tags", with_views("wide taxonomy", f"""SELECT id, {WIDE_SQL},
    array_to_string(list_filter(tags, lambda t: NOT list_contains(k.names, t)), ', ') AS "None_tags"
    FROM wide, (SELECT list(tag) AS names FROM taxonomy) k"""))
def categorize_tags(spark, sf):
    d = T.categorize_tags(samples(spark, sf), taxonomy(spark, sf), on_unknown="collect")
    return d.select("id", *[joined(c).alias(c) for c in TAG_COLS + ["None_tags"]])


@query("categorize_by_join", with_views("wide", f"SELECT id, {WIDE_SQL} FROM wide"))
def categorize_by_join(spark, sf):
    d = T.categorize_by_join(samples(spark, sf), taxonomy(spark, sf).frame, CATS, "id", "tags")
    return d.select("id", *[joined(c).alias(c) for c in TAG_COLS])


N_CATS = "((len(tempo)>0)::INT + (len(genre)>0)::INT + (len(mood)>0)::INT + (len(instrument)>0)::INT)"


@query("min_categories", with_views("wide", f"SELECT id, {WIDE_SQL} FROM wide WHERE {N_CATS} >= 3"))
def min_categories(spark, sf):
    return T.min_categories(wide(spark, sf), TAG_COLS, 3).select("id", *[joined(c).alias(c) for c in TAG_COLS])


@query("combined_tags", with_views("wide", f"""SELECT id, len(c)::BIGINT AS n_tags, array_to_string(c, ', ') AS aspect_list
    FROM (SELECT id, list_concat(list_concat(tempo, genre), list_concat(mood, instrument)) AS c FROM wide WHERE {N_CATS} >= 3)"""))
def combined_tags(spark, sf):
    d = T.min_categories(wide(spark, sf), TAG_COLS, 3).select("id", T.combined_tags(TAG_COLS).alias("c"))
    return d.select("id", F.size("c").cast("bigint").alias("n_tags"), joined("c").alias("aspect_list"))


@query("multi_hot", with_views("tagged taxonomy", """SELECT id, array_to_string(list_transform(range((SELECT count(*) FROM taxonomy)), lambda j:
    CASE WHEN list_contains(tag_idx, j) THEN '1' ELSE '0' END), '') AS bits, array_to_string(tag_idx, ',') AS tag_idx FROM tagged"""))
def multi_hot(spark, sf):
    tax = taxonomy(spark, sf)
    d = tagged(spark, sf).withColumn("dense", tax.dense())
    bits = F.array_join(F.transform("dense", lambda x: x.cast("int").cast("string")), "")
    return d.select("id", bits.alias("bits"), joined(F.col("tag_idx").cast("array<string>"), ",").alias("tag_idx"))


SEED_SQL = """CASE WHEN len({c}_tags) >= 2 THEN {c}_tags[1 + ('0x' || substr(md5('7:' || id || ':{c}_tags'), 1, 8))::BIGINT % len({c}_tags)] END"""


@query("seed_tags", with_views("wide", f"""SELECT id, array_to_string([s FOR s IN [
    {SEED_SQL.format(c='genre')}, {SEED_SQL.format(c='instrument')}, {SEED_SQL.format(c='mood')}] IF s IS NOT NULL], ', ') AS seed_tags
    FROM (SELECT id, genre AS genre_tags, instrument AS instrument_tags, mood AS mood_tags FROM wide)"""))
def seed_tags(spark, sf):
    pick = T.seed_tags(["genre_tags", "instrument_tags", "mood_tags"], "id", 7)
    return wide(spark, sf).select("id", joined(pick).alias("seed_tags"))


@query("surrogate_key", with_views("samples", r"""SELECT id, md5(id || '_[' || array_to_string(list_transform(tags, lambda t: '''' || t || ''''), ', ') || ']_1.0') AS key FROM samples"""))
def surrogate_key(spark, sf):
    d = samples(spark, sf).withColumn("temperature", F.lit(1.0))
    return d.select("id", T.surrogate_key("id", "tags", "temperature").alias("key"))


TEMPS = (0.25, 0.5, 0.75, 1.0, 1.0, 1.0, 1.25, 1.5, 1.75, 2.0)  # fixed values: sampling temperatures, 1.0 weighted three times


@query("temperature_grid", with_views("samples", f"""SELECT id, t.temperature, t.slot::BIGINT AS slot FROM samples,
    (SELECT unnest([{', '.join(map(str, TEMPS))}]::DOUBLE[]) AS temperature, unnest(range({len(TEMPS)})) AS slot) t"""))
def temperature_grid(spark, sf):
    grid = F.posexplode(F.array(*[F.lit(t) for t in TEMPS])).alias("slot", "temperature")
    return samples(spark, sf).select("id", grid).select("id", "temperature", F.col("slot").cast("bigint"))


@query("key_duplicates", with_views("samples", f"""SELECT copies, count(*) AS n_keys FROM (SELECT count(*) AS copies FROM (
    SELECT md5(id || '_[]_' || t.temperature) AS k FROM samples, (SELECT unnest([{', '.join(map(str, TEMPS))}]::DOUBLE[]) AS temperature) t) GROUP BY k) GROUP BY copies"""))
def key_duplicates(spark, sf):
    grid = samples(spark, sf).select("id", F.array().cast("array<string>").alias("tags"), F.explode(F.array(*[F.lit(t) for t in TEMPS])).alias("t"))
    return T.key_duplicates(grid.select(T.surrogate_key("id", "tags", "t").alias("key")), "key")


@query("rows_with_tag", with_views("wide", "SELECT id, array_to_string(mood, ', ') AS mood_tags FROM wide WHERE list_contains(list_concat(list_concat(genre, mood), list_concat(instrument, tempo)), 'brand#3')"))
def rows_with_tag(spark, sf):
    d = wide(spark, sf)
    hit = F.array_contains(F.concat("genre_tags", "mood_tags", "instrument_tags", "tempo_tags"), "brand#3")
    return d.where(hit).select("id", joined("mood_tags").alias("mood_tags"))


@query("genre_points", with_views("wide", "SELECT id, g AS genre FROM wide, (SELECT unnest(['promo', 'economy']) AS g) WHERE list_contains(genre, g)"))
def genre_points(spark, sf):
    chosen = F.array_intersect(F.array(F.lit("promo"), F.lit("economy")), F.col("genre_tags"))
    return wide(spark, sf).select("id", F.explode(chosen).alias("genre"))


@query("tag_category_join", with_views("kept", "SELECT id, tag, category, tag_idx::BIGINT AS tag_idx FROM kept"))
def tag_category_join(spark, sf):
    return kept(spark, sf).select("id", "tag", "category", F.col("tag_idx").cast("bigint"))


@query("tag_frequency", with_views("item_tags", "SELECT tag, count(*) AS n FROM item_tags GROUP BY 1"))
def tag_frequency(spark, sf):
    return T.tag_frequency(samples(spark, sf))


@query("tag_frequency_csv", ORACLES["tag_frequency"])
def tag_frequency_csv(spark, sf):
    """The table written as CSV and read back; tags have no line breaks, so its files are read in splits."""
    root = scratch_path(spark, "frequency")
    freq = tag_frequency(spark, sf)
    DS.write_csv(freq, root)
    return DS.read_csv(spark, root, freq.schema, multi_line=False)


@query("top_tags", with_views("item_tags", "SELECT tag, count(*) AS n FROM item_tags GROUP BY 1 ORDER BY n DESC, tag LIMIT 20"))
def top_tags(spark, sf):
    return T.top_tags(T.tag_frequency(samples(spark, sf)), 20)


@query("top_tags_per_category", with_views("kept", """SELECT category, tag, n, rnk FROM (SELECT category, tag, count(*) AS n,
    row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, tag) AS rnk FROM kept GROUP BY 1, 2) WHERE rnk <= 15"""))
def top_tags_per_category(spark, sf):
    freq = taxonomy(spark, sf).join_long(T.tag_frequency(samples(spark, sf)), "tag")
    return T.top_per_group(freq, ["category"], [F.desc("n"), F.col("tag")], 15).select("category", "tag", "n", "rnk")


@query("concepts_per_category", with_views("kept", "SELECT category, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS concepts, count(DISTINCT tag) AS n FROM kept GROUP BY 1"))
def concepts_per_category(spark, sf):
    used = taxonomy(spark, sf).join_long(samples(spark, sf).select(F.explode("tags").alias("tag")).distinct(), "tag")
    return used.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("concepts"), F.count("*").alias("n"))


@query("unknown_tags", with_views("item_tags taxonomy", "SELECT tag, count(*) AS n FROM item_tags WHERE tag NOT IN (SELECT tag FROM taxonomy) GROUP BY 1"))
def unknown_tags(spark, sf):
    return T.unknown_tags(samples(spark, sf), taxonomy(spark, sf))


@query("samples_per_concept", with_views("kept", """SELECT tag, id, rnk, n_found, n_found < 50 AS short FROM (
    SELECT tag, id, row_number() OVER (PARTITION BY tag ORDER BY id) AS rnk, count(*) OVER (PARTITION BY tag) AS n_found FROM kept) WHERE rnk <= 50"""))
def samples_per_concept(spark, sf):
    rows = kept(spark, sf).select("tag", "id")
    first = T.top_per_group(rows, ["tag"], [F.col("id")], 50)
    found = T.tag_frequency(samples(spark, sf)).withColumnRenamed("n", "n_found")
    return first.join(found, "tag").select("tag", "id", "rnk", "n_found", (F.col("n_found") < 50).alias("short"))


@query("cooccurrence", with_views("kept", "SELECT a.tag_idx::BIGINT AS a, b.tag_idx::BIGINT AS b, count(*) AS n FROM kept a JOIN kept b ON a.id = b.id GROUP BY 1, 2"))
def cooccurrence(spark, sf):
    return co.cooccurrence(tagged(spark, sf), taxonomy(spark, sf).size)


@query("top_tag_pairs", with_views("kept", """SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM kept a JOIN kept b ON a.id = b.id AND a.tag_idx < b.tag_idx
    WHERE a.id IN (SELECT id FROM kept GROUP BY id HAVING count(DISTINCT category) >= 3) GROUP BY 1, 2 ORDER BY n DESC, tag_a, tag_b LIMIT 50"""))
def top_tag_pairs(spark, sf):
    tax = taxonomy(spark, sf)
    rich = T.min_categories(wide(spark, sf), TAG_COLS, 3)
    pairs = co.cooccurrence(tax.encode(rich, "tags"), tax.size).where("a < b")
    named = co.name_pairs(pairs, tax.frame)
    return named.select("tag_a", "tag_b", "n").orderBy(F.desc("n"), "tag_a", "tag_b").limit(50)


PAIRS_CTE = "cooc AS (SELECT a.tag_idx AS a, b.tag_idx AS b, count(*) AS n FROM kept a JOIN kept b ON a.id = b.id GROUP BY 1, 2), model AS (SELECT c.a, c.b, c.n / d.n::DOUBLE AS prob FROM cooc c JOIN cooc d ON d.a = c.a AND d.b = c.a WHERE c.a <> c.b)"


@query("conditional_tag_model", with_views("kept", "SELECT a::BIGINT AS a, b::BIGINT AS b, round(prob, 6) AS prob FROM model", PAIRS_CTE))
def conditional_tag_model(spark, sf):
    model = co.conditional_tag_model(co.cooccurrence(tagged(spark, sf), taxonomy(spark, sf).size))
    return model.select("a", "b", F.round("prob", 6).alias("prob"))


@query("sample_conditional", with_views("kept tagged", """SELECT t.id, t.a::BIGINT AS a, coalesce(string_agg(m.b::VARCHAR, ',' ORDER BY m.b) FILTER (
      (('0x' || substr(md5('5:' || t.id || ':' || m.b), 1, 8))::BIGINT / 4294967296.0::DOUBLE) < m.prob), '') AS tags
    FROM (SELECT id, tag_idx[1] AS a FROM tagged) t LEFT JOIN model m ON m.a = t.a GROUP BY 1, 2""", PAIRS_CTE))
def sample_conditional(spark, sf):
    rows = tagged(spark, sf)
    model = co.conditional_tag_model(co.cooccurrence(rows, taxonomy(spark, sf).size))
    seeds = rows.select("id", F.get("tag_idx", F.lit(0)).cast("bigint").alias("seed_tag"))
    drawn = co.sample_conditional(seeds, model, "id", "seed_tag", 5)
    return drawn.select("id", "a", joined(F.col("tag_idx").cast("array<string>"), ",").alias("tags"))


@query("random_tag_sets", with_views("samples taxonomy", """SELECT id, string_agg(tag, ', ' ORDER BY cat_pos, m, tag) AS tags FROM (
    SELECT s.id, t.cat_pos, t.tag, md5('3:' || s.id || ':' || t.tag) AS m,
      row_number() OVER (PARTITION BY s.id, t.category ORDER BY md5('3:' || s.id || ':' || t.tag), t.tag) AS rn
    FROM samples s, taxonomy t) WHERE rn <= 2 GROUP BY id"""))
def random_tag_sets(spark, sf):
    from tagloom.operators.splits import random_tag_sets as draw

    d = draw(samples(spark, sf).select("id"), taxonomy(spark, sf), "id", per_category=2, seed=3)
    return d.select("id", joined("tags").alias("tags"))
