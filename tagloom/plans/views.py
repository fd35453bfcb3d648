"""Tables and derived views that the ready-made queries read, in Spark and in SQL.

There is no tag data among the tables, so an order stands for a sample and the attributes of its parts
stand for the free-form tags of that sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.bind import let
from tagloom.functions.text import words
from tagloom.operators.taxonomy import Taxonomy
from tagloom.session import is_small_scan, spread

# Category order of the taxonomy.
CATEGORIES = ("tempo", "genre", "mood", "instrument")

_SMALL_SCANS: dict[tuple[int, str, str], bool] = {}
_TAXONOMIES: dict[tuple[int, str], Taxonomy] = {}


_HEAVY = {"lineitem", "orders", "documents", "conversations", "embeddings", "events", "pages"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in _HEAVY and _is_small(df, sf, name) else df


def _is_small(df: DataFrame, sf: str, name: str) -> bool:
    key = (id(df.sparkSession), sf, name)
    if key not in _SMALL_SCANS:
        _SMALL_SCANS[key] = is_small_scan(df)
    return _SMALL_SCANS[key]


def _part_tags() -> Column:
    tag = lambda pos, text: F.struct(F.lit(CATEGORIES[pos]).alias("category"), F.lit(pos).alias("cat_pos"), text.alias("tag"))
    return F.array(
        tag(0, F.concat(F.lit("size "), F.col("p_size").cast("string"))),
        tag(1, F.lower("p_type")),
        tag(2, F.lower("p_brand")),
        tag(3, F.col("p_name")),
    )


def taxonomy(spark: SparkSession, sf: str) -> Taxonomy:
    """The stand-in taxonomy: a selection of part attributes, read once per session and folder."""
    key = (id(spark), sf)
    if key not in _TAXONOMIES:
        t, c = F.col("tag"), F.col("category")
        chosen = (
            ((c == "genre") & t.isin("promo", "economy", "small"))
            | ((c == "mood") & (F.replace(t, F.lit("brand#"), F.lit("")).try_cast("int") <= 12))
            | ((c == "instrument") & (t.startswith("red ") | t.startswith("blue ") | t.startswith("old ")))
            | ((c == "tempo") & (F.replace(t, F.lit("size "), F.lit("")).try_cast("int") <= 25))
        )
        tags = table(spark, sf, "part").select(F.inline(_part_tags())).where(chosen).distinct()
        _TAXONOMIES[key] = Taxonomy.from_frame(tags)
    return _TAXONOMIES[key]


def _parts_of_lines(spark: SparkSession, sf: str, part: DataFrame) -> DataFrame:
    """``id`` and the columns of ``part`` but its key, for each line of a sample."""
    scan = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines = scan.select(F.col("l_orderkey").alias("id"), "l_partkey")
    if _is_small(scan, sf, "lineitem"):
        lines = spread(lines, "id")  # a large scan is combined per id before its shuffle instead
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


def _part_tag_lists(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.transform(_part_tags(), lambda t: t["tag"]).alias("tags"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, tags)``: the distinct raw tags of every sample, sorted; a set per id, bounded by the vocabulary."""
    long = _parts_of_lines(spark, sf, _part_tag_lists(spark, sf)).select("id", F.explode("tags").alias("tag"))
    return long.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, tag_idx)``: sorted taxonomy positions of every sample with at least one known tag.

    Tags are looked up once for each part, not for each sample that has it, and only positions are grouped.
    """
    part = taxonomy(spark, sf).encode(_part_tag_lists(spark, sf), "tags").where(F.size("tag_idx") > 0).select("p_partkey", "tag_idx")
    long = _parts_of_lines(spark, sf, part).select("id", F.explode("tag_idx").alias("i"))
    return long.groupBy("id").agg(F.array_sort(F.collect_set("i")).alias("tag_idx"))


def kept(spark: SparkSession, sf: str) -> DataFrame:
    """Long ``(id, category, tag, tag_idx)`` rows of the known tags."""
    tax = taxonomy(spark, sf)
    return tax.join_long(samples(spark, sf).select("id", F.explode("tags").alias("tag")), "tag")


# Two multiplicative generators modulo primes below 2^31.
_M1, _M2 = 2147483647, 2147483399


def with_probs(df: DataFrame, n: int, salt: int = 11, id_col: str = "id") -> DataFrame:
    """A probability vector per row, mixed from the id: stands for a model's output.

    What a row's numbers share is computed once, and what rows share is a constant, as lambdas are slow.
    """
    positions = F.sequence(F.lit(0).cast("bigint"), F.lit(69621 * (n - 1)).cast("bigint"), F.lit(69621).cast("bigint"))
    unit = lambda a: (((a % _M1) * 40692) % _M2) * 48271 % _M1 / F.lit(float(_M1))
    return df.withColumn("probs", let(lambda v: F.transform(positions, lambda j: unit(v["a"] + j)), a=(F.col(id_col) % _M1) * 48271 + salt))


def sql_prob(j: str, salt: int = 11, id_col: str = "id") -> str:
    a = f"((({id_col} % {_M1}) * 48271 + {j} * 69621 + {salt}) % {_M1})"
    return f"(((({a} * 40692) % {_M2}) * 48271 % {_M1}) / {_M1}.0::DOUBLE)"


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("bigint").alias("label")
    )


def text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, prediction, reference)``: an assistant turn and the turn before it."""
    c = table(spark, sf, "conversations")
    pred = c.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("prediction"))
    ref = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return pred.join(ref, ["conv_id", "turn"]).select(key.alias("id"), "prediction", "reference")


def captions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("split"), F.col("text").alias("caption"))


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, ids)``: every word of a document as a token id below 64."""
    to_id = lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % 64)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.transform(words("text"), to_id).alias("ids"))


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    """``(run, step, name, value)``: user actions stand for the logged metrics of a run."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("name"), "value"
    )


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("model"), F.col("event_id").alias("id"), (F.col("value") / 500.0).alias("score"))


def judge_replies(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, reply)``: replies in the shapes a judge model gives, good and bad, built from document ids."""
    d = F.col("doc_id")
    score = (d % 14).cast("string")
    reply = (
        F.when(d % 7 == 0, F.concat(F.lit("Score: "), score, F.lit("/10\nReasoning: text of "), F.col("lang")))
        .when(d % 7 == 1, F.concat(F.lit("  Score: "), score, F.lit(".5 out of 10\nReasoning:")))
        .when(d % 7 == 2, F.concat(F.lit("Score: abc\nReasoning: from "), F.col("source")))
        .when(d % 7 == 3, F.lit(""))
        .when(d % 7 == 4, F.concat(F.lit("Score: 3\nScore: "), score, F.lit("\nReasoning: last one wins ")))
        .when(d % 7 == 5, F.concat(F.lit("Score:\nI would say "), score))
        .otherwise(F.concat(F.lit("The Score: 9\nscore: 2\nReasoning: no line starts with it")))
    )
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), reply.alias("reply"))


WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def sql_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{WS}'), lambda w: w <> '')"


_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "item_tags": (
        (),
        """SELECT DISTINCT id, category, cat_pos, tag FROM (
          SELECT l_orderkey AS id, 'tempo' AS category, 0 AS cat_pos, 'size ' || p_size AS tag FROM lineitem JOIN part ON l_partkey = p_partkey
          UNION ALL SELECT l_orderkey, 'genre', 1, lower(p_type) FROM lineitem JOIN part ON l_partkey = p_partkey
          UNION ALL SELECT l_orderkey, 'mood', 2, lower(p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey
          UNION ALL SELECT l_orderkey, 'instrument', 3, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    ),
    "part_tags": (
        (),
        """SELECT DISTINCT category, cat_pos, tag FROM (
          SELECT 'tempo' AS category, 0 AS cat_pos, 'size ' || p_size AS tag FROM part
          UNION ALL SELECT 'genre', 1, lower(p_type) FROM part
          UNION ALL SELECT 'mood', 2, lower(p_brand) FROM part
          UNION ALL SELECT 'instrument', 3, p_name FROM part)""",
    ),
    "taxonomy": (
        ("part_tags",),
        """SELECT category, cat_pos, tag,
          row_number() OVER (PARTITION BY category ORDER BY tag) - 1 AS tag_pos,
          row_number() OVER (ORDER BY cat_pos, tag) - 1 AS tag_idx
        FROM part_tags WHERE (category='genre' AND tag IN ('promo','economy','small'))
          OR (category='mood' AND try_cast(replace(tag,'brand#','') AS INT) <= 12)
          OR (category='instrument' AND (tag LIKE 'red %' OR tag LIKE 'blue %' OR tag LIKE 'old %'))
          OR (category='tempo' AND try_cast(replace(tag,'size ','') AS INT) <= 25)""",
    ),
    "kept": (
        ("item_tags", "taxonomy"),
        """SELECT i.id, t.category, t.cat_pos, t.tag, t.tag_idx FROM item_tags i
          JOIN taxonomy t ON i.category = t.category AND i.tag = t.tag""",
    ),
    "samples": (("item_tags",), "SELECT id, list(tag ORDER BY tag) AS tags FROM item_tags GROUP BY id"),
    "wide": (
        ("samples", "kept"),
        """SELECT s.id, s.tags,
          coalesce(list(k.tag ORDER BY k.tag) FILTER (k.category='tempo'), []) AS tempo,
          coalesce(list(k.tag ORDER BY k.tag) FILTER (k.category='genre'), []) AS genre,
          coalesce(list(k.tag ORDER BY k.tag) FILTER (k.category='mood'), []) AS mood,
          coalesce(list(k.tag ORDER BY k.tag) FILTER (k.category='instrument'), []) AS instrument
        FROM samples s LEFT JOIN kept k ON s.id = k.id GROUP BY s.id, s.tags""",
    ),
    "tagged": (("kept",), "SELECT id, list(tag_idx ORDER BY tag_idx) AS tag_idx FROM kept GROUP BY id"),
    "probs": (
        ("tagged", "taxonomy"),
        f"""SELECT id, j AS tag_idx, {sql_prob("j")} AS prob
          FROM tagged, (SELECT tag_idx AS j FROM taxonomy)""",
    ),
    "scored": (
        ("probs", "kept"),
        """SELECT p.id, p.tag_idx, p.prob, CASE WHEN k.tag_idx IS NULL THEN 0 ELSE 1 END AS y
          FROM probs p LEFT JOIN kept k ON p.id = k.id AND p.tag_idx = k.tag_idx""",
    ),
    "vecs": ((), "SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label::BIGINT AS label FROM embeddings"),
    "pairs": (
        (),
        """SELECT p.conv_id || '-' || p.turn AS id, p.text AS prediction, r.text AS reference
          FROM conversations p JOIN conversations r ON r.conv_id = p.conv_id AND r.turn = p.turn - 1
          WHERE p.role = 'assistant'""",
    ),
    "metric_log": ((), "SELECT user_id AS run, event_id AS step, event_type AS name, value FROM events"),
    "model_scores": ((), "SELECT event_type AS model, event_id AS id, value / 500.0::DOUBLE AS score FROM events"),
    "doc_tokens": (
        (),
        f"""SELECT doc_id AS id, source, list_transform({sql_words('text')},
          lambda w: (('0x' || substr(md5(w), 1, 4))::BIGINT % 64)) AS ids FROM documents""",
    ),
    "judge_replies": (
        (),
        r"""SELECT doc_id AS id, CASE doc_id % 7
          WHEN 0 THEN 'Score: ' || (doc_id % 14) || '/10' || chr(10) || 'Reasoning: text of ' || lang
          WHEN 1 THEN '  Score: ' || (doc_id % 14) || '.5 out of 10' || chr(10) || 'Reasoning:'
          WHEN 2 THEN 'Score: abc' || chr(10) || 'Reasoning: from ' || source
          WHEN 3 THEN ''
          WHEN 4 THEN 'Score: 3' || chr(10) || 'Score: ' || (doc_id % 14) || chr(10) || 'Reasoning: last one wins '
          WHEN 5 THEN 'Score:' || chr(10) || 'I would say ' || (doc_id % 14)
          ELSE 'The Score: 9' || chr(10) || 'score: 2' || chr(10) || 'Reasoning: no line starts with it' END AS reply
        FROM documents""",
    ),
}


def with_views(names: str, body: str, extra: str = "", recursive: bool = False) -> str:
    """Prefix ``body`` with the named views, what they need first, and further common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _VIEWS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for n in names.split():
        add(n)
    ctes = [f"{n} AS ({_VIEWS[n][1]})" for n in ordered]
    if extra:
        ctes.append(extra)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {body}" if ctes else body
