"""Tag lists per sample: extraction, categories, filters, frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.functions.hashing import hash_key
from tagloom.functions.text import parse_tag_literal, render_tag_literal
from tagloom.operators.taxonomy import Taxonomy


def parse_tag_lists(df: DataFrame, col: str, on_error: str = "drop") -> DataFrame:
    """Parse list literals; a malformed row is dropped or becomes the empty list."""
    parsed = df.withColumn(col, parse_tag_literal(col))
    if on_error == "drop":
        return parsed.where(F.col(col).isNotNull())
    return parsed.withColumn(col, F.coalesce(col, F.array().cast("array<string>")))


def extract_tags(df: DataFrame, tax: Taxonomy, tags_col: str = "tags", suffix: str = "_tags") -> DataFrame:
    """One array column per category with the row's known tags in taxonomy order."""
    added = {c + suffix: F.array_intersect(tax.tags_column(c), F.col(tags_col)) for c in tax.categories}
    return df.withColumns(added)


def categorize_tags(
    df: DataFrame,
    tax: Taxonomy,
    tags_col: str = "tags",
    suffix: str = "_tags",
    on_unknown: str = "drop",
    normalize_case: bool = False,
) -> DataFrame:
    """One array column per category in the row's own order; unknown tags are dropped or kept apart."""
    tags = F.transform(F.col(tags_col), F.lower) if normalize_case else F.col(tags_col)

    def among(names: Sequence[str], wanted: bool = True) -> Column:
        return F.filter(tags, lambda t: t.isin(*names) == wanted)

    added = {c + suffix: among(tax.tags(c)) for c in tax.categories}
    if on_unknown == "collect":
        added["None" + suffix] = among(tax.tags(), wanted=False)
    elif on_unknown != "drop":
        raise ValueError("on_unknown is 'drop' or 'collect'")
    return df.withColumns(added)


def categorize_by_join(df: DataFrame, tags: DataFrame, categories: Sequence[str], id_col: str, tags_col: str) -> DataFrame:
    """The same for a taxonomy too big to be configuration: explode, join, collect again."""
    long = df.select(id_col, F.explode(tags_col).alias("tag")).join(tags.select("tag", "category"), "tag")
    wide = long.groupBy(id_col).pivot("category", list(categories)).agg(F.array_sort(F.collect_set("tag")))
    out = df.select(id_col).join(wide, id_col, "left")
    empty = F.array().cast("array<string>")
    return out.select(id_col, *[F.coalesce(F.col(c), empty).alias(c + "_tags") for c in categories])


def nonempty_count(cols: Sequence[str]) -> Column:
    flags = [F.when(F.size(c) > 0, 1).otherwise(0) for c in cols]
    out = flags[0]
    for f in flags[1:]:
        out = out + f
    return out


def min_categories(df: DataFrame, cols: Sequence[str], k: int = 3) -> DataFrame:
    """Keep rows with tags in at least ``k`` of the category columns."""
    return df.where(nonempty_count(cols) >= k)


def combined_tags(cols: Sequence[str]) -> Column:
    return F.concat(*[F.col(c) for c in cols])


def canonical_tags(col: str) -> Column:
    return F.array_sort(F.array_distinct(F.col(col)))


def tag_frequency(df: DataFrame, tags_col: str = "tags", by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of every tag; counted on the map side first."""
    return df.select(*by, F.explode(tags_col).alias("tag")).groupBy(*by, "tag").agg(F.count("*").alias("n"))


def top_tags(freq: DataFrame, k: int) -> DataFrame:
    return freq.orderBy(F.desc("n"), "tag").limit(k)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rnk") -> DataFrame:
    """First ``k`` rows of every group in a total order, skew-safe.

    Every partition keeps at most ``k`` rows per group before the shuffle. Spark does that by itself up to
    its limit threshold; above it the groups are cut into salted parts first, so that no task sorts a whole
    hot group.
    """
    if k > 1000:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(256)))
        part = W.partitionBy(*by, "_salt").orderBy(*order)
        df = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= k).drop("_rn", "_salt")
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w).cast("bigint")).where(F.col(rank_col) <= k)


def seed_tags(cat_cols: Sequence[str], id_col: str, seed: int, min_tags: int = 2) -> Column:
    """One hashed pick from every category that has at least ``min_tags`` tags."""
    picks = []
    for c in cat_cols:
        n = F.size(c)
        h = F.conv(F.substring(hash_key(seed, F.col(id_col), F.lit(c)), 1, 8), 16, 10).cast("bigint")
        pick = F.get(F.col(c), F.pmod(h, F.greatest(n, F.lit(1)).cast("bigint")).cast("int"))
        picks.append(F.when(n >= min_tags, pick))
    return F.array_compact(F.array(*picks))


def surrogate_key(id_col: str, tags_col: str, temperature_col: str) -> Column:
    """md5 over id, list literal of the original tags and temperature."""
    return F.md5(
        F.concat_ws("_", F.col(id_col).cast("string"), render_tag_literal(tags_col), F.col(temperature_col).cast("string"))
    )


def key_duplicates(df: DataFrame, key: str) -> DataFrame:
    """How often keys repeat: number of keys per multiplicity."""
    return (
        df.groupBy(key).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("n_keys"))
    )


def unknown_tags(df: DataFrame, tax: Taxonomy, tags_col: str = "tags") -> DataFrame:
    """Tags in use that the taxonomy does not have, with their counts."""
    freq = tag_frequency(df, tags_col)
    return freq.join(F.broadcast(tax.frame.select("tag")), "tag", "left_anti")
