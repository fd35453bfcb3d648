"""The stages that turn raw documents into a training mix: ``run(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.base import bounded, id_key, stored, table
from tagloom.llm.decontaminate import decontaminate
from tagloom.llm.language_id import UNKNOWN, identify_language
from tagloom.llm.mixing import mixed_sources
from tagloom.llm.near_dedup import first_of_each_class
from tagloom.llm.secrets import MOST_TEXTS, scan_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents with secrets up to this number are looked up by broadcast, more by shuffle.
BROADCAST_SECRETS = 200_000
SECRET = "[SECRET]"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that can have no language: null texts and texts without a letter.

    That is the whole rule for rejecting: it holds with labels or without, and which language is predicted rejects no
    document. A document without a label takes the predicted language, if one was learned.
    """
    labelled = docs.filter("lang is not null and text is not null").select("text", "lang")
    found = identify_language(docs.select(*COLUMNS), labelled).filter("has_letter")
    learned = F.when(F.col("lang_pred") != UNKNOWN, F.col("lang_pred"))
    return found.withColumn("lang", F.coalesce("lang", learned)).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each class of near-duplicates, the document with the smallest id."""
    return first_of_each_class(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a word window of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(*COLUMNS)


def redacted(text: str, spans: str) -> Column:
    """The text with each of the spans, in order, replaced; overlapping ones once."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(
        F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.col(text).substr(a["at"] + 1, s["start"] - a["at"]), F.lit(SECRET))).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.col(text).substr(a["at"] + 1, F.length(text))))


def without_live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets that few unequal texts or a single source have; widely copied examples stay, and so do all documents."""
    docs = docs.select(*COLUMNS)  # an input may have columns of any other names
    live = scan_secrets(docs, most_texts=MOST_TEXTS).select(id_key("doc_id").alias("k"), "text_key", F.filter("spans", lambda s: s["live"]).alias("live"))
    live = bounded(live.filter(F.size("live") > 0).dropDuplicates(["k", "text_key"]), BROADCAST_SECRETS, "live")
    rows = docs.withColumn("k", id_key("doc_id")).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))).join(live, ["k", "text_key"], "left")
    text = F.when(F.col("live").isNull(), F.col("text")).otherwise(redacted("text", "live"))
    rows = rows.withColumn("text", text)
    return rows.withColumn("n_chars", F.when(F.col("live").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mixed_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix takes it, with the number of the copy."""
    out = mixed_sources(docs).filter("copies > 0")
    return out.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("known_language", known_language),
    ("one_of_each", one_of_each),
    ("without_benchmark", without_benchmark),
    ("without_live_secrets", without_live_secrets),
    ("mixed_by_source", mixed_by_source),
]

#: No SQL: learned language identification and sampled signatures can't be expressed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
