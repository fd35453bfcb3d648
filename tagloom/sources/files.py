"""File listings and binary content joined to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def label_from_path(path) -> Column:
    """Name of the directory a file lies in; a partition directory gives its value."""
    folder = F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/]+)/[^/]+$", 1)
    return F.regexp_replace(folder, "^[^=]*=", "")


def file_name(path) -> Column:
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/]+)$", 1)


def list_files(spark: SparkSession, root: str, pattern: str = "*.{wav,mp3,flac}") -> DataFrame:
    """``(path, file_name, label, length)`` of the matching files below ``root``; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    )
    return files.select("path", file_name("path").alias("file_name"), label_from_path("path").alias("label"), "length")


def rows_with_file(df: DataFrame, files: DataFrame, name_col: str) -> DataFrame:
    return df.join(files.select(F.col("file_name").alias(name_col)), name_col, "left_semi")


def missing_file_count(df: DataFrame, files: DataFrame, name_col: str) -> DataFrame:
    lost = df.join(files.select(F.col("file_name").alias(name_col)), name_col, "left_anti")
    return lost.agg(F.count("*").alias("n_missing"))


def attach_binary(df: DataFrame, root: str, path_col: str = "path", pattern: str = "*") -> DataFrame:
    """Add ``content`` by path; the bytes are only read when a later step selects them."""
    files = (
        df.sparkSession.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    )
    return df.join(files.select(F.col("path").alias(path_col), "content"), path_col, "left")
