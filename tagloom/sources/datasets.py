"""Reading and writing named datasets with configurations and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of a published record.
PUBLISHED = ("id", "caption", "aspect_list", "genre_aspects", "mood_aspects", "instrument_aspects", "tempo_aspects")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, fill: str | None = "", multi_line: bool = True) -> DataFrame:
    """CSV with quoted commas, quotes and line breaks; missing text becomes ``fill``.

    A file with line breaks inside of quotes can only be read by one task. Files without any are cut into splits
    with ``multi_line=False``.
    """
    df = (
        spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').csv(path)
    )
    return df if fill is None else df.na.fill(fill)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.option("header", True).option("quote", '"').option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def read_splits(spark: SparkSession, paths: Mapping[str, str], schema, fill: str | None = "") -> DataFrame:
    """One file or folder per split, stacked with a ``split`` column."""
    parts = [read_csv(spark, p, schema, fill).withColumn("split", F.lit(name)) for name, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One folder per split, in files of about even size; reading ``path`` itself gives all of them."""
    write_csv(df.hint("rebalance", split_col), path, [split_col])


def read_dataset(spark: SparkSession, root: str, config: str | None = None, split: str = "all") -> DataFrame:
    """A named dataset; configuration and split select folders, ``all`` reads every split."""
    df = spark.read.parquet(root)
    if config is not None:
        df = df.where(F.col("config") == config)
    return df if split == "all" else df.where(F.col("split") == split)


def publish(df: DataFrame, root: str, configs_col: str = "configs", max_records_per_file: int = 1_000_000) -> None:
    """Write each row into every configuration it belongs to.

    Rows are rebalanced by folder: large folders are written by many tasks, small ones by one, so the number of
    files follows the data and not the number of tasks.
    """
    rows = df.withColumn("config", F.explode(configs_col)).drop(configs_col).hint("rebalance", "config", "split")
    rows.write.option("maxRecordsPerFile", max_records_per_file).partitionBy("config", "split").parquet(root)


def published_schema(df: DataFrame, with_file: bool = False) -> DataFrame:
    return df.select(*PUBLISHED, *(["file_name"] if with_file else []))
