"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SPREAD_SPLITS = 64


def build_session(app: str = "tagloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",  # rows here are costly, not large
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local master may fall back
    to a temporary folder, because there driver and executors share one disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def is_small_scan(df: DataFrame) -> bool:
    """Whether a scan has fewer splits than the cluster has cores, and few at all: a table of many splits is never
    shuffled for the sake of idle cores."""
    return df.rdd.getNumPartitions() < min(df.sparkSession.sparkContext.defaultParallelism, SPREAD_SPLITS)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a small scan out to all cores, by key if one is given.

    Few splits would leave most cores idle during row-heavy work. A large table has more splits than there
    are cores and must not be shuffled for this: ask :func:`is_small_scan` first.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
