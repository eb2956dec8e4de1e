"""Reading the driver tables; column pruning and filters reach the parquet
scan because every query selects before it computes."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# tables whose rows carry long texts: per-row work on them is CPU-heavy
TEXT_TABLES = {"documents", "conversations", "pages", "benchmark"}


# a table of at most this many bytes may be dealt out anew before per-row work
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table out over the cores: a file of one row group is one
    task, however much work its rows are.  Only a table of at most
    ``SPREAD_BYTES`` (by the scan's own statistics) is moved; larger ones are read
    as they are split."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


# bytes of a larger table in one task, where each row is much work
FINE_BYTES = 16 << 20


def fine(df: DataFrame) -> DataFrame:
    """``spread`` for queries that work on a row for milliseconds: a larger table is dealt out too, ``FINE_BYTES`` a
    task, as a task of one split of it (``spark.sql.files.maxPartitionBytes``) would run for many minutes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return spread(df) if size <= SPREAD_BYTES else df.repartition(-(-size // FINE_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = True) -> DataFrame:
    """Scan a driver table; ``heavy`` (per-row text work follows) deals a small
    text table out over the cores."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if heavy and name in TEXT_TABLES else df
