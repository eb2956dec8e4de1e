"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.session import ensure_checkpoint_dir, ship_package

#: The six characters that part words: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Rows in an Arrow batch: texts may be long, so batches are short.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and keep Arrow batches of texts small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``)."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = ensure_checkpoint_dir(spark) if now.isEmpty() else now.get()
    return d.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the
    lineage is cut, every executor can read it, and a lost executor loses
    nothing."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the ``[^\\x20\\x09-\\x0D]+`` words of a text (null: none)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.array_remove(F.split(spaced, " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def text_hash(text: Column) -> Column:
    """With the doc_id, the identity of a row: rows that repeat both id and
    text are the same document and get the same decision."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same_row(a: DataFrame, b: DataFrame, a_hash: str = "__hash", b_hash: str = "__th") -> Column:
    """Null-safe join condition on (doc_id, text hash); ``b`` has its id as ``__id``."""
    return a["doc_id"].eqNullSafe(b["__id"]) & (a[a_hash] == b[b_hash])
