"""Session helpers.

``get_spark`` is for tests, the bench and local runs; on a cluster the caller
brings its own session and the engine only reads settings from it.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on; every one is a public Spark option.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "false",
}


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8,
              app: str = "critiq", driver_memory: str = "16g") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared folder and is used as is; unset, it
    is an error there.  Only a local session (tests, the bench) gets a scratch folder.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not sc._jsc.sc().getCheckpointDir().isEmpty():
            return sc._jsc.sc().getCheckpointDir().get()
        d = tempfile.mkdtemp(prefix="critiq-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint of ``df`` into the session's checkpoint
    folder (``spark.checkpoint.dir``; a scratch folder only when unset).
    Cuts the lineage and survives executor loss; never ``localCheckpoint``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table at a ``shared_path``: what ``checkpointed`` does, but compressed (a checkpoint is not) and
    read back by column.  For long texts."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Give back the disk of a ``written`` table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``critiq`` importable in the Python workers: the package is
    zipped once and added with ``SparkContext.addPyFile`` (Spark ships it to
    every executor).  Needed for the steps that run Python (model map, dict
    literal fallback, numpy blocks) when the workers do not already have the
    package on their path."""
    import zipfile

    sc = spark.sparkContext
    ident = sc.applicationId
    if ident in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="critiq-pkg-"), "critiq.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(ident)
