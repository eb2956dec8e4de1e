"""Completions kept across runs (M0, S3): what a model has answered once is not asked again.

A store is a folder that all machines share, with one append-only Parquet table a model:
(prompt hash, seed, completion).  A run reads the hashes, sends only the prompts that have no row (anti-join),
appends the answers and reads the table again.  An append is committed as a whole: a run that fails
in between leaves no partial rows, and the next one asks for that part again.  Two runs at
once may answer a prompt twice; readers then take the least answer, so that they agree."""
from __future__ import annotations

import hashlib
from typing import Callable, Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "_h string, _seed long, _answer string"


class CompletionStore:
    """``model`` names whose answers these are: another model, or other settings of it, take another name."""

    def __init__(self, folder: str, model: str):
        self.path = f"{folder.rstrip('/')}/{hashlib.sha256(model.encode()).hexdigest()}"

    def read(self, spark) -> DataFrame:
        """(_h, _seed, _answer), one row a prompt and seed."""
        spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(self.path)
        rows = spark.read.schema(SCHEMA).parquet(self.path)
        return rows.groupBy("_h", "_seed").agg(F.min("_answer").alias("_answer"))

    def complete(self, distinct: DataFrame, seed: Optional[str], out: str,
                 ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(_h, [seed], out) for the rows (_h, [seed], prompt) of ``distinct``; ``ask`` gets those without an answer."""
        spark = distinct.sparkSession
        number = F.col(seed).cast("long") if seed else F.lit(-1).cast("long")
        wanted = distinct.withColumn("_seed", number)
        new = wanted.join(self.read(spark).select("_h", "_seed"), ["_h", "_seed"], "left_anti")
        answers = ask(new.drop("_seed")).withColumn("_seed", number)
        answers.select("_h", "_seed", F.col(out).alias("_answer")).write.mode("append").parquet(self.path)
        keys = wanted.select("_h", "_seed", *([seed] if seed else []))
        return keys.join(self.read(spark), ["_h", "_seed"]).drop("_seed").withColumnRenamed("_answer", out)
