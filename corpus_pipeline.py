"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark
decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage
before kept; ``run`` writes each stage's result to the shared folder as Parquet and
reads it back as the next one's input."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from critiq.llm import decontam, langid, linededup, mixing, simhash
from critiq.llm.common import load, prepare, shared_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language go."""
    prepare(spark)
    return langid.identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages; documents of which nothing is left go."""
    prepare(spark)
    out = linededup.dedup_lines(docs, short=True)
    return out.filter(~linededup.emptied(out["text"], out["n_removed"])).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    prepare(spark)
    return simhash.keep_one(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    return decontam.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (column ``copy``)."""
    prepare(spark)
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Trained language identification cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_table(docs, f"stage{k}")
    return docs
