"""Registered queries of this subpackage and their DuckDB SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.llm import (decontam, docprint, langid, linededup, linequality, mixing, phrases, pii, replytree, simhash,
                        sketchsearch, toxicity, warc)
from critiq.llm.common import load, prepare


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    return run


def op1_decontamination(spark, sf_dir):
    return decontam.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_pii(spark, sf_dir):
    return pii.digest(load(spark, sf_dir, "documents"))


def op3_reply_trees(spark, sf_dir):
    return replytree.digest(spark, load(spark, sf_dir, "conversations"))


def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op5_line_frequency(spark, sf_dir):
    return linequality.quality(load(spark, sf_dir, "documents"))


def op6_systematic_mix(spark, sf_dir):
    return mixing.digest(load(spark, sf_dir, "documents"))


def op7_language(spark, sf_dir):
    return langid.digest(load(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.digest(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_warc(spark, sf_dir):
    return warc.digest(load(spark, sf_dir, "pages"))


def op10_line_windows(spark, sf_dir):
    return linededup.digest(load(spark, sf_dir, "documents"))


def op11_document_fingerprints(spark, sf_dir):
    return docprint.digest(load(spark, sf_dir, "documents"))


def op12_lexical_search(spark, sf_dir):
    index = sketchsearch.Index(load(spark, sf_dir, "documents"))
    return sketchsearch.search(index, load(spark, sf_dir, "benchmark"))


def op13_collocations(spark, sf_dir):
    return phrases.collocations(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: _query(f) for f in (
    op1_decontamination, op2_pii, op3_reply_trees, op4_simhash, op5_line_frequency, op6_systematic_mix,
    op7_language, op8_toxicity, op9_warc, op10_line_windows, op11_document_fingerprints, op12_lexical_search, op13_collocations)}

ORACLE = {
    "op3_reply_trees": replytree.ORACLE,
    "op5_line_frequency": linequality.ORACLE,
    "op6_systematic_mix": mixing.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_line_windows": linededup.ORACLE,
    "op12_lexical_search": sketchsearch.ORACLE,
    "op13_collocations": phrases.ORACLE,
}
