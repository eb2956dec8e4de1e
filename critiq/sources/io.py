"""Readers and writers.

The original passes tables between scripts as TSV files with nested values
stringified; here Parquet is the default hand-off (nested types survive), and
TSV is kept for the review files and for compatible outputs.
"""
from __future__ import annotations

import ast
from typing import Iterable, Optional

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_of, safe_name

# What a pandas TSV read treats as missing (Spark's CSV reader knows one)
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

REVIEW_SENTENCES = T.StructType([
    T.StructField("ID", T.StringType()), T.StructField("Review", T.StringType()),
    T.StructField("Section", T.StringType()), T.StructField("Sentence", T.StringType()),
    T.StructField("Desired_Section", T.StringType()), T.StructField("Segment_annotation", T.StringType()),
    T.StructField("Issue Type", T.StringType()), T.StructField("full_reviews", T.StringType()),
])

ISSUE_SEGMENTS = T.StructType([
    T.StructField("ID", T.StringType()), T.StructField("Review Segment", T.StringType()),
    T.StructField("Combined Issue Types", T.StringType()),
])

TEMPLATE_MAP = "map<string,struct<Knowledge:string,Template:string>>"


def normalize_nulls(df: DataFrame, cols: Optional[Iterable[str]] = None) -> DataFrame:
    """Map the pandas missing-value tokens of string columns to NULL."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    for c in cols:
        df = df.withColumn(c, F.when(F.col(c).isin(*NULL_TOKENS), F.lit(None)).otherwise(F.col(c)))
    return df


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated file with a header, quoted multi-line cells and
    doubled quotes; fixed schema (no inference), pandas null tokens."""
    df = (spark.read.schema(schema)
          .option("sep", "\t").option("header", True).option("multiLine", True)
          .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
          .csv(path))
    return normalize_nulls(df)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A stable 0-based position for rows that have no key of their own
    (a TSV read in file order).  Rows are numbered within their partition on the
    JVM, and each partition begins where the counts of those before it end (one
    small row per partition); the numbered rows are checkpointed, so ids stay."""
    from ..session import checkpointed
    mono = checkpointed(df.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = mono.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_s"))
    own = F.col("_m") - F.shiftleft(F.col("_p"), 33)
    return (mono.withColumn("_p", part).join(start, "_p").withColumn(name, F.col("_s") + own)
            .select(*df.columns, name))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """The template JSON object -> (template_key, knowledge, template)."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", TEMPLATE_MAP)
    return raw.select(F.explode(m).alias("template_key", "v")).select(
        "template_key", F.col("v.Knowledge").alias("knowledge"), F.col("v.Template").alias("template"))


def write_questions(questions: DataFrame, path: str, model: str, mode: str = "overwrite") -> None:
    """S3 (save): (model, issue, q_idx, question) as Parquet, one folder per
    model name (S8 keeps the folder name safe)."""
    (questions.withColumn("model", safe_name(F.lit(model)))
     .write.mode(mode).partitionBy("model").parquet(path))


def read_questions(spark: SparkSession, path: str, model: Optional[str] = None) -> DataFrame:
    """S3 (load); partition pruning on the model folder."""
    df = spark.read.parquet(path)
    if model is not None:
        df = df.filter(F.col("model") == safe_name(F.lit(model)))
    return df


def _literal_eval_map(s: pd.Series) -> pd.Series:
    def one(v):
        if v is None:
            return None
        try:
            d = ast.literal_eval(v)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        if not isinstance(d, dict):
            return None
        return {str(k): (None if x is None else str(x)) for k, x in d.items()}
    return s.map(one)


_literal_eval_udf = F.pandas_udf(_literal_eval_map, T.MapType(T.StringType(), T.StringType()))


def review_dict_json(c) -> Column:
    """S4 fast path: the JVM JSON parser with single quotes allowed."""
    return F.from_json(col_of(c), "map<string,string>", {"allowSingleQuotes": "true",
                                                          "allowBackslashEscapingAnyCharacter": "true",
                                                          "mode": "PERMISSIVE"})


def parse_review_dict(df: DataFrame, c: str, out: str = "review_map") -> DataFrame:
    """Python dict literal (section -> text) -> map<string,string>.

    Rows the JSON path reads stay on the JVM; only the rows it returns NULL
    for (a Python ``None`` value, escapes JSON lacks) go to an Arrow batch
    ``ast.literal_eval``.  The split is done on rows, because a Python UDF
    inside a CASE would still be evaluated for every row.  A literal that is
    not a dict stays NULL (``review_parse_reason`` names it)."""
    from ..session import checkpointed
    parsed = checkpointed(df.withColumn(out, review_dict_json(c)))      # both sides below read it
    ok = parsed.filter(F.col(out).isNotNull() | F.col(c).isNull())
    slow = parsed.filter(F.col(out).isNull() & F.col(c).isNotNull()).withColumn(out, _literal_eval_udf(F.col(c)))
    return ok.unionByName(slow)


def review_parse_reason(c) -> Column:
    """Skip reason for rows whose review cannot be parsed."""
    return F.when(col_of(c).isNull(), F.lit("review could not be parsed"))


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """TSV with header; arrays and maps are written as JSON text."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out = out.withColumn(f.name, F.to_json(F.col(f.name)))
    out.write.mode(mode).option("sep", "\t").option("header", True).option("quote", '"') \
        .option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Comma-separated results with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def write_report(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per row one text line for each task (the part of a column's name before
    its first ``_``), ``name: value`` pairs at 4 decimals."""
    tasks: dict = {}
    for c in metrics.columns:
        tasks.setdefault(c.split("_")[0], []).append(F.format_string(f"{c}: %.4f", F.col(c).cast("double")))
    lines = F.array(*[F.concat_ws(", ", *pairs) for pairs in tasks.values()])
    metrics.select(F.explode(lines).alias("value")).coalesce(1).write.mode(mode).text(path)
