"""Evaluation metrics (A4-A11, F24, J7) as aggregations.

Everything is a count or a sum over the rows followed by scalar arithmetic,
so each metric is one partial+final aggregation with no per-row state on the
driver.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import sample_prf


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def single_label_metrics(df: DataFrame, gold: str, pred: str, by=None) -> DataFrame:
    """A4: accuracy, macro precision/recall over the union of gold and
    predicted labels (undefined -> 0) and micro F1 (= accuracy here).

    One row (per ``by`` value): n, accuracy, precision_macro, recall_macro,
    f1_micro."""
    by = list(by or [])
    conf = df.groupBy(*by, F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    per_label = (conf.select(*by, F.explode(F.array(
        F.struct(F.col("g").alias("label"), F.col("c").alias("n_true"), F.lit(0).cast("long").alias("n_pred"),
                 F.when(F.col("g") == F.col("p"), F.col("c")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("n_true"), F.col("c").alias("n_pred"),
                 F.lit(0).cast("long").alias("tp")))).alias("x"))
        .groupBy(*by, "x.label").agg(F.sum("x.n_true").alias("n_true"), F.sum("x.n_pred").alias("n_pred"),
                                     F.sum("x.tp").alias("tp")))
    macro = per_label.groupBy(*by).agg(F.avg(_div(F.col("tp"), F.col("n_pred"))).alias("precision_macro"),
                                       F.avg(_div(F.col("tp"), F.col("n_true"))).alias("recall_macro"),
                                       F.sum("tp").alias("tp"), F.sum("n_true").alias("n"))
    acc = _div(F.col("tp"), F.col("n"))
    return macro.select(*by, F.col("n").cast("bigint").alias("n"), acc.alias("accuracy"), "precision_macro",
                        "recall_macro", acc.alias("f1_micro"))


def single_label_report(df: DataFrame, tasks: dict) -> DataFrame:
    """A4 for several (gold, pred) column pairs in one pass, as one row with
    ``{task}_{metric}`` columns (no join between the tasks' results)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("task"), F.col(g).alias("gold"), F.col(p).alias("pred"))
        for t, (g, p) in tasks.items()])).alias("x")).select("x.*")
    m = single_label_metrics(long, "gold", "pred", by=["task"])
    metrics = ["n", "accuracy", "precision_macro", "recall_macro", "f1_micro"]
    return m.agg(*[F.max(F.when(F.col("task") == t, F.col(c))).alias(f"{t}_{c}") for t in tasks for c in metrics])


def label_matches(df: DataFrame, key: str, true_col: str, pred_col: str) -> DataFrame:
    """The full outer match of a row's gold and predicted label sets: in
    both = TP, predicted only = FP, gold only = FN.  Both sets sit in the row, so
    they are matched there; only the matched labels are exploded."""
    empty = F.array().cast("array<string>")
    t, p = (F.coalesce(F.col(c), empty) for c in (true_col, pred_col))
    has = lambda side, x: F.coalesce(F.array_contains(side, x), F.lit(False))
    cells = F.transform(F.array_union(t, p), lambda x: F.struct(
        x.alias("label"), (has(t, x) & has(p, x)).cast("int").alias("tp"), (~has(t, x)).cast("int").alias("fp"),
        (~has(p, x)).cast("int").alias("fn")))
    return df.select(key, F.inline(cells))


def per_class_relaxed(df: DataFrame, key: str, true_col: str, pred_col: str) -> DataFrame:
    """A5: per-label precision and recall over every label seen on either
    side (undefined -> 0)."""
    m = label_matches(df, key, true_col, pred_col).groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return m.select("label", F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
                    F.col("fn").cast("bigint").alias("fn"),
                    _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    b2 = beta * beta
    return F.when((b2 * p + r) > 0, (1 + b2) * p * r / (b2 * p + r)).otherwise(F.lit(0.0))


def multilabel_summary(df: DataFrame, true_col: str, pred_col: str, beta: float = 0.5) -> DataFrame:
    """A6 + A7 + A8 in one aggregation.

    relaxed_accuracy: share of rows whose sets overlap; sample_*: means of the
    per-row P/R/F1 (F24) and F-beta of those means; micro_*: summed
    tp/fp/fn over all (row, label) cells."""
    t, p = F.array_distinct(F.col(true_col)), F.array_distinct(F.col(pred_col))
    prec, rec, f1 = sample_prf(t, p)
    inter = F.size(F.array_intersect(t, p))
    agg = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(inter > 0, 1.0).otherwise(0.0)).alias("relaxed_accuracy"),
        F.avg(prec).alias("sample_precision"), F.avg(rec).alias("sample_recall"), F.avg(f1).alias("sample_f1"),
        F.sum(inter).alias("tp"), F.sum(F.size(p) - inter).alias("fp"), F.sum(F.size(t) - inter).alias("fn"))
    b2 = beta * beta
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select(
        F.col("n").cast("bigint").alias("n"), "relaxed_accuracy", "sample_precision", "sample_recall", "sample_f1",
        f_beta(F.col("sample_precision"), F.col("sample_recall"), beta).alias("sample_f05"),
        _div(tp, tp + fp).alias("micro_precision"), _div(tp, tp + fn).alias("micro_recall"),
        _div((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp).alias("micro_f05"))


def micro_fbeta_cells(cells: DataFrame, beta: float = 0.5, by=None) -> DataFrame:
    """A8 over a long (…, y_true, y_pred) 0/1 cell table, optionally per group
    (``by``): micro precision, recall and F-beta."""
    b2 = beta * beta
    g = cells.groupBy(*(by or [])).agg(
        F.sum((F.col("y_true") * F.col("y_pred"))).alias("tp"),
        F.sum(((1 - F.col("y_true")) * F.col("y_pred"))).alias("fp"),
        F.sum((F.col("y_true") * (1 - F.col("y_pred")))).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(*(by or []), _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"),
                    _div((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp).alias("f05"))
