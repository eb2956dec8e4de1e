"""Scaling, binary relevance and classifiers (G3-G6, C2-C14) on MLlib.

Multi-label classification is binary relevance: one binary MLlib model per
label on the same cached training frame (``pyspark.ml.OneVsRest`` is
multi-class and does not fit).  Labels are a bounded vocabulary, so the loop
over them runs on the driver (a thread pool submits the fits concurrently);
every fit itself is a distributed MLlib job.
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from typing import Callable, Dict, Sequence

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, MultilayerPerceptronClassifier,
                                       NaiveBayes, RandomForestClassifier)
from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..session import checkpointed
from .metrics import micro_fbeta_cells


def feature_stats(fit: DataFrame, col: str) -> Column:
    """Per-position mean and population std (scikit-learn divides by n) as
    one array value (scalar subquery over a table bounded by the width)."""
    # one vector per row into the aggregation buffer, not a row per position
    v = array_to_vector(F.col(col).cast("array<double>"))
    both = fit.select(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s"))
    m, var, n = vector_to_array("s.mean"), vector_to_array("s.variance"), F.col("s.count").cast("double")
    return both.select(F.transform(F.arrays_zip(m.alias("m"), var.alias("v")), lambda x: F.struct(
        x["m"].alias("m"), F.sqrt(x["v"] * (n - 1) / n).alias("s")))).scalar()


def standardize(df: DataFrame, col: str, fit: DataFrame = None, out: str = "scaled") -> DataFrame:
    """(x - mean) / std per position, statistics from ``fit`` (the
    training part); a constant position scales to 0."""
    stats = feature_stats(fit if fit is not None else df, col)
    d = df.withColumn("_st", stats)
    z = F.transform(col, lambda x, i: F.when(F.col("_st")[i]["s"] > 0,
                                             (x.cast("double") - F.col("_st")[i]["m"]) / F.col("_st")[i]["s"])
                    .otherwise(F.lit(0.0)))
    return d.withColumn(out, z).drop("_st")


def _n_rows_reg(n: int) -> float:
    return 1.0 / max(n, 1)


def _svm(n: int, col: str = "features") -> LinearSVC:
    return LinearSVC(featuresCol=col, maxIter=100, regParam=_n_rows_reg(n))


# C1-C14, in the order of ``fixed.CLASSIFIER_NAMES``: MLlib stand-ins for the compared
# classifiers (see README for the ones that are approximations).  Each factory takes the
# training row count and the feature width.
CLASSIFIERS: Dict[str, Callable[[int, int], object]] = dict(zip(fixed.CLASSIFIER_NAMES, [
    lambda n, d: KNNClassifier(),
    lambda n, d: LogisticRegression(regParam=_n_rows_reg(n), elasticNetParam=0.0, maxIter=2000, standardization=False),
    lambda n, d: LogisticRegression(regParam=_n_rows_reg(n), elasticNetParam=1.0, maxIter=2000, standardization=False),
    lambda n, d: RandomForestClassifier(numTrees=100, featureSubsetStrategy="sqrt", maxDepth=30, seed=fixed.SEED),
    lambda n, d: DecisionTreeClassifier(maxDepth=30, seed=fixed.SEED),
    lambda n, d: MarginModel(lambda c: _svm(n, c), RandomFourier(d)),
    lambda n, d: MarginModel(lambda c: _svm(n, c)),
    lambda n, d: MarginModel(lambda c: _svm(n, c), TensorSketch(d)),
    lambda n, d: GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, seed=fixed.SEED),
    lambda n, d: AdaBoostStumps(rounds=100, learning_rate=1.0),
    lambda n, d: RandomForestClassifier(numTrees=100, bootstrap=False, featureSubsetStrategy="sqrt", maxDepth=30,
                                        seed=fixed.SEED),
    lambda n, d: MultilayerPerceptronClassifier(layers=[d, 100, 2], maxIter=500, seed=fixed.SEED),
    lambda n, d: NaiveBayes(modelType="gaussian"),
    lambda n, d: LogisticRegression(regParam=1e-4, maxIter=1000, tol=1e-3),
]))


class RandomFourier:
    """Random Fourier features of an RBF kernel (Rahimi and Recht, 2007), gamma =
    1 / width (the 'scale' default on standardised inputs)."""

    def __init__(self, width: int, components: int = 256, seed: int = fixed.SEED):
        rng = np.random.RandomState(seed)
        self.w = rng.normal(0.0, np.sqrt(2.0 / max(width, 1)), size=(width, components))
        self.b = rng.uniform(0, 2 * np.pi, size=components)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / self.w.shape[1]) * np.cos(x @ self.w + self.b)


class TensorSketch:
    """Sketch of the polynomial kernel (gamma * x.y)^degree (Pham and Pagh, 2013), gamma =
    1 / width: the product of count sketches in the frequency domain.  Every feature
    direction takes part; ``components`` sets the sketch's width."""

    def __init__(self, width: int, components: int = 256, degree: int = 3, seed: int = fixed.SEED):
        rng = np.random.RandomState(seed)
        self.components, self.scale = components, np.sqrt(1.0 / max(width, 1))
        self.place = rng.randint(0, components, size=(degree, width))
        self.sign = rng.choice([-1.0, 1.0], size=(degree, width))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = 1.0
        for place, sign in zip(self.place, self.sign):
            sketch = np.zeros((len(x), self.components))
            np.add.at(sketch.T, place, (x * sign * self.scale).T)
            out = out * np.fft.rfft(sketch, axis=1)
        return np.fft.irfft(out, n=self.components, axis=1)


class MarginModel:
    """A linear model with a margin over the features or a seeded map of
    them (applied in Arrow batches with numpy), and the probability as a logistic fit
    of the label on the training margin (Platt, 1999)."""

    def __init__(self, make, features=None):
        self.make, self.features = make, features

    def _mapped(self, df: DataFrame) -> DataFrame:
        if self.features is None:
            return df.withColumn("_map", F.col("features"))
        mapped = self.features

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(mapped(np.vstack(x.map(np.asarray).values)))) if len(x) else pd.Series([], dtype=object)

        return df.withColumn("_map", array_to_vector(run(vector_to_array("features"))))

    def _margins(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._mapped(df)).drop("_map")
        return out.withColumn("_m", array_to_vector(F.array(vector_to_array("rawPrediction")[1])))

    def fit(self, df: DataFrame):
        self.model = self.make("_map").fit(self._mapped(df))
        self.link = LogisticRegression(featuresCol="_m", rawPredictionCol="_lr", predictionCol="_lp").fit(
            self._margins(df).select("_m", "label"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.link.transform(self._margins(df)).drop("_m", "_lr", "_lp")


class KNNClassifier:
    """C1 as a binary model: the share of positive labels among the k nearest
    training rows (exact, see ``neighbors``); a label is predicted above one half."""

    def __init__(self, k: int = 5):
        self.k = k

    def fit(self, df: DataFrame):
        self.train = checkpointed(df.select(vector_to_array("features").alias("_v"), "label")
                                  .withColumn("_tid", F.monotonically_increasing_id()))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        from .neighbors import knn
        rows = checkpointed(df.withColumn("_qid", F.monotonically_increasing_id()))
        near = knn(self.train.withColumnRenamed("_v", "v"), rows.select("_qid", vector_to_array("features").alias("v")),
                   "_tid", "_qid", "v", self.k)
        share = (near.join(self.train.select("_tid", F.col("label").alias("_y")), "_tid").groupBy("_qid")
                 .agg(F.avg("_y").alias("_p")))
        out = rows.join(share, "_qid", "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
        two = lambda a, b: array_to_vector(F.array(a, b))
        return (out.withColumn("prediction", (F.col("_p") > 0.5).cast("double"))
                .withColumn("rawPrediction", two(1 - F.col("_p"), F.col("_p")))
                .withColumn("probability", two(1 - F.col("_p"), F.col("_p"))).drop("_qid", "_p"))


class AdaBoostStumps:
    """Binary SAMME boosting over depth-1 trees with a weight column.

    Each round fits a stump on the current weights, computes the weighted
    error with one aggregation and updates the weights as a column; the
    weighted frame is checkpointed every ``checkpoint_every`` rounds so the
    lineage stays short."""

    def __init__(self, rounds: int = 100, learning_rate: float = 1.0, checkpoint_every: int = 10):
        self.rounds, self.lr, self.every = rounds, learning_rate, checkpoint_every

    def fit(self, df: DataFrame):
        n = df.count()
        cur = df.select("features", "label").withColumn("w", F.lit(1.0 / max(n, 1)))
        self.stumps = []
        for m in range(self.rounds):
            stump = DecisionTreeClassifier(maxDepth=1, weightCol="w", seed=fixed.SEED).fit(cur)
            pred = stump.transform(cur).withColumn("_miss", (F.col("prediction") != F.col("label")).cast("double"))
            err = pred.select((F.sum(F.col("w") * F.col("_miss")) / F.sum("w")).alias("e")).first()["e"] or 0.0
            if err >= 0.5:
                break
            alpha = self.lr * float(np.log((1 - err) / max(err, 1e-12)))
            self.stumps.append((stump, alpha))
            if err <= 0:
                break
            cur = pred.select("features", "label", (F.col("w") * F.exp(F.lit(alpha) * F.col("_miss"))).alias("w"))
            if self.every and (m + 1) % self.every == 0:
                cur = checkpointed(cur)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_s", F.lit(0.0))
        for i, (stump, alpha) in enumerate(self.stumps):
            p = stump.setPredictionCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setProbabilityCol(f"_q{i}")
            out = p.transform(out).withColumn("_s", F.col("_s") + F.lit(alpha) * (2 * F.col(f"_p{i}") - 1)) \
                .drop(f"_p{i}", f"_r{i}", f"_q{i}")
        prob = 1 / (1 + F.exp(-2 * F.col("_s")))
        return (out.withColumn("prediction", (F.col("_s") > 0).cast("double"))
                .withColumn("rawPrediction", array_to_vector(F.array(-F.col("_s"), F.col("_s"))))
                .withColumn("probability", array_to_vector(F.array(1 - prob, prob))).drop("_s"))


def binary_relevance(train: DataFrame, test: DataFrame, key: str, features: str, labels: str,
                     vocab: Sequence[str], make: Callable[[int, int], object], threads: int = 4) -> DataFrame:
    """G4 + G6: fit one binary model per label of ``vocab`` on ``train`` and
    predict ``test``.  Returns long cells (key, label, y_true, y_pred, score);
    a label constant in training predicts that constant."""
    # both sides are materialized once (checkpoint: on the shared folder, so
    # nothing is pinned in executor memory and a lost executor costs nothing)
    # before the concurrent fits share them
    tr = checkpointed(train.select(key, array_to_vector(F.col(features).cast("array<double>")).alias("features"), labels))
    te = checkpointed(test.select(key, array_to_vector(F.col(features).cast("array<double>")).alias("features"), labels))
    # all labels are counted in one pass
    counts = tr.agg(F.count(F.lit(1)), *[F.count_if(F.array_contains(labels, v)) for v in vocab]).first()
    n, held = counts[0], dict(zip(vocab, counts[1:]))
    width = tr.select(F.size(vector_to_array("features")).alias("d")).first()["d"] if n else 0

    def one(label):
        y = F.array_contains(labels, label).cast("double")
        trl = tr.withColumn("label", y)
        pos = held[label]
        t = te.withColumn("label", y)
        if pos in (0, n):
            const = 1.0 if pos == n else 0.0
            return t.select(key, F.lit(label).alias("label_name"), F.col("label").alias("y_true"),
                            F.lit(const).alias("y_pred"), F.lit(const).alias("score"))
        model = make(n, width).fit(trl)
        p = model.transform(t)
        # decision score: probability where the model has one, else the raw margin
        score_col = "probability" if "probability" in p.columns else "rawPrediction"
        return p.select(key, F.lit(label).alias("label_name"), F.col("label").alias("y_true"),
                        F.col("prediction").alias("y_pred"), vector_to_array(score_col)[1].alias("score"))

    with ThreadPoolExecutor(max_workers=threads) as ex:
        parts = list(ex.map(one, list(vocab)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def holdout_scores(cells: DataFrame, beta: float = 0.5) -> DataFrame:
    """A8 on predicted cells: micro precision, recall, F-beta."""
    return micro_fbeta_cells(cells, beta)


def cross_validate(df: DataFrame, key: str, features: str, labels: str, fold_col: str,
                   vocab: Sequence[str], models: Dict[str, Callable[[int, int], object]], n_folds: int,
                   threads: int = 5) -> DataFrame:
    """G5 + A9: for each model and fold, train on the other folds, score the
    fold (micro F0.5, precision, recall); then the mean per model.  Features
    are standardised per fold with statistics of the training folds only
    (G3 inside the pipeline, as in the original)."""
    def one(task):
        name, f = task
        fit = df.filter(F.col(fold_col) != f)
        tr = standardize(fit, features, out="_x")
        te = standardize(df.filter(F.col(fold_col) == f), features, fit=fit, out="_x")
        cells = binary_relevance(tr, te, key, "_x", labels, vocab, models[name])
        return micro_fbeta_cells(cells).select(F.lit(name).alias("model"), F.lit(f).alias("fold"), "*")

    # folds (and models) are independent: their fits are submitted concurrently
    with ThreadPoolExecutor(max_workers=threads) as ex:
        rows = list(ex.map(one, [(name, f) for name in models for f in range(n_folds)]))
    res = rows[0]
    for r in rows[1:]:
        res = res.unionByName(r)
    return res.groupBy("model").agg(F.avg("f05").alias("mean_f05"), F.avg("precision").alias("mean_precision"),
                                    F.avg("recall").alias("mean_recall"))


def _with_params(est, param_map: dict):
    """Set grid values by parameter name (a grid built on another instance
    carries that instance's Param objects, which ``copy`` would ignore)."""
    for p, v in param_map.items():
        est.set(est.getParam(p.name), v)
    return est


def grid_search(df: DataFrame, key: str, features: str, labels: str, fold_col: str, vocab: Sequence[str],
                name: str, make: Callable[[int, int], object], param_maps: Sequence[dict], n_folds: int,
                threads: int = 5) -> DataFrame:
    """Score every parameter map (e.g. from ``ParamGridBuilder().build()``)
    with the same folds (G5) and report the means per combination, best
    first.  The original keeps its grids disabled; this is the same loop."""
    models = {}
    for pm in param_maps:
        label = name + " " + ", ".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda x: x[0].name))
        models[label] = (lambda pm: (lambda n, d: _with_params(make(n, d), pm)))(pm)
    res = cross_validate(df, key, features, labels, fold_col, vocab, models, n_folds, threads)
    return res.orderBy(F.desc("mean_f05"), "model")
