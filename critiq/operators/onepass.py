"""All labels and all folds of a cross-validation in one pass.

A pass reads the rows once and returns one bounded array of sums over them, for every (fold, label) at
once: the tasks' partial sums are added up by Spark in two levels.  A fold's training rows are all
rows but its own, so its statistics are the totals less the fold's, and no row is copied for a fold or
a label.  The rows are packed into blocks of matrices, dealt evenly over the cores, so that a pass does no work row by
row in Python.  Features are standardised per fold (G3) inside the algebra: a model that is linear, or sums of squares,
in (x - m) / s follows from sums over x.

* Gaussian naive Bayes: one pass of counts, sums and squares per (fold, label).
* Logistic regression (L2): Newton-like steps with the fold's Gram matrix, which bounds the curvature
  of every label's loss (Boehning, 1992), as the starting metric of L-BFGS; one pass a step, whatever the labels.
* AdaBoost over stumps: a contingency cube of weights by (feature, value, class) per (fold, label);
  every stump of a round follows from it; one pass a round.  The stumps so far are a table by (feature, threshold),
  so that a round costs the same however many rounds went before it.

The number of Spark jobs depends on steps and rounds, never on labels or folds.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Dict, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .metrics import _div

#: Rows whose mean is taken off all features first, so that squares do not cancel.
SHIFT_ROWS = 1000
#: Bytes of features in one block of rows.
BLOCK_BYTES = 4 << 20
LEVELS = 32
VARIANCE_SHARE = 1e-9


@dataclass
class Data:
    """Blocks of rows (n long, and as bytes x double (n, width), y 0/1 (n, labels), part int (n)), written once, and
    their shape."""

    blocks: DataFrame
    vocab: list
    parts: int
    width: int
    shift: np.ndarray

    def summed(self, fn: Callable, size: int) -> np.ndarray:
        """Sum over all batches of ``fn(x, y, part)``, an array of ``size``: x (n, width) less the shift, y (n, labels) 0/1."""
        n_labels, shift, width = len(self.vocab), self.shift, self.width
        if not width:                                              # no rows
            return np.zeros(size)

        def run(frames):
            total = np.zeros(size)
            for x, y, part in _unpacked(frames, n_labels, width, shift):
                total += np.asarray(fn(x, y, part)).ravel()
            yield pd.DataFrame({"k": [TaskContext.get().partitionId() % LEVELS], "v": [total]})

        sums = self.blocks.mapInPandas(run, "k int, v array<double>").withColumn("v", array_to_vector("v"))
        sums = sums.groupBy("k").agg(Summarizer.sum(F.col("v")).alias("v")).agg(Summarizer.sum(F.col("v")).alias("v"))
        got = sums.select(vector_to_array("v").alias("v")).first()["v"]
        return np.array(got if got else np.zeros(size))

    def predicted(self, models: Dict[str, Callable]) -> DataFrame:
        """(model, part, tp, fp, fn): each row is predicted by its own part's model; ``models``: name ->
        fn(x, part) of the labels' 0/1."""
        n_labels, shift, width = len(self.vocab), self.shift, self.width

        def run(frames):
            out = []
            for x, y, part in _unpacked(frames, n_labels, width, shift):
                for name, fn in models.items():
                    for p in np.unique(part):
                        own = part == p
                        hit, t = fn(x[own], int(p)), y[own]
                        out.append((name, int(p), float((t * hit).sum()), float(((1 - t) * hit).sum()), float((t * (1 - hit)).sum())))
            yield pd.DataFrame(out, columns=["model", "part", "tp", "fp", "fn"])

        return self.blocks.mapInPandas(run, "model string, part int, tp double, fp double, fn double").groupBy("model", "part").agg(
            *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def _packed(frames, n_labels: int):
    """Frames of rows (x, y label numbers, part) as blocks of ``BLOCK_BYTES`` of features."""
    for df in frames:
        if not len(df):
            continue
        step = max(1, BLOCK_BYTES // (8 * max(len(df["x"].iloc[0]), 1)))
        for at in range(0, len(df), step):
            some = df.iloc[at:at + step]
            y = np.zeros((len(some), n_labels), dtype=np.int8)
            for k, own in enumerate(some["y"].to_numpy()):
                y[k, own] = 1
            yield pd.DataFrame({"n": [len(some)], "x": [np.stack(some["x"].to_numpy()).astype(float).tobytes()],
                                "y": [y.tobytes()], "part": [some["part"].to_numpy(dtype=np.int32).tobytes()]})


def _unpacked(frames, n_labels: int, width: int, shift: np.ndarray):
    """(x less the shift, y 0/1, part) of every block."""
    for df in frames:
        for n, x, y, part in zip(df["n"], df["x"], df["y"], df["part"]):
            yield (np.frombuffer(x).reshape(n, width) - shift, np.frombuffer(y, dtype=np.int8).reshape(n, n_labels).astype(float),
                   np.frombuffer(part, dtype=np.int32))


def data(df: DataFrame, features: str, labels: str, part: str, vocab: Sequence[str], parts: int) -> Data:
    """Rows whose ``part`` is 0 .. parts - 1; labels outside ``vocab`` are left out."""
    index = F.create_map(*[F.lit(v) for k, name in enumerate(vocab) for v in (name, k)]) if vocab else None
    own = F.transform(F.array_intersect(F.col(labels), F.array(*[F.lit(v) for v in vocab])), lambda x: index[x]) if vocab else \
        F.array().cast("array<int>")
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.coalesce(own, F.array().cast("array<int>")).alias("y"),
                     F.col(part).cast("int").alias("part")).filter(F.col("x").isNotNull())
    n_labels = len(vocab)
    # dealt evenly: a shuffle is coalesced by its compressed bytes, and vote vectors are few bytes for much work
    blocks = checkpointed(rows.repartition(df.sparkSession.sparkContext.defaultParallelism).mapInPandas(
        lambda frames: _packed(frames, n_labels), "n long, x binary, y binary, part binary"))
    first = [np.frombuffer(bytes(r["x"])).reshape(r["n"], -1) for r in blocks.select("n", "x").limit(2).collect()]
    first = np.concatenate(first)[:SHIFT_ROWS] if first else np.zeros((0, 0))
    return Data(blocks, list(vocab), parts, first.shape[1], first.mean(0) if len(first) else np.zeros(0))


@dataclass
class Statistics:
    """Sums over each part's training rows (all rows but the part's own): n (parts), s and q (parts, width), gram
    (parts, width, width), and of the rows with a label n_l (parts, labels), s_l and q_l (parts, labels, width)."""

    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    gram: np.ndarray
    n_l: np.ndarray
    s_l: np.ndarray
    q_l: np.ndarray

    def scale(self):
        """(mean, std) of the training rows; std 1 and weight 0 for constant features."""
        n = np.maximum(self.n, 1)[:, None]
        mean = self.s / n
        var = np.maximum(self.q / n - mean ** 2, 0)
        var[var < 1e-14 * np.maximum(self.q / n, 1e-300)] = 0
        return mean, np.sqrt(var)


def statistics(d: Data, gram: bool = True) -> Statistics:
    """One pass."""
    p, w, m = d.parts, d.width, len(d.vocab)
    shapes = [(p,), (p, w), (p, w), (p, w, w) if gram else (0,), (p, m), (p, m, w), (p, m, w)]
    sizes = [int(np.prod(s)) for s in shapes]

    def fn(x, y, part):
        out = [np.zeros(s) for s in shapes]
        for f in range(p):
            own = part == f
            if own.any():
                a, b = x[own], y[own]
                for k, value in enumerate((own.sum(), a.sum(0), (a * a).sum(0), a.T @ a if gram else None,
                                           b.sum(0), b.T @ a, b.T @ (a * a))):
                    if value is not None:
                        out[k][f] = value
        return np.concatenate([o.ravel() for o in out])

    flat, at, got = d.summed(fn, sum(sizes)), 0, []
    for shape, size in zip(shapes, sizes):
        part = flat[at:at + size].reshape(shape)
        got.append(part.sum(0, keepdims=True) - part if size else part)
        at += size
    return Statistics(*got)


def naive_bayes(d: Data, st: Statistics) -> Callable:
    """Class means and population variances of the standardised features, plus ``VARIANCE_SHARE`` of the largest
    variance; a class that does not occur is not predicted."""
    mean, std = st.scale()
    safe = np.where(std > 0, std, 1.0)
    eps = VARIANCE_SHARE * np.where(std > 0, 1.0, 0.0).max(axis=1, initial=0)
    n1, n_labels = st.n_l, len(d.vocab)
    classes = []
    for n, s, q in ((st.n[:, None] - n1, st.s[:, None] - st.s_l, st.q[:, None] - st.q_l), (n1, st.s_l, st.q_l)):
        c = np.maximum(n, 1)[:, :, None]
        mu = s / c
        var = np.maximum(q / c - mu ** 2, 0)
        var[var < 1e-12 * np.maximum(q / c, 1e-300)] = 0
        mu = np.where(std[:, None] > 0, (mu - mean[:, None]) / safe[:, None], 0.0)
        var = np.where(std[:, None] > 0, var / safe[:, None] ** 2, 0.0) + eps[:, None, None]
        classes.append((n, mu, var, np.log(2 * np.pi * np.maximum(var, 1e-300)).sum(2)))

    def predict(x, f):
        z = np.where(std[f] > 0, (x - mean[f]) / safe[f], 0.0)
        score = []
        with np.errstate(divide="ignore", invalid="ignore"):
            for n, mu, var, logs in classes:
                far = np.stack([((z - mu[f, k]) ** 2 / var[f, k]).sum(1) for k in range(n_labels)], axis=1)
                score.append(np.where(n[f] > 0, np.log(n[f]) - 0.5 * (logs[f] + far), -np.inf))
        return (score[1] > score[0]).astype(float)
    return predict


def _metric(st: Statistics, mean, std, penalty: np.ndarray) -> np.ndarray:
    """Inverse of the bound on the curvature in (weights of standardised features, bias), per part."""
    out = []
    for f in range(len(st.n)):
        n, m, s = max(st.n[f], 1.0), mean[f], np.where(std[f] > 0, std[f], 1.0)
        live = (std[f] > 0).astype(float)
        cov = (st.gram[f] / n - np.outer(m, m)) / np.outer(s, s) * np.outer(live, live)
        h = np.zeros((len(m) + 1,) * 2)
        h[:-1, :-1] = 0.25 * cov + penalty[f] * np.eye(len(m))
        h[-1, -1] = 0.25
        out.append(np.linalg.inv(h + 1e-10 * np.eye(len(h))))
    return np.array(out)


def logistic(d: Data, st: Statistics, strength: float = 1.0, steps: int = 60, tolerance: float = 1e-6, memory: int = 10) -> Callable:
    """Minimises mean log-loss + |w|^2 / (2 n strength) over the standardised features, free bias, for every (part,
    label) at once.  A label that all or none of the training rows have is predicted so."""
    mean, std = st.scale()
    safe, p, m, w = np.where(std > 0, std, 1.0), d.parts, len(d.vocab), d.width
    n = np.maximum(st.n, 1)
    penalty = 1 / (n * strength)
    start = _metric(st, mean, std, penalty)
    theta = np.zeros((p, m, w + 1))

    def raw(t):
        """Weights of x itself, and biases."""
        v = np.where(std[:, None] > 0, t[:, :, :-1] / safe[:, None], 0.0)
        return v, t[:, :, -1] - (v * mean[:, None]).sum(2)

    def evaluate(t):
        v, c = raw(t)

        def fn(x, y, part):
            loss, grad, bias = np.zeros((p, m)), np.zeros((p, m, w)), np.zeros((p, m))
            for f in range(p):
                own = part != f                                    # all but the part's own rows train it
                if own.any():
                    a, b = x[own], y[own]
                    s = a @ v[f].T + c[f]
                    loss[f] = (np.logaddexp(0, s) - b * s).sum(0)
                    r = 1 / (1 + np.exp(-s)) - b
                    grad[f], bias[f] = r.T @ a, r.sum(0)
            return np.concatenate([loss.ravel(), grad.ravel(), bias.ravel()])

        flat = d.summed(fn, p * m * (w + 2))
        loss, grad, bias = (flat[a:b].reshape(s) for a, b, s in ((0, p * m, (p, m)), (p * m, p * m * (w + 1), (p, m, w)),
                                                                 (p * m * (w + 1), None, (p, m))))
        g = np.where(std[:, None] > 0, (grad - bias[:, :, None] * mean[:, None]) / safe[:, None], 0.0)
        g = g / n[:, None, None] + penalty[:, None, None] * t[:, :, :-1]
        return (loss / n[:, None] + 0.5 * penalty[:, None] * (t[:, :, :-1] ** 2).sum(2),
                np.concatenate([g, (bias / n[:, None])[:, :, None]], axis=2))

    mixed = (st.n_l > 0) & (st.n_l < st.n[:, None])
    pairs: list = []
    loss, grad = evaluate(theta)
    for _ in range(steps):
        open_ = mixed & (np.abs(grad).max(2) > tolerance)
        if not open_.any():
            break
        step = _two_loop(grad, pairs, start)
        size = np.where(open_, 1.0, 0.0)
        for _ in range(12):                                        # halved where the loss does not fall
            tried = theta - size[:, :, None] * step
            new_loss, new_grad = evaluate(tried)
            worse = open_ & (new_loss > loss - 1e-4 * size * (grad * step).sum(2) + 1e-12) & (size > 0)
            if not worse.any():
                break
            size = np.where(worse, size / 2, size)
        pairs = (pairs + [(tried - theta, new_grad - grad)])[-memory:]
        theta, loss, grad = tried, new_loss, new_grad
    v, c = raw(theta)

    def predict(x, f):
        return np.where(mixed[f], x @ v[f].T + c[f] > 0, st.n_l[f] > 0).astype(float)
    predict.theta = theta
    return predict


def _two_loop(grad: np.ndarray, pairs: list, start: np.ndarray) -> np.ndarray:
    """L-BFGS direction of every problem, from the metric ``start``."""
    q, done = grad.copy(), []
    for s, y in reversed(pairs):
        sy = (s * y).sum(2)
        rho = np.where(sy > 1e-14, 1 / np.where(sy > 1e-14, sy, 1.0), 0.0)
        a = rho * (s * q).sum(2)
        q -= a[:, :, None] * y
        done.append((s, y, rho, a))
    r = np.einsum("fij,fmj->fmi", start, q)
    for s, y, rho, a in reversed(done):
        b = rho * (y * r).sum(2)
        r += (a - b)[:, :, None] * s
    return r


def boosted_stumps(d: Data, st: Statistics, values: Sequence[float], rounds: int = 100, rate: float = 1.0) -> Callable:
    """SAMME over depth-1 trees (weighted Gini, leaves by weighted majority) on features that take the few
    ``values``.  Ties go to the lower feature, then the lower threshold; an empty split is none."""
    p, m, w, cuts = d.parts, len(d.vocab), d.width, sorted(values)
    stumps = [[[] for _ in range(m)] for _ in range(p)]            # (feature, cut, below, above, alpha)
    # all stumps of a (part, label) vote base + sum of table over the (threshold, feature) that a row is not above
    table, base, alphas = np.zeros((p * m, (len(cuts) - 1) * w)), np.zeros(p * m), np.zeros(p * m)
    offset = np.zeros((p, m))
    active = (st.n_l > 0) & (st.n_l < st.n[:, None])
    shift = d.shift

    def votes(x, own):
        """2 * prediction - 1 of each stump (columns) and their alphas."""
        if not own:
            return np.zeros((len(x), 0)), np.zeros(0)
        feature, cut, below, above, alpha = (np.array(c) for c in zip(*own))
        left = x[:, feature.astype(int)] + shift[feature.astype(int)] <= cut + 1e-9
        return 2 * np.where(left, below, above) - 1, alpha

    for _ in range(rounds):
        if not active.any():
            break

        live = np.flatnonzero(active)

        def fn(x, y, part):
            cube, value = np.zeros((p * m, w, len(cuts), 2)), x + shift
            under = np.concatenate([value <= c + 1e-9 for c in cuts[:-1]], axis=1).astype(float)
            codes = np.concatenate([np.abs(value - c) < 1e-9 for c in cuts], axis=1).astype(float)
            t = y[:, live % m]
            wrong = (alphas[live] - (2 * t - 1) * (under @ table[live].T + base[live])) / 2    # alphas of the stumps that miss
            own = part[:, None] != live // m                       # all but the part's own rows train it
            weight = np.exp(np.where(own, wrong - offset.ravel()[live], -np.inf))
            for c, side in enumerate((weight * (1 - t), weight * t)):
                cube[live, :, :, c] = (side.T @ codes).reshape(len(live), len(cuts), w).transpose(0, 2, 1)
            return cube.ravel()

        cube = d.summed(fn, p * m * w * len(cuts) * 2).reshape(p, m, w, len(cuts), 2)
        for f, k in zip(*np.nonzero(active)):
            found = best_stump(cube[f, k], cuts)
            if found is None:
                active[f, k] = False
                continue
            feature, cut, below, above, error = found
            if error >= 0.5:
                active[f, k] = False
                continue
            alpha = rate * float(np.log((1 - error) / max(error, 1e-12)))
            stumps[f][k].append((feature, cut, below, above, alpha))
            table[f * m + k, cuts.index(cut) * w + feature] += 2 * alpha * (below - above)
            base[f * m + k] += alpha * (2 * above - 1)
            alphas[f * m + k] += alpha
            if error <= 1e-12:
                active[f, k] = False
            total = cube[f, k, 0].sum()
            offset[f, k] += np.log(total * (1 - error + error * np.exp(alpha)))   # weights add up to 1 again
    constant = st.n_l > 0

    def predict(x, f):
        out = np.zeros((len(x), m))
        for k in range(m):
            v, alpha = votes(x, stumps[f][k])
            out[:, k] = (v @ alpha > 0) if stumps[f][k] else float(constant[f, k] and st.n_l[f, k] * 2 > st.n[f])
        return out
    predict.stumps = stumps
    return predict


def best_stump(cube: np.ndarray, cuts: Sequence[float]):
    """(feature, cut, class below, class above, weighted error) from weights (feature, value, class); None without a split."""
    below = cube.cumsum(1)[:, :-1]                                 # up to each value but the last
    total = cube.sum(1)[:, None]
    above = total - below
    size_b, size_a = below.sum(2), above.sum(2)
    whole = total.sum() / max(len(cube), 1)
    split = (size_b > 1e-12 * whole) & (size_a > 1e-12 * whole)
    if not split.any():
        return None
    gini = lambda side, size: size - (side ** 2).sum(2) / np.where(size > 0, size, 1.0)
    impurity = np.where(split, np.round((gini(below, size_b) + gini(above, size_a)) / whole, 10), np.inf)
    feature, at = np.unravel_index(impurity.argmin(), impurity.shape)
    b, a = below[feature, at], above[feature, at]
    cls = lambda side: float(side[1] > side[0] * (1 + 1e-12))
    error = (b.sum() - b[int(cls(b))] + a.sum() - a[int(cls(a))]) / whole
    return int(feature), float(cuts[at]), cls(b), cls(a), float(error)


def micro_scores(cells: DataFrame, beta: float = 0.5) -> DataFrame:
    """(model, part, precision, recall, f05)."""
    b2, tp, fp, fn = beta * beta, F.col("tp"), F.col("fp"), F.col("fn")
    return cells.select("model", "part", _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"),
                        _div((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp).alias("f05"))


#: Classifiers that are fitted for all labels and folds at once.
ONE_PASS: Dict[str, Callable[[Data, Statistics], Callable]] = {
    "Gaussian Naive Bayes": naive_bayes,
    "Logistic Regression (L2)": logistic,
    "AdaBoost": lambda d, st: boosted_stumps(d, st, (-1.0, 0.0, 1.0)),
}


def cross_validate(df: DataFrame, features: str, labels: str, fold: str, vocab: Sequence[str], n_folds: int,
                   names: Sequence[str] = tuple(ONE_PASS)) -> DataFrame:
    """G5 + A9: (model, mean_f05, mean_precision, mean_recall), every fold scored by the model of the others."""
    d = data(df, features, labels, fold, vocab, n_folds)
    st = statistics(d, gram="Logistic Regression (L2)" in names)
    scores = micro_scores(d.predicted({name: ONE_PASS[name](d, st) for name in names}))
    return scores.groupBy("model").agg(F.avg("f05").alias("mean_f05"), F.avg("precision").alias("mean_precision"),
                                       F.avg("recall").alias("mean_recall"))


def hold_out(df: DataFrame, features: str, labels: str, test: str, vocab: Sequence[str],
             names: Sequence[str] = tuple(ONE_PASS)) -> DataFrame:
    """(model, precision, recall, f05) on the rows where ``test`` is true, trained on the others."""
    d = data(df.withColumn("_part", F.col(test).cast("int")), features, labels, "_part", vocab, 2)
    st = statistics(d, gram="Logistic Regression (L2)" in names)
    return micro_scores(d.predicted({name: ONE_PASS[name](d, st) for name in names})).filter("part = 1").drop("part")
