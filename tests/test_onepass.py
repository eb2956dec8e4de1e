"""One-pass classifiers against plain numpy versions, one fold and one label at a time."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from critiq.operators import onepass as op
from critiq.operators.metrics import micro_fbeta_cells

LABELS = ["a", "b", "c", "never", "always"]
PARTS = 3


def table(seed=1, n=150, width=7):
    rng = np.random.default_rng(seed)
    x = rng.choice([-1.0, 0.0, 1.0], size=(n, width))
    x[:, 3] = 1.0                                                  # a constant feature
    y = np.zeros((n, len(LABELS)))
    for k in range(3):
        y[:, k] = (x[:, k] + 0.7 * x[:, (k + 1) % 3] + rng.normal(0, 0.8, n)) > 0.3
    y[:, 4] = 1
    return x, y, rng.integers(0, PARTS, n)


@pytest.fixture(scope="module")
def sample(spark):
    x, y, part = table()
    rows = [(i, x[i].tolist(), [LABELS[k] for k in np.flatnonzero(y[i])] + ["other"], int(part[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "id int, f array<double>, labels array<string>, fold int").repartition(4)
    return df, op.data(df, "f", "labels", "fold", LABELS, PARTS), x, y, part


def scaled(x, train):
    m, s = x[train].mean(0), x[train].std(0)
    return np.where(s > 0, (x - m) / np.where(s > 0, s, 1), 0.0)


def cells(spark, guess, y, part):
    rows = [(int(part[i]), int(y[i, k]), int(guess[i, k])) for i in range(len(y)) for k in range(y.shape[1])]
    return {r["part"]: r for r in micro_fbeta_cells(spark.createDataFrame(rows, "part int, y_true int, y_pred int"), by=["part"]).collect()}


def plain_nb(x, y, part):
    guess = np.zeros_like(y)
    for f in range(PARTS):
        train = part != f
        z = scaled(x, train)
        eps = 1e-9 * z[train].var(0).max()
        for k in range(y.shape[1]):
            score = []
            for c in (0, 1):
                own = train & (y[:, k] == c)
                if not own.any():
                    score.append(np.full(len(x), -np.inf))
                    continue
                mu, var = z[own].mean(0), z[own].var(0) + eps
                score.append(np.log(own.sum()) - 0.5 * (np.log(2 * np.pi * var) + (z - mu) ** 2 / var).sum(1))
            guess[part == f, k] = (score[1] > score[0])[part == f]
    return guess


def plain_logistic(z, t, strength=1.0):
    """Newton's method on the same loss."""
    a = np.c_[z, np.ones(len(z))]
    n, ridge = len(z), np.r_[np.full(z.shape[1], 1 / (len(z) * strength)), 0]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        g = a.T @ (p - t) / n + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a / n + np.diag(ridge) + 1e-12 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def plain_samme(x, t, rounds):
    """One weight a row; every feature and threshold tried in turn."""
    w, out = np.full(len(x), 1 / len(x)), []
    for _ in range(rounds):
        best = None
        for j in range(x.shape[1]):
            for cut in (-1.0, 0.0):
                left = x[:, j] <= cut
                if w[left].sum() <= 0 or w[~left].sum() <= 0 or left.all() or not left.any():
                    continue
                gini = sum(w[s].sum() - (w[s & (t == 0)].sum() ** 2 + w[s & (t == 1)].sum() ** 2) / w[s].sum() for s in (left, ~left))
                gini = round(gini / w.sum(), 10)
                if best is None or gini < best[0]:
                    cls = [float(w[s & (t == 1)].sum() > w[s & (t == 0)].sum() * (1 + 1e-12)) for s in (left, ~left)]
                    best = (gini, j, cut, cls)
        _, j, cut, (b, a) = best
        guess = np.where(x[:, j] <= cut, b, a)
        err = w[guess != t].sum() / w.sum()
        if err >= 0.5:
            break
        alpha = np.log((1 - err) / max(err, 1e-12))
        out.append((j, cut, b, a, alpha))
        if err <= 1e-12:
            break
        w = w * np.exp(alpha * (guess != t))
        w /= w.sum()
    return out


def test_statistics_leave_the_part_out(sample):
    _, d, x, y, part = sample
    st = op.statistics(d)
    for f in range(PARTS):
        train = part != f
        shifted = x[train] - d.shift
        assert st.n[f] == train.sum() and np.allclose(st.s[f], shifted.sum(0)) and np.allclose(st.gram[f], shifted.T @ shifted)
        assert np.allclose(st.n_l[f], y[train].sum(0)) and np.allclose(st.q_l[f], y[train].T @ shifted ** 2)
        mean, std = st.scale()
        assert np.allclose(std[f], x[train].std(0)) and std[f][3] == 0


def test_naive_bayes_equals_the_plain_version(spark, sample):
    _, d, x, y, part = sample
    got = {r["part"]: r for r in op.micro_scores(d.predicted({"nb": op.naive_bayes(d, op.statistics(d, gram=False))})).collect()}
    want = cells(spark, plain_nb(x, y, part), y, part)
    assert {f: r["f05"] for f, r in got.items()} == pytest.approx({f: r["f05"] for f, r in want.items()})


def test_logistic_equals_newton(sample):
    _, d, x, y, part = sample
    fitted = op.logistic(d, op.statistics(d), tolerance=1e-8)
    for f in range(PARTS):
        z = scaled(x, part != f)[part != f]
        for k in range(3):
            assert np.allclose(fitted.theta[f, k], plain_logistic(z, y[part != f, k]), atol=1e-5)
    assert fitted(x - d.shift, 0)[:, 3].sum() == 0 and fitted(x - d.shift, 0)[:, 4].all()


def test_boosted_stumps_equal_plain_samme(sample):
    _, d, x, y, part = sample
    fitted = op.boosted_stumps(d, op.statistics(d, gram=False), (-1.0, 0.0, 1.0), rounds=12)
    for f in range(PARTS):
        for k in range(3):
            want = plain_samme(x[part != f], y[part != f, k], 12)
            assert len(want) > 3 and [s[:4] for s in fitted.stumps[f][k]] == [s[:4] for s in want]
            assert np.allclose([s[4] for s in fitted.stumps[f][k]], [s[4] for s in want])
    assert fitted.stumps[0][3] == [] and fitted(x - d.shift, 0)[:, 4].all() and not fitted(x - d.shift, 0)[:, 3].any()


def test_passes_do_not_depend_on_labels(spark, sample, monkeypatch):
    df, *_ = sample
    passes = []
    real = op.Data.summed
    monkeypatch.setattr(op.Data, "summed", lambda self, fn, size: passes.append(size) or real(self, fn, size))
    for vocab in (["a"], LABELS):
        passes.clear()
        d = op.data(df, "f", "labels", "fold", vocab, PARTS)
        st = op.statistics(d)
        op.naive_bayes(d, st)
        assert len(passes) == 1
        op.boosted_stumps(d, st, (-1.0, 0.0, 1.0), rounds=4)
        assert len(passes) == 5
        op.logistic(d, st)
        assert len(passes) < 45


def test_cross_validation_and_hold_out(spark, sample):
    df, _, x, y, part = sample
    got = {r["model"]: r for r in op.cross_validate(df, "f", "labels", "fold", LABELS, PARTS).collect()}
    assert set(got) == set(op.ONE_PASS) and all(r["mean_f05"] > 0.7 for r in got.values())
    want = cells(spark, plain_nb(x, y, part), y, part)
    assert got["Gaussian Naive Bayes"]["mean_f05"] == pytest.approx(np.mean([r["f05"] for r in want.values()]))
    held = op.hold_out(df.withColumn("test", F.col("fold") == 0), "f", "labels", "test", LABELS, ["Gaussian Naive Bayes"]).collect()
    assert len(held) == 1 and held[0]["f05"] == pytest.approx(want[0]["f05"])


def test_rows_and_labels_may_be_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], ["a"], 0), (1, None, ["a"], 0), (2, [0.0, 1.0], None, 1)],
                               "id int, f array<double>, labels array<string>, fold int")
    got = op.cross_validate(df, "f", "labels", "fold", ["a"], 2, ["Gaussian Naive Bayes", "AdaBoost"]).collect()
    assert {r["model"] for r in got} == {"Gaussian Naive Bayes", "AdaBoost"}
    assert op.cross_validate(df.limit(0), "f", "labels", "fold", ["a"], 2, ["Gaussian Naive Bayes"]).count() == 0


def test_blocks_are_dealt_over_the_cores(spark):
    """A pass is Python work: its tasks must not follow from the few bytes that vote vectors have."""
    df = spark.range(4000).selectExpr("cast(id as int) id", "array(1.0D, 0.0D, cast(id % 3 - 1 as double)) f",
                                      "array('a') labels", "cast(id % 3 as int) fold").coalesce(1)
    d = op.data(df, "f", "labels", "fold", ["a"], PARTS)
    n = spark.sparkContext.defaultParallelism
    sizes = [r["count"] for r in d.blocks.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("count")).collect()]
    assert len(sizes) == n and sum(sizes) == 4000 and max(sizes) < 2 * 4000 / n


def test_a_round_costs_the_same_after_many_rounds(sample, monkeypatch):
    """What a task is sent for a round does not grow with the rounds before it."""
    from pyspark import cloudpickle
    _, d, *_ = sample
    sent = []
    real = op.Data.summed
    monkeypatch.setattr(op.Data, "summed", lambda self, fn, size: sent.append(len(cloudpickle.dumps(fn))) or real(self, fn, size))
    fitted = op.boosted_stumps(d, op.statistics(d, gram=False), (-1.0, 0.0, 1.0), rounds=8)
    assert max(map(len, fitted.stumps[0])) == 8 and sent[-1] <= sent[1] * 1.1
