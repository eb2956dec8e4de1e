"""Model tests: every classifier stand-in separates a separable synthetic
vote table (micro F0.5 above a fixed floor); scaling matches hand values."""
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from critiq import fixed
from critiq.operators import models as mdl
from critiq.operators.metrics import micro_fbeta_cells


@pytest.fixture(scope="module")
def votes(spark):
    rows = []
    for i in range(80):
        a = 1 if i % 2 else -1
        b = 1 if i % 3 == 0 else (-1 if i % 3 == 1 else 0)
        rows.append((i, [float(a), float(b), float(-a), 0.0], ["x"] if a > 0 else []))
    return spark.createDataFrame(rows, "k int, f array<double>, labels array<string>").cache()


def test_standardize(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "k int, v array<double>")
    r = {x["k"]: x["scaled"] for x in mdl.standardize(df, "v").collect()}
    assert r[1] == [-1.0, 0.0] and r[2] == [1.0, 0.0]      # population std; constant -> 0


def test_every_classifier_separates(spark, votes):
    """All fourteen, trained on one side and scored on the other."""
    assert list(mdl.CLASSIFIERS) == fixed.CLASSIFIER_NAMES

    def run(name):
        cells = mdl.binary_relevance(votes.filter("k < 56"), votes.filter("k >= 56"), "k", "f", "labels", ["x"],
                                     mdl.CLASSIFIERS[name], threads=1)
        assert cells.filter("score < 0 or score > 1").count() == 0, name         # probabilities, the SVMs' too
        return name, micro_fbeta_cells(cells).first()["f05"]
    with ThreadPoolExecutor(max_workers=4) as ex:
        scores = dict(ex.map(run, list(mdl.CLASSIFIERS)))
    assert set(scores) >= {"Logistic Regression (L2)", "Random Forest", "SVM (RBF)", "SVM (Poly)", "AdaBoost",
                           "Multi-layer Perceptron (MLP)", "Gaussian Naive Bayes", "Gradient Boosting"}
    low = {k: v for k, v in scores.items() if v < 0.8}
    assert not low, low


def test_constant_label_predicts_constant(spark, votes):
    allx = votes.withColumn("labels", F.array(F.lit("x")))
    cells = mdl.binary_relevance(allx, allx, "k", "f", "labels", ["x"], mdl.CLASSIFIERS["Decision Tree"])
    assert cells.filter("y_pred != 1.0").count() == 0


def test_knn_exact_against_brute_force(spark):
    import math
    import random
    from critiq.operators import neighbors as nbr
    rnd = random.Random(5)
    pts = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    pts += [(150 + i, list(pts[3][1])) for i in range(8)]          # duplicates of one point
    df = spark.createDataFrame(pts, "id int, v array<double>")
    got = {}
    for r in nbr.knn(df.withColumnRenamed("id", "t"), df.withColumnRenamed("id", "q"), "t", "q", "v", 5,
                     exclude_self=True, target=8).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["t"]))
    for qi, qv in pts:
        d = sorted((round(math.dist(qv, tv), 9), ti) for ti, tv in pts if ti != qi)[:5]
        assert [t for _, t in sorted(got[qi])] == [t for _, t in d], qi


def test_grid_search(spark, votes):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.tuning import ParamGridBuilder
    lr = LogisticRegression()
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 10.0]).build()
    df = votes.withColumn("fold", (F.col("k") % 2).cast("int"))
    r = mdl.grid_search(df, "k", "f", "labels", "fold", ["x"], "LR",
                        lambda n, d: LogisticRegression(maxIter=50), grid, 2).collect()
    assert len(r) == 2 and all("regParam" in x["model"] for x in r)


def test_knn_chunked_groups(spark, monkeypatch):
    import math
    import random
    from critiq.operators import neighbors as nbr
    monkeypatch.setattr(nbr, "QUERY_CHUNK", 7)
    monkeypatch.setattr(nbr, "TRAIN_CHUNK", 5)
    rnd = random.Random(9)
    pts = [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(60 + i, [0.5, 0.5, 0.5]) for i in range(20)]
    df = spark.createDataFrame(pts, "id int, v array<double>")
    got = {}
    for r in nbr.knn(df.withColumnRenamed("id", "t"), df.withColumnRenamed("id", "q"), "t", "q", "v", 4,
                     exclude_self=True, target=6).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["t"]))
    for qi, qv in pts:
        d = sorted((round(math.dist(qv, tv), 9), ti) for ti, tv in pts if ti != qi)[:4]
        assert [t for _, t in sorted(got[qi])] == [t for _, t in d], qi


def test_tensor_sketch_keeps_the_polynomial_kernel():
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6))
    sketch = mdl.TensorSketch(6, components=4096)
    got = sketch(x) @ sketch(x).T
    want = (x @ x.T / 6) ** 3
    assert np.abs(got - want).max() < 0.25 * np.abs(want).max()
    assert np.corrcoef(got.ravel(), want.ravel())[0, 1] > 0.98


def test_knn_outlier_and_one_point(spark):
    from critiq.operators import neighbors as nbr
    pts = [(i, [float(i % 7), float(i // 7)]) for i in range(50)] + [(50, [1e9, -1e9])]
    df = spark.createDataFrame(pts, "id int, v array<double>")
    got = nbr.knn(df.withColumnRenamed("id", "t"), df.withColumnRenamed("id", "q"), "t", "q", "v", 3, exclude_self=True, target=4)
    assert got.count() == 51 * 3 and {r["t"] for r in got.filter("q = 0").collect()} == {1, 7, 8}
    one = df.filter("id = 0")
    assert nbr.knn(one.withColumnRenamed("id", "t"), one.withColumnRenamed("id", "q"), "t", "q", "v", 3).count() == 1


def _clusters(n, width, centres, seed):
    import random
    rnd = random.Random(seed)
    mid = [[rnd.gauss(0, 10) for _ in range(width)] for _ in range(centres)]
    return [(i, [m + rnd.gauss(0, 0.5) for m in mid[i % centres]]) for i in range(n)]


def test_knn_computes_few_pairs_of_clustered_vectors(spark):
    import math
    from critiq.operators import neighbors as nbr
    pts = _clusters(1500, 64, 40, 3)
    df = spark.createDataFrame(pts, "id int, v array<double>")
    report = {}
    got = {}
    for r in nbr.knn(df.withColumnRenamed("id", "t"), df.withColumnRenamed("id", "q"), "t", "q", "v", 5, exclude_self=True,
                     report=report).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["t"]))
    assert report["pairs"] == 1500 ** 2 and report["computed"] < 0.25 * report["pairs"], report
    for qi, qv in pts[::29]:
        d = sorted((round(math.dist(qv, tv), 9), ti) for ti, tv in pts if ti != qi)[:5]
        assert [t for _, t in sorted(got[qi])] == [t for _, t in d], qi


def test_cell_bounds_never_exceed_distances():
    import numpy as np
    from critiq.operators import neighbors as nbr
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(40, 8)) * 3
    marks = nbr.farthest_first(x, 5)
    cell = rng.integers(0, 7, 300)
    d = nbr._distances(x, marks)
    lo, hi = (np.array([f(d[cell == c], axis=0) for c in range(7)]) for f in (np.min, np.max))
    b = nbr.cell_bounds(nbr._distances(q, marks), lo, hi)
    real = np.array([[nbr._distances(q[i:i + 1], x[cell == c]).min() for c in range(7)] for i in range(40)])
    assert (b <= real + 1e-9).all() and b.max() > 0
    assert len(nbr.farthest_first(np.ones((9, 3)), 4)) == 1


def test_knn_empty_sides(spark):
    from critiq.operators import neighbors as nbr
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], "id int, v array<double>")
    t, q = df.withColumnRenamed("id", "t"), df.withColumnRenamed("id", "q")
    assert nbr.knn(t.limit(0), q, "t", "q", "v").count() == 0
    assert nbr.knn(t, q.limit(0), "t", "q", "v").count() == 0
    assert nbr.knn(t, q, "t", "q", "v", 1, exclude_self=True).count() == 2


def test_knn_copies_a_vector_once_a_block_not_once_a_cell(spark, monkeypatch):
    """Random directions leave nearly every cell open; what is sent must not grow with the cells."""
    import random
    from critiq.operators import neighbors as nbr
    monkeypatch.setattr(nbr, "TRAIN_CHUNK", 400)
    sent = []
    keep = nbr.checkpointed

    def counted(df):
        out = keep(df)
        if "_qv" in df.columns:
            sent.append(out.count())
        return out
    monkeypatch.setattr(nbr, "checkpointed", counted)
    rnd = random.Random(4)
    pts = [(i, [rnd.gauss(0, 1) for _ in range(24)]) for i in range(1200)]
    df = spark.createDataFrame(pts, "id int, v array<double>")
    got = nbr.knn(df.withColumnRenamed("id", "t"), df.withColumnRenamed("id", "q"), "t", "q", "v", 5, exclude_self=True, target=8)
    assert got.count() == 1200 * 5
    assert sum(sent) <= 1200 * 5, sent                    # 3 or 4 blocks of 150 cells


def test_knn_one_vector_many_ids(spark):
    """A large group of copies costs its k + 1 lowest ids, and a repeated id counts as often as it stands."""
    from critiq.operators import neighbors as nbr
    pts = [(i, [1.0, 2.0]) for i in range(3000)] + [(5000 + i, [float(i), 0.0]) for i in range(20)] + [(5003, [3.0, 0.0])]
    df = spark.createDataFrame(pts, "id int, v array<double>")
    report = {}
    got = nbr.knn(df.withColumnRenamed("id", "t"), df.withColumnRenamed("id", "q"), "t", "q", "v", 2, exclude_self=True,
                  report=report).collect()
    near = {}
    for r in got:
        near.setdefault(r["q"], []).append((r["rank"], r["t"]))
    assert [t for _, t in sorted(near[2999])] == [0, 1] and [t for _, t in sorted(near[0])] == [1, 2]
    assert [t for _, t in sorted(near[5004])] == [5003, 5003]
    assert report["computed"] < 0.1 * report["pairs"]


def test_documents_are_labelled_twice_for_the_classifiers(spark, monkeypatch):
    """Once for all labels and once for the questions' segments, not again for every use of them; the rows are dealt evenly."""
    from critiq.plans import catalog
    sf = "/root/testdata/sf0.001"
    made, real = [], catalog._labeled
    monkeypatch.setattr(catalog, "_labeled", lambda *a, **k: made.append(k) or real(*a, **k))
    data, vocab = catalog._voted_data(spark, sf)
    assert len(made) == 2 and vocab == sorted(vocab) and data.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    labels = {r["doc_id"]: r["issues"] for r in catalog._issue_dataset(spark, sf).collect()}
    assert {r["doc_id"]: r["issues"] for r in data.collect()} == labels
    docs = catalog.table(spark, sf, "documents").select("doc_id", "text")
    votes = catalog.iss.vote_vectors(docs, "doc_id", "text", catalog._question_table(spark, sf))
    want = {r["doc_id"]: r["features"] for r in votes.collect() if r["doc_id"] in labels}
    assert {r["doc_id"]: r["features"] for r in data.collect()} == want


def test_labels_are_counted_in_one_pass(spark, monkeypatch):
    from pyspark.sql import DataFrame
    counted, real = [], DataFrame.count
    monkeypatch.setattr(type(spark.range(0)), "count", lambda self: counted.append(1) or real(self))
    df = spark.createDataFrame([(i, [float(i % 2), 1.0], ["a"] if i % 2 else ["b", "a"]) for i in range(20)],
                               "id int, x array<double>, labels array<string>")
    got = mdl.binary_relevance(df, df, "id", "x", "labels", ["a", "b", "c"], mdl.CLASSIFIERS["Gaussian Naive Bayes"]).collect()
    assert not counted and {(r["label_name"], r["y_true"]) for r in got} == {("a", 1.0), ("b", 0.0), ("b", 1.0), ("c", 0.0)}
