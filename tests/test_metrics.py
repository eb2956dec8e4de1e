from critiq.operators import metrics as met


def test_single_label_hand_computed(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "g string, p string")
    r = met.single_label_metrics(df, "g", "p").collect()[0]
    assert r["n"] == 4 and abs(r["accuracy"] - 0.5) < 1e-12 and abs(r["f1_micro"] - 0.5) < 1e-12
    # labels a,b,c: precision a=1, b=1/3, c=0 ; recall a=1/2, b=1, c=0
    assert abs(r["precision_macro"] - (1 + 1 / 3) / 3) < 1e-12
    assert abs(r["recall_macro"] - 1.5 / 3) < 1e-12


def test_per_class_only_one_side(spark):
    df = spark.createDataFrame([(1, ["x"], ["y"])], "k int, t array<string>, p array<string>")
    r = {x["label"]: x for x in met.per_class_relaxed(df, "k", "t", "p").collect()}
    assert r["x"]["fn"] == 1 and r["x"]["precision"] == 0.0 and r["x"]["recall"] == 0.0
    assert r["y"]["fp"] == 1 and r["y"]["precision"] == 0.0


def test_multilabel_empty_and_zero(spark):
    df = spark.createDataFrame([([], []), (["a"], []), ([], ["a"])], "t array<string>, p array<string>")
    r = met.multilabel_summary(df, "t", "p").collect()[0]
    for c in ["relaxed_accuracy", "sample_precision", "sample_recall", "sample_f1", "sample_f05",
              "micro_precision", "micro_recall", "micro_f05"]:
        assert r[c] == 0.0, c


def test_multilabel_values(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["c"], ["c", "d"])], "t array<string>, p array<string>")
    r = met.multilabel_summary(df, "t", "p").collect()[0]
    assert abs(r["sample_precision"] - 0.75) < 1e-12 and abs(r["sample_recall"] - 0.75) < 1e-12
    assert r["relaxed_accuracy"] == 1.0
    # micro: tp 2, fp 1, fn 1 -> P = R = 2/3, F0.5 = 2/3
    assert abs(r["micro_f05"] - 2 / 3) < 1e-12
