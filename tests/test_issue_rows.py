"""A1 with keys of any type, P7 with repeated keys."""
from critiq.operators import issues as iss


def test_positions_follow_text_keys_and_sparse_numbers(spark):
    for keys, kind in ((["b", "a", "zz", "ab"], "string"), ([7 << 50, 3, -(9 << 48), 12], "long")):
        df = spark.createDataFrame([(k, ["x", "y"] if i % 2 else ["x"], f"s{k}") for i, k in enumerate(keys)],
                                   f"k {kind}, issues array<string>, seg string")
        got = [(r["issue"], r["pos"], r["k"]) for r in iss.issue_segments(df, "k", "seg").collect()]
        want = [("x", p, k) for p, k in enumerate(sorted(keys))]
        want += [("y", p, k) for p, k in enumerate(sorted(k for i, k in enumerate(keys) if i % 2))]
        assert sorted(got) == sorted(want)


def test_rows_that_repeat_the_key_stay(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (1, ["c"]), (2, ["b"])], "k int, issues array<string>")
    names = spark.createDataFrame([("a",), ("b",)], "issue string")
    got = sorted((r["k"], r["issues"]) for r in iss.with_supported_issue(df, names, "k").collect())
    assert got == [(1, ["a"]), (1, ["a", "b"]), (2, ["b"])]
