from pyspark.sql import functions as F

from critiq.operators import split as spl


def test_two_groups_ten_percent(spark):
    df = spark.createDataFrame([(i, "g1" if i < 5 else "g2", ["a"] if i % 2 else ["b"]) for i in range(10)],
                               "id int, grp string, labels array<string>")
    s = spl.stratified_group_split(df, "labels", "grp", test_size=0.1, n_trials=20).collect()
    assert sorted(r["side"] for r in s) == ["test", "train"]           # one test group (B18)


def test_groups_whole_and_deterministic(spark):
    data = [(i, f"g{i % 7}", [f"l{i % 3}"]) for i in range(70)]
    df = spark.createDataFrame(data, "id int, grp string, labels array<string>")
    a = {r["grp"]: r["side"] for r in spl.stratified_group_split(df, "labels", "grp", 0.3, 30).collect()}
    b = {r["grp"]: r["side"] for r in spl.stratified_group_split(df.repartition(5), "labels", "grp", 0.3, 30).collect()}
    assert a == b and len(a) == 7 and sum(v == "test" for v in a.values()) == 2
    train, test = spl.split_sides(df, spl.stratified_group_split(df, "labels", "grp", 0.3, 30), "grp")
    tg = {r["grp"] for r in test.select("grp").distinct().collect()}
    assert not tg & {r["grp"] for r in train.select("grp").distinct().collect()}
    assert train.count() + test.count() == 70


def test_kfold_covers_all_groups(spark):
    data = [(i, f"g{i % 10}", [f"l{i % 4}"]) for i in range(100)]
    df = spark.createDataFrame(data, "id int, grp string, labels array<string>")
    k = spl.stratified_group_kfold(df, "labels", "grp", 5, 10).collect()
    assert len(k) == 10 and sorted({r["fold"] for r in k}) == [0, 1, 2, 3, 4]
    assert all(sum(r["fold"] == f for r in k) == 2 for f in range(5))


def test_buckets_rank_like_one_window(spark, monkeypatch):
    """Many groups are ranked in buckets of their uniforms, with the same result."""
    from critiq.operators import split as spl
    rows = [(f"g{k}", ["a"] * (k % 3 == 0) + ["b"] * (k % 5 == 0)) for k in range(60) for _ in range(1 + k % 4)]
    df = spark.createDataFrame(rows, "g string, labels array<string>")
    def both():
        side = {r["g"]: (r["side"], r["trial"], round(r["diff"], 9)) for r in spl.stratified_group_split(df, "labels", "g", 0.3, 12, 42).collect()}
        fold = {r["g"]: (r["fold"], r["trial"], round(r["score"], 9)) for r in spl.stratified_group_kfold(df, "labels", "g", 4, 7, 42).collect()}
        return side, fold
    whole = both()
    monkeypatch.setattr(spl, "RANKED", 5)
    assert both() == whole and sum(s[0] == "test" for s in whole[0].values()) == 18
