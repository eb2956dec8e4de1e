import math

import duckdb
import pytest
from pyspark.sql import functions as F

from critiq.llm import mixing


def plain_targets(sizes):
    """{source: size} -> {source: target}, resharing the excess step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while total:
        rest = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}
    return dict.fromkeys(names, 0)


def check(docs, near=True):
    rows = mixing.plan(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = plain_targets(sizes)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9) for r in mine)
        ratio = want[s] / sizes[s] if sizes[s] else 0
        assert all(math.floor(ratio - 1e-9) <= r.copies <= min(3, math.ceil(ratio + 1e-9)) for r in mine)
        assert abs(sum(r.copies for r in mine) - ratio * len(mine)) <= 1.0001
        if near:
            assert abs(sum(r.copies * r.size for r in mine) - want[s]) <= 2 * max(r.size for r in mine) + 1
    return rows


def test_driver_table_and_oracle(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    check(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    want = sorted(con.execute(mixing.ORACLE).fetchall())
    got = sorted(map(tuple, mixing.digest(docs).collect()))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(math.isclose(g[3], w[3]) for g, w in zip(got, want))


def test_small_sources_stop_at_three_times(spark):
    rows = [(k, "w " * 40, "big") for k in range(60)] + [(100 + k, "w w", "tiny") for k in range(5)] + [(200, "w", None)]
    rows = check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert all(r.copies == 3 for r in rows if r.source != "big")


def test_slices_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "same size of text", f"s{k % 2}") for k in range(500)],
                                 "doc_id long, text string, source string")
    whole = sorted(map(tuple, mixing.plan(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "SLICE", 3)
    assert sorted(map(tuple, mixing.plan(docs).collect()), key=str) == whole


def test_messy(messy, nothing):
    rows = check(messy, near=False)
    assert len(rows) == messy.count()
    out = mixing.mix(messy)
    assert out.columns == [c for c in messy.columns if c != "copy"] + ["copy"]
    assert out.count() == sum(r.copies for r in rows)
    assert mixing.plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_equal_rows_keep_their_source(spark):
    rows = [(1, "a b c", "x", k) for k in range(7)] + [(1, "a b c", "y", k) for k in range(3)] + [(2, "d e", None, k) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    want = {r.source: r.n for r in mixing.plan(docs).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    got = mixing.mix(docs).collect()
    assert {s: sum(r.source == s for r in got) for s in want} == want
    again = mixing.mix(docs.repartition(5, "other")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("texts", [["", None], ["", "a"]])
def test_sources_without_words(spark, texts):
    rows = [(k, t, f"s{k}") for k, t in enumerate(texts)]
    got = {r.source: r for r in mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got["s0"].target == 0 and got["s0"].copies == 0
