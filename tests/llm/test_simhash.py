import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from critiq.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, d=4):
    """Least index reachable, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint(long_text):
    for t in (None, "", " \n ", "A b", "a b c d", "a b c d e", "É È\x0bw a\x85b x y z Z", long_text[:4000], "w " * 3000):
        assert simhash.fingerprint(t) == plain_fingerprint(t), t


def test_spark_hash_agrees(spark):
    t = "four words of text"
    want = spark.range(1).select(F.xxhash64(F.lit(t)).alias("h")).first()["h"]
    assert np.uint64(simhash.fingerprint(t)) == np.int64(want).view(np.uint64)


def near_fps(n, seed):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for k in range(n):                          # chains of near fingerprints
        x = rng.choice(out)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return list(dict.fromkeys([*out, 0, 1, 3, 2**64 - 1]))


@pytest.mark.parametrize("limit", [1 << 16, 40])
def test_links_connect_all_near_pairs(spark, limit):
    fps = near_fps(150, 3)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    got = {}
    for r in simhash.components(simhash.links(df, len(fps), 4, limit)).collect():
        got[r.node] = r.root
    mine = classes(fps)
    signed = df.collect()
    by_class = {}
    for k, r in enumerate(signed):
        by_class.setdefault(mine[k], set()).add(got.get(r.fp, r.fp))
    assert all(len(v) == 1 for v in by_class.values())
    assert len(set.union(*by_class.values())) == len(by_class)


def test_hot_key_is_cut_and_exact(spark):
    """All fingerprints share their high bits, so whole buckets exceed the limit."""
    rng = random.Random(5)
    fps = list({rng.getrandbits(20) for _ in range(400)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, len(fps), 4, 64)).collect()}
    mine = classes(fps)
    assert len({got.get(x, x) for x in fps}) == len(set(mine))


def test_forest_connects_dense_group():
    rng = random.Random(2)
    fps = np.array(sorted({rng.getrandbits(12) for _ in range(900)}), np.uint64)
    a, b = simhash.forest(fps)
    assert len(a) == len(fps) - len(set(classes(fps.tolist())))
    assert (np.bitwise_count(a ^ b) <= 4).all()


def test_pivot_difference_never_exceeds_distance():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    assert np.abs(simhash.pivot_table(x) - simhash.pivot_table(y)).max() <= 1


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows.sort(key=lambda r: r.doc_id)
    fps = [plain_fingerprint(texts[r.doc_id]) for r in rows]
    assert [r.fp % 2**64 for r in rows] == fps
    assert [r.component_id for r in rows] == [rows[k].doc_id for k in classes(fps)]


def test_messy(spark, messy, nothing):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    of = {(r.doc_id, r.fp): r.component_id for r in rows}
    zero = {c for (i, fp), c in of.items() if fp == 0}
    assert zero == {4}                                        # null, empty and blank texts are linked
    assert {c for (i, _), c in of.items() if i in (1, 2)} == {1}
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 4 in ids and 5 not in ids
    assert ids.count(9) == 2                                  # two texts of one id, in two components
    assert kept.count() == 1 + len({r.component_id if r.component_id is not None else ("null", r.fp) for r in rows})
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e")] * 3 + [(None, "x y z")] * 2 + [(None, "x  y z")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(df).collect()) in (["a b c d e", "x y z"], ["a b c d e", "x  y z"])
