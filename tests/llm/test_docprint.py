import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from critiq.llm import docprint

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_fingerprint(text):
    """One term after the other, one vote after the other."""
    low = (text or "").lower()
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in low.split(" ") if w]
    votes = [0] * 64
    for k, h in enumerate(hashes):
        pair = xxhash.xxh64_intdigest(struct.pack("<Q", h), 42)
        if k + 1 < len(hashes):
            pair = xxhash.xxh64_intdigest(struct.pack("<Q", hashes[k + 1]), pair)
        for term, weight in ((h, docprint.WORD), (pair, docprint.PAIR)):
            for b in range(64):
                votes[b] += weight if term >> b & 1 else -weight
    return sum(1 << b for b in range(64) if votes[b] > 0)


def plain_edited(texts):
    """texts in the order of their documents."""
    texts = [t or "" for t in texts]
    for k, t in enumerate(texts):
        q = len(t) // 4
        yield t[:len(t) - q] + texts[(k + 1) % len(texts)][:q]


def like(a, b):
    return 1 - (a ^ b).bit_count() / 64


def test_whole_table_against_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(docprint.digest(spark.read.parquet(f"{SF}/documents.parquet")).collect(), key=lambda r: r.doc_id)
    texts = [r.text for r in rows]
    new = list(plain_edited(texts))
    fps, efps = [plain_fingerprint(t) for t in texts], [plain_fingerprint(t) for t in new]
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert [r.n_chars for r in got] == [len(t or "") for t in texts]
    assert [r.edited_sha256 for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in new]
    assert [r.fingerprint for r in got] == [f"{x:016x}" for x in fps]
    assert [r.edited_fingerprint for r in got] == [f"{x:016x}" for x in efps]
    assert [r.near_edited for r in got] == [like(a, b) for a, b in zip(fps, efps)]
    assert [r.near_next for r in got] == [like(a, fps[(k + 1) % len(fps)]) for k, a in enumerate(fps)]
    each = set(fps)
    assert [r.n_near for r in got] == [sum(0 < (a ^ b).bit_count() <= docprint.RADIUS for b in each) for a in fps]


def near_fps(n, seed):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(2 * n):
        x = rng.choice(out)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted({*out, 0, 1, 3, (1 << 64) - 1, (1 << 63)})


@pytest.mark.parametrize("radius,blocks,part", [(3, 6, 2048), (3, 6, 5), (1, 4, 2048), (4, 7, 9)])
def test_block_tables_find_all_pairs_once(spark, radius, blocks, part):
    fps = near_fps(120, 7)
    df = spark.createDataFrame([(signed(x),) for x in fps] * 2, "fp long")
    got = [tuple(r) for r in docprint.within(df, radius, blocks, part).collect()]
    want = {(signed(a), signed(b), (a ^ b).bit_count()) for a in fps for b in fps if 0 < (a ^ b).bit_count() <= radius}
    assert len(got) == len(want) and set(got) == want
    counts = {r.fp: r.n_near for r in docprint.near_counts(df, radius, blocks, part).collect()}
    assert counts == {f: n for f in {a for a, _, _ in want} if (n := sum(a == f for a, _, _ in want))}


def test_bucket_is_cut_into_parts(spark):
    """All fingerprints share their high bits: one hot bucket in most tables."""
    rng = random.Random(1)
    fps = sorted({rng.getrandbits(14) for _ in range(500)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    entries, parts = docprint._buckets(df, 2, 5, 40)
    assert parts.agg(F.max(F.size("fps"))).first()[0] < 120
    got = {r.fp: r.n_near for r in docprint.near_counts(df, 2, 5, 40).collect()}
    assert got == {a: n for a in fps if (n := sum(0 < (a ^ b).bit_count() <= 2 for b in fps))}


def test_long_text_and_equal_texts(spark, long_text):
    df = spark.createDataFrame([(1, long_text), (2, long_text), (3, long_text + " end")], "k long, t string")
    got = {r.k: r.fp % 2**64 for r in docprint.fingerprints(df, ["k"], "t").collect()}
    assert got[1] == got[2] == plain_fingerprint(long_text)
    assert (got[1] ^ got[3]).bit_count() <= 2


def test_messy(spark, messy, nothing):
    got = docprint.digest(messy).collect()
    assert len(got) == messy.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len({tuple(r) for r in by[2]}) == 1 and len(by[2]) == 2       # a repeated row: one document, two results
    assert by[1][0].fingerprint == by[2][0].fingerprint and by[1][0].near_next == 1.0
    for empty in (4, 5, 6):
        assert by[empty][0].fingerprint == "0" * 16
    assert by[4][0].n_chars == 0 and by[4][0].edited_sha256 == hashlib.sha256(b"").hexdigest()
    # order: 1, 2, 3, ..., 10, then the two rows without an id (by hash), then again 1
    first = by[1][0].fingerprint
    ends = [r for r in by[None] if r.near_next == like(int(r.fingerprint, 16), int(first, 16))]
    assert ends and len(by[None]) == 2
    assert docprint.digest(nothing).count() == 0


def test_single_document_follows_itself(spark):
    r = docprint.digest(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0 and r.n_near == 0


def test_edit_is_nearer_than_the_next_text(spark):
    got = docprint.digest(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    apart = [r.near_edited > r.near_next for r in got if r.n_chars > 100 and r.near_next < 0.9]
    assert sum(apart) / len(apart) > 0.98
