import re
from collections import Counter

import numpy as np
import pytest

from critiq.llm import phrases

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest=3):
    """{lang: {words tuple: count}} by one loop."""
    out = {}
    for text, lang in rows:
        found = out.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            for k in range(1, longest + 1):
                found.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return out


def plain_ranks(counts, least=10, top=2000):
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        good = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        rows = []
        for g, a in good.items():
            longer = [c for h, c in good.items() if len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h)))]
            if any(100 * c >= 50 * a for c in longer):
                continue
            score, _, l, r = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_whole_table_against_plain_version(spark):
    docs = table(spark)
    want = plain_ranks(plain_counts([(r.text, r.lang) for r in docs.collect()]))
    assert sorted(tuple(r) for r in phrases.collocations(docs).collect()) == want and want


@pytest.mark.parametrize("share,bits,passes", [(0.0, 1 << 26, 3), (1.0, 1 << 26, 1), (0.25, 1 << 16, None)])
def test_any_sample_and_full_bitmaps_give_the_same_counts(spark, share, bits, passes):
    """Without a sample everything is a border failure; with the whole table as the sample nothing is."""
    docs = table(spark)
    found, n = phrases.frequent(docs, share=share, bits=bits)
    got = {(r.lang, r.phrase): r.n for r in found.filter("size > 0").collect()}
    want = {(lang, " ".join(g)): c for lang, f in plain_counts([(r.text, r.lang) for r in docs.collect()]).items()
            for g, c in f.items() if c >= 10}
    assert got == want and (passes is None or n == passes)


def test_longer_phrases(spark):
    rows = [("a b c d e", "x")] * 12 + [("b c d", "x")] * 3
    found, _ = phrases.frequent(spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)],
                                                      "doc_id long, text string, lang string"), longest=5)
    got = {r.phrase: r.n for r in found.filter("size > 0").collect()}
    assert got == {" ".join(g): c for g, c in plain_counts(rows, 5)["x"].items() if c >= 10}
    assert [r.phrase for r in phrases.ranked(found).collect()] == ["a b c d e"]


def test_members_are_found_at_the_hashes_of_a_chunk(spark):
    df = spark.createDataFrame([("x", 1, "é"), ("x", 2, "é b"), ("y", 2, "b c")], "lang string, size int, phrase string")
    m = phrases.members(df, 2, 1 << 20)
    h = phrases.word_hashes(["é".encode(), b"b", b"c"], "x")
    assert m.has(1, h).tolist() == [True, False, False]
    assert m.has(2, phrases.joined(h[:-1], h[1:])).tolist() == [True, False]
    y = phrases.word_hashes([b"b", b"c"], "y")
    assert m.has(2, phrases.joined(y[:1], y[1:])).tolist() == [True] and not np.array_equal(h[1:], y)


def test_arithmetic_passes_64_bits(spark):
    a, l, r = 3_000_000_007, 4_000_000_009, 5_000_000_021
    found = spark.createDataFrame([("x", 0, "", 10**11), ("x", 1, "p", l), ("x", 1, "q", r), ("x", 2, "p q", a)],
                                  "lang string, size int, phrase string, n long")
    assert [tuple(x) for x in phrases.ranked(found).collect()] == [("x", 1, "p q", a, l, r, 10**11, 10**6 * a * a // (l * r))]


def test_ties_take_the_first_cut(spark):
    found = spark.createDataFrame([("x", 0, "", 90), ("x", 1, "p", 20), ("x", 1, "q", 20), ("x", 2, "p p", 15), ("x", 2, "p q", 15),
                                   ("x", 3, "p p q", 12)], "lang string, size int, phrase string, n long")
    got = [tuple(x)[2:6] for x in phrases.ranked(found).collect()]
    assert got == [("p p q", 12, 20, 15)]                        # both cuts score alike; both pairs lie within


def test_messy(spark, messy, nothing):
    rows = [(r.text, r.lang) for r in messy.collect()]
    want = plain_ranks(plain_counts(rows))
    assert sorted(tuple(r) for r in phrases.collocations(messy).collect()) == want
    assert phrases.collocations(nothing).count() == 0
    few = spark.createDataFrame([(k, "Ab  ab\tAB", None) for k in range(9)] + [(None, "\x00 ab ab. É\x85é", None)],
                                "doc_id long, text string, lang string")
    want = plain_ranks(plain_counts([(r.text, r.lang) for r in few.collect()]))
    assert sorted(tuple(r) for r in phrases.collocations(few).collect()) == want and want[0][0] == "und"
