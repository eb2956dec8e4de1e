"""Mergeable text statistics against the direct formulas (functions/scoring.py)."""
import random

import pytest
from pyspark.sql import functions as F

from critiq.functions import scoring as sc
from critiq.functions import textstats as ts
from critiq.functions.text import tokens

WORDS = ["hi", "this", "Thanks", "good", "job", "rhythm", "the", "paper", "great", "work.", "nice", "é", "queue!", "x?", "İst", "a",
         ".", "Hello,", "hello hi", " ", "ΟΔΟΣ", "chi"]


def words(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice(["", " ", " ", "  ", "\n", "\t "]) for _ in range(n))


def tt():
    return F.array_distinct(tokens("template"))


def direct(text, sign):
    return F.round(sc.fitness(text, "template", sign), 9)


def test_any_cut_gives_the_same_fitness(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        t = words(rng, rng.randrange(0, 14))
        i, j = sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))
        rows.append((k, t, t[:i], t[i:j], t[j:], words(rng, 6)))
    df = spark.createDataFrame(rows, "k int, text string, a string, b string, c string, template string")
    one = lambda c: ts.summarise(c, tt())
    left = ts.merge(ts.merge(one("a"), one("b"), tt()), one("c"), tt())
    right = ts.merge(one("a"), ts.merge(one("b"), one("c"), tt()), tt())
    got = df.select("text", direct("text", 1).alias("want"), F.round(ts.fitness(one("text"), tt()), 9).alias("whole"),
                    F.round(ts.fitness(left, tt()), 9).alias("left"), F.round(ts.fitness(right, tt()), 9).alias("right")).collect()
    for r in got:
        assert r.whole == r.want and r.left == r.want and r.right == r.want, r


def test_empty_text_is_the_identity(spark):
    df = spark.createDataFrame([("hi there, good", "hi x"), ("", ""), (" ", "a")], "text string, template string")
    none = ts.summarise(F.lit(""), tt())
    own = ts.summarise("text", tt())
    for s in (ts.merge(none, own, tt()), ts.merge(own, none, tt())):
        assert all(r[0] == r[1] for r in df.select(F.struct(own).cast("string"), F.struct(s).cast("string")).collect())


@pytest.mark.parametrize("sign", [1, -1])
def test_candidates_around_a_segment(spark, sign):
    rng = random.Random(5)
    rows = []
    for k in range(200):
        seg = words(rng, rng.choice([0, 1, 9, 12]))
        if k % 17 == 0:
            seg += ts.MARK
        a, b, c = (words(rng, 3) for _ in range(3))
        cands = [a + seg + b, seg, a + seg + b + seg + c, a + b, seg + seg, a + ts.MARK + seg, "", seg[:-1] + a]
        rows.append((k, seg, cands, words(rng, 6)))
    df = spark.createDataFrame(rows, "k int, segment string, texts array<string>, template string")
    cands = F.transform("texts", lambda t, i: F.struct(i.alias("cand_id"), t.alias("text")))
    got = df.select("k", "template", F.inline(sc.let(tt(), lambda t: sc.let(ts.known("segment", t), lambda seg: ts.scored(cands, t, sign, seg)))))
    bad = got.withColumn("want", direct("text", sign)).filter(F.round("fitness", 9) != F.col("want"))
    assert got.count() == 1600 and bad.collect() == []


def test_null_texts_stay_null(spark):
    df = spark.createDataFrame([(None, "a b"), ("a b c", None)], "text string, template string")
    got = df.select(ts.fitness(ts.summarise("text", tt()), tt()).alias("f"), sc.fitness("text", "template").alias("g")).collect()
    assert got[0].f is None and got[0].g is None
