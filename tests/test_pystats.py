"""Text statistics in a Python worker against the direct formulas (functions/scoring.py)."""
import random

from pyspark.sql import functions as F

from critiq.functions import pystats as ps
from critiq.functions import scoring as sc
from critiq.functions.text import split_sentences
from critiq.operators import feedback as fb

WORDS = ["hi", "this", "Thanks", "good", "job", "rhythm", "the", "paper", "great", "work.", "nice", "é", "queue!", "x?", "İst", "a",
         ".", "Hello,", "hello hi", " ", "ΟΔΟΣ", "chi", "K", "日本", "\x1c", " "]


def words(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice(["", " ", " ", "  ", "\n", "\t ", " "]) for _ in range(n))


def test_any_cut_gives_the_direct_fitness(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        a, b, c, t = words(rng, rng.randrange(4)), words(rng, rng.randrange(16)), words(rng, rng.randrange(4)), words(rng, 6)
        s = ps.Scorer(t)
        whole, own = a + b + c + b, s.summarise(b)
        got = [s.summarise(whole), s.around(whole, b, own), s.merge(s.wrapped(a, own, c), own),
               s.merge(s.piece(a), s.merge(own, s.merge(s.piece(c), own)))]
        assert len(set(got)) == 1, (a, b, c, got)
        rows.append((k, whole, t, s.fitness(got[1], 1), s.fitness(got[2], -1)))
    df = spark.createDataFrame(rows, "k int, text string, template string, f double, g double")
    for r in df.select("*", sc.fitness("text", "template", 1).alias("wf"), sc.fitness("text", "template", -1).alias("wg")).collect():
        assert abs(r.f - r.wf) < 1e-9 and abs(r.g - r.wg) < 1e-9, r


def test_rounding_and_last_sentence_are_sparks(spark):
    rng = random.Random(4)
    numbers = [rng.uniform(-200, 200) for _ in range(300)] + [0.0, 0.0000000005, 1.0000000015, -1.0000000025, 2.5, -84600.0]
    texts = [words(rng, rng.randrange(9)) for _ in range(len(numbers))]
    df = spark.createDataFrame(list(zip(numbers, texts)), "x double, t string")
    for r in df.select("x", "t", F.round("x", 9).alias("r"), F.element_at(split_sentences("t"), -1).alias("last")).collect():
        assert ps.round9(r.x) == r.r and fb._last_sentence(r.t) == r.last, r
