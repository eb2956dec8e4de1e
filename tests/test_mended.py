"""Cases where Java, Python and naive string replacement differ."""
import pytest
from pyspark.sql import functions as F

from critiq.functions import prompts, scoring, text
from critiq.operators import split, tagging
from critiq.operators.backend import BackendFactory, model_map
from critiq.sources import io as sio

ODD = "a b　c\x1cd e \x85f"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_unicode_whitespace(spark):
    assert one(spark, text.tokens(F.lit(ODD))) == ODD.split()
    assert one(spark, text.strip(F.lit(" \x1f x 　\n"))) == "x"
    assert one(spark, text.split_sentences(F.lit("A. B! C?　D"))) == ["A.", "B!", "C?", "D"]
    assert one(spark, scoring.syllables(F.lit("xyz bcd　ea"))) == 3
    assert one(spark, scoring.template_adherence(F.lit("a b"), F.lit("b a"))) == 1.0


def test_end_of_text_is_not_before_a_newline(spark):
    assert one(spark, text.normalize_label(F.lit("abc;\n"))) == "abc"     # stripped first, as in Python
    assert one(spark, F.regexp_replace(F.lit("abc;\n"), r"[;,]+\z", "")) == "abc;\n"
    assert one(spark, text.strip(F.lit("a\n\n"))) == "a"


def test_factories_may_share_a_name(spark):
    df = spark.createDataFrame([("p",)], "prompt string")
    got = [model_map(df, "prompt", BackendFactory("same", lambda k=k: (lambda ps: [k] * len(ps))), "c").first()["c"]
           for k in ("one", "two")]
    assert got == ["one", "two"]


def test_placeholder_inside_a_value_stays(spark):
    assert "{sentence}" in prompts.fill("bio_chained", review="see {sentence}", context="", sentence="S")
    rows = spark.createDataFrame([("r", 0, "S", "text with {sentence} in it")], "k string, pos int, s string, body string")
    answer = lambda ps: ["B" if "text with {sentence} in it" in p else "O" for p in ps]
    seen = tagging.tag_reviews_with_model(rows, "k", "pos", "s", "body", answer).first()
    assert (seen.section_pred, seen.bio_pred) == ("summary_of_weaknesses", "B")


def test_split_needs_two_groups(spark):
    df = spark.createDataFrame([("g", ["a"]), ("g", ["b"])], "grp string, labels array<string>")
    with pytest.raises(ValueError):
        split.stratified_group_split(df, "labels", "grp", 0.1, 5)
    two = spark.createDataFrame([("g", ["a"]), ("h", ["b"])], "grp string, labels array<string>")
    with pytest.raises(ValueError):
        split.stratified_group_split(two, "labels", "grp", 1.0, 5)
    assert {r.side for r in split.stratified_group_split(two, "labels", "grp", 0.1, 5).collect()} == {"test", "train"}


def test_pandas_missing_tokens(spark):
    df = spark.createDataFrame([(t,) for t in ("#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "1.#IND", "1.#QNAN", "x")], "c string")
    assert [r.c for r in sio.normalize_nulls(df).collect()] == [None] * 6 + ["x"]
