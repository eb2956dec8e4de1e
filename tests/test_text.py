"""Column builders on literal frames (FIXTURES section 3)."""
from pyspark.sql import functions as F

from critiq import fixed
from critiq.functions.scoring import forbidden_penalty, reading_ease, template_adherence, syllables
from critiq.functions.text import (bracket_items, has_bracket_list, judge_feedback, judge_score, normalize_label,
                                   pad_flatten, parse_labels, safe_name, score_int, validate_bio,
                                   validate_section, vote_code)
from critiq.operators.issues import template_key_norm


def one(spark, value, expr, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).collect()[0]["r"]


def test_normalize_label(spark):
    assert one(spark, ' "H3. Some label;, ', normalize_label) == "Some label"
    assert one(spark, "éH3. x", normalize_label) == "éH3. x"       # Unicode word char stays
    assert one(spark, "a/b\\c", normalize_label) == "abc"
    assert one(spark, "`H12. X`", normalize_label) == "X"


def test_parse_labels(spark):
    p1, p2 = fixed.PROTECTED_PHRASES
    assert one(spark, "H8. " + p2, parse_labels) == [p2]              # no empty label (B9)
    both = one(spark, p1 + "; x; " + p2, parse_labels)
    assert both == ["x", p1.split(". ", 1)[1], p2]                    # both phrases whole (B10)
    assert one(spark, "H1. X; X", parse_labels) == ["X"]              # B11
    assert one(spark, None, parse_labels) == []                       # Other, dropped
    assert one(spark, None, lambda c: parse_labels(c, include_other=True)) == ["Other"]
    assert one(spark, "", parse_labels) == []
    assert one(spark, ";;", parse_labels) == []


def test_validators(spark):
    assert one(spark, "B ", validate_bio) == "B"
    assert one(spark, "b", validate_bio) == "O"
    assert one(spark, "junk", validate_bio) == "O"
    assert one(spark, "summary_of_strengths", validate_section) == "summary_of_strengthes"
    assert one(spark, "summary_of_strengths", lambda c: validate_section(c, strict=True)) == "summary_of_weaknesses"
    assert one(spark, "comments_suggestions_and_typos", validate_section) == "comments,_suggestions_and_typos"


def test_vote_code(spark):
    cases = {"[[Yes]]": (1, 1), "NO": (-1, 0), "[[Other]]": (0, 0), "I cannot tell": (-1, 0), "eyes": (1, 0),
             "[[No]]": (-1, -1)}
    for text, (sub, tag) in cases.items():
        assert one(spark, text, vote_code) == sub, text
        assert one(spark, text, lambda c: vote_code(c, "tag")) == tag, text


def test_bracket_items(spark):
    assert one(spark, 'x ["a?", "b]c", "d"]', bracket_items) == ["a?"]  # cut at the inner ]
    assert one(spark, 'Q: ["a", "b"] tail', bracket_items) == ["a", "b"]
    assert one(spark, 'no list ["a", "b"', has_bracket_list) is False


def test_judge_parse(spark):
    assert one(spark, "x ### good [RESULT] 4", judge_feedback) == "good"
    assert one(spark, "x ### good [RESULT] 4", judge_score) == "4"
    assert one(spark, "good\nline [RESULT] 4", judge_feedback) == "good line"
    assert one(spark, "a [RESULT] b [RESULT] c", judge_feedback) == ""
    assert one(spark, "none", judge_score) == ""
    assert one(spark, "4", score_int) == 4
    assert one(spark, "7", score_int) is None
    assert one(spark, "", score_int) is None


def test_fitness_parts(spark):
    assert one(spark, "", lambda c: template_adherence(F.lit("a b"), c)) == 0.0
    assert one(spark, "a b", lambda c: template_adherence(c, F.lit(""))) == 0.0
    assert one(spark, "", reading_ease) == 0.0
    assert abs(one(spark, "this which hi", forbidden_penalty) - 1.0) < 1e-12
    assert abs(one(spark, "this which hi", lambda c: forbidden_penalty(c, True)) - 1 / 3) < 1e-12
    # one sentence assumed without a mark: 206.835 - 1.015*2 - 84.6*(2/2)
    assert abs(one(spark, "cat dog", reading_ease) - (206.835 - 1.015 * 2 - 84.6)) < 1e-9
    assert one(spark, "rhythm a queue", syllables) == 1 + 1 + 1


def test_pad_flatten(spark):
    df = spark.createDataFrame([([[1, -1, 0], [1]],)], "v array<array<int>>")
    assert df.select(pad_flatten("v").alias("r")).collect()[0]["r"] == [1, -1, 0, 1, 0, 0]
    assert df.select(pad_flatten("v", 4).alias("r")).collect()[0]["r"] == [1, -1, 0, 0, 1, 0, 0, 0]


def test_keys_and_names(spark):
    key = "H14. \U0001F195 The authors should compare to a 'closed' model X"
    assert one(spark, key, template_key_norm) == "The authors should compare to a 'closed' model X"
    assert one(spark, "org/model-7B v1.0", safe_name) == "org_model-7B_v1_0"


def test_multi_hot(spark):
    from critiq.functions.text import multi_hot
    df = spark.createDataFrame([(["b", "z"], ["a", "b", "c"])], "l array<string>, v array<string>")
    assert df.select(multi_hot("l", "v").alias("r")).first()["r"] == [0, 1, 0]   # unknown label ignored
