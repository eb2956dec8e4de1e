"""Rubric judge.

With a model backend the (row, dimension) prompts are rows so they can be
batched (``judge_with_model`` sends the four of a row together; ``judge_long`` and
``pivot_judgements`` are the long form).  With the
native rules backend the four dimensions are four column expressions on the
same row: no explode, no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.prompts import JUDGE_SYSTEM, RUBRICS, chat, render
from ..functions.text import col_of, first_part, judge_feedback, judge_score, score_int, sentence_marks, tokens


def judge_input(df: DataFrame, segment: str, outputs: str) -> DataFrame:
    """P2 + P10: drop rows with any null, keep the part before the first ';'."""
    return df.na.drop("any").withColumn(segment, first_part(segment))


def judge_prompt(dimension: str, segment, feedback) -> Column:
    """The rubric of one dimension over a segment and its feedback."""
    question, *levels = RUBRICS[dimension]
    return render("judge", dimension=F.lit(dimension), question=F.lit(question), weakness=segment, feedback=feedback,
                  **{f"s{k}": F.lit(x) for k, x in enumerate(levels, 1)})


# words that propose something to do (rules judge)
SUGGESTIONS = ("please", "could", "consider", "add", "suggest", "cite", "example")


def judge_features(segment, feedback) -> Column:
    """What the rules judge reads off a row, for all dimensions: marks, distinct words, how many of them the
    segment has, the lower-cased feedback and its number of words."""
    seg, fb = col_of(segment), col_of(feedback)
    words = F.array_distinct(tokens(fb))
    return F.struct(sentence_marks(fb).alias("marks"), F.size(words).alias("words"),
                    F.size(F.array_intersect(tokens(seg), words)).alias("shared"),
                    F.lower(fb).alias("low"), F.size(F.split(fb, " ")).alias("n"),
                    F.contains(fb, F.substring(seg, 1, 20)).alias("quotes"))


def rules_judge_score(dimension: str, feedback, f: Column) -> Column:
    """Rules judge: a score from 1 to 5 from what the feedback says: its number of
    sentences, the share of its words that the segment has, its proposals, its
    concrete references.  ``f``: ``judge_features``."""
    fb = col_of(feedback)
    if dimension == "Conciseness":
        n = f["marks"]
        return F.when(n <= 2, 5).when(n == 3, 4).when(n <= 5, 3).when(n <= 8, 2).otherwise(1)
    if dimension == "Relevance":
        return (1 + F.floor(4 * f["shared"] / F.greatest(f["words"], F.lit(1)))).cast("int")
    if dimension == "Constructiveness":
        return 1 + F.least(F.lit(4), sum((f["low"].contains(w).cast("int") for w in SUGGESTIONS), F.lit(0)))
    return (1 + fb.contains('"').cast("int") + fb.rlike("[0-9]").cast("int") + (f["words"] >= 30).cast("int")
            + f["quotes"].cast("int"))


def rules_judge_completion(dimension: str, feedback, f: Column) -> Column:
    """Rules backend: the rules judge's score in the four completion shapes that
    a judge model produces (the last two cannot be parsed)."""
    k = (f["marks"] + F.lit(fixed.JUDGE_DIMENSIONS.index(dimension))) % 4
    score = rules_judge_score(dimension, feedback, f).cast("string")
    reason = F.concat(F.lit("The feedback has "), f["n"].cast("string"), F.lit(" words."))
    return (F.when(k == 0, F.concat(F.lit("Feedback: "), reason, F.lit(" [RESULT] "), score))
            .when(k == 1, F.concat(F.lit("Notes.\n### "), reason, F.lit("\n[RESULT] "), score))
            .when(k == 2, F.concat(reason, F.lit(" [RESULT] 3 [RESULT] "), score))
            .otherwise(reason))


def judge_wide(df: DataFrame, segment: str, outputs: str, prompt_type: str) -> DataFrame:
    """M18 with the rules backend + F10 + F11 + P11, one row per input row.  The texts are read once, behind a
    one-row generator, so that no dimension's expressions read them again."""
    out = df.select("*", F.inline(F.array(F.struct(judge_features(segment, outputs).alias("_f")))))
    for dim in fixed.JUDGE_DIMENSIONS:
        comp = rules_judge_completion(dim, outputs, F.col("_f"))
        d = dim.lower()
        out = (out.withColumn(f"_{d}", comp)
               .withColumn(f"{d}_feedback", judge_feedback(f"_{d}"))
               .withColumn(f"{d}_score", judge_score(f"_{d}"))
               .withColumn(f"{d}_score_int", score_int(f"{d}_score"))
               .drop(f"_{d}"))
    return out.drop("_f").withColumn("prompt", F.lit(prompt_type))


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def judge_message(dimension: str, segment: str, outputs: str) -> Column:
    """A model's prompt: the JSON of its chat messages (F23), the judge's system message and the rubric."""
    return F.to_json(chat(judge_prompt(dimension, F.col(segment), F.col(outputs)), JUDGE_SYSTEM))


def judge_long(df: DataFrame, key, segment: str, outputs: str) -> DataFrame:
    """(keys..., dimension, prompt) rows for a model backend: the four
    dimensions are a literal array, exploded per row (map-only).  A prompt is
    the JSON of its chat messages (F23): the judge's system message and the rubric."""
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), judge_message(d, segment, outputs).alias("prompt"))
                     for d in fixed.JUDGE_DIMENSIONS])
    return df.select(*_keys(key), F.inline(dims))


def judge_with_model(df: DataFrame, key, segment: str, outputs: str, backend, prompt_type: str) -> DataFrame:
    """M18 with a model: P2 + P10, the four prompts of a distinct (segment, feedback) through ``array_map`` (its texts
    are shuffled once, not once a dimension), F10 + F11, A13 as columns of the row, P11 tag."""
    from .backend import array_map
    rows = judge_input(df, segment, outputs)
    prompts = F.array(*[judge_message(d, segment, outputs) for d in fixed.JUDGE_DIMENSIONS])
    done = array_map(rows.select(*_keys(key), segment, outputs), [segment, outputs], prompts, backend, "_answers")
    return wide_judgements(done, key, "_answers").withColumn("prompt", F.lit(prompt_type))


def wide_judgements(df: DataFrame, key, completions: str) -> DataFrame:
    """A13 for rows that hold the array of their completions, in the order of the dimensions -> (keys..., 8 wide columns
    and parsed ints); a key that repeats keeps its first row, as in ``pivot_judgements``."""
    one = df.groupBy(*_keys(key)).agg(F.first(completions).alias("_c"))
    names = [d.lower() for d in fixed.JUDGE_DIMENSIONS]
    wide = one.select(*_keys(key), *[c for i, d in enumerate(names) for c in (
        judge_feedback(F.col("_c")[i]).alias(f"{d}_feedback"), judge_score(F.col("_c")[i]).alias(f"{d}_score"))])
    return wide.select("*", *[score_int(f"{d}_score").alias(f"{d}_score_int") for d in names])


def pivot_judgements(long: DataFrame, key, completion: str = "completion") -> DataFrame:
    """(keys..., dimension, completion) -> 8 wide columns (+ parsed ints)."""
    parsed = long.select(*_keys(key), "dimension", judge_feedback(completion).alias("feedback"),
                         judge_score(completion).alias("score"))
    wide = parsed.groupBy(*_keys(key)).pivot("dimension", fixed.JUDGE_DIMENSIONS).agg(
        F.first("feedback").alias("feedback"), F.first("score").alias("score"))
    for d in fixed.JUDGE_DIMENSIONS:
        wide = (wide.withColumnRenamed(f"{d}_feedback", f"{d.lower()}_feedback")
                .withColumnRenamed(f"{d}_score", f"{d.lower()}_score")
                .withColumn(f"{d.lower()}_score_int", score_int(f"{d.lower()}_score")))
    return wide
