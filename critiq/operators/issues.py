"""Issue labels, grouping, questions and votes (A1-A3, J1-J4, M5-M7, F8, F9,
F19, F20, P6-P8, P13).

Question sets are cut into blocks of ``BLOCK_ISSUES`` issues; every block is
attached to the segment rows as one array value through a scalar subquery, so
asking every question of every segment is a per-row ``transform`` (no join, no
shuffle) at any number of questions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import (bracket_items, col_of, has_bracket_list, normalize_label,
                              pad_flatten, parse_labels, strip, tokens, vote_code)
from ..sources.dimensions import GENERIC_REASON
from ..session import checkpointed

# issues whose questions make up one array value
BLOCK_ISSUES = 200
# questions mined per issue
N_QUESTIONS = 10


def short_segment(seg) -> Column:
    """Not a string, or shorter than 10 characters after stripping."""
    s = col_of(seg)
    return s.isNull() | (F.length(strip(s)) < fixed.SHORT_SEGMENT_CHARS)


def label_rows(df: DataFrame, key: str, issues_col: str, seg_col: str,
               include_other: bool = False) -> DataFrame:
    """F4 + P6 + P8: parsed label array per row (empty for short segments)."""
    parsed = parse_labels(issues_col, include_other=include_other)
    return df.withColumn("issues", F.when(short_segment(seg_col), F.array().cast("array<string>"))
                         .otherwise(parsed))


def explode_labels(df: DataFrame, key: str, carry=()) -> DataFrame:
    """(key, carried columns..., label_idx, issue) long form, label order kept."""
    return df.select(key, *carry, F.posexplode("issues").alias("label_idx", "issue"))


def issue_segments(labeled: DataFrame, key: str, seg_col: str) -> DataFrame:
    """A1 in full: (issue, pos, key, segment), the segments of every issue in
    order of the key (of any type that orders).  ``pos`` is counted in two steps, so a hot issue is cut into
    Spark's range partitions of the key and never ranked in one task."""
    rows = explode_labels(labeled, key, [seg_col]).filter(F.col("issue") != "")
    rows = checkpointed(rows.repartitionByRange(key).withColumn("_b", F.spark_partition_id()))
    before = Window.partitionBy("issue").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = (rows.groupBy("issue", "_b").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    own = F.row_number().over(Window.partitionBy("issue", "_b").orderBy(key))
    return (rows.withColumn("_own", own).join(start, ["issue", "_b"])
            .select("issue", (F.col("_start") + F.col("_own") - 1).alias("pos"), key, F.col(seg_col).alias("segment")))


def group_by_issue(labeled: DataFrame, key: str) -> DataFrame:
    """A1: per issue, number of segments and first position; partial
    aggregation before the shuffle, so a hot issue costs one row per task."""
    return (explode_labels(labeled, key).filter(F.col("issue") != "")   # P13
            .groupBy("issue").agg(F.count(F.lit(1)).alias("n_segments"),
                                  F.min(key).alias("first_key")))


def supported(groups: DataFrame, min_support: int = fixed.MIN_SUPPORT,
              count_col: str = "n_segments") -> DataFrame:
    """A3: issues with more than ``min_support`` segments (rule B15: support
    counts segments)."""
    return groups.filter(F.col(count_col) > min_support)


def top_segments(labeled: DataFrame, key: str, k: int = fixed.TOP_SEGMENTS_PER_ISSUE, carry=()) -> DataFrame:
    """A2: the first k segments (by position) of each issue.  ``row_number <=
    k`` is planned as a window group limit, so each task keeps k rows per
    issue before the shuffle."""
    w = Window.partitionBy("issue").orderBy(key)
    return (explode_labels(labeled, key, carry).filter(F.col("issue") != "")
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def with_supported_issue(labeled: DataFrame, issues: DataFrame, key: str, carry=()) -> DataFrame:
    """Rows with at least one of ``issues`` (column issue), as (key, carried
    columns..., issues); a semi join on the exploded labels, whatever the size
    of the vocabulary."""
    cols = [key, *carry, "issues"]
    rows = labeled.select(*cols, F.monotonically_increasing_id().alias("_row"))      # rows may repeat the key
    long = rows.select(*cols, "_row", F.explode("issues").alias("issue")).join(issues.select("issue"), "issue", "left_semi")
    return long.dropDuplicates(["_row"]).select(*cols)


def template_key_norm(c) -> Column:
    """J3 key cleaning: F1, then any leading non-word characters (an emoji
    after the prefix)."""
    return F.regexp_replace(normalize_label(c), r"(?U)^\W+", "")


def attach_rationale(issues: DataFrame, rationale: DataFrame) -> DataFrame:
    """Left join on the 24-row rationale; empty or missing -> generic."""
    return (issues.join(F.broadcast(rationale), "issue", "left")
            .withColumn("reason", F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit(GENERIC_REASON))))


def attach_templates(issues: DataFrame, templates: DataFrame) -> DataFrame:
    """Left join on the cleaned template key (22 rows, broadcast)."""
    t = templates.withColumn("issue", template_key_norm("template_key"))
    return issues.join(F.broadcast(t), "issue", "left")


def missing_templates(issues: DataFrame, templates: DataFrame) -> DataFrame:
    """The issues that no template's cleaned key matches."""
    t = templates.select(template_key_norm("template_key").alias("issue"))
    return issues.join(F.broadcast(t), "issue", "left_anti")


# --- question mining (M5): rules backend + parse (F9) --------------------------------

def frequent_words(segments: DataFrame, issue: str = "issue", text: str = "text", k: int = N_QUESTIONS - 1) -> DataFrame:
    """(issue, keywords): the ``k`` words that occur most often in the whole
    texts of an issue's selected segments (ties: code point order)."""
    words = segments.select(issue, F.explode(tokens(F.lower(col_of(text)))).alias("w"))
    words = words.withColumn("w", F.replace("w", F.lit("'"), F.lit(""))).filter("w <> ''")
    w = Window.partitionBy(issue).orderBy(F.desc("n"), "w")
    top = (words.groupBy(issue, "w").agg(F.count(F.lit(1)).alias("n"))
           .withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k))
    return top.groupBy(issue).agg(F.array_sort(F.collect_list(F.struct("r", "w"))).alias("_k")).select(
        issue, F.transform("_k", lambda x: x["w"]).alias("keywords"))


def rules_question_completion(issue, keywords) -> Column:
    """Rules backend for M5: a bracketed list of up to 10 quoted questions.  The
    first question quotes the label, so a label containing ']' cuts the list
    exactly as the original parser would (rule B27)."""
    qs = F.concat(F.array(F.concat(F.lit("Does the segment justify '"), col_of(issue), F.lit("'?"))),
                  F.transform(F.slice(col_of(keywords), 1, N_QUESTIONS - 1),
                              lambda w: F.concat(F.lit("Does the segment use the word '"), w, F.lit("'?"))))
    return F.concat(F.lit("Questions: ["),
                    F.array_join(F.transform(qs, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "),
                    F.lit("]"))


def mine_questions(segments: DataFrame, rationale: DataFrame, backend, issue: str = "issue", rank: str = "rank",
                   text: str = "text", store=None) -> DataFrame:
    """M5 with a model: (issue, completion) from the mining prompt over label,
    reason (J2) and the selected segments in order; with ``store`` only unseen prompts are sent."""
    from ..functions.prompts import render
    from .backend import model_map
    per = (segments.groupBy(issue).agg(F.array_sort(F.collect_list(F.struct(rank, text))).alias("_s"))
           .select(issue, F.array_join(F.transform("_s", lambda x: x[text]), "\n").alias("segments")))
    per = attach_rationale(per, rationale).withColumn(
        "prompt", render("question_mining", issue=issue, reason="reason", segments="segments"))
    return model_map(per.select(issue, "prompt"), "prompt", backend, "completion", keep_prompt=False, store=store)


def parse_questions(completions: DataFrame, issue_col: str = "issue", text_col: str = "completion") -> DataFrame:
    """F9 + posexplode: (issue, q_idx, question); issues whose completion has
    no bracketed list are absent."""
    return (completions.filter(has_bracket_list(text_col))
            .select(issue_col, F.posexplode(bracket_items(text_col)).alias("q_idx", "question")))


def question_table(completions: DataFrame, order: DataFrame, issue_col: str = "issue",
                   text_col: str = "completion") -> DataFrame:
    """F9 over mining completions -> (issue, issue_idx, q_idx, question,
    keyword).  Issues are numbered in ``order_key`` order over every issue
    whose completion has a bracketed list; one whose list holds no quoted
    item keeps its slot with a NULL question (its votes are all padding)."""
    from pyspark.sql import Window
    with_list = (completions.filter(has_bracket_list(text_col))
                 .select(issue_col, bracket_items(text_col).alias("_items"))
                 .join(order, issue_col))
    # bounded dimension (one row per issue): a global window is fine here
    w = Window.orderBy("order_key", issue_col)
    numbered = with_list.withColumn("issue_idx", (F.dense_rank().over(w) - 1).cast("int"))
    return (numbered.select(issue_col, "issue_idx", F.posexplode_outer("_items").alias("q_idx", "question"))
            .withColumn("q_idx", F.col("q_idx").cast("int"))
            .withColumn("keyword", keyword_of("question")))


def keyword_of(question) -> Column:
    """Keyword the rules vote backend looks for: the quoted word of a
    question, else the label quoted in it."""
    return F.lower(F.regexp_extract(col_of(question), r"'([^']*)'", 1))


# --- voting (J4, M6, F8, M7, F19) ---------------------------------------------------------

def question_blocks(questions: DataFrame) -> list:
    """The question table as sorted array values (scalar subqueries), one per
    ``BLOCK_ISSUES`` issues; the number of blocks is one count on the driver."""
    last = questions.agg(F.max("issue_idx")).first()[0]
    n_blocks = 0 if last is None else last // BLOCK_ISSUES + 1
    arr = F.array_sort(F.collect_list(F.struct(
        F.col("issue_idx").cast("int").alias("issue_idx"), F.col("q_idx").cast("int").alias("q_idx"),
        F.col("question"), F.col("keyword"))))
    block = F.floor(F.col("issue_idx") / BLOCK_ISSUES)
    return [questions.filter(block == k).select(arr.alias("qs")).scalar() for k in range(n_blocks)]


def question_width(questions: DataFrame) -> Column:
    """The most questions that any issue of the set has."""
    return questions.select(F.coalesce(F.max("q_idx") + 1, F.lit(0))).scalar()


def segment_vote_features(segment) -> Column:
    """Per-segment inputs of the rules vote backend, computed once per row."""
    s = col_of(segment)
    return F.struct(F.lower(s).alias("_low"), s.contains("!").alias("_bang"), F.length(s).alias("_n"))


def rules_vote_completion(seg, q) -> Column:
    """Rules backend for M6: answers in the formats a model produces.
    ``seg`` is the struct of ``segment_vote_features``."""
    n = seg["_n"]
    return (F.when(seg["_low"].contains(q["keyword"]), F.lit("[[Yes]]"))
            .when(seg["_bang"], F.lit("I cannot tell"))
            .when(n < 300, F.lit("[[Other]]"))
            .when(n % 2 == 0, F.lit("NO"))
            .otherwise(F.lit("[[No]]")))


def vote_vectors(segments: DataFrame, key: str, seg_col: str, questions: DataFrame,
                 mode: str = "substring") -> DataFrame:
    """M6 + M7 + F19 with the native rules backend: every question of every
    segment, coded, nested per issue (issue order, then question order),
    padded per row and flattened.

    The nesting is built in one pass over the question array, so each vote is
    computed once.  The per-segment inputs (lower-cased text, flags) sit
    behind a one-row generator: a column computed in a projection and read
    inside a lambda of the next one would otherwise be inlined into the lambda
    and recomputed for every question."""
    blocks = question_blocks(questions)
    segments = segments.select(key, *[b.alias(f"_q{k}") for k, b in enumerate(blocks)],
                               F.inline(F.array(F.struct(segment_vote_features(seg_col).alias("_sf")))))
    sf = F.col("_sf")

    def votes(qs):
        issue_ids = F.array_distinct(F.transform(qs, lambda q: q["issue_idx"]))
        return F.transform(issue_ids, lambda i: F.transform(
            F.filter(qs, lambda q: (q["issue_idx"] == i) & q["question"].isNotNull()),
            lambda q: vote_code(rules_vote_completion(sf, q), mode)))

    nested = F.concat(*[votes(F.col(f"_q{k}")) for k in range(len(blocks))]) if blocks else F.array().cast("array<array<int>>")
    return (segments.select(key, nested.alias("feature_vectors"), question_width(questions).alias("_w"))
            .withColumn("features", pad_flatten("feature_vectors", F.col("_w"))).drop("_w"))


def vote_with_model(segments: DataFrame, key: str, seg_col: str, questions: DataFrame, backend) -> DataFrame:
    """M6 + F8 + M7 + F19 with a model.  A distinct text goes to Python once,
    with the array of its questions; the worker renders the vote prompts of all
    of them and returns the answers in order, so neither text x question rows
    nor answers are shuffled.  Votes are re-assembled in the row."""
    from ..functions.prompts import PROMPTS, fill
    from .backend import list_map
    blocks = question_blocks(questions)
    qs = F.concat(*blocks) if blocks else F.array().cast("array<struct<issue_idx:int,q_idx:int,question:string,keyword:string>>")
    asked = F.transform(F.filter("_qs", lambda q: q["question"].isNotNull()), lambda q: q["question"])
    assert "yes_no_vote" in PROMPTS
    rows = segments.select(key, F.col(seg_col).alias("_t"), qs.alias("_qs")).withColumn("_asked", asked).drop("_qs")
    rows = list_map(rows, "_t", "_asked", backend, "_answers",
                    lambda text, question: fill("yes_no_vote", segment=text or "", question=question or ""))
    rows = rows.select(key, "_answers", qs.alias("_qs"))         # behind the join: the set is never shuffled with each row
    held = F.filter("_qs", lambda q: q["question"].isNotNull())
    coded = F.transform(F.arrays_zip(held.alias("q"), F.col("_answers").alias("a")), lambda z: F.struct(
        z["q"]["issue_idx"].alias("issue_idx"), vote_code(z["a"]).alias("vote")))
    rows = rows.select(key, F.array_distinct(F.transform("_qs", lambda q: q["issue_idx"])).alias("_ids"), coded.alias("_v"))
    nested = F.transform("_ids", lambda i: F.transform(F.filter("_v", lambda v: v["issue_idx"] == i), lambda v: v["vote"]))
    return (rows.select(key, nested.alias("feature_vectors"), question_width(questions).alias("_w"))
            .withColumn("features", pad_flatten("feature_vectors", F.col("_w"))).drop("_w"))


def votes_to_vectors(votes: DataFrame, key: str, slots: DataFrame = None, width=None) -> DataFrame:
    """M7 for a long vote table (key, issue_idx, q_idx, vote), e.g. the output
    of a model backend: sort explicitly, never rely on collect order.
    ``slots`` (key, issue_idx) keeps issues that were asked no question as
    empty inner lists, as the original does."""
    per_issue = (votes.groupBy(key, "issue_idx")
                 .agg(F.array_sort(F.collect_list(F.struct("q_idx", "vote"))).alias("_q"))
                 .select(key, "issue_idx", F.transform("_q", lambda x: x["vote"]).alias("v")))
    if slots is not None:
        per_issue = (slots.join(per_issue, [key, "issue_idx"], "left")
                     .withColumn("v", F.coalesce("v", F.array().cast("array<int>"))))
    return (per_issue.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("issue_idx", "v"))).alias("_i"))
            .select(key, F.transform("_i", lambda x: x["v"]).alias("feature_vectors"))
            .withColumn("features", pad_flatten("feature_vectors", width)))
