"""Group-aware splits.

The original re-filters the whole table once per trial.  Here the rows are
aggregated once to per-(group, label) counts; trials only touch that small
table: each trial ranks the groups by a seeded uniform, and the label
prevalences of the test side are sums over those counts.  Train-side sums are
totals minus test sums, so no trial ever rescans rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.scoring import det_uniform
from ..session import checkpointed


def group_label_counts(df: DataFrame, group: str, labels: str):
    """Per-group row counts and per-(group, label) counts in one aggregation
    (a NULL label stands for the row itself).  The result is small (groups x
    labels) and is read by every trial and several scalar subqueries, so it
    is checkpointed to the shared checkpoint folder: the rows are scanned
    once."""
    cells = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(labels))
    cnt = checkpointed(df.select(group, F.explode(cells).alias("label"))
                       .groupBy(group, "label").agg(F.count(F.lit(1)).alias("n")))
    rows = cnt.filter(F.col("label").isNull()).select(group, F.col("n").alias("n_rows"))
    lab = cnt.filter(F.col("label").isNotNull()).select(group, "label", F.col("n").alias("n_lab"))
    return rows, lab


#: Groups of one trial that one task orders; more are dealt into this many by their uniforms.
RANKED = 4096


def _prevalence_diff(assign: DataFrame, rows: DataFrame, lab: DataFrame, group: str, by: list) -> DataFrame:
    """``_distance`` of the test sides ``assign`` (by..., group)."""
    t_rows = assign.join(rows, group).groupBy(*by).agg(F.sum("n_rows").alias("test_rows"))
    t_lab = assign.join(lab, group).groupBy(*by, "label").agg(F.sum("n_lab").alias("test_lab"))
    return _distance(t_rows, t_lab, rows, lab, by)


def _distance(t_rows: DataFrame, t_lab: DataFrame, rows: DataFrame, lab: DataFrame, by: list) -> DataFrame:
    """A10 + A11: mean over all labels of |train prevalence - test prevalence|
    for every ``by`` key, from the test sides' rows (by..., test_rows) and labels (by..., label, test_lab).

    A label absent from the test side contributes tot_l / train_rows, so
    mean = (sum over test labels of (|p_train - p_test| - tot_l / train_rows)
            + TOT / train_rows) / L
    with L labels carrying TOT label occurrences in total: only the labels a
    test side actually has are touched, and no key x label product is built.
    """
    tot_rows = rows.select(F.sum("n_rows")).scalar()
    tot_lab = lab.groupBy("label").agg(F.sum("n_lab").alias("tot_lab"))
    n_labels = tot_lab.select(F.count(F.lit(1))).scalar()
    tot_occ = tot_lab.select(F.sum("tot_lab")).scalar()
    t_lab = t_lab.join(tot_lab, "label")
    train_rows = F.col("tot_rows") - F.col("test_rows")
    term = (F.abs((F.col("tot_lab") - F.col("test_lab")) / train_rows - F.col("test_lab") / F.col("test_rows"))
            - F.col("tot_lab") / train_rows)
    per_key = t_lab.join(t_rows, by).withColumn("tot_rows", tot_rows).groupBy(*by, "test_rows", "tot_rows") \
        .agg(F.sum(term).alias("_s"))
    keys = t_rows.withColumn("tot_rows", tot_rows).join(per_key.drop("test_rows", "tot_rows"), by, "left")
    return keys.select(*by, ((F.coalesce(F.col("_s"), F.lit(0.0)) + tot_occ / train_rows) / n_labels).alias("diff"))


def stratified_group_split(df: DataFrame, labels: str, group: str, test_size: float = 0.5,
                           n_trials: int = 50, seed: int = fixed.SEED) -> DataFrame:
    """G1: try ``n_trials`` seeded group partitions and keep the one whose
    train/test label prevalences differ least (ties: lowest trial).

    Returns (group, side, trial, diff) for every group; ``side`` is 'test' or
    'train'.  ``n_test = max(1, floor(n_groups * test_size))`` (rule B18)."""
    rows, lab = group_label_counts(df, group, labels)
    n_groups = rows.count()
    if n_groups < 2:
        raise ValueError(f"a group split needs at least 2 groups, got {n_groups} (rule B18)")
    n_test = max(1, int(n_groups * test_size))
    if n_test >= n_groups:
        raise ValueError(f"test_size {test_size} leaves no group for training")
    # one row per group with all its counts: no (group, trial) row is ever shuffled
    own = lab.groupBy(group).agg(F.collect_list(F.struct("label", "n_lab")).alias("_labels"))
    groups = checkpointed(rows.join(own, group, "left"))
    trials = (groups.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))))
              .withColumn("u", det_uniform(F.lit(seed), F.col("trial"), F.col(group))))
    cuts = checkpointed(_nth(trials, n_test, group, max(1, n_groups // RANKED)))
    below = F.struct(F.col("u"), F.col(group)) <= F.struct(F.col("_cut_u"), F.col("_cut_g"))
    test = trials.join(F.broadcast(cuts), "trial").filter(below)       # a row per trial is broadcast
    t_rows = test.groupBy("trial").agg(F.sum("n_rows").alias("test_rows"))
    t_lab = (test.select("trial", F.inline("_labels")).groupBy("trial", "label").agg(F.sum("n_lab").alias("test_lab")))
    diffs = _distance(t_rows, t_lab, rows, lab, ["trial"])
    best = diffs.select(F.min_by(F.struct("trial", "diff"), F.struct(F.round("diff", 9), "trial"))).scalar()
    cut = cuts.join(diffs.select(F.min_by("trial", F.struct(F.round("diff", 9), "trial")).alias("trial")), "trial")
    cut = cut.select(F.struct("_cut_u", "_cut_g")).scalar()
    u = det_uniform(F.lit(seed), best["trial"], F.col(group))
    return rows.select(group, F.when(F.struct(u.alias("_cut_u"), F.col(group).alias("_cut_g")) <= cut, "test").otherwise("train").alias("side"),
                       best["trial"].alias("trial"), best["diff"].alias("diff"))


def _nth(trials: DataFrame, n: int, group: str, buckets: int) -> DataFrame:
    """(trial, _cut_u, _cut_g): the n-th (u, group) of each trial, by distributed selection.  A histogram of
    the uniforms, which every task adds up before the shuffle, names the bucket that holds it; only that
    bucket's rows are ordered."""
    bucket = F.floor(F.col("u") * buckets)
    counts = trials.groupBy("trial", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("trial").orderBy("_b"))
    held = counts.withColumn("_upto", upto).filter((F.col("_upto") >= n) & (F.col("_upto") - F.col("_n") < n))
    held = held.select(F.col("trial"), F.col("_b"), (n - F.col("_upto") + F.col("_n")).alias("_left"))   # one row a trial
    rank = F.row_number().over(Window.partitionBy("trial").orderBy("u", group))
    near = trials.select("trial", "u", group, bucket.alias("_b")).join(F.broadcast(held), ["trial", "_b"])
    return near.withColumn("_rank", rank).filter(F.col("_rank") == F.col("_left")).select(
        "trial", F.col("u").alias("_cut_u"), F.col(group).alias("_cut_g"))


def _ranked(trials: DataFrame, group: str, buckets: int) -> DataFrame:
    """``trials`` with ``rank`` by (u, group) in each trial: numbered within buckets of the uniforms, after the
    counts of the buckets before."""
    dealt = trials.withColumn("_b", F.floor(F.col("u") * buckets))
    counts = dealt.groupBy("trial", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("trial").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("trial", "_b").orderBy("u", group))
    return dealt.withColumn("_own", own).join(counts, ["trial", "_b"]).withColumn("rank", F.col("_before") + F.col("_own"))


def stratified_group_kfold(df: DataFrame, labels: str, group: str, n_splits: int = fixed.CV_FOLDS,
                           n_trials: int = fixed.CV_TRIALS, seed: int = fixed.SEED) -> DataFrame:
    """G2 (our definition; the original calls a function it never defines):
    per trial, groups ranked by a seeded uniform go to fold ``rank mod k``;
    the trial's score is the mean over folds of the fold-vs-rest prevalence
    distance; the best trial (lowest, then lowest id) is kept.

    Returns (group, fold, trial, score)."""
    rows, lab = group_label_counts(df, group, labels)
    trials = (rows.select(group).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))))
              .withColumn("u", det_uniform(F.lit(seed), F.lit("kfold"), F.col("trial"), F.col(group))))
    ranked = _ranked(trials, group, max(1, rows.count() // RANKED))
    folds = ranked.withColumn("fold", ((F.col("rank") - 1) % n_splits).cast("int")).select("trial", group, "fold")
    per_fold = _prevalence_diff(folds, rows, lab, group, ["trial", "fold"])
    score = per_fold.groupBy("trial").agg(F.avg("diff").alias("score"))
    best = score.select(F.min_by(F.struct("trial", "score"), F.struct(F.round("score", 9), "trial"))).scalar()
    return (folds.filter(F.col("trial") == best["trial"])
            .select(group, "fold", "trial", best["score"].alias("score")))


def split_sides(df: DataFrame, assignment: DataFrame, group: str):
    """Rows of the train and of the test groups (semi joins on the group
    key; the assignment has one row per group)."""
    test = assignment.filter(F.col("side") == "test").select(group)
    return df.join(test, group, "left_anti"), df.join(test, group, "left_semi")
