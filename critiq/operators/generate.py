"""Feedback generation with a user's model (M8-M17, M19): every prompt goes
through the model map or, where it quotes a pair's segment, through one pass
over the written pairs that also scores the answers (``baselines``).

``pairs`` holds one row per (segment, issue): the ``keys`` and the columns
``segment, issue, template`` and, where known, ``knowledge, summary, strengths,
abstract`` (missing or null: empty).  A backend answers ``fn(prompts)``; the
sampling steps (candidates, drafts) call ``fn(prompts, seeds)``.
"""
from __future__ import annotations

import json
from typing import Callable, Dict, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import scoring
from ..functions.prompts import fill, render
from ..functions.pystats import best_first, scorer
from ..functions.scoring import let
from ..functions.text import safe_name, tokens
from ..functions.textstats import known, scored
from ..session import checkpointed, removed, shared_path, written
from .backend import in_calls, model_map, resolve, sample_map, sampled
from .feedback import in_batches, knowledge_context, parents_in_row

OPTIONAL = ("knowledge", "summary", "strengths", "abstract")


def _prepared(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in pairs.columns else F.lit("").alias(c) for c in OPTIONAL]
    return pairs.select(*keys, "segment", "issue", "template", *cols)


def _ask(df: DataFrame, name: str, backend, out: str, **cols) -> DataFrame:
    return model_map(df.withColumn("_prompt", render(name, **cols)), "_prompt", backend, out, keep_prompt=False)


def _sample(df: DataFrame, name: str, n: int, backend, out: str, **cols) -> DataFrame:
    return sample_map(df.withColumn("_prompt", render(name, **cols)), "_prompt", n, backend, out)


def _array(texts: Column) -> Column:
    return F.transform(texts, lambda t, i: F.struct(i.cast("int").alias("cand_id"), F.coalesce(t, F.lit("")).alias("text")))


def make_plan(pairs: DataFrame, backend, out: str = "plan") -> DataFrame:
    """M8: which knowledge the feedback should use, with the context that the
    template asks for (F25)."""
    p = pairs.withColumn("_context", knowledge_context("knowledge", "summary", "abstract"))
    return _ask(p, "plan", backend, out, segment="segment", issue="issue", summary="summary", strengths="strengths",
                context="_context", template="template").drop("_context")


# a table of so many rows (row numbers and keys) is sent to every executor
BROADCAST_ROWS = 1 << 19
_MADE = "strategy string, cand_id int, fitness double, text string"


def _once(pairs: DataFrame, keys: Sequence[str], path: str):
    """(rows, repeats, number of repeats): ``pairs`` written once to ``path`` as (keys..., _row, _h, _segment, _issue, _template), and
    the keys of those rows that have the texts of an earlier row, ``_first``.  They are told by their hashes: no
    text is shuffled."""
    texts = [F.col(c).cast("string").alias(f"_{c}") for c in ("segment", "issue", "template")]
    rows = pairs.select(*keys, F.monotonically_increasing_id().alias("_row"), *texts)
    rows = written(rows.withColumn("_h", F.unhex(F.sha2(F.to_json(F.struct("_segment", "_issue", "_template")), 256))), path)
    firsts = rows.groupBy("_h").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeats = rows.select(*keys, "_row", "_h").join(firsts, "_h").filter("_row <> _first").select(*keys, "_row", "_first")
    repeats = written(repeats, shared_path(pairs.sparkSession, "repeats"))
    return rows, repeats, repeats.count()


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _with_repeats(found: DataFrame, keys: Sequence[str], repeats: DataFrame, n: int) -> DataFrame:
    """``found`` (keys..., _row, ...) of the first rows, and the same for the keys of the rows that repeat their texts."""
    if not n:
        return found.drop("_row")
    others = [c for c in found.columns if c not in (*keys, "_row")]
    again = repeats.select(F.col("_first").alias("_row"), F.struct(*keys).alias("_keys"))
    more = found.drop(*keys).join(_small(again, n), "_row").select(*[F.col("_keys")[k].alias(k) for k in keys], *others)
    return found.select(*keys, *others).unionByName(more)


def _scored_texts(texts: Sequence, template, segment, own, sign: int = 1) -> tuple:
    """F18 + W3 in a worker: (cand_id, fitness, text) of the best text."""
    texts = ["" if t is None else t for t in texts]
    if template is None:
        return 0, None, texts[0]
    s = scorer(template)
    return best_first([(c, s.fitness(s.around(t, segment, own), sign), t) for c, t in enumerate(texts)])


def _first_calls(strategies: Sequence[str], backend, n: int, n_gen: int) -> Callable:
    """The calls that read a pair's segment, for the rows (template, segment, issue) of a batch: what 1-pass, Temp and
    BoN choose, the plan of Plan and the drafts of Self-Ref., which are told by their template."""
    one = {"1-pass": "one_pass", "Temp": "template_guided", "Plan": "short_plan"}
    many = {"BoN": ("template_guided", n * n_gen), "Self-Ref.": ("refine_draft", n)}

    def work(rows):
        fn = resolve(backend)
        known = [scorer(t).summarise(x) if t is not None and x is not None else None for t, x, _ in rows]
        out: list = [[] for _ in rows]

        def prompt(name, i):
            template, segment, issue = (x or "" for x in rows[i])
            return fill(name, template=template, segment=segment, issue=issue)

        for name in strategies:
            if name in one:
                for i, a in enumerate(in_calls((prompt(one[name], i) for i in range(len(rows))), fn)):
                    template, segment, _ = rows[i]
                    out[i].append((name, 0, None, a, template or "") if name == "Plan" else
                                  (name, *_scored_texts([a], template, segment, known[i]), None))
            else:
                ask, k = many[name]
                asked = sampled(range(len(rows)), (prompt(ask, i) for i in range(len(rows))), k, fn)
                for i, answers in asked:
                    template, segment, _ = rows[i]
                    out[i] += ([(name, c, None, a, template or "") for c, a in enumerate(answers)] if name == "Self-Ref." else
                               [(name, *_scored_texts(answers, template, segment, known[i]), None)])
        return out

    return work


def _planned(plans: DataFrame, keys: Sequence[str], backend) -> DataFrame:
    """M14's second call, which sees the plan, and its score."""
    p = _ask(plans, "from_plan", backend, "_text", plan="text", template="_template")
    return in_batches(p, [*keys, "_row"], ["_template", "_text"], lambda rows: [
        [("Plan", *_scored_texts([text], template, None, None))] for template, text in rows], _MADE)


def _refined(drafts: DataFrame, keys: Sequence[str], backend, n_gen: int) -> DataFrame:
    """M16's rounds of refinement of each draft, and the best of a pair's."""
    d = drafts.select(*keys, "cand_id", "_template", F.col("text").alias("_text"))
    for _ in range(n_gen):
        d = _ask(d, "refine", backend, "_next", template="_template", feedback="_text").drop("_text").withColumnRenamed("_next", "_text")
    d = d.groupBy(*keys, "_template").agg(F.array_sort(F.collect_list(F.struct("cand_id", "_text"))).alias("_t"))
    d = d.select(*keys, "_template", F.to_json(F.transform("_t", lambda x: F.coalesce(x["_text"], F.lit("")))).alias("_t"))
    return in_batches(d, keys, ["_template", "_t"], lambda rows: [
        [("Self-Ref.", *_scored_texts(json.loads(texts), template, None, None))] for template, texts in rows], _MADE)


def _only(name: str, pairs: DataFrame, keys, backend, **size) -> DataFrame:
    return baselines(pairs, keys, backend, [name], **size).drop("strategy")


def one_pass(pairs: DataFrame, keys: Sequence[str], backend) -> DataFrame:
    """(keys, cand_id, fitness, text)."""
    return _only("1-pass", pairs, keys, backend)


def template_guided(pairs: DataFrame, keys: Sequence[str], backend) -> DataFrame:
    """M13."""
    return _only("Temp", pairs, keys, backend)


def plan_then_generate(pairs: DataFrame, keys: Sequence[str], backend) -> DataFrame:
    """Two chained calls, the second sees the first's plan."""
    return _only("Plan", pairs, keys, backend)


def best_of_n(pairs: DataFrame, keys: Sequence[str], backend, n: int = fixed.BON_N, n_gen: int = fixed.BON_GEN) -> DataFrame:
    """N * n_gen seeded candidates of the template-guided prompt, the best kept."""
    return _only("BoN", pairs, keys, backend, n=n, n_gen=n_gen)


def self_refine(pairs: DataFrame, keys: Sequence[str], backend, n: int = fixed.BON_N, n_gen: int = fixed.BON_GEN) -> DataFrame:
    """N seeded drafts, each refined n_gen times in sequence, the best kept."""
    return _only("Self-Ref.", pairs, keys, backend, n=n, n_gen=n_gen)


def evolve(pairs: DataFrame, keys: Sequence[str], backend, n_candidates: int = fixed.N_CANDIDATES,
           n_generations: int = fixed.N_GENERATIONS, n_parents: int = fixed.N_PARENTS, tau: float = fixed.TAU,
           seed: int = fixed.SEED) -> DataFrame:
    """A plan (M8), candidates from it (M9), then per generation the drawn
    parents (W4) are numbered and joined into the crossover prompt (M10) and the
    child is appended (U1); the best at the end (W3).  The population is an array
    of the pair's row, written once when its candidates are scored; only the model
    map moves rows."""
    p = make_plan(_prepared(pairs, keys), backend)
    p = _sample(p, "candidate", n_candidates, backend, "_texts", segment="segment", template="template", plan="plan")
    p = p.select(*keys, "template", F.array_distinct(tokens("template")).alias("_tt"), "segment", "_texts")
    p = p.select(*keys, "template", "_tt", known("segment", F.col("_tt")).alias("_seg"), "_texts")
    p = p.select(*keys, "_tt", scored(_array(F.col("_texts")), F.col("_tt"), -1, F.col("_seg")).alias("_pop"))
    p = checkpointed(p)        # every generation reads the population twice: its candidates are scored once
    for g in range(n_generations):
        numbered = let(parents_in_row(F.col("_pop"), keys, n_parents, tau, seed, g), lambda ps: F.array_join(F.transform(
            ps, lambda x, i: F.concat(F.lit("Parent "), (i + 1).cast("string"), F.lit(": "), x["text"])), "\n"))
        p = _ask(p.withColumn("_parents", numbered), "crossover", backend, "_child", parents="_parents").drop("_parents")
        child = F.array(F.struct(F.lit(n_candidates + g).alias("cand_id"), F.coalesce("_child", F.lit("")).alias("text")))
        p = p.withColumn("_pop", F.concat("_pop", scored(child, F.col("_tt"), -1))).drop("_child")
    return p.select(*keys, scoring.best_first(F.col("_pop")).alias("_b")).select(*keys, "_b.*")


STRATEGIES: Dict[str, Callable] = {"1-pass": one_pass, "Temp": template_guided, "Plan": plan_then_generate,
                                   "BoN": best_of_n, "Self-Ref.": self_refine}


def baselines(pairs: DataFrame, keys: Sequence[str], backend, strategies: Sequence[str] = fixed.BASELINES,
              n: int = fixed.BON_N, n_gen: int = fixed.BON_GEN) -> DataFrame:
    """(keys, strategy, cand_id, fitness, text) for every chosen strategy.

    The pairs are written once, and one pass over them makes all calls that read a segment, scores the answers where
    they are made (F18, W3) and writes what is chosen: a segment, and the candidates that quote it, are never
    shuffled.  Equal (segment, issue, template) are sent once.  The later calls (M14, M16) see plans and drafts only."""
    spark = pairs.sparkSession
    path = shared_path(spark, "pairs")
    rows, repeats, n_repeats = _once(pairs, keys, path)
    asked = rows.drop("_h")
    if n_repeats:
        asked = asked.join(_small(repeats.select("_row"), n_repeats), "_row", "left_anti")
    calls = _first_calls([x for x in STRATEGIES if x in strategies], backend, n, n_gen)
    made = written(in_batches(asked, [*keys, "_row"], ["_template", "_segment", "_issue"], calls, f"{_MADE}, _template string"),
                   shared_path(spark, "answers"))
    removed(spark, path)
    out = made.filter(~F.col("strategy").isin("Plan", "Self-Ref.")).drop("_template")
    if "Plan" in strategies:
        out = out.unionByName(_planned(made.filter("strategy = 'Plan'").select(*keys, "_row", "text", "_template"), keys, backend))
    out = _with_repeats(out, keys, repeats, n_repeats)
    if "Self-Ref." in strategies:
        drafts = made.filter("strategy = 'Self-Ref.'").select(*keys, "_row", "cand_id", "text", "_template")
        out = out.unionByName(_refined(_with_repeats(drafts, keys, repeats, n_repeats), keys, backend, n_gen))
    return out.select(*keys, "strategy", "cand_id", "fitness", "text")


def sweep(models: Dict[str, object], stage: Callable[[object], DataFrame]) -> DataFrame:
    """``stage(backend)`` for each named model, with its file-safe name
    in ``model`` (the column a partitioned write uses)."""
    out = None
    for name, backend in models.items():
        d = stage(backend).withColumn("model", safe_name(F.lit(name)))
        out = d if out is None else out.unionByName(d)
    return out
