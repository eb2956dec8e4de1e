"""Feedback generation and selection
with the native ``template`` backend.

A pair (segment, issue) is one row, and its candidates are what stands before
and after the filled template (at most a few dozen): building, scoring (F18),
selecting (W3, W4), crossing over and appending (U1) are one Arrow batch function
on the row, so no candidate text is ever shuffled, sorted or checkpointed, and
only the chosen ones are written out as texts.

The ``template`` backend is a deterministic generator: it fills the template
placeholder with the segment (F21) and varies the wording by candidate id.
The same operators over a user's model are in ``operators.generate``.
"""
from __future__ import annotations

import hashlib
import math
import re
from typing import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import fixed
from ..functions.pystats import best_first, round9, scorer
from ..functions.scoring import gumbel
from ..functions.text import col_of, split_sentences

# our own wording: openings and closings the template backend varies over
OPENINGS = ["", "Hello reviewer. "]
CLOSINGS = ["", " Thanks for the careful reading.", " Please add one concrete example!",
            " Could you cite the prior work you have in mind?", " Nice work on the summary, but be specific."]
REFINEMENTS = [" Be specific.", " Give one reference.", " Keep it short."]
# pairs whose candidates a worker holds at once
ROWS = 256


def fill_template(template, segment) -> Column:
    """replace the placeholder with the segment."""
    return F.replace(col_of(template), F.lit(fixed.TEMPLATE_PLACEHOLDER), col_of(segment))


def knowledge_context(knowledge, summary, abstract) -> Column:
    """the context a template asks for (summary, abstract, both, or none)."""
    k = col_of(knowledge)
    return F.concat_ws("\n", F.when(k.contains("Paper summary"), col_of(summary)),
                       F.when(k.contains("Abstract"), col_of(abstract)))


def _pick(options: Sequence[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (idx % len(options)).cast("int") + 1)


def template_candidate(base, cand_id) -> Column:
    """Template backend: candidate ``cand_id`` of a filled template."""
    c = col_of(cand_id)
    return F.concat(_pick(OPENINGS, F.floor(c / len(CLOSINGS))), col_of(base), _pick(CLOSINGS, c))


def template_one_pass(segment, issue) -> Column:
    return F.concat(F.lit("Regarding '"), col_of(issue), F.lit("': please support the point \""),
                    col_of(segment), F.lit("\" with evidence."))


def template_plan(issue, knowledge) -> Column:
    """M8 with the template backend: a plan naming the knowledge source."""
    return F.concat(F.lit("knowledge_source: "), F.coalesce(col_of(knowledge), F.lit("Template")),
                    F.lit("; justification: the issue is '"), col_of(issue), F.lit("'."))


def template_refine(text, step) -> Column:
    return F.concat(col_of(text), _pick(REFINEMENTS, col_of(step)))


def template_crossover(parents) -> Column:
    """M10 with the template backend: the best parent plus the last sentence
    of every other one (parents sorted by rank)."""
    p = col_of(parents) if isinstance(parents, str) else parents
    rest = F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
                       lambda x: F.element_at(split_sentences(x["text"]), -1))
    return F.array_join(F.concat(F.array(p[0]["text"]), rest), " ")


def candidates(n: int, base: str = "base") -> Column:
    """``n`` candidates of a pair as array<struct<cand_id, text>>."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.struct(
        c.alias("cand_id"), template_candidate(F.col(base), c).alias("text")))


def argmax_first(cands: DataFrame, keys: Sequence[str], score: str = "fitness",
                 cand: str = "cand_id", cols: Sequence[str] = ("text",)) -> DataFrame:
    """Per key, the candidate with the highest score; ties -> lowest
    candidate id (``np.argmax``).  Partial aggregation keeps one row per key
    per task before the shuffle, so a hot key costs nothing extra."""
    best = F.max_by(F.struct(F.col(cand), F.col(score), *[F.col(c) for c in cols]),
                    F.struct(F.round(score, 9), -F.col(cand)))
    out = cands.groupBy(*keys).agg(best.alias("_b"))
    return out.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [cand, score, *cols]])


def boltzmann_parents(pop: DataFrame, keys: Sequence[str], n_parents: int, tau: float,
                      seed: int, generation) -> DataFrame:
    """Draw ``n_parents`` without replacement with p ~ exp(f / tau), as a
    Gumbel top-k: rank by f/tau + Gumbel noise (seeded by pair, generation and
    candidate).  Same distribution as sequential draws; fewer candidates than
    parents returns all of them (rule B22)."""
    g = gumbel(F.lit(seed), *[F.col(k) for k in keys], F.lit(generation), F.col("cand_id"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_key"), "cand_id")
    return (pop.withColumn("_key", F.round(F.col("fitness"), 9) / F.lit(tau) + g)
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_parents).drop("_key"))


def parents_in_row(pop, keys: Sequence[str], n_parents: int, tau: float, seed: int, generation: int) -> Column:
    """W4 inside the row (see ``boltzmann_parents``): the first ``n_parents`` by
    f/tau + Gumbel noise, as array<struct<cand_id, text>>."""
    def keyed(c):
        g = gumbel(F.lit(seed), *[F.col(k) for k in keys], F.lit(generation), c["cand_id"])
        return F.struct((-(F.round(c["fitness"], 9) / F.lit(tau) + g)).alias("k"), c["cand_id"].alias("cand_id"),
                        c["text"].alias("text"))
    return F.slice(F.sort_array(F.transform(pop, keyed)), 1, n_parents)


def _wording(c: int) -> tuple:
    """``template_candidate`` in a worker: what stands before and after the base."""
    return OPENINGS[c // len(CLOSINGS) % len(OPENINGS)], CLOSINGS[c % len(CLOSINGS)]


_SENTENCES = re.compile(r".*[.!?]\s+", re.S)


def _last_sentence(text: str) -> str:
    """The last entry of ``split_sentences``."""
    found = _SENTENCES.match(text)
    return text[found.end():] if found else text


def _drawn(pop: list, n_parents: int, tau: float, draw: str) -> list:
    """W4 in a worker (see ``parents_in_row``) over (cand_id, fitness, ...)."""
    def key(c):
        u = (int(hashlib.md5(f"{draw}|{c[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 4503599627370496.0
        return (c[1] is not None, 0.0 if c[1] is None else -(round9(c[1]) / tau + -math.log(-math.log(u))), c[0])
    return sorted(pop, key=key)[:n_parents]


def in_batches(df: DataFrame, keys: Sequence[str], inputs: Sequence, work: Callable, found: str) -> DataFrame:
    """(keys..., ``found``...): ``work`` gets the inputs (as strings) of up to ``ROWS`` rows, a list of tuples, and gives a
    list of tuples for each of them.  Only the keys and the inputs cross into Python, the keys as Arrow columns that
    are never read."""
    names = [f"_in{i}" for i in range(len(inputs))]
    rows = df.select(*keys, *[col_of(c).cast("string").alias(n) for c, n in zip(inputs, names)])
    made = StructType.fromDDL(found)
    schema, n_keys, types = StructType([*rows.select(*keys).schema.fields, *made.fields]), len(keys), to_arrow_schema(made)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                of, out = [], []
                for i, got in enumerate(work([*zip(*(part.column(n_keys + k).to_pylist() for k in range(len(names))))])):
                    of.extend([i] * len(got))
                    out.extend(got)
                if out:
                    cols = [pa.array(list(v), t.type) for v, t in zip(zip(*out), types)]
                    yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(of, pa.int32())) for k in range(n_keys)] + cols,
                                                     names=schema.names)

    return rows.mapInArrow(run, schema)


def evolve(pairs: DataFrame, keys: Sequence[str], template: str = "template", base: str = "base", segment: str = "segment",
           n_candidates: int = fixed.N_CANDIDATES, n_generations: int = fixed.N_GENERATIONS,
           n_parents: int = fixed.N_PARENTS, tau: float = fixed.TAU, seed: int = fixed.SEED) -> DataFrame:
    """Initial population, then per generation select parents (W4),
    cross over (M10) and append the child (U1); the best candidate at the end
    (W3).  The population (``n_candidates`` + ``n_generations`` items at most) is
    a list about the pair's row from beginning to end: map-only."""
    draw = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])      # as in ``gumbel``

    def row(template, base, draw):
        if base is None:                          # children of missing texts are empty
            return [(n_candidates, 0.0, "") if n_generations and template is not None else (0, None, None)]
        s = scorer("" if template is None else template)
        own = s.summarise(base)

        def member(c, before, after):
            return (c, s.fitness(s.wrapped(before, own, after), -1) if template is not None else None, before, after)

        pop = [member(c, *_wording(c)) for c in range(n_candidates)]
        for g in range(n_generations):
            parents = _drawn(pop, n_parents, tau, f"{draw}|{g}")
            best, *rest = parents
            texts = [_last_sentence(before + base + after) for _, _, before, after in rest]
            pop.append(member(n_candidates + g, best[2], " ".join([best[3], *texts])))
        c, fitness, before, after = best_first(pop)
        return [(c, fitness, before + base + after)]

    return in_batches(pairs, keys, [template, base, draw], lambda rows: [row(*x) for x in rows],
                      "cand_id int, fitness double, text string")


def best_of_n(pairs: DataFrame, keys: Sequence[str], template: str = "template", base: str = "base",
              n: int = fixed.BON_N, n_gen: int = fixed.BON_GEN) -> DataFrame:
    """N * n_gen candidates, best by baseline fitness (+ length)."""
    return _only(pairs, keys, "BoN", template, base, n, n_gen)


def self_refine(pairs: DataFrame, keys: Sequence[str], template: str = "template", base: str = "base",
                n: int = fixed.BON_N, n_gen: int = fixed.BON_GEN) -> DataFrame:
    """N drafts, each refined n_gen times in sequence, best by fitness."""
    return _only(pairs, keys, "Self-Ref.", template, base, n, n_gen)


def _only(pairs, keys, strategy, template, base, n, n_gen):
    return baselines(pairs, keys, template, base, strategies=[strategy], n=n, n_gen=n_gen).drop("strategy")


def baselines(pairs: DataFrame, keys: Sequence[str], template: str = "template", base: str = "base",
              segment: str = "segment", issue: str = "issue", knowledge: str = "knowledge",
              strategies: Sequence[str] = fixed.BASELINES, n: int = fixed.BON_N,
              n_gen: int = fixed.BON_GEN) -> DataFrame:
    """For every chosen strategy its candidates, F18 (baseline sign)
    and W3, all inside the pair's row -> (keys..., strategy, cand_id, fitness,
    text), one row per strategy (U2)."""
    names = [x for x in fixed.BASELINES if x in strategies]
    inputs = [template, base, segment if "1-pass" in names else F.lit(None),
              issue if {"1-pass", "Plan"} & set(names) else F.lit(None), knowledge if "Plan" in names else F.lit(None)]

    def row(template, base, segment, issue, knowledge):
        s = scorer("" if template is None else template)
        quoted = None if segment is None else s.summarise(segment)
        own = None if base is None else s.around(base, segment, quoted)

        def best(cands, text, summary):
            """The first of (cand_id, before, after) around a text; all of a missing text are missing."""
            if text is None:
                return (0, None, None)
            if template is None:
                return (0, None, cands[0][1] + text + cands[0][2])
            c, fitness, before, after = best_first([(c, s.fitness(s.wrapped(x, summary, y), 1), x, y) for c, x, y in cands])
            return (c, fitness, before + text + after)

        def one_pass():
            if issue is None:
                return (0, None, None)
            return best([(0, f"Regarding '{issue}': please support the point \"", "\" with evidence.")], segment, quoted)

        def plan():
            said = None if issue is None else (f"knowledge_source: {'Template' if knowledge is None else knowledge}; "
                                               f"justification: the issue is '{issue}'.")
            if base is None:
                return best([(0, "", "")], said or "", s.summarise(said or ""))
            return best([(0, "" if said is None else said + " ", "")], base, own)

        def refined(c):
            before, after = _wording(c)
            return (c, before, after + "".join(REFINEMENTS[(c + step) % len(REFINEMENTS)] for step in range(n_gen)))

        made = {"1-pass": one_pass, "Temp": lambda: best([(0, *_wording(0))], base, own), "Plan": plan,
                "BoN": lambda: best([(c, *_wording(c)) for c in range(n * n_gen)], base, own),
                "Self-Ref.": lambda: best([refined(c) for c in range(n)], base, own)}
        return [(name, *made[name]()) for name in names]

    return in_batches(pairs, keys, inputs, lambda rows: [row(*x) for x in rows],
                      "strategy string, cand_id int, fitness double, text string")
