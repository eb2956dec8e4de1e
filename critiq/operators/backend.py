"""Model map (M0): prompts -> completions with a user-supplied batch function.

A backend is any ``Callable[[list[str]], list[str]]`` or a zero-argument
factory returning one (``BackendFactory``); the factory runs once per Python
worker, so a model is loaded once per process, not per batch.  Prompts
travel as Arrow batches (``mapInPandas``); the batch size is Spark's
``spark.sql.execution.arrow.maxRecordsPerBatch``.

Filters must be applied before ``model_map``: Catalyst does not push
predicates through a Python operator.  Only the key and prompt columns cross
into Python; results are joined back on the key.
"""
from __future__ import annotations

import uuid
from itertools import islice
from typing import Callable, Iterable, Iterator, List, Optional, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Backend = Callable[[List[str]], List[str]]

_CACHE: dict = {}
# prompts in one call of a backend (list_map, array_map, sample_map), and the characters after which a call is made anyway
BATCH = 256
BATCH_CHARS = 4 << 20


class BackendFactory:
    """Wraps a zero-argument constructor so the backend is built once per
    worker process.  The cache is keyed by a token of this factory, not by its
    name: two factories may share a name."""

    def __init__(self, name: str, make: Callable[[], Backend]):
        self.name, self.make, self.token = name, make, uuid.uuid4().hex

    def get(self) -> Backend:
        fn = _CACHE.get(self.token)
        if fn is None:
            fn = _CACHE[self.token] = self.make()
        return fn


def resolve(backend) -> Backend:
    return backend.get() if isinstance(backend, BackendFactory) else backend


def model_map(df: DataFrame, prompt: str, backend, out: str = "completion",
              keys: Optional[Sequence[str]] = None, dedupe: bool = True, seed: Optional[str] = None,
              keep_prompt: bool = True, materialize: bool = True, store=None) -> DataFrame:
    """M0: add ``out`` = backend(prompt) to every row.

    With ``dedupe`` each distinct prompt is sent once (duplicate segments ask
    the same question once).  Prompts are keyed by SHA-256: the distinct step
    ships each prompt text once, and the completions are joined back on the
    key, so the join moves (row, key) and (key, completion), never the prompt
    text twice; ``keep_prompt=False`` also drops the prompt from the rows
    before that join.  Without ``dedupe``, ``keys`` plus the prompt cross
    into Python.  With ``seed`` (an integer column, e.g. the candidate id)
    the backend is called as ``fn(prompts, seeds)`` so a sampling model draws
    different candidates for the same prompt; de-duplication is then on
    (prompt, seed).

    With ``materialize`` (default) the completions are checkpointed as soon
    as they exist: model calls are the expensive step, and a sampling model
    may answer differently when a lost partition is recomputed, so they are
    made once and read back from the shared checkpoint folder afterwards.

    With ``store`` (a ``CompletionStore``; needs ``dedupe``) only prompts that no
    earlier run has stored are sent, and their completions are stored."""
    if store is not None and not dedupe:
        raise ValueError("a store of completions needs dedupe")
    from ..session import checkpointed
    keep = checkpointed if materialize else (lambda d: d)
    if dedupe:
        jk = ["_h"] + ([seed] if seed else [])
        keyed = df.withColumn("_h", F.sha2(F.col(prompt), 256))
        distinct = (keyed.filter(F.col(prompt).isNotNull())
                    .select(*jk, prompt).dropDuplicates(jk))
        ask = lambda d: _map_prompts(d.select(*jk, prompt), prompt, backend, out, seed).select(*jk, out)
        done = keep(ask(distinct) if store is None else store.complete(distinct, seed, out, ask))
        rows = keyed if keep_prompt else keyed.drop(prompt)
        return rows.join(done, jk, "left").drop("_h")
    cols = list(keys or []) + [prompt] + ([seed] if seed else [])
    return keep(_map_prompts(df.select(*cols), prompt, backend, out, seed))


def _map_prompts(df: DataFrame, prompt: str, backend, out: str, seed: Optional[str] = None) -> DataFrame:
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out, StringType(), True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = resolve(backend)
        for pdf in batches:
            texts = pdf[prompt].fillna("").astype(str).tolist()
            res = fn(texts, pdf[seed].astype("int64").tolist()) if seed else fn(texts)
            if len(res) != len(texts):
                raise ValueError(f"backend returned {len(res)} completions for {len(texts)} prompts")
            pdf[out] = pd.Series(res, index=pdf.index, dtype="object")
            yield pdf

    return df.mapInPandas(run, schema)


def list_map(df: DataFrame, text: str, items: str, backend, out: str, prompt: Callable) -> DataFrame:
    """M0 for several prompts about one text: ``out`` = the completions of
    ``prompt(text, item)`` for every entry of the array column ``items``, in order.

    The distinct (text, items) cross into Python once, keyed by SHA-256; the
    prompts exist only inside the worker, which sends them in batches of
    ``BATCH``.  Completions are checkpointed as in ``model_map``."""
    from ..session import checkpointed
    keyed = df.withColumn("_h", F.sha2(F.to_json(F.struct(text, items)), 256))
    distinct = keyed.select("_h", F.col(text).alias("_text"), F.col(items).alias("_items")).dropDuplicates(["_h"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = resolve(backend)
        for pdf in batches:
            asked = ((h, ([] if x is None else x), t) for h, t, x in zip(pdf["_h"], pdf["_text"], pdf["_items"]))
            yield from _answered(((h, len(x), (prompt(t, i) for i in x)) for h, x, t in asked), fn, out)

    done = checkpointed(distinct.mapInPandas(run, f"_h string, {out} array<string>"))
    return keyed.join(done, "_h", "left").drop("_h")


def array_map(df: DataFrame, inputs: Sequence[str], prompts, backend, out: str) -> DataFrame:
    """M0 for several prompts about one row: ``out`` = the completions of the array ``prompts`` (a column over
    ``inputs``), in order.

    The distinct ``inputs`` are shuffled once, keyed by SHA-256, and the prompts are rendered behind that shuffle, so the
    same long texts are not moved once for every prompt; ``inputs`` are dropped from the rows before the completions,
    which are checkpointed as in ``model_map``, are joined back."""
    from ..session import checkpointed
    keyed = df.withColumn("_h", F.sha2(F.to_json(F.struct(*inputs)), 256))
    distinct = keyed.select("_h", *inputs).dropDuplicates(["_h"]).select("_h", prompts.alias("_prompts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = resolve(backend)
        for pdf in batches:
            lists = ((h, [] if x is None else x) for h, x in zip(pdf["_h"], pdf["_prompts"]))
            yield from _answered(((h, len(x), iter(x)) for h, x in lists), fn, out)

    done = checkpointed(distinct.mapInPandas(run, f"_h string, {out} array<string>"))
    return keyed.drop(*inputs).join(done, "_h", "left").drop("_h")


def _answered(rows: Iterable, fn: Backend, out: str) -> Iterator[pd.DataFrame]:
    """(_h, ``out``) frames of rows (key, number of prompts, iterator of prompts).  The backend is called as soon as ``BATCH``
    prompts or ``BATCH_CHARS`` characters are there, and rows go out ``BATCH`` at a time: however many rows an Arrow batch
    has, only the prompts of one call exist at once."""
    asked: list = []
    answers: list = []
    keys: list = []
    sizes: list = []

    def ask():
        got = fn(asked)
        if len(got) != len(asked):
            raise ValueError(f"backend returned {len(got)} completions for {len(asked)} prompts")
        answers.extend(got)
        asked.clear()

    def frame(n):
        ends = [0]
        for size in sizes[:n]:
            ends.append(ends[-1] + size)
        made = pd.DataFrame({"_h": keys[:n], out: [answers[a:b] for a, b in zip(ends, ends[1:])]})
        del keys[:n], sizes[:n], answers[:ends[-1]]
        return made

    chars = 0
    for key, size, prompts in rows:
        keys.append(key)
        sizes.append(size)
        for p in prompts:
            asked.append(p)
            chars += len(p or "")
            if len(asked) >= BATCH or chars >= BATCH_CHARS:
                ask()
                chars = 0
        if len(keys) >= BATCH:
            if asked:
                ask()
                chars = 0
            yield frame(len(keys))
    if asked:
        ask()
    if keys:
        yield frame(len(keys))


def in_calls(prompts: Iterable, fn: Backend) -> Iterator:
    """The answers to ``prompts`` in order, asked ``BATCH`` prompts or ``BATCH_CHARS`` characters at a time."""
    asked: list = []
    chars = 0

    def answers():
        got = fn(asked)
        if len(got) != len(asked):
            raise ValueError(f"backend returned {len(got)} completions for {len(asked)} prompts")
        return got

    for p in prompts:
        asked.append(p)
        chars += len(p)
        if len(asked) >= BATCH or chars >= BATCH_CHARS:
            yield from answers()
            asked, chars = [], 0
    if asked:
        yield from answers()


def sample_map(df: DataFrame, prompt: str, n: int, backend, out: str) -> DataFrame:
    """M0 for a sampling model: ``out`` = array of ``n`` completions of the prompt,
    drawn with seeds 0 .. n-1 (``fn(prompts, seeds)``).  A distinct prompt is
    shuffled and crosses into Python once, whatever ``n``."""
    from ..session import checkpointed
    keyed = df.withColumn("_h", F.sha2(F.col(prompt), 256))
    distinct = keyed.select("_h", F.col(prompt).alias("_p")).dropDuplicates(["_h"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = resolve(backend)
        for pdf in batches:
            yield from _sampled(pdf["_h"].tolist(), pdf["_p"].fillna("").astype(str).tolist(), n, fn, out)

    done = checkpointed(distinct.mapInPandas(run, f"_h string, {out} array<string>"))
    return keyed.drop(prompt).join(done, "_h", "left").drop("_h")


def _sampled(keys: list, texts: list, n: int, fn: Callable, out: str) -> Iterator[pd.DataFrame]:
    """(_h, ``out``) frames, one for each call of the backend: ``n`` completions of a text may be many times its size."""
    per = max(1, BATCH // max(n, 1))
    for k in range(0, len(texts), per):
        got = [*sampled(keys[k:k + per], texts[k:k + per], n, fn)]
        yield pd.DataFrame({"_h": [h for h, _ in got], out: [x for _, x in got]})


def sampled(keys: Iterable, texts: Iterable, n: int, fn: Callable) -> Iterator:
    """(key, ``n`` completions) of each text, asked as many texts at a time as make ``BATCH`` prompts."""
    rows, per = zip(keys, texts), max(1, BATCH // max(n, 1))
    while part := [*islice(rows, per)]:
        got = fn([t for _, t in part for _ in range(n)], list(range(n)) * len(part))
        if len(got) != n * len(part):
            raise ValueError(f"backend returned {len(got)} completions for {n * len(part)} prompts")
        for i, (key, _) in enumerate(part):
            yield key, got[i * n:(i + 1) * n]
