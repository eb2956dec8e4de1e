"""Sentence tagging and segment assembly.

The chained taggers of the original make every prediction see the previous
*prediction*, so a ``lag`` over inputs is not enough: the tags are an ordered
fold.  The fold runs on an array of sentences that belongs to one review:

* for a document, the sentence array comes from splitting the row's own text,
  so the fold is map-only (no shuffle, no grouping);
* for a review stored as one row per sentence, the rows of one review are
  gathered once (``collect_list`` of small structs, sorted by position).

The fold emits the tag and the running segment number together (W2 fused into
W1), so segment assembly needs no extra window.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import (col_of, split_sentences, tokens, validate_bio,
                              validate_section)

Step = Callable[[Column, Column], Column]

TAGGED = "array<struct<tag:string,seg:int>>"


def is_opener(tag: Column, prev: Column) -> Column:
    """A segment opens at a B, or at an I that follows O or nothing."""
    return (tag == "B") | ((tag == "I") & (prev.isNull() | prev.isin("", "O")))


# items of one slice of a fold
SLICE = 64


def _slices(items) -> Column:
    """An array cut into slices of ``SLICE`` items (empty: no slice)."""
    n = F.size(col_of(items))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(SLICE))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(col_of(items), i + 1, F.lit(SLICE)))


def _fold_two_levels(items, init: Column, merge, empty: Column) -> Column:
    """Fold with one output per item, each slice into a short array of its own:
    an array that grows by one item at a time is copied at every step, so the
    outputs of slices are appended whole and flattened once.

    ``merge(acc, x)`` -> (state fields, output); ``init`` is a struct of the
    state fields; ``empty`` an empty array of outputs."""
    state = init.alias("state")

    def outer(acc, part):
        start = F.struct(acc["state"].alias("state"), empty.alias("out"))
        def inner(a, x):
            st, out = merge(a["state"], x)
            return F.struct(st.alias("state"), F.concat(a["out"], F.array(out)).alias("out"))
        return F.aggregate(part, start, inner, lambda a: F.struct(
            a["state"].alias("state"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    return F.aggregate(_slices(items), F.struct(state, F.array(empty).alias("out")), outer,
                       lambda acc: F.flatten(acc["out"]))


def fold_tags(items, step: Step, init_prev=None, init_seg=None) -> Column:
    """W1+W2: ordered fold of ``step(prev_tag, item) -> tag`` over an array.

    Returns ``array<struct<tag, seg>>`` aligned with ``items``; ``seg`` counts
    segment openers so far (sentences tagged O keep the current count and are
    dropped by ``segments_from_tags``).  ``init_prev``/``init_seg`` start the
    fold mid-review (chunked scan)."""
    p0 = F.lit("") if init_prev is None else col_of(init_prev)
    s0 = F.lit(0) if init_seg is None else col_of(init_seg).cast("int")

    def merge(st, x):
        tag = step(st["prev"], x)
        seg = st["seg"] + is_opener(tag, st["prev"]).cast("int")
        return F.struct(tag.alias("prev"), seg.alias("seg")), F.struct(tag.alias("tag"), seg.alias("seg"))

    return _fold_two_levels(items, F.struct(p0.alias("prev"), s0.alias("seg")), merge, F.array().cast(TAGGED))


def fold_summary(items, step: Step, entry) -> Column:
    """Exit state and number of segment openers of a fold started in state
    ``entry`` (no per-item output: cheap)."""
    init = F.struct(col_of(entry).alias("prev"), F.lit(0).alias("seg"))

    def merge(acc, x):
        tag = step(acc["prev"], x)
        return F.struct(tag.alias("prev"), (acc["seg"] + is_opener(tag, acc["prev"]).cast("int")).alias("seg"))

    return F.aggregate(col_of(items), init, merge)


# --- rules backend taggers (deterministic, native columns) ----------------------

def sentence_features(sentence) -> Column:
    s = col_of(sentence)
    return F.struct(s.alias("text"), F.size(tokens(s)).alias("n_words"),
                    s.endswith("!").alias("bang"), s.contains(",").alias("comma"))


def rules_bio_raw(prev: Column, x: Column) -> Column:
    """Raw completion of the rules BIO tagger (before F7 validation).

    short sentence -> O; first sentence or after O -> B; a long sentence opens
    a new segment; after an I a sentence ending in '!' opens one; else I.
    Junk answers ('b', 'I ') are emitted on purpose so that F7 runs."""
    n = x["n_words"]
    return (F.when(n < 3, F.lit("O"))
            .when(prev.isin("", "O"), F.lit("B "))
            .when(n > 20, F.lit("B"))
            .when((prev == "I") & x["bang"], F.lit("B"))
            .when(x["comma"] & (n < 5), F.lit("i"))   # junk -> O after F7
            .otherwise(F.lit("I")))


def rules_bio_step(prev: Column, x: Column) -> Column:
    return validate_bio(rules_bio_raw(prev, x))


def rules_section_raw(prev: Column, x: Column) -> Column:
    """Raw completion of the rules section tagger: short sentences keep the
    previous section; commas in long sentences mean comments; '!' means
    strengths (data spelling, canonicalised by F6); else weaknesses."""
    n = x["n_words"]
    return (F.when((n < 4) & (prev != ""), prev)
            .when(x["comma"] & (n > 15), F.lit(fixed.SECTION_COMMENTS_PROMPT))
            .when(x["bang"], F.lit(fixed.SECTION_STRENGTHS_DATA))
            .otherwise(F.lit(fixed.SECTION_DEFAULT)))


def rules_section_step(prev: Column, x: Column) -> Column:
    return validate_section(rules_section_raw(prev, x))


# --- documents: in-row tagging ----------------------------------------------------

def tag_document_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text",
                           step: Step = rules_bio_step) -> DataFrame:
    """Split each text into sentences and tag them with the chained tagger;
    one output row per sentence: (key, pos, sentence, tag, seg_id).

    Every document is folded inside its own row: one scan, no shuffle, no
    grouping; the fold's work is linear in the sentences (``_fold_two_levels``)."""
    feats = F.transform(split_sentences(text), sentence_features)
    rows = docs.select(key, feats.alias("f"))
    rows = rows.select(key, "f", fold_tags("f", step).alias("t"))
    return rows.select(key, F.posexplode(F.arrays_zip(F.col("f"), F.col("t"))).alias("pos", "z")).select(
        key, "pos", F.col("z.f.text").alias("sentence"), F.col("z.t.tag").alias("tag"),
        F.col("z.t.seg").alias("seg_id"))


def segments_from_tags(tagged: DataFrame, key: str, pos: str = "pos", seg: str = "seg_id",
                       tag: str = "tag", text: str = "sentence") -> DataFrame:
    """W2 (second half): drop O sentences, join each segment's sentences in
    position order.  Groups on (review, segment), so one long review spreads
    over many groups."""
    return (tagged.filter(F.col(tag) != "O")
            .groupBy(key, seg)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(text)))).alias("_s"))
            .select(key, seg,
                    F.size("_s").alias("n_sentences"),
                    F.col("_s")[0][pos].alias("first_pos"),
                    F.array_join(F.transform("_s", lambda x: x[text]), " ").alias("segment")))


def assign_segments(tags: DataFrame, key: str, pos: str = "pos", tag: str = "tag") -> DataFrame:
    """W2 for an already tagged table (e.g. model output): opener = B, or I
    after O / at the start; segment id = running count of openers."""
    w = Window.partitionBy(key).orderBy(pos)
    prev = F.lag(tag).over(w)
    return (tags.withColumn("_open", is_opener(F.col(tag), prev).cast("int"))
            .withColumn("seg_id", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
            .drop("_open"))


# --- reviews stored one row per sentence -------------------------------------------

BIO_STATES = ["", *fixed.BIO_TAGS]
SECTION_STATES = ["", *fixed.SECTION_NAMES]


def _chain_entries(summ: DataFrame, key: str, idx: str, chains: dict) -> DataFrame:
    """Entry state and segment offset of every chunk of a review, given the
    chunks' summaries (``_s_{chain}``: for each possible entry state, the exit
    state and the number of openers).  One short row per chunk of 1,024
    sentences is chained per review, in linear work.  Returns (key, idx,
    _st_{chain})."""
    names = list(chains)
    out_t = "array<struct<i:bigint,prev:string,seg:int>>"

    def chain_from(n: str) -> Column:
        states = F.array(*[F.lit(x) for x in chains[n]])

        def merge(st, c):
            here = F.element_at(c[f"_s_{n}"], F.array_position(states, st["prev"]).cast("int"))
            return (F.struct(here["prev"].alias("prev"), (st["seg"] + here["seg"]).alias("seg")),
                    F.struct(c["_i"].cast("bigint").alias("i"), st["prev"].alias("prev"), st["seg"].alias("seg")))
        init = F.struct(F.lit("").alias("prev"), F.lit(0).alias("seg"))
        return _fold_two_levels("_c", init, merge, F.array().cast(out_t))

    items = F.struct(F.col(idx).alias("_i"), *[F.col(f"_s_{n}") for n in names])
    per = summ.groupBy(key).agg(F.array_sort(F.collect_list(items)).alias("_c"))
    per = per.select(key, *[chain_from(n).alias(f"_o_{n}") for n in names])
    ex = per.select(key, F.inline(F.arrays_zip(*[f"_o_{n}" for n in names])))
    return ex.select(key, F.col(f"_o_{names[0]}.i").alias(idx), *[
        F.struct(F.col(f"_o_{n}.prev").alias("prev"), F.col(f"_o_{n}.seg").alias("seg")).alias(f"_st_{n}") for n in names])


def chunked_scan(rows: DataFrame, key: str, pos: str, feats: str, chains, chunk_rows: int = 1024) -> DataFrame:
    """W1 for reviews stored one row per sentence, without gathering a whole
    review into one task.

    The taggers are finite-state (each output depends on the previous output
    only), so the fold is a parallel scan in three steps:
      1. rows are cut into chunks of ``chunk_rows`` positions; each chunk is
         folded once per possible entry state (exit state + opener count);
      2. per review, only those small chunk summaries are chained in order to
         find every chunk's real entry state and segment offset;
      3. each chunk is folded once more from its entry state, emitting tags.
    ``chains`` maps an output prefix to (step, states); the result has
    ``{prefix}_tag`` and ``{prefix}_seg`` per row."""
    chunks = (rows.withColumn("_chunk", F.floor(F.col(pos) / chunk_rows))
              .groupBy(key, "_chunk")
              .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(feats).alias("f")))).alias("_r")))
    items = F.transform("_r", lambda x: x["f"])
    def summarize(step):
        return lambda e: fold_summary(items, step, e)
    summ = chunks.select(key, "_chunk", *[
        F.transform(F.array(*[F.lit(st) for st in states]), summarize(step)).alias(f"_s_{name}")
        for name, (step, states) in chains.items()])
    starts = _chain_entries(summ, key, "_chunk", {n: states for n, (_, states) in chains.items()})
    joined = chunks.join(starts, [key, "_chunk"])
    out = joined.select(key, "_r", *[fold_tags(items, step, F.col(f"_st_{n}.prev"), F.col(f"_st_{n}.seg")).alias(f"_t_{n}")
                                     for n, (step, _) in chains.items()])
    z = F.arrays_zip("_r", *[f"_t_{n}" for n in chains])
    ex = out.select(key, F.inline(z))
    cols = [F.col("_r.p").alias(pos)]
    for n in chains:
        cols += [F.col(f"_t_{n}.tag").alias(f"{n}_tag"), F.col(f"_t_{n}.seg").alias(f"{n}_seg")]
    return ex.select(key, *cols)


def tag_review_rows(rows: DataFrame, key: str, pos: str, sentence: str,
                    bio_step: Step = rules_bio_step,
                    section_step: Step = rules_section_step, chunk_rows: int = 1024) -> DataFrame:
    """M3 + M4 (chained) per review -> (key, pos, section_pred, bio_pred,
    seg_id).  Skipped rows must be filtered out before (rule B5: the context is
    the last *processed* row).  A review is never gathered whole: see
    ``chunked_scan``."""
    f = rows.select(key, pos, sentence_features(sentence).alias("_f"))
    t = chunked_scan(f, key, pos, "_f", {"bio": (bio_step, BIO_STATES), "section": (section_step, SECTION_STATES)},
                     chunk_rows)
    return t.select(key, pos, F.col("section_tag").alias("section_pred"), F.col("bio_tag").alias("bio_pred"),
                    F.col("bio_seg").alias("seg_id"))


def tag_rows_independent(rows: DataFrame, sentence: str,
                         bio_step: Step = rules_bio_step,
                         section_step: Step = rules_section_step) -> DataFrame:
    """M1 + M2 (standalone): every sentence tagged on its own (empty context);
    map-only."""
    f = sentence_features(sentence)
    return (rows.withColumn("section_pred", section_step(F.lit(""), f))
            .withColumn("bio_pred", bio_step(F.lit(""), f)))


# --- taggers backed by a user model (M0) -----------------------------------------

def tag_rows_with_model(rows: DataFrame, sentence: str, review: str, backend) -> DataFrame:
    """M1 + M2 with a model: every sentence's two prompts (section text and
    sentence, no context) go through ``model_map`` in Arrow batches, then F6 /
    F7 validate the completions."""
    from ..functions.prompts import render
    from .backend import model_map
    r = (rows.withColumn("_ps", render("section_chained", review=review, context=F.lit(""), sentence=sentence))
         .withColumn("_pb", render("bio_chained", review=review, context=F.lit(""), sentence=sentence)))
    r = model_map(r, "_ps", backend, "_cs")
    r = model_map(r, "_pb", backend, "_cb")
    return (r.withColumn("section_pred", validate_section("_cs")).withColumn("bio_pred", validate_bio("_cb"))
            .drop("_ps", "_pb", "_cs", "_cb"))


def tag_reviews_with_model(rows: DataFrame, key: str, pos: str, sentence: str, review: str, backend) -> DataFrame:
    """M3 + M4 with a model: each prompt carries the previous *prediction*, so
    within one review the calls are sequential by definition; reviews run in
    parallel (``groupBy(review).applyInPandas``).  Validation (F6/F7) is the
    same rule as the native path, applied in the task before the next prompt
    is built.  Returns (key, pos, section_pred, bio_pred)."""
    import pandas as pd
    from ..functions.prompts import fill
    from .backend import BackendFactory

    sec_names, sec_default = list(fixed.SECTION_NAMES), fixed.SECTION_DEFAULT
    alias = {fixed.SECTION_STRENGTHS_DATA: fixed.SECTION_NAMES[0], fixed.SECTION_COMMENTS_PROMPT: fixed.SECTION_NAMES[2]}

    def check_section(x: str) -> str:
        x = alias.get(x.strip(), x.strip())
        return x if x in sec_names else sec_default

    def check_bio(x: str) -> str:
        x = x.strip()
        return x if x in fixed.BIO_TAGS else fixed.BIO_DEFAULT

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fn = backend.get() if isinstance(backend, BackendFactory) else backend
        pdf = pdf.sort_values(pos)
        prev_s, prev_b, secs, bios = "", "", [], []
        for sent, body in zip(pdf[sentence].fillna(""), pdf[review].fillna("")):
            ctx_s = f"Previous label: {prev_s}\n" if prev_s else ""
            ctx_b = f"Previous label: {prev_b}\n" if prev_b else ""
            out = fn([fill("section_chained", review=body, context=ctx_s, sentence=sent),
                      fill("bio_chained", review=body, context=ctx_b, sentence=sent)])
            prev_s, prev_b = check_section(out[0]), check_bio(out[1])
            secs.append(prev_s)
            bios.append(prev_b)
        return pd.DataFrame({key: pdf[key].to_numpy(), pos: pdf[pos].to_numpy(), "section_pred": secs, "bio_pred": bios})

    schema = (f"{key} {rows.schema[key].dataType.simpleString()}, {pos} {rows.schema[pos].dataType.simpleString()}, "
              "section_pred string, bio_pred string")
    return rows.select(key, pos, sentence, review).groupBy(key).applyInPandas(run, schema)
