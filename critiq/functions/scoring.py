"""Scoring column builders: fitness (F14-F18), per-row set metrics (F24),
deterministic uniforms for seeded sampling (W4, G1, G2)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import SPACE, col_of, tokens, sentence_marks

__all__ = [
    "length_score", "template_adherence", "reading_ease", "forbidden_count", "forbidden_penalty",
    "fitness", "let", "best_first", "word_count", "syllables", "det_uniform", "gumbel", "sample_prf", "round6",
]


def round6(c) -> Column:
    return F.round(col_of(c).cast("double"), 6)


def length_score(text) -> Column:
    """min(#sentence marks, 5) / 5."""
    return F.least(sentence_marks(text), F.lit(fixed.MAX_SENTENCES)) / F.lit(float(fixed.MAX_SENTENCES))


def let(value, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda variable is never
    inlined into the expressions that read it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def template_adherence(text, template, toks=None, ttoks=None) -> Column:
    """distinct shared tokens / distinct template tokens (at least 1)."""
    t = F.array_distinct(tokens(template)) if ttoks is None else ttoks
    # the hash set is built from the second argument: keep the small template
    # set there and stream the (long) text tokens through it
    return F.size(F.array_intersect(tokens(text) if toks is None else toks, t)) / F.greatest(F.size(t), F.lit(1))


def word_count(text) -> Column:
    """Number of whitespace tokens; the token array is shared with template
    adherence by common-subexpression elimination, so it is split once."""
    return F.size(tokens(text))


def syllables(text, low=None) -> Column:
    """Sum over words of max(1, runs of vowels incl. y).

    Vowel runs never cross whitespace, so this is the number of vowel runs in
    the whole text plus the number of words without any vowel, counted in one
    regex pass: the second alternative starts only at whitespace (or the text
    start) and its possessive run never backtracks, and the two alternatives
    can never match the same characters."""
    s = F.lower(col_of(text)) if low is None else low
    # every match becomes a capital, which lower-cased text does not have, and those are counted
    marked = F.regexp_replace(s, rf"(?U)[aeiouy]+|(?:^|[{SPACE}])[^aeiouy{SPACE}]++(?=[{SPACE}]|\z)", "A")
    return let(marked, lambda m: (F.length(m) - F.length(F.replace(m, F.lit("A"), F.lit("")))).cast("int"))


def reading_ease(text, toks=None, low=None) -> Column:
    """F16: Flesch reading ease, 206.835 - 1.015 w/s - 84.6 syl/w; empty -> 0."""
    n_words = word_count(text) if toks is None else F.size(toks)
    n_sent = F.greatest(sentence_marks(text), F.lit(1))
    return F.when(n_words == 0, F.lit(0.0)).otherwise(
        F.lit(fixed.FLESCH_BASE)
        - F.lit(fixed.FLESCH_WPS) * (n_words / n_sent)
        - F.lit(fixed.FLESCH_SPW) * (syllables(text, low) / n_words))


def forbidden_count(low) -> Column:
    """Occurrences of the forbidden terms as substrings of a lower-cased text."""
    s, total = col_of(low), F.lit(0).cast("long")
    for t in fixed.FORBIDDEN_TERMS:
        total = total + F.floor((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(t), F.lit("")))) / len(t))
    return total


def forbidden_penalty(text, word_bounded: bool = False, toks=None, low=None) -> Column:
    """occurrences of the forbidden terms / max(#words, 1).

    Default counts substrings (so "hi" is found in "this", rule B20); with
    ``word_bounded`` only whole words count."""
    s = F.lower(col_of(text)) if low is None else low
    if word_bounded:
        total = F.lit(0).cast("long")
        for t in fixed.FORBIDDEN_TERMS:
            total = total + F.regexp_count(s, F.lit(r"\b" + t + r"\b"))
    else:
        total = forbidden_count(s)
    return total / F.greatest(word_count(text) if toks is None else F.size(toks), F.lit(1))


def fitness(text, template, length_sign: int = 1, read_scale: float = 1.0,
            word_bounded: bool = False, toks=None, ttoks=None, low=None) -> Column:
    """length_sign*length + adherence + read_scale*reading - penalty.

    The evolutionary search uses ``length_sign=-1``, the baselines ``+1``
    (rule B20); ``read_scale=1`` is the literal raw reading ease.  ``toks``,
    ``ttoks`` and ``low`` are the text's tokens, the template's distinct
    tokens and the lower-cased text where they are known already."""
    return (F.lit(float(length_sign)) * length_score(text)
            + template_adherence(text, template, toks, ttoks)
            + F.lit(float(read_scale)) * reading_ease(text, toks, low)
            - forbidden_penalty(text, word_bounded, toks, low))


def best_first(cands) -> Column:
    """W3 inside the row: the struct of highest fitness; ties -> lowest
    candidate id (``np.argmax``)."""
    return F.array_max(F.transform(cands, lambda c: F.struct(
        F.round(c["fitness"], 9).alias("r"), (-c["cand_id"]).alias("o"), c.alias("c"))))["c"]


def det_uniform(*parts) -> Column:
    """Deterministic uniform in (0, 1) from an md5 of the '|'-joined parts.

    Reproducible across runs, partitionings and engines (the same value comes
    out of DuckDB's md5), unlike ``rand()``."""
    key = F.concat_ws("|", *[col_of(p).cast("string") for p in parts])
    h = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint")
    return ((h.cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)).cast("double")


def gumbel(*parts) -> Column:
    """Gumbel(0,1) noise from ``det_uniform``: -ln(-ln u)."""
    return -F.log(-F.log(det_uniform(*parts)))


def sample_prf(true_set, pred_set):
    """per-row precision, recall, F1 of two label arrays (0 when empty)."""
    t, p = col_of(true_set), col_of(pred_set)
    inter = F.size(F.array_intersect(F.array_distinct(t), F.array_distinct(p)))
    n_p, n_t = F.size(F.array_distinct(p)), F.size(F.array_distinct(t))
    prec = F.when(n_p > 0, inter / n_p).otherwise(F.lit(0.0))
    rec = F.when(n_t > 0, inter / n_t).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return prec, rec, f1
