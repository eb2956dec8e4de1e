"""String, label and tag column builders (operators F1-F13, F19-F20, S8)."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

__all__ = [
    "col_of", "strip", "normalize_label", "split_labels", "parse_labels",
    "clean_gold", "validate_section", "validate_bio", "tokens", "sentence_marks",
    "split_sentences", "vote_code", "bracket_items", "has_bracket_list",
    "judge_feedback", "judge_score", "score_int", "safe_name", "pad_flatten",
    "multi_hot", "first_part", "SENTENCE_SPLIT", "SPACE", "SPACE_LISTED",
]

# What Python's ``str.split()`` and ``str.strip()`` take as whitespace, as the inside of a
# regex character class: for Java under ``(?U)`` (one property test and four separators that
# Unicode does not count), and spelled out for engines without it
SPACE = r"\s\x1C\x1D\x1E\x1F"
SPACE_LISTED = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# sentence boundary: whitespace that follows a sentence mark
SENTENCE_SPLIT = rf"(?U)(?<=[.!?])[{SPACE}]+"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace on both ends (Spark ``trim``
    removes spaces only)."""
    return F.regexp_replace(col_of(c), rf"(?U)^[{SPACE}]+|[{SPACE}]+\z", "")


def normalize_label(c) -> Column:
    """strip, strip quotes/backticks, drop a leading ``H<n>.`` prefix
    (with any non-word characters before it), drop slashes, strip trailing
    ``;``/``,`` and whitespace."""
    s = strip(c)
    s = F.regexp_replace(s, r"^['\"`]+|['\"`]+\z", "")
    s = F.regexp_replace(s, r"(?U)^[\s\W]*H\d+\.\s*", "")
    s = F.regexp_replace(s, r"[\\/]", "")
    s = F.regexp_replace(s, r"[;,]+\z", "")
    return strip(s)


def split_labels(c, phrases: Sequence[str] = fixed.PROTECTED_PHRASES) -> Column:
    """F2 + F3: cut every protected phrase out, split the rest on ``;``/``,``,
    strip, drop empties, append the phrases that were present (in list order),
    then keep the first occurrence of each piece."""
    raw = col_of(c)
    cut = raw
    for p in phrases:
        cut = F.replace(cut, F.lit(p), F.lit(""))
    pieces = F.filter(F.transform(F.split(cut, "[;,]"), strip), lambda x: x != "")
    present = F.filter(
        F.array(*[F.when(raw.contains(p), F.lit(p)) for p in phrases]),
        lambda x: x.isNotNull())
    return F.array_distinct(F.concat(pieces, present))


def parse_labels(c, include_other: bool = False, keep_empty: bool = False,
                 phrases: Sequence[str] = fixed.PROTECTED_PHRASES) -> Column:
    """label string -> ordered, de-duplicated, normalised label array.

    A missing string means ``Other`` (P9).  Labels that normalise to the empty
    string are dropped (rule B9) and duplicates created by normalisation are
    removed (rule B11).  ``Other`` is dropped unless ``include_other`` (P8).
    """
    raw = F.coalesce(col_of(c), F.lit(fixed.OTHER_LABEL))
    labels = F.transform(split_labels(raw, phrases), normalize_label)
    if not keep_empty:
        labels = F.filter(labels, lambda x: x != "")
    labels = F.array_distinct(labels)
    if not include_other:
        labels = F.filter(labels, lambda x: x != fixed.OTHER_LABEL)
    return labels


def clean_gold(c) -> Column:
    """drop double quotes and lower-case."""
    return F.lower(F.replace(col_of(c).cast("string"), F.lit('"'), F.lit("")))


def validate_section(c, strict: bool = False) -> Column:
    """anything outside the accepted section names becomes the default.

    Non-strict (rule B1) first maps the data spelling of the strengths section
    and the comma-less comments spelling offered by the prompts onto the
    accepted names."""
    s = strip(c)
    if not strict:
        s = (F.when(s == fixed.SECTION_STRENGTHS_DATA, F.lit(fixed.SECTION_NAMES[0]))
             .when(s == fixed.SECTION_COMMENTS_PROMPT, F.lit(fixed.SECTION_NAMES[2]))
             .otherwise(s))
    return F.when(s.isin(*fixed.SECTION_NAMES), s).otherwise(F.lit(fixed.SECTION_DEFAULT))


def validate_bio(c) -> Column:
    """B, I or O after stripping; anything else is O."""
    s = strip(c)
    return F.when(s.isin(*fixed.BIO_TAGS), s).otherwise(F.lit(fixed.BIO_DEFAULT))


def tokens(c) -> Column:
    """whitespace tokens (Python ``str.split()``)."""
    return F.array_remove(F.split(col_of(c), f"(?U)[{SPACE}]+"), "")


def sentence_marks(c) -> Column:
    """number of ``.``, ``!`` and ``?`` characters (plain replacement,
    no regex)."""
    s = col_of(c)
    return sum((F.length(s) - F.length(F.replace(s, F.lit(m), F.lit(""))) for m in ".!?"), F.lit(0))


def split_sentences(c) -> Column:
    """Sentence list of a text: split at whitespace after ``.``, ``!``, ``?``."""
    return F.split(col_of(c), SENTENCE_SPLIT)


def vote_code(c, mode: str = "substring") -> Column:
    """F8: completion -> 1 / -1 / 0.

    ``substring`` is the original rule: contains "yes" -> 1, else contains
    "no" -> -1, else 0 (so "cannot" codes -1, rule B14).  ``tag`` only accepts
    the bracketed answers ``[[Yes]]`` and ``[[No]]``."""
    s = F.lower(col_of(c))
    if mode == "tag":
        return (F.when(s.contains("[[yes]]"), 1).when(s.contains("[[no]]"), -1)
                .otherwise(0))
    return F.when(s.contains("yes"), 1).when(s.contains("no"), -1).otherwise(0)


def has_bracket_list(c) -> Column:
    return col_of(c).rlike(r"(?s)\[.*?\]")


def bracket_items(c) -> Column:
    """quoted items inside the first ``[ ... ]`` (a ``]`` inside an item
    ends the list, as in the original)."""
    inner = F.regexp_extract(col_of(c), r"(?s)\[(.*?)\]", 1)
    return F.regexp_extract_all(inner, F.lit(r'"(.*?)"'), 1)


def _judge_parts(c) -> Column:
    tail = F.substring_index(col_of(c), fixed.JUDGE_SECTION_MARK, -1)
    return F.split(tail, r"\[RESULT\]", -1)


def judge_feedback(c) -> Column:
    """feedback part of a judge completion ('' unless the last ``###``
    part splits on ``[RESULT]`` into exactly two)."""
    parts = _judge_parts(c)
    return F.when(F.size(parts) == 2,
                  F.replace(strip(parts[0]), F.lit("\n"), F.lit(" "))).otherwise(F.lit(""))


def judge_score(c) -> Column:
    parts = _judge_parts(c)
    return F.when(F.size(parts) == 2,
                  F.replace(strip(parts[1]), F.lit("\n"), F.lit(" "))).otherwise(F.lit(""))


def score_int(c) -> Column:
    """integer score when the text is a single digit in 1..5, else NULL."""
    s = col_of(c)
    return F.when(s.rlike(f"^[{fixed.SCORE_MIN}-{fixed.SCORE_MAX}]$"), s.cast("int"))


def safe_name(c) -> Column:
    """Characters outside ``[a-zA-Z0-9_-]`` become ``_``."""
    return F.regexp_replace(col_of(c), "[^a-zA-Z0-9_-]", "_")


def first_part(c, sep: str = ";") -> Column:
    """P10: the part before the first separator."""
    return F.substring_index(col_of(c), sep, 1)


def pad_flatten(nested, width=None) -> Column:
    """pad each inner list with 0 to ``width`` (default: the row's
    longest inner list) and concatenate."""
    v = col_of(nested)
    w = F.array_max(F.transform(v, F.size)) if width is None else (
        F.lit(width) if isinstance(width, int) else width)
    return F.flatten(F.transform(
        v, lambda x: F.concat(x, F.array_repeat(F.lit(0), F.greatest(w - F.size(x), F.lit(0))))))


def multi_hot(labels, vocab) -> Column:
    """0/1 array over a sorted vocabulary column; unknown labels ignored."""
    lab = col_of(labels)
    return F.transform(col_of(vocab), lambda l: F.array_contains(lab, l).cast("int"))
