"""Mergeable text statistics.

A summary holds what the fitness of a text is made of, in a form that two neighbouring pieces of a
text can be merged in: counts of the words that stand whole inside the piece, the open words at both
ends, and enough of the lower-cased borders to see a forbidden term across a seam.  ``merge`` is
associative and ``summarise("")`` its identity, so a text's summary follows from those of its pieces.

A row's segment is summarised once.  A candidate that quotes it (``around``) is cut at the quotations, which is
one plain search, and only the few words around them are read again.  Any other candidate is read as a whole.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .scoring import forbidden_count, let, syllables
from .text import SPACE, col_of, sentence_marks

#: Stands for the segment in a candidate; a text that holds it already is read as a whole.
MARK = "\uE000"
#: A shorter segment (bytes) is not worth the cut.
WORTH = 32
_BORDER = max(map(len, fixed.FORBIDDEN_TERMS)) - 1


def summarise(text, ttoks: Column) -> Column:
    """Summary of a text on its own; ``ttoks``: the template's distinct tokens."""
    s = col_of(text)

    def of(p):
        parts, low = p["parts"], p["low"]
        n = F.size(parts)
        head, tail = F.element_at(parts, 1), F.when(n > 1, F.element_at(parts, -1)).otherwise(F.lit(""))
        inner = F.slice(parts, 2, F.greatest(n - 2, F.lit(0)))
        return F.struct(
            F.size(inner).alias("words"),
            sentence_marks(s).alias("marks"),
            F.when(n > 2, syllables(s, low) - syllables(head) - syllables(tail)).otherwise(F.lit(0)).alias("sylls"),
            forbidden_count(low).alias("terms"),
            F.array_intersect(inner, ttoks).alias("hits"),
            head.alias("head"), tail.alias("tail"), (n > 1).alias("open"),
            F.substring(low, 1, _BORDER).alias("left"), F.substring(low, -_BORDER, _BORDER).alias("right"))

    return let(F.struct(F.split(s, f"(?U)[{SPACE}]+").alias("parts"), F.lower(s).alias("low")), of)


def _word(w: Column, ttoks: Column) -> Column:
    """(words, sylls, hits) of one run without blanks."""
    return F.struct((w != "").cast("int").alias("words"), F.when(w == "", F.lit(0)).otherwise(syllables(w)).alias("sylls"),
                    F.array_intersect(F.array(w), ttoks).alias("hits"))


def merge(a: Column, b: Column, ttoks: Column) -> Column:
    """Summary of the concatenation of two pieces."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: _merged(p["a"], p["b"], ttoks))


def _merged(a: Column, b: Column, ttoks: Column) -> Column:
    def joined(j):
        both = a["open"] & b["open"]
        seam = let(F.struct(F.concat(a["right"], b["left"]).alias("w")), lambda x: (
            forbidden_count(x["w"]) - forbidden_count(a["right"]) - forbidden_count(b["left"])))
        return let(_word(j, ttoks), lambda w: F.struct(
            (a["words"] + b["words"] + F.when(both, w["words"]).otherwise(F.lit(0))).alias("words"),
            (a["marks"] + b["marks"]).alias("marks"),
            (a["sylls"] + b["sylls"] + F.when(both, w["sylls"]).otherwise(F.lit(0))).alias("sylls"),
            (a["terms"] + b["terms"] + seam).alias("terms"),
            F.when(both, F.array_union(F.array_union(a["hits"], b["hits"]), w["hits"])).otherwise(
                F.array_union(a["hits"], b["hits"])).alias("hits"),
            F.when(a["open"], a["head"]).otherwise(j).alias("head"),
            F.when(b["open"], b["tail"]).when(a["open"], j).otherwise(F.lit("")).alias("tail"),
            (a["open"] | b["open"]).alias("open"),
            F.substring(F.concat(a["left"], b["left"]), 1, _BORDER).alias("left"),
            F.substring(F.concat(a["right"], b["right"]), -_BORDER, _BORDER).alias("right")))

    return let(F.concat(F.when(a["open"], a["tail"]).otherwise(a["head"]), b["head"]), joined)


def known(segment, ttoks: Column) -> Column:
    """What ``around`` has to know of a row's segment: its text and its summary."""
    s = col_of(segment)
    return F.struct(s.alias("text"), summarise(s, ttoks).alias("summary"))


def around(text, segment: Column | None, ttoks: Column) -> Column:
    """Summary of a text that may quote ``segment`` (see ``known``) any number of times."""
    s = col_of(text)
    if segment is None:
        return summarise(s, ttoks)
    size = F.octet_length(segment["text"])

    def cut(p):
        quotes = F.size(p) - 1
        # Only quotations became marks if the bytes that went are those of as many segments.
        clean = (F.octet_length(s) - F.aggregate(p, quotes * len(MARK.encode()), lambda n, x: n + F.octet_length(x))
                 == quotes * (size - len(MARK.encode())))
        folded = F.aggregate(F.slice(p, 2, F.greatest(quotes, F.lit(1))), summarise(F.element_at(p, 1), ttoks), lambda done, x: let(
            merge(done, segment["summary"], ttoks), lambda half: let(summarise(x, ttoks), lambda own: merge(half, own, ttoks))))
        return F.when((quotes > 0) & clean & (size >= WORTH), folded).otherwise(summarise(s, ttoks))

    return let(F.split(F.replace(s, segment["text"], F.lit(MARK)), MARK), cut)


def fitness(summary: Column, ttoks: Column, length_sign: int = 1, read_scale: float = 1.0) -> Column:
    """F18 from a summary (see ``scoring.fitness``)."""
    def of(e):
        summary, first, last = e["s"], e["a"], e["b"]
        words = summary["words"] + first["words"] + last["words"]
        sylls = summary["sylls"] + first["sylls"] + last["sylls"]
        hits = F.size(F.array_union(summary["hits"], F.array_union(first["hits"], last["hits"])))
        marks = summary["marks"]
        ease = F.when(words == 0, F.lit(0.0)).otherwise(
            F.lit(fixed.FLESCH_BASE) - F.lit(fixed.FLESCH_WPS) * (words / F.greatest(marks, F.lit(1)))
            - F.lit(fixed.FLESCH_SPW) * (sylls / words))
        return (F.lit(float(length_sign)) * (F.least(marks, F.lit(fixed.MAX_SENTENCES)) / F.lit(float(fixed.MAX_SENTENCES)))
                + hits / F.greatest(F.size(ttoks), F.lit(1)) + F.lit(float(read_scale)) * ease
                - summary["terms"] / F.greatest(words, F.lit(1)))

    return let(summary, lambda s: let(F.struct(
        s.alias("s"), _word(s["head"], ttoks).alias("a"), _word(s["tail"], ttoks).alias("b")), of))


def scored(cands, ttoks: Column, length_sign: int = 1, segment: Column | None = None, fields=("cand_id",)) -> Column:
    """F18 inside the row: array<struct<fields..., text>> -> the same structs with ``fitness`` before ``text``."""
    def one(c):
        return let(around(c["text"], segment, ttoks), lambda s: F.struct(
            *[c[f].alias(f) for f in fields], fitness(s, ttoks, length_sign).alias("fitness"), c["text"].alias("text")))
    return F.transform(cands, one)
