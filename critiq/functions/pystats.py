"""``textstats`` inside a Python worker: the same mergeable summaries (F13, F15-F18) over Python strings.

Many candidates of one row differ in a few words, and over a row's arrays each step of a column expression is
interpreted anew for every candidate.  Here a text is one ``split`` and a few counts over its bytes, and the summary of
a short piece (an opening, a closing, what a template says around its placeholder) is kept, so that a candidate
costs a few merges.  Results are those of ``textstats``."""
from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from typing import Dict, Optional

from .. import fixed

#: A shorter segment (characters) is not worth the cut.
WORTH = 32
_BORDER = max(map(len, fixed.FORBIDDEN_TERMS)) - 1
_VOWELS = re.compile("[aeiouy]+")
# what a worker keeps: words at the seams and their syllables, templates, short pieces of a template's candidates
_KEPT_WORDS, _KEPT_TEMPLATES, _KEPT_PIECES, _SHORT = 1 << 14, 256, 1 << 10, 1 << 11
_NINE = Decimal("1e-9")


class _Syllables(dict):
    def __missing__(self, word: str) -> int:
        n = len(_VOWELS.findall(word.lower())) or 1
        if len(word) <= 64:
            if len(self) >= _KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


_SYLLABLES = _Syllables()


# letters of lower-cased UTF-8 bytes: v a vowel, c anything else
_CLASSES = bytes(ord("v") if chr(b) in "aeiouy" else b if chr(b) == " " else ord("c") for b in range(256))
_NO_VOWEL = bytes(b for b in range(256) if chr(b) not in "aeiouy ")


def _syllables(words: list) -> int:
    """Runs of vowels of many words, and one for each word without a vowel."""
    low = " ".join(words).lower().encode()
    runs = low.translate(_CLASSES)
    return (runs.count(b"cv") + runs.count(b" v") + runs.startswith(b"v")
            + len(words) - len(low.translate(None, _NO_VOWEL).split()))


def _terms(low: str) -> int:
    return sum(map(low.count, fixed.FORBIDDEN_TERMS))


@lru_cache(1 << 13)
def _across(right: str, left: str) -> int:
    """Forbidden terms that two borders make together."""
    return _terms(right + left) - _terms(right) - _terms(left)


@lru_cache(1 << 10)
def round9(x: float) -> float:
    """Spark's ``round(x, 9)``: half up on the printed number."""
    return float(Decimal(repr(x)).quantize(_NINE, ROUND_HALF_UP))


class Scorer:
    """Summaries against one template.  A summary is (words, marks, sylls, terms, hits, head, tail, open, left,
    right), as in ``textstats``: words, syllables and hits of the words that stand whole inside, the open words at
    both ends, and the lower-cased borders."""

    def __init__(self, template: str):
        self.ttoks = frozenset(template.split())
        self._pieces: dict = {}

    def summarise(self, text: str) -> tuple:
        if not text:
            return (0, 0, 0, 0, frozenset(), "", "", False, "", "")
        low, parts = text.lower(), text.split()
        lead, trail = text[0].isspace(), text[-1].isspace()
        marks, terms = text.count(".") + text.count("!") + text.count("?"), _terms(low)
        if len(parts) == 1 and not lead and not trail:
            return (0, marks, 0, terms, frozenset(), text, "", False, low[:_BORDER], low[-_BORDER:])
        inner = parts[0 if lead else 1:len(parts) if trail else -1]
        return (len(inner), marks, _syllables(inner), terms, self.ttoks.intersection(inner),
                "" if lead else parts[0], "" if trail else parts[-1], True, low[:_BORDER], low[-_BORDER:])

    def piece(self, text: str) -> tuple:
        """``summarise``, kept for short texts."""
        if len(text) > _SHORT:
            return self.summarise(text)
        found = self._pieces.get(text)
        if found is None:
            if len(self._pieces) >= _KEPT_PIECES:
                self._pieces.clear()
            found = self._pieces[text] = self.summarise(text)
        return found

    def merge(self, a: tuple, b: tuple) -> tuple:
        """Summary of the concatenation of two pieces."""
        words, marks, sylls, terms, hits, head, tail, opened, left, right = a
        words2, marks2, sylls2, terms2, hits2, head2, tail2, opened2, left2, right2 = b
        if right and left2:
            terms += _across(right, left2)
        joined = (tail if opened else head) + head2
        words, sylls = words + words2, sylls + sylls2
        hits = hits | hits2 if hits2 else hits
        if opened and opened2:
            if joined:
                words, sylls = words + 1, sylls + _SYLLABLES[joined]
                if joined in self.ttoks:
                    hits = hits | {joined}
            tail = tail2
        elif opened:
            tail = joined
        elif opened2:
            head, tail = joined, tail2
        else:
            head = joined
        return (words, marks + marks2, sylls, terms + terms2, hits, head, tail, opened or opened2,
                (left + left2)[:_BORDER], (right + right2 if len(right2) < _BORDER else right2)[-_BORDER:])

    def wrapped(self, before: str, inside: tuple, after: str) -> tuple:
        """Summary of a summarised text between two others."""
        done = self.merge(self.piece(before), inside) if before else inside
        return self.merge(done, self.piece(after)) if after else done

    def around(self, text: str, segment: Optional[str], own: Optional[tuple]) -> tuple:
        """Summary of a text that may quote ``segment``, whose summary is ``own``, any number of times."""
        if segment is None or own is None or len(segment) < WORTH:
            return self.summarise(text)
        first, *others = text.split(segment)
        if not others:
            return self.summarise(text)
        done = self.piece(first)
        for x in others:
            done = self.wrapped("", self.merge(done, own), x)
        return done

    def fitness(self, summary: tuple, length_sign: int = 1, read_scale: float = 1.0) -> float:
        """F18 from a summary (see ``scoring.fitness``), in the same order of operations."""
        words, marks, sylls, terms, hits, head, tail = summary[:7]
        n = len(hits)
        for k, w in enumerate((head, tail)):
            if w:
                words, sylls = words + 1, sylls + _SYLLABLES[w]
                n += w in self.ttoks and w not in hits and not (k and w == head)
        ease = 0.0 if words == 0 else (fixed.FLESCH_BASE - fixed.FLESCH_WPS * (words / max(marks, 1))
                                       - fixed.FLESCH_SPW * (sylls / words))
        return (float(length_sign) * (min(marks, fixed.MAX_SENTENCES) / float(fixed.MAX_SENTENCES))
                + n / max(len(self.ttoks), 1) + float(read_scale) * ease - terms / max(words, 1))


_SCORERS: Dict[str, Scorer] = {}


def scorer(template: str) -> Scorer:
    """The worker's ``Scorer`` of a template."""
    found = _SCORERS.get(template)
    if found is None:
        if len(_SCORERS) >= _KEPT_TEMPLATES:
            _SCORERS.clear()
        found = _SCORERS[template] = Scorer(template)
    return found


def best_first(cands: list):
    """W3 (see ``scoring.best_first``) over (cand_id, fitness, ...) tuples: highest fitness, ties to the lowest id; a
    candidate without a fitness comes last."""
    return max(cands, key=lambda c: (c[1] is not None, 0.0 if c[1] is None else round9(c[1]), -c[0]))
