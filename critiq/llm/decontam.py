"""Benchmark decontamination by template windows.

A text becomes a sequence of template tokens: lower-cased words, where numbers,
names (capitalised words inside a sentence) and units (a unit word or sign after a number)
become typed placeholders, so that a re-parameterised question has the template of
the original.  Every ``WINDOW`` consecutive tokens are hashed (an item with fewer
tokens is one window), and the documents' windows are joined by hash with the benchmark's.
Windows with fewer than ``MIN_LITERALS`` literal words say too little as templates: they, and items of
one window, are (also) looked up by their own words, slot values and signs between them included
(from ``MIN_EXACT`` tokens on), so that verbatim copies are found.  An item's capitalised first word may
also be a name in the document, if it is the same word.
Matches of an item in a document are aligned on diagonals; on each the slots are
compared: equal slot values of the item must all have become one value in the document.
A diagonal of which fewer than ``CONSISTENT`` of the slots agree is discarded.  A
document is contaminated by an item if the remaining matches cover ``SHARE`` of its tokens,
or ``LONG`` tokens.

The benchmark is a stated query set: its windows are cut into blocks of at most
``BLOCK`` windows, each broadcast in turn (at most about 50 MB) and probed by all
documents, so that no document window is ever shuffled.

Rows: null or empty texts contain nothing.  Items with null text or fewer than
``MIN_EXACT`` tokens are never found, and without a window of ``MIN_LITERALS`` literal words only verbatim.  Documents and items are told apart
by row: repeated rows are found repeatedly; null ids are carried along.  Empty
tables: nothing is found."""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import prepare

WINDOW = 8
MIN_LITERALS = 4
MIN_EXACT = 3
CONSISTENT = 0.8
SHARE = 0.5
LONG = 20
BLOCK = 1 << 21
#: Unit words and signs; number words.
UNITS = frozenset("""kg g mg lb lbs oz km m cm mm mi ft km/h mph s sec min h hr hrs l ml usd eur gbp % $ € £ °
    second seconds minute minutes hour hours day days week weeks month months year years percent degrees
    meter meters metre metres mile miles foot feet liter liters litre litres gram grams pound pounds ounce ounces
    dollar dollars cent cents euro euros""".split())
NUMBER_WORDS = frozenset("""zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen
    sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand""".split())

_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_NUMBER = re.compile(r"[0-9]+(?:[.,:/][0-9]+)*")
_GLUED = re.compile(r"(?<=[0-9])(?=[^\W\d_]|[%$€£°])|(?<=[$€£])(?=[0-9])")
_HAS_DIGIT = re.compile("[0-9]")
LITERAL, TITLE, NUMBER, UNIT, NOTHING = range(5)
_PLACE = np.array([0, *(xxhash.xxh64_intdigest(x) for x in ("<name>", "<number>", "<unit>"))], dtype=np.uint64)
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(WINDOW)], dtype=np.uint64)
_KNOWN = 1 << 18        # words kept in a worker's memory


class _Words(dict):
    """Number of each whitespace-separated word seen so far, and by number its kind, hash and sentence end."""

    def __init__(self):
        super().__init__()
        self.kind, self.hash, self.ends = np.empty(1024, np.int8), np.empty(1024, np.uint64), np.empty(1024, bool)

    def __missing__(self, word: str) -> int:
        core = _CORE.search(word)
        low = core.group().lower() if core else word.lower()
        if not core and word not in UNITS:
            kind = NOTHING
        elif _NUMBER.fullmatch(low) or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        else:
            c = core.group()
            kind = TITLE if c[0].isupper() and len(c) > 1 and not any(map(str.isupper, c[1:])) else LITERAL
        n = len(self)
        if n == len(self.kind):
            self.kind, self.hash, self.ends = (np.concatenate([x, np.empty_like(x)])
                                               for x in (self.kind, self.hash, self.ends))
        self[word], self.kind[n], self.hash[n] = n, kind, xxhash.xxh64_intdigest(low)
        self.ends[n] = word[-1] in ".!?:;" or word.rstrip("\"')]”»")[-1:] in (".", "!", "?")
        return n

    def of(self, words: list[str]):
        if len(self) > _KNOWN:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.kind[at], self.hash[at], self.ends[at]


_words = _Words()


def template(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template token hashes, kinds (LITERAL, or the placeholder's kind), the words' own hashes, and
    the hash of the signs that stand between a word and the one before (0: none)."""
    text = text or ""
    if _HAS_DIGIT.search(text):
        text = _GLUED.sub(" ", text)
    kind, own, ends = _words.of(text.split())
    real = kind != NOTHING
    at = np.flatnonzero(real)
    signs = np.zeros(len(at), np.uint64)
    other = np.flatnonzero(~real)
    after = np.searchsorted(at, other)
    other, after = other[after < len(at)], after[after < len(at)]
    np.add.at(signs, after, own[other] * _FACTORS[(at[after] - other) % WINDOW])
    kind, own, ends = kind[real].copy(), own[real], ends[real]
    if not len(kind):
        return own, kind, own, signs
    first = np.r_[True, ends[:-1]]
    kind[(kind == TITLE) & first] = LITERAL
    number = kind == NUMBER
    beside = np.r_[False, number[:-1]] | np.r_[number[1:], False]
    kind[(kind == UNIT) & ~beside] = LITERAL
    return np.where(kind == LITERAL, own, _PLACE[kind % 4]), kind, own, signs


def _title(text: str) -> bool:
    """The first word is capitalised."""
    core = _CORE.search(next((w for w in text.split() if _CORE.search(w)), ""))
    return bool(core) and len(core.group()) > 1 and core.group()[0].isupper() and not any(map(str.isupper, core.group()[1:]))


def windows(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += (tokens[k:k + n] ^ (tokens[k:k + n] >> np.uint64(29))) * _FACTORS[k]
    return total ^ (total >> np.uint64(32))


class Index:
    """Windows of a block of benchmark items, sorted by hash for each window width."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        self.parts = [template(t) for _, t in items]
        found: dict[tuple, list] = {}        # (width, by own words): (hash, item, place, first word is a name)
        for k, ((_, text), (tokens, kind, own, _)) in enumerate(zip(items, self.parts)):
            width = min(WINDOW, len(tokens))
            if not width:
                continue
            literal = np.convolve(kind == LITERAL, np.ones(width), "valid")
            for exact, hashes, good in ((False, windows(tokens, width), literal >= MIN_LITERALS),
                                        (True, windows(own, width), (literal < MIN_LITERALS) | (len(tokens) <= WINDOW))):
                if not exact or width >= MIN_EXACT:
                    found.setdefault((width, exact), []).extend((hashes[p], k, p, 0) for p in np.flatnonzero(good))
            if kind[0] == LITERAL and literal[0] > MIN_LITERALS and _title(text):
                as_name = np.r_[_PLACE[TITLE], tokens[1:width]]
                found.setdefault((width, False), []).append((windows(as_name, width)[0], k, 0, 1))
        self.tables = []
        for (width, exact), rows in found.items():
            if not rows:
                continue
            hashes = np.array([x[0] for x in rows], np.uint64)
            places = np.array([x[1:] for x in rows], np.int64)
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables.append((width, exact, hashes[order], *places[order].T, seen))

    def _same(self, exact: bool, k: int, p: int, at: int, width: int, own: np.ndarray, signs: np.ndarray) -> bool:
        """The item's first word is the document's; of an exact window the signs between its words too."""
        _, _, i_own, i_signs = self.parts[k]
        if exact:
            return bool((i_signs[p + 1:p + width] == signs[at + 1:at + width]).all())
        return i_own[p] == own[at]

    def find(self, text: str | None) -> list[tuple]:
        """(item id, item tokens, covered tokens, slots, consistent slots) per contaminating item."""
        tokens, kind, own, signs = template(text)
        hits = []
        for width, exact, hashes, item, place, name, seen in self.tables:
            w = windows(own if exact else tokens, width)
            at = np.flatnonzero(seen[(w & np.uint64((1 << 20) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(hashes, w[at], "left"), np.searchsorted(hashes, w[at], "right")
            count = hi - lo
            if count.sum():
                row = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                p = np.repeat(at, count)
                if exact or name[row].any():
                    ok = np.array([not (exact or name[i]) or self._same(exact, item[i], place[i], q, width, own, signs)
                                   for i, q in zip(row, p)], bool)
                    row, p = row[ok], p[ok]
                hits.append(np.stack([item[row], p - place[row], place[row], np.full(len(row), width)]))
        if not hits:
            return []
        item, diagonal, place, width = np.concatenate(hits, axis=1)
        out = []
        for k in np.unique(item):
            i_tokens, i_kind, i_own, _ = self.parts[k]
            covered, slots, agreed = np.zeros(len(i_tokens), bool), 0, 0
            mine = item == k
            for d in np.unique(diagonal[mine]):
                here = np.zeros(len(i_tokens), bool)
                for p, w in zip(place[mine & (diagonal == d)], width[mine & (diagonal == d)]):
                    here[p:p + w] = True
                spots = np.flatnonzero(here & (i_kind != LITERAL))
                ok = _consistent(i_own[spots], own[spots + d])
                if ok >= CONSISTENT * len(spots):
                    covered |= here
                    slots, agreed = slots + len(spots), agreed + ok
            n = int(covered.sum())
            if n and (n >= SHARE * len(i_tokens) or n >= LONG):
                out.append((self.ids[k], len(i_tokens), n, slots, agreed))
        return out


def _consistent(mine: np.ndarray, theirs: np.ndarray) -> int:
    """Slots whose item value became the value that it became most often."""
    total = 0
    for value in np.unique(mine):
        total += int(np.unique(theirs[mine == value], return_counts=True)[1].max())
    return total


def _blocks(benchmark: DataFrame):
    """Items in blocks of at most ``BLOCK`` windows, one block in the driver's memory at a time."""
    block, n = [], 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        size = len((text or "").split())
        if block and n + size > BLOCK:
            yield block
            block, n = [], 0
        block.append((item_id, text))
        n += size
    if block:
        yield block


def _search_udf(index, form: str):
    @F.pandas_udf(form)
    def search(texts: pd.Series) -> pd.Series:
        names = ("item_id", "n_tokens", "covered", "slots", "consistent")
        return pd.Series([[dict(zip(names, x)) for x in index.value.find(t)] for t in texts], dtype=object)
    return search


def leaks(benchmark: DataFrame, text: Column) -> Column:
    """Array column: an entry for each benchmark item that contaminates the text."""
    spark = benchmark.sparkSession
    prepare(spark)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    form = f"array<struct<item_id:{kind},n_tokens:int,covered:int,slots:int,consistent:int>>"
    found = [_search_udf(spark.sparkContext.broadcast(Index(block)), form)(text) for block in _blocks(benchmark)]
    return F.concat(*found) if found else F.array().cast(form)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_tokens, covered, slots, consistent): one row per leak."""
    return docs.select("doc_id", F.explode(leaks(benchmark, F.col("text"))).alias("leak")).select("doc_id", "leak.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (all its columns) without the contaminated ones."""
    return (docs.withColumn("__leaks", leaks(benchmark, F.col("text")))
            .filter(F.size("__leaks") == 0).select(*docs.columns))
