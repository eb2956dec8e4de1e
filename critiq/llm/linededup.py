"""Line dedup by overlapping three-line windows.

A text is cut into logical lines: physical lines, cut again after a sentence end
([.!?] and blanks), and pieces of more than ``WRAP`` words again after words whose hash
is the least of the ``REACH`` words on either side (``cuts``).  These cuts follow from the words
around them, not from where the piece began, so a passage is cut alike wherever it
stands in a physical line, from its first such cut on.  Lines without a word are no lines.
Every three consecutive lines (all of them, if the text has fewer) are hashed
over their words, lower-cased; windows of fewer than ``MIN_WORDS`` words are
left alone, since such short runs repeat by chance.  Short lines that would be in no other
window are joined (``pooled``), so that some hashed window covers every line of a text of as many words.
A text of fewer words in all is one window if ``short`` is given, as the pipeline does.  Of windows that repeat
anywhere, the first in order of (doc_id, nulls first; text hash; position) stays;
the lines that the later ones cover are merged and removed.  What is left of a
text is kept as it was.

Rows: null text = empty text, never changed (stays null).  Rows that repeat both
doc_id and text are one document here: they get the same result.  Empty table:
empty result."""
from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import n_words, prepare, same_row, shared_table, text_hash

WINDOW = 3
WRAP = 16
REACH = 4
MIN_WORDS = 10
_CUT = re.compile(r"\n|(?<=[.!?])[ \t]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cuts(words: list[bytes]) -> list[int]:
    """Where each line of a piece begins: after a word whose hash is less than those of the
    ``REACH`` words before and not more than those of the ``REACH`` after; where that leaves more than
    ``WRAP`` words, also after the (last) word of the least hash that leaves a line of ``REACH`` + 1
    to ``WRAP`` words.  Lines of a cut piece have more than ``REACH`` words."""
    n = len(words)
    if n <= WRAP:
        return [0]
    h = [crc32(w) for w in words]
    out, begin, i = [0], 0, REACH
    while begin < n:
        while i < n - REACH - 1 and not (h[i] <= min(h[i + 1:i + REACH + 1]) and h[i] < min(h[i - REACH:i])):
            i += 1
        end = i + 1 if i < n - REACH - 1 else n
        while end - begin > WRAP:
            near = h[begin + REACH:min(begin + WRAP, end - REACH - 1)]
            begin += REACH + len(near) - near[::-1].index(min(near))
            out.append(begin)
        begin, i = end, end + REACH
        if end < n:
            out.append(end)
    return out


def by_place(words: list[bytes]) -> list[int]:
    """As ``cuts``, after every ``WRAP`` words: the lines that ``ORACLE`` states."""
    return list(range(0, len(words), WRAP))


def pooled(text: str, starts: list[int], found: list[list[bytes]]) -> tuple[list[int], list[list[bytes]]]:
    """The lines with those joined that no window of ``MIN_WORDS`` words covers: runs of them are one piece,
    cut as ``cuts`` has it; a single one goes to the line before it (the first to the next), until
    all lines are covered or one window has them all."""
    while len(found) > WINDOW:
        sizes = [len(w) for w in found]
        if min(a + b + c for a, b, c in zip(sizes, sizes[1:], sizes[2:])) >= MIN_WORDS:
            break
        full = [a + b + c >= MIN_WORDS for a, b, c in zip(sizes, sizes[1:], sizes[2:])]
        held = [any(full[max(0, i - WINDOW + 1):i + 1]) for i in range(len(found))]
        if all(held):
            break
        new_starts, new_found, i, first = [], [], 0, None
        while i < len(found):
            j = i + 1
            while not held[i] and j < len(found) and not held[j]:
                j += 1
            if held[i]:
                if first is not None:
                    new_starts.append(first[0])
                    new_found.append(first[1] + found[i])
                    first = None
                else:
                    new_starts.append(starts[i])
                    new_found.append(found[i])
            elif j > i + 1:
                words = [w for line in found[i:j] for w in line]
                places = cuts(words)
                spots = []
                for k in range(i, j):
                    end = starts[k + 1] if k + 1 < len(starts) else len(text)
                    at = [starts[k] + m.start() for m in _WORD.finditer(text[starts[k]:end])]
                    spots += [starts[k], *at[1:]]
                for k, to in zip(places, [*places[1:], len(words)]):
                    new_starts.append(spots[k])
                    new_found.append(words[k:to])
            elif new_found:
                new_found[-1] = new_found[-1] + found[i]
            else:
                first = starts[i], found[i]
            i = j
        starts, found = new_starts, new_found
    return starts, found


def lines(text: str, cut=cuts) -> tuple[list[int], list[list[bytes]]]:
    """Code point at which each logical line begins, and its lower-cased words.
    A line reaches to the beginning of the next."""
    starts, found = [], []
    at = 0
    for end, after in [*(m.span() for m in _CUT.finditer(text)), (len(text), len(text))]:
        piece, begin = text[at:end], at
        at = after
        words = piece.lower().encode("utf-8").split()
        if not words:
            continue
        if len(words) <= WRAP:
            starts.append(begin)
            found.append(words)
            continue
        spots = [m.start() for m in _WORD.finditer(piece)]
        places = cut(words)
        for k, to in zip(places, [*places[1:], len(words)]):
            starts.append(begin + (spots[k] if k else 0))
            found.append(words[k:to])
    return pooled(text, starts, found) if cut is cuts else (starts, found)


def windows(text: str | None, cut=cuts, short: bool = False) -> tuple[int, list[int], list[int]]:
    """Number of lines, and position and signed 64-bit hash of each window."""
    if not text:
        return 0, [], []
    _, found = lines(text, cut)
    n, width = len(found), min(WINDOW, len(found))
    sizes = [len(w) for w in found]
    joined = [b" ".join(w) for w in found]
    whole = short and n <= WINDOW
    at = [i for i in range(n - width + 1) if n and (whole or sum(sizes[i:i + width]) >= MIN_WORDS)]
    hashes = np.array([xxhash.xxh64_intdigest(b"\n".join(joined[i:i + width])) for i in at], dtype=np.uint64)
    return n, at, hashes.view(np.int64).tolist()


def _windows_of(cut, short):
    def run(batches):
        for batch in batches:
            rows = [windows(t, cut, short) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("__th"), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                names=["__id", "__th", "n_lines", "at", "hashes"])
    return run


def covered(docs: DataFrame, cut=cuts, short: bool = False) -> DataFrame:
    """(__id, __th, n_lines, removed): for each distinct (doc_id, text) the
    positions of the lines to remove, ascending (null: none)."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = shared_table(
        docs.select("doc_id", "text", text_hash(F.col("text")).alias("__th"))
        .mapInArrow(_windows_of(cut, short), f"__id {kind}, __th long, n_lines long, at array<long>, hashes array<long>"),
        "windows")
    each = table.select("__id", "__th", F.explode(F.arrays_zip("at", "hashes")).alias("w")).select(
        F.col("w.hashes").alias("h"), F.struct("__id", "__th", F.col("w.at").alias("at")).alias("place"))
    first = each.groupBy("h").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    first = shared_table(first.filter("first <> last").select("h", "first"), "repeated")
    later = each.join(first, "h").filter("place <> first").select("place.*")
    removed = later.select(
        "__id", "__th", F.explode(F.sequence(F.col("at"), F.col("at") + (WINDOW - 1))).alias("line"))
    removed = (removed.groupBy("__id", "__th").agg(F.array_sort(F.collect_set("line")).alias("removed"))
               .withColumnsRenamed({"__id": "rid", "__th": "rth"}))
    table = table.select("__id", "__th", "n_lines").distinct()
    return (table.join(removed, table["__id"].eqNullSafe(removed["rid"]) & (table["__th"] == removed["rth"]), "left")
            .select("__id", "__th", "n_lines",
                    F.filter("removed", lambda x: x < F.col("n_lines")).alias("removed")))


def without(text: str, removed, cut=cuts) -> str:
    """The text without the lines at these positions."""
    starts, _ = lines(text, cut)
    gone, out, at = set(int(x) for x in removed), [], 0
    for k, begin in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(text)
        if k in gone:
            out.append(text[at:begin])
            at = end
    return ("".join(out) + text[at:]).strip("\n ") if gone else text


def _without_udf(cut):
    @F.pandas_udf("string")
    def run(text: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or r is None else without(t, r, cut) for t, r in zip(text, removed)], dtype=object)
    return run


def dedup_lines(docs: DataFrame, cut=cuts, short: bool = False) -> DataFrame:
    """``docs`` (all its columns) with the later copies of repeated passages cut
    out of ``text``, and n_lines, n_removed (long; columns of these names are replaced).
    ``short``: also texts of fewer than ``MIN_WORDS`` words in all, if they are copies as a whole."""
    found = covered(docs, cut, short).withColumnsRenamed({"n_lines": "__n", "removed": "__removed"})
    named = docs.withColumn("__hash", text_hash(F.col("text")))
    out = named.join(found, same_row(named, found), "left")
    hit = F.size("__removed") > 0
    left = _without_udf(cut)(F.when(hit, F.col("text")), F.when(hit, F.col("__removed")))
    return (out.withColumn("__cut", left)
            .withColumn("text", F.when(hit, F.col("__cut")).otherwise(F.col("text")))
            .withColumn("n_lines", F.coalesce("__n", F.lit(0).cast("long")))
            .withColumn("n_removed", F.when(hit, F.size("__removed")).otherwise(0).cast("long"))
            .select(*[F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, with the lines that ``ORACLE`` states (cut by place)."""
    return dedup_lines(docs, by_place).select("doc_id", "n_lines", "n_removed", n_words(F.col("text")).alias("words_left"))


def emptied(text: Column, n_removed: Column) -> Column:
    """A text that lost lines and has no word left."""
    return (n_removed > 0) & (n_words(text) == 0)


#: The same in DuckDB SQL: lines as word lists, windows joined, first place of each repeated window.
ORACLE = r"""
WITH physical AS (
  SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS ln,
         generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), 1) AS k
  FROM documents),
worded AS (
  SELECT doc_id, k, regexp_extract_all(lower(ln), '[^ \t\n\x0B\x0C\r]+') AS w FROM physical),
pieces AS (
  SELECT doc_id, k, p, list_slice(w, 16 * p + 1, 16 * p + 16) AS w
  FROM (SELECT doc_id, k, w, unnest(range(CAST(ceil(len(w) / 16.0) AS BIGINT))) AS p FROM worded WHERE len(w) > 0)),
units AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY k, p) - 1 AS pos,
         count(*) OVER (PARTITION BY doc_id) AS n FROM pieces),
wins AS (
  SELECT doc_id, pos, n, array_to_string(w, ' ') AS a, len(w) AS la,
         lead(array_to_string(w, ' ')) OVER d AS b, coalesce(lead(len(w)) OVER d, 0) AS lb,
         lead(array_to_string(w, ' '), 2) OVER d AS c, coalesce(lead(len(w), 2) OVER d, 0) AS lc
  FROM units WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
full_wins AS (
  SELECT doc_id, pos, n, concat_ws(chr(10), a, b, c) AS win FROM wins
  WHERE la + lb + lc >= 10 AND ((n >= 3 AND pos <= n - 3) OR (n < 3 AND pos = 0))),
ranked AS (
  SELECT doc_id, pos, n, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS r FROM full_wins),
gone AS (
  SELECT DISTINCT doc_id, pos + o AS pos FROM (SELECT doc_id, pos, n, unnest([0, 1, 2]) AS o FROM ranked WHERE r > 1)
  WHERE pos + o < n),
per_doc AS (
  SELECT u.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         sum(CASE WHEN g.pos IS NULL THEN len(u.w) ELSE 0 END) AS words_left
  FROM units u LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.pos = g.pos GROUP BY u.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(words_left, 0) AS BIGINT) AS words_left
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""
