"""Ranked lexical search with hashed max-sketches.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.  A term that
stands tf times in a document has the impact (10^9 tf) div (1000 tf + 20 m), m from the document's length; a
document's score for an item is the sum of weight times impact over the item's terms (weights from document
frequencies; integers throughout).

Index.  One pass counts documents, terms and document frequencies; a second one writes a row per document
with its text and its sketch: impacts are rounded up to a byte and folded at the term's hash into
coordinatewise maxima.  A sketch is the least power of two that is ``ROOM`` times the document's distinct
terms, so that a text of any length is pruned alike.

Search.  Items are taken in blocks of about ``BLOCK``, which bounds all that is broadcast.  Looking an item's
terms up in a sketch gives an upper bound of the score.
1. Over the sketches alone: the ``top`` documents of highest bound for each item.
2. Their exact scores: the least is a threshold that ``top`` documents reach.
3. Over the index: documents whose bound reaches the threshold of some item are scored exactly, by descending
   bound, each task raising its thresholds as it goes, until no bound reaches them.
A document that is left out has, for every item, a bound below the scores of ``top`` others: the result is exact.

Rows: null text = empty text, which has no terms and is never found; null doc_id ranks after all others of equal
score; repeated rows are documents of their own (ties by place).  Items: null or empty texts find nothing; each row of
the benchmark is an item of its own.  Extra columns are ignored.  Either table empty: empty result."""
from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critiq.llm.common import prepare, shared_table

TOP = 50
ROOM = 8
STEP = 3922                  # an impact is below 10^6 = 255 * 3922 - 110: a byte holds it, rounded up
LEAST_WIDTH = 64
BLOCK = 2000
#: Distinct terms that a task holds before it passes their counts on.
HELD = 400_000
#: Documents scored between two looks at the thresholds.
STRIDE = 32
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TABLE).split()


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    return (10**9 * tf) // (1000 * tf + 20 * m)


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - 50 + (50 * n * n_docs) // max(n_terms, 1)


def sketch(tf: Counter, m: int) -> bytes:
    width = max(LEAST_WIDTH, 1 << (ROOM * len(tf) - 1).bit_length()) if tf else LEAST_WIDTH
    out = np.zeros(width, np.uint8)
    if tf:
        at = np.fromiter(map(zlib.crc32, tf), np.int64, len(tf)) & (width - 1)
        n = np.fromiter(tf.values(), np.int64, len(tf))
        order = np.argsort(n)                                    # impacts grow with tf: the last one written is the greatest
        out[at[order]] = -(-impacts(n[order], m) // STEP)
    return out.tobytes()


def statistics(docs: DataFrame) -> DataFrame:
    """(term binary, n long): document frequencies; for the null term, of which there is a row ``n_docs`` and a row
    ``n_terms`` by ``what``, documents with a term and all their terms."""
    def run(batches):
        df, n_docs, n_terms = Counter(), 0, 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = terms(text)
                n_docs, n_terms = n_docs + bool(words), n_terms + len(words)
                df.update(set(words))
            if len(df) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(["df"] * len(df)), pa.array(df.keys(), pa.binary()),
                                                  pa.array(df.values(), pa.int64())], names=["what", "term", "n"])
                df.clear()
        yield pa.RecordBatch.from_arrays([pa.array(["df"] * len(df) + ["n_docs", "n_terms"]),
                                          pa.array([*df.keys(), None, None], pa.binary()),
                                          pa.array([*df.values(), n_docs, n_terms], pa.int64())], names=["what", "term", "n"])

    return (docs.select("text").mapInArrow(run, "what string, term binary, n long")
            .groupBy("what", "term").agg(F.sum("n").alias("n")))


class Index:
    """Written tables of a corpus: ``rows`` (rid, doc_id, text, n, sketch) and ``df`` (what, term, n)."""

    def __init__(self, docs: DataFrame):
        prepare(docs.sparkSession)
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.df = shared_table(statistics(docs), "df")
        got = {r["what"]: r["n"] for r in self.df.filter(F.col("what") != "df").collect()}
        n_docs, n_terms = self.n_docs, self.n_terms = got.get("n_docs", 0), got.get("n_terms", 0)

        def run(batches):
            for batch in batches:
                found = [Counter(terms(t)) for t in batch.column("text").to_pylist()]
                n = [tf.total() for tf in found]
                made = [sketch(tf, length_factor(k, n_docs, n_terms)) for tf, k in zip(found, n)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(made, pa.binary())],
                                                 names=["rid", "doc_id", "text", "n", "sketch"])

        rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
        self.rows = shared_table(rows.mapInArrow(run, "rid long, doc_id long, text string, n long, sketch binary"), "sketches")


class Items:
    """A block of items: their distinct terms, hashes and weights, laid out for lookups of all items at once."""

    def __init__(self, texts: list[str | None], df: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms, self.n = n_docs, n_terms, len(texts)
        each = [[t for t in dict.fromkeys(terms(x)) if t in df] for x in texts]
        self.index = {t: k for k, t in enumerate(dict.fromkeys(t for x in each for t in x))}
        self.hashes = np.array([zlib.crc32(t) for t in self.index], np.int64)
        self.own = np.array([self.index[t] for x in each for t in x], np.int64)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in self.index], np.int64)
        self.weights = weight[self.own]
        self.filled = np.flatnonzero([len(x) for x in each])     # items that have terms
        self.starts = np.cumsum([0, *(len(x) for x in each)])[:-1][self.filled]

    def sums(self, impact: np.ndarray) -> np.ndarray:
        """Scores of all items from the impacts of all distinct terms."""
        out = np.zeros(self.n, np.int64)
        if len(self.starts):
            out[self.filled] = np.add.reduceat(impact[self.own] * self.weights, self.starts)
        return out

    def bounds(self, sketches: list[bytes]) -> np.ndarray:
        out = np.zeros((len(sketches), self.n), np.int64)
        for k, raw in enumerate(sketches):
            folded = np.frombuffer(raw, np.uint8)
            out[k] = self.sums(folded[self.hashes & (len(folded) - 1)].astype(np.int64) * STEP)
        return out

    def exact(self, text: str | None) -> np.ndarray:
        words = terms(text)
        held = Counter(filter(self.index.__contains__, words))
        impact = np.zeros(len(self.index), np.int64)
        if held:
            at = np.fromiter(map(self.index.__getitem__, held), np.int64, len(held))
            impact[at] = impacts(np.fromiter(held.values(), np.int64, len(held)),
                                 length_factor(len(words), self.n_docs, self.n_terms))
        return self.sums(impact)


def _best(held: np.ndarray, more: np.ndarray, top: int) -> np.ndarray:
    """Of two tables (rows, items), the ``top`` greatest of each column."""
    both = np.concatenate([held, more])
    return both if len(both) <= top else np.partition(both, len(both) - top, axis=0)[-top:]


def _highest_bounds(items, top: int):
    """For each item the ``top`` rows of a task that have the highest bounds."""
    def run(batches):
        q = items.value
        bound, rid = np.zeros((0, q.n), np.int64), np.zeros((0, q.n), np.int64)
        for batch in batches:
            b = q.bounds(batch.column("sketch").to_pylist())
            r = np.broadcast_to(batch.column("rid").to_numpy()[:, None], b.shape)
            bound, rid = np.concatenate([bound, b]), np.concatenate([rid, r])
            if len(bound) > top:
                at = np.argpartition(bound, len(bound) - top, axis=0)[-top:]
                bound, rid = np.take_along_axis(bound, at, 0), np.take_along_axis(rid, at, 0)
        k, item = np.nonzero(bound > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(rid[k, item]), pa.array(bound[k, item])],
                                         names=["item", "rid", "bound"])
    return run


def _rescored(items, least: np.ndarray, top: int):
    """(item, rid, doc_id, score): documents of a task that may be among the ``top`` of an item."""
    def run(batches):
        q, level = items.value, least.copy()
        held = np.zeros((0, q.n), np.int64)
        for batch in batches:
            text, rid, ids = batch.column("text"), batch.column("rid"), batch.column("doc_id")
            b = q.bounds(batch.column("sketch").to_pylist())
            order = np.argsort(-(b - level).max(axis=1, initial=0), kind="stable")
            for s in range(0, len(order), STRIDE):
                some = order[s:s + STRIDE]
                some = some[((b[some] >= level) & (b[some] > 0)).any(axis=1)]
                if not len(some):
                    continue
                scores = np.array([q.exact(text[int(k)].as_py()) for k in some])
                k, item = np.nonzero((scores >= level) & (scores > 0))
                rows = pa.array(some[k])
                yield pa.RecordBatch.from_arrays([pa.array(item), rid.take(rows), ids.take(rows), pa.array(scores[k, item])],
                                                 names=["item", "rid", "doc_id", "score"])
                held = _best(held, scores, top)
                if len(held) == top:
                    level = np.maximum(level, held.min(axis=0))
    return run


def _thresholds(index: Index, shared, n: int, top: int) -> np.ndarray:
    """A score for each item that ``top`` documents reach (0 if fewer have any)."""
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "rid")
    seeds = index.rows.select("rid", "sketch").mapInArrow(_highest_bounds(shared, top), "item long, rid long, bound long")
    seeds = shared_table(seeds.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top).select("rid").distinct(), "seeds")
    picked = index.rows.select("rid", "doc_id", "text", "sketch").join(F.broadcast(seeds), "rid", "left_semi")
    scored = picked.select("rid", "doc_id", "text", "sketch").mapInArrow(
        _rescored(shared, np.zeros(n, np.int64), top), "item long, rid long, doc_id long, score long")
    k = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "rid"))
    out = np.zeros(n, np.int64)
    for r in scored.withColumn("k", k).filter(F.col("k") == top).select("item", "score").collect():    # at most one an item
        out[r["item"]] = r["score"]
    return out


def _blocks(items: DataFrame):
    """The items, (item_id, text), in lists of about ``BLOCK``."""
    n = math.ceil(items.count() / BLOCK)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for k in range(n):
        yield items.filter(part == k).select("item_id", "text").collect()


def search(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank int, doc_id, score): the ``top`` documents of highest score above 0 of each item."""
    spark, out = items.sparkSession, None
    for block in _blocks(items.select("item_id", "text")):
        vocabulary = sorted({t for r in block for t in terms(r["text"])})
        wanted = spark.createDataFrame([(bytearray(t),) for t in vocabulary], "term binary")
        df = {bytes(r["term"]): r["n"] for r in index.df.join(F.broadcast(wanted), "term").collect()}   # at most the block's terms
        q = Items([r["text"] for r in block], df, index.n_docs, index.n_terms)
        shared = spark.sparkContext.broadcast(q)
        least = _thresholds(index, shared, q.n, top)
        scored = index.rows.select("rid", "doc_id", "text", "sketch").mapInArrow(
            _rescored(shared, least, top), "item long, rid long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "rid")
        ranked = scored.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(block)],
                                      f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        ranked = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        ranked = shared_table(ranked, "ranked")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
           FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, list_distinct(list_filter(regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w
      FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT iid, item_id, unnest(w) AS term FROM i),
m AS (SELECT rid, doc_id, 100 - 50 + ((50 * len(w)::HUGEINT * nn) // ll) AS m FROM d, s WHERE len(w) > 0),
scored AS (SELECT iid, item_id, rid, doc_id,
                  CAST(sum(CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS HUGEINT)
                       * ((1000000000::HUGEINT * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
           FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (rid), s GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
