"""Phrase collocation mining by Toivonen's method.

Texts are lower-cased (A-Z only), split at ``.,;:!?`` and line ends into pieces, and these at
blanks into words.  Phrases are runs of 2 to ``LONGEST`` words within a piece; everything is per lang.

1. A sample (``SHARE`` of the documents, by hash) proposes: its words and shorter phrases with at
   least ``SAMPLE_LEAST`` occurrences are the members.
2. A full pass counts exactly, over all documents, every word, and every longer phrase whose two parts
   (without its last and without its first word) are members: the members themselves and their negative
   border, the phrases just beyond them.
3. Phrases that turn out frequent (``LEAST`` occurrences) without being members are border failures:
   they become members, and a further pass counts the phrases that this brings within the border, and
   only these.  The search is closed when no pass fails.  Whatever the sample, then, every phrase
   with ``LEAST`` occurrences has been counted, as each part of a frequent phrase is frequent.

Members are held as bitmaps of ``BITS`` bits, one for each length, at the phrase's hash: of fixed size at
any corpus size, made by Spark's bitmap aggregates.  A false member only has more phrases counted; counts
go by the phrases themselves.  Once a bitmap fills up (far above 10 million members) passes count
nearly all phrases: slower, and as exact.

A pass counts with numpy in chunks of about ``CHUNK`` bytes of a task's texts, and Spark adds the chunks up.

Rows: null text = empty text; null lang = ``und``.  doc_id only helps to draw the sample; repeated rows
count as often as they are there.  Very long texts are chunks of their own.  Equal scores go by count, then
phrase.  Extra columns are ignored.  Empty table: empty result."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from critiq.llm.common import prepare, shared_table, text_hash

LONGEST = 3
LEAST = 10
TOP = 2000
#: Parts that a lang's phrases are ranked in before they are ranked together.
PARTS = 16
#: A candidate goes if a longer one has at least this share (percent) of its occurrences.
WITHIN_PERCENT = 50
SHARE = 0.25
SAMPLE_LEAST = 2
BITS = 1 << 26
CHUNK = 12 << 20
_END = b"\xff"                                       # never a byte of UTF-8
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _END * 10)
_COUNTED = "lang string, size int, phrase string, n long"


def tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, int]:
    """Distinct words, the words' indices in order, and the index that stands between pieces."""
    data = _END.join([b"", *texts]).translate(_TABLE).replace(_END, b" " + _END + b" ")
    coded = pa.array(data.split(), pa.binary()).dictionary_encode()
    distinct = coded.dictionary
    return distinct, coded.indices.to_numpy().astype(np.int64), pc.index(distinct, pa.scalar(_END, pa.binary())).as_py()


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8")) & 0xFFFFFFFF
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)


def joined(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of the phrase without its last word, and that word's."""
    x = (h ^ (last >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + last
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


class Members:
    """Bitmaps of the member phrases, by number of words."""

    def __init__(self, maps: dict[int, np.ndarray]):
        self.maps = maps

    def has(self, size: int, h: np.ndarray) -> np.ndarray:
        bits = self.maps[size]
        at = place(h, 8 * len(bits))
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1

    def with_more(self, more: "Members") -> "Members":
        return Members({k: v | more.maps[k] for k, v in self.maps.items()})

    def same(self, other: "Members") -> bool:
        return all(np.array_equal(v, other.maps[k]) for k, v in self.maps.items())


def count_chunk(lang: str, texts: list[bytes], longest: int, now: Members | None, before: Members | None):
    """(size, phrases, counts) of one chunk: words (only if there is no ``before``), and the phrases whose two
    parts are members now and were not both before; without ``now`` all phrases."""
    words, ids, end = tokens(texts)
    names = [*range(1, longest + 1)]
    inside = ids != end
    if before is None:
        counts = np.bincount(ids, minlength=len(words))
        counts[end] = 0
        seen = np.flatnonzero(counts)
        yield 0, pa.array([""]), np.array([counts.sum()])
        yield 1, words.take(pa.array(seen)).cast(pa.string()), counts[seen]
    if longest == 1 or not len(ids):
        return
    hashed = word_hashes(words.to_pylist(), lang) if now is not None else np.zeros(len(words), np.uint64)
    last = hashed[ids]
    h, valid = last, inside
    for size in names[1:]:
        valid = valid[:-1] & inside[size - 1:]
        if not valid.any():
            return
        wanted = valid
        if now is not None:
            part = now.has(size - 1, h)
            wanted = wanted & part[:-1] & part[1:]
            if before is not None:
                part = before.has(size - 1, h)
                wanted = wanted & ~(part[:-1] & part[1:])
        at = np.flatnonzero(wanted)
        if len(at):
            codes, n = ids[at], len(words)
            parts = []
            for k in range(1, size):
                codes, distinct = pd.factorize(codes * n + ids[at + k])
                parts.append(distinct)
            last_words, rest = [], np.arange(len(parts[-1]))
            for distinct in reversed(parts):                     # from the last word back to the first
                pair = distinct[rest]
                last_words.append(pair % n)
                rest = pair // n
            columns = [words.take(pa.array(x)).cast(pa.string()) for x in (rest, *reversed(last_words))]
            yield size, pc.binary_join_element_wise(*columns, " "), np.bincount(codes, minlength=len(parts[-1]))
        if now is not None and size < longest:
            h = joined(h[:-1], last[size - 1:])


def counts(docs: DataFrame, longest: int, now: Members | None = None, before: Members | None = None) -> DataFrame:
    """(lang, size, phrase, n): exact sums over ``docs`` (lang, text); size 0 counts all words of a lang."""
    shared = docs.sparkSession.sparkContext.broadcast((now, before))

    def run(batches):
        held: dict[str, list[bytes]] = {}
        total = 0

        def flush():
            for lang, texts in held.items():
                for size, phrases, n in count_chunk(lang, texts, longest, *shared.value):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), size, np.int32)),
                         phrases, pa.array(n.astype(np.int64))], names=["lang", "size", "phrase", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if text:
                    held.setdefault(lang, []).append(text)
                    total += len(text)
                if total >= CHUNK:
                    yield from flush()
                    total = 0
        yield from flush()

    return docs.mapInArrow(run, _COUNTED).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def members(phrases: DataFrame, longest: int, bits: int = BITS) -> Members:
    """Bitmaps of (lang, size, phrase) for 1 to ``longest`` words, made from bit numbers by Spark."""
    def run(batches):
        for batch in batches:
            frame = batch.to_pandas()
            out = np.empty(len(frame), np.int64)
            for (lang, size), part in frame.groupby(["lang", "size"]).indices.items():
                split = [p.encode("utf-8").split(b" ") for p in frame["phrase"].to_numpy()[part]]
                h = last = word_hashes([w[0] for w in split], lang)
                for k in range(1, size):
                    last = word_hashes([w[k] for w in split], lang)
                    h = joined(h, last)
                out[part] = place(h, bits)
            yield pa.RecordBatch.from_arrays([pa.array(frame["size"], pa.int32()), pa.array(out)], names=["size", "at"])

    rows = (phrases.select("lang", "size", "phrase").mapInArrow(run, "size int, at long").withColumn("at", F.col("at") + 1)
            .groupBy("size", F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())   # at most BITS / 8 bytes a size
    maps = {k: np.zeros(bits // 8, np.uint8) for k in range(1, longest + 1)}
    for r in rows:
        part, at = np.frombuffer(r["bits"], np.uint8), (r["bucket"] - 1) * 4096
        maps[r["size"]][at:at + len(part)] = part[:len(maps[r["size"]]) - at]
    return Members(maps)


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: float = SHARE,
             bits: int = BITS) -> tuple[DataFrame, int]:
    """(lang, size, phrase, n) of every word and phrase with ``least`` occurrences, and of size 0 the number of
    words of each lang; and the number of full passes."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text_hash(F.col("text")), F.lit("phrases")), F.lit(1 << 20))
    sample = texts.filter(draw < int(share * (1 << 20))).select("lang", "text")
    texts = texts.select("lang", "text")
    proposed = counts(sample, longest - 1).filter((F.col("size") > 0) & (F.col("n") >= SAMPLE_LEAST))
    now, before, found, passes = members(proposed, longest - 1, bits), None, None, 0
    while True:
        passes += 1
        counted = counts(texts, longest, now, before)
        counted = shared_table(counted.filter((F.col("n") >= least) | (F.col("size") == 0)), f"phrases{passes}")
        found = counted if found is None else found.unionByName(counted)
        grown = now.with_more(members(counted.filter(F.col("size").between(1, longest - 1)), longest - 1, bits))
        if grown.same(now):
            return found, passes
        now, before = grown, now


def _part(phrase: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, share: float = SHARE,
                 bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's ``top`` phrases."""
    return ranked(frequent(docs, longest, least, share, bits)[0], top)


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each lang from the counts that ``frequent`` gives, in exact arithmetic."""
    sums = found.filter("size > 0").select("lang", "phrase", F.col("n").alias("f"))
    totals = found.filter("size = 0").select(F.col("lang").alias("tl"), F.col("n").alias("total"))
    phrases = found.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("head", _part(F.col("phrase"), F.lit(1), F.col("k"))).withColumn(
        "rest", _part(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")))
    cuts = cuts.join(sums.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(sums.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(cast(1000000 * {wide('a')} * {wide('a')} as decimal(38,0))) div ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # A phrase inside a longer one: every run of its words that is at least two long.
    runs = F.expr("""flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1),
                     i -> array_join(slice(split(phrase, ' '), i, w), ' '))))""")
    inner = (phrases.filter("size > 2").select("lang", F.col("a").alias("f"), F.explode(runs).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < WITHIN_PERCENT * F.col("a")))
    # A lang's phrases are ranked in parts first, so that the task which ranks them all gets a bounded number.
    best_first = [F.desc("score"), F.desc("a"), "phrase"]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best_first)
    first = kept.select("lang", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= top)
    order = Window.partitionBy("lang").orderBy(*best_first)
    first = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return (first.join(totals, F.col("lang") == F.col("tl"))
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS rid,
                  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\n\x0B\x0C\r]') AS ps FROM documents),
q AS (SELECT lang, rid, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pid FROM p),
w AS (SELECT lang, rid, pid, regexp_extract_all(piece, '[^ \t]+') AS ws FROM q),
t AS (SELECT lang, rid, pid, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM w),
g AS (SELECT lang, w1, lead(w1, 1) OVER s AS w2, lead(w1, 2) OVER s AS w3 FROM t WINDOW s AS (PARTITION BY rid, pid ORDER BY pos)),
f1 AS (SELECT lang, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1 || ' ' || w2 AS phrase, w1 AS x, w2 AS y, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1 || ' ' || w2 || ' ' || w3 AS phrase, w1 AS x, w2 AS y, w3 AS z, count(*) AS f
       FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
cut AS (SELECT c.lang, c.phrase, c.f AS a, 1 AS k, a1.f AS l, a2.f AS r FROM f2 c
          JOIN f1 a1 ON a1.lang = c.lang AND a1.phrase = c.x JOIN f1 a2 ON a2.lang = c.lang AND a2.phrase = c.y
        UNION ALL
        SELECT c.lang, c.phrase, c.f, 1, a1.f, a2.f FROM f3 c
          JOIN f1 a1 ON a1.lang = c.lang AND a1.phrase = c.x JOIN f2 a2 ON a2.lang = c.lang AND a2.phrase = c.y || ' ' || c.z
        UNION ALL
        SELECT c.lang, c.phrase, c.f, 2, a1.f, a2.f FROM f3 c
          JOIN f2 a1 ON a1.lang = c.lang AND a1.phrase = c.x || ' ' || c.y JOIN f1 a2 ON a2.lang = c.lang AND a2.phrase = c.z),
scored AS (SELECT lang, phrase, a, k, l, r, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cut),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, x || ' ' || y AS phrase, f FROM f3
           UNION ALL SELECT lang, y || ' ' || z, f FROM f3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
         WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= 2000
"""
