"""Quality rules by cross-document line frequency (DataFrame functions only).

Lines are normalised (lower case, runs of digits to 0, runs of blanks to one) and
hashed together with the document's host; the documents of a host that hold a
line are counted (a document counts once for a line).  Lines in more than
``MAX_SHARE`` of the host's documents are boilerplate and removed; a document that keeps less than ``LEAST_LEFT`` of its words is
depleted and rejected.  Base rules (length, repeated 8-word windows) come first.

The share means the same at every size of a host; ``LEAST_LINE_DOCS`` only keeps a few pages from being enough.
The table's ``source`` stands for the host.

Rows: null text = no words, base_failed.  Null source: a host of its own.  doc_id is
only carried along: null or repeated ids, and repeated rows, are documents of their
own.  Empty table: empty result."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import SPACES, shared_table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
LEAST_LINE_DOCS = 5
MAX_SHARE = 0.01
LEAST_LEFT = 0.3


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda variable is never inlined."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(w: Column) -> Column:
    """Words inside 8-word windows that a text holds twice or more (first included)."""
    def hashes(h):
        return F.when(F.size(h) >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))))

    def spots(g):
        """Start positions, ascending, of windows that are not unique: by sorting (hash, position)."""
        return _let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
                    lambda s: F.sort_array(F.transform(
                        F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])),
                        lambda x: x["i"])))

    def cover(g):
        return _let(spots(g), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    each = F.transform(w, lambda x: F.xxhash64(x))
    return _let(each, lambda h: _let(hashes(h), lambda g: F.when(
        g.isNull() | (F.size(F.array_distinct(g)) == F.size(g)), F.lit(0).cast("long")).otherwise(cover(g))))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, SPACES)) > 0)


def normalised(line: Column) -> Column:
    line = F.regexp_replace(F.translate(F.lower(line), SPACES[1:], " " * 5), " +", " ")
    return F.regexp_replace(F.trim(line), "[0-9]+", "0")


def base_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, __row, __host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, __lines)."""
    text = F.coalesce("text", F.lit(""))
    host_line = lambda x: F.struct(F.xxhash64("source", normalised(x)).alias("h"), F.size(words(x)).alias("w"))
    return docs.select(
        "doc_id", F.monotonically_increasing_id().alias("__row"), F.col("source").alias("__host"),
        _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        _let(_lines(text), lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
            F.transform(x, host_line).alias("lines"))).alias("l"),
    ).select("doc_id", "__row", "__host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
             F.col("l.dup").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.lines").alias("__lines"))


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base columns, n_common_lines and n_common_words
    (long; lines above the limits and their words), base_failed, kept."""
    base = shared_table(base_stats(docs), "stats")
    hosts = base.groupBy("__host").agg(F.count("*").alias("host_docs"))
    # The line's words depend on the line alone; a line that a document repeats counts once for it.
    once = base.select("__host", F.explode(F.array_distinct(F.transform("__lines", lambda x: x["h"]))).alias("h"))
    common = once.groupBy("__host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > LEAST_LINE_DOCS)
    common = common.join(hosts.withColumnRenamed("__host", "hh"), F.col("__host").eqNullSafe(F.col("hh")))
    common = shared_table(common.filter(F.col("n") > MAX_SHARE * F.col("host_docs")).select("h"), "common")
    each = base.select("__row", F.explode("__lines").alias("x")).select("__row", F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    lost = each.join(common, "h").groupBy("__row").agg(
        F.count("*").alias("n_common_lines"), F.sum("w").cast("long").alias("n_common_words"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = base.drop("__lines").join(lost, "__row", "left").fillna(0, ["n_common_lines", "n_common_words"])
    depleted = F.col("n_words") - F.col("n_common_words") < LEAST_LEFT * F.col("n_words")
    return (out.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~depleted)
            .drop("__row", "__host"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^ \t\n\x0B\x0C\r]+') AS w FROM d),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM w),
win AS (SELECT rid, pos, n, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p
          || ' ' || lead(word, 4) OVER p || ' ' || lead(word, 5) OVER p || ' ' || lead(word, 6) OVER p || ' ' || lead(word, 7) OVER p AS g
        FROM words WINDOW p AS (PARTITION BY rid ORDER BY pos)),
rep AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS c FROM win WHERE pos <= n - 7) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - pos, 8))) AS r
        FROM (SELECT rid, pos, lead(pos) OVER (PARTITION BY rid ORDER BY pos) AS nxt FROM rep) GROUP BY rid),
ln AS (SELECT rid, source, x AS line, len(regexp_extract_all(x, '[^ \t\n\x0B\x0C\r]+')) AS nw,
              regexp_replace(trim(regexp_replace(lower(x), '[ \t\n\x0B\x0C\r]+', ' ', 'g')), '[0-9]+', '0', 'g') AS norm
       FROM (SELECT rid, source, unnest(string_split(text, chr(10))) AS x FROM d)
       WHERE regexp_matches(x, '[^ \t\n\x0B\x0C\r]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS dups FROM ln GROUP BY rid),
hosts AS (SELECT source, count(*) AS hd FROM d GROUP BY source),
common AS (SELECT l.source, norm FROM ln l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
           GROUP BY l.source, norm, hd HAVING count(DISTINCT rid) > 5 AND count(DISTINCT rid) > 0.01 * hd),
lost AS (SELECT rid, count(*) AS cl, sum(nw) AS cw FROM ln l JOIN common c
         ON l.source IS NOT DISTINCT FROM c.source AND l.norm = c.norm GROUP BY rid),
s AS (SELECT d.doc_id, len(w.w) AS n_words, length(regexp_replace(d.text, '[ \t\n\x0B\x0C\r]+', '', 'g')) AS word_chars,
             length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dups, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words,
             coalesce(cl, 0) AS n_common_lines, coalesce(cw, 0) AS n_common_words
      FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       CAST(n_common_lines AS BIGINT) AS n_common_lines, CAST(n_common_words AS BIGINT) AS n_common_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words - n_common_words < 0.3 * n_words) AS kept
FROM s
"""
