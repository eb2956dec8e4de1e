"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius
(DataFrame functions only).

Fingerprint.  The terms of a text are its lower-cased words (weight ``WORD``) and its pairs
of neighbouring words (weight ``PAIR``; the last word is paired with the end of the text).
The bits of a term's 64-bit hash vote: a set bit adds the term's weight, a clear one takes it
away; a bit of the fingerprint is set where the sum is positive.  Terms are exploded and summed
in partial aggregates: two counters of 32 bits share a long, so a text of any length (up to a
thousand million words) is 32 longs when it is shuffled.  Equal texts have equal fingerprints.

Search.  The 64 bits are cut into ``BLOCKS`` blocks.  Of two fingerprints that differ in at
most ``radius`` bits, at least BLOCKS - radius blocks agree, so there is a table for each choice
of that many blocks, keyed by the chosen bits (the fingerprint with these blocks permuted to
the front, and cut there).  Every pair within the radius meets in a bucket of some table, and
is verified in the first such table only.  A bucket with many fingerprints is cut into parts of
about ``PART`` that meet each other as arrays in a row, so no pair is ever a row of its own
unless asked for (``within``), and no bucket is ever in one row.

Rows: null text = empty text, which has no terms and fingerprint zero.  Documents follow one another
by doc_id (nulls last), then text hash; rows that repeat both are one document, and each gets its
result.  One document follows itself.  Extra columns are ignored.  Empty table: empty result."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from critiq.functions.scoring import let
from critiq.llm.common import prepare, shared_table, text_hash, words

WORD, PAIR = 1, 2
RADIUS = 3
BLOCKS = 6
#: Fingerprints of a bucket that stand in one row together.
PART = 2048
#: A row's identity: doc_id (in two non-null columns) and text hash.
KEYS = ["__none", "__id", "__th"]


def _terms(text: Column) -> Column:
    """array<struct<a,b>>: hash of each word, and of it and the next one."""
    hashed = F.transform(words(F.lower(text)), lambda x: F.xxhash64(x))
    return let(hashed, lambda h: F.transform(
        h, lambda x, i: F.struct(x.alias("a"), F.xxhash64(x, F.get(h, i + 1)).alias("b"))))


def _two_bits(term: str, k: int) -> str:
    """SQL: bits 2k and 2k + 1 of a hash as counters in the lower and the upper half of a long."""
    x = f"(shiftrightunsigned({term}, {2 * k}) & 3L)"
    return f"(({x} | shiftleft({x}, 31)) & {(1 << 32) | 1}L)"


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fp long): one row for each value of the non-null ``keys``; rows that share
    a key must share the text."""
    votes = rows.select(*keys, F.explode_outer(_terms(F.col(text))).alias("__t")).select(
        *keys, F.col("__t.a").alias("__a"), F.col("__t.b").alias("__b"))
    sums = votes.groupBy(*keys).agg((F.count("__a") * (WORD + PAIR)).alias("__total"), F.array(*[
        F.expr(f"sum({_two_bits('__a', k)} * {WORD} + {_two_bits('__b', k)} * {PAIR})") for k in range(32)]).alias("__votes"))
    fp = """aggregate(__votes, struct(0L AS fp, 0 AS at), (done, x) -> struct(
        done.fp | if(2 * (x & 4294967295L) > __total, shiftleft(1L, done.at), 0L)
                | if(2 * shiftrightunsigned(x, 32) > __total, shiftleft(2L, done.at), 0L) AS fp, done.at + 2 AS at), done -> done.fp)"""
    return sums.select(*keys, F.expr(fp).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return (64 - F.bit_count(a.bitwiseXOR(b))).cast("double") / 64


def keyed(docs: DataFrame) -> DataFrame:
    """(KEYS, text)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("__id"),
                       text_hash(text).alias("__th"), text.alias("text"))


def following(rows: DataFrame) -> DataFrame:
    """(KEYS, n_rows, n_chars, next struct of KEYS) of every document, in order; the last is followed by the
    first.  Documents are numbered by range partitions: only a partition's own rows, and one row of
    each partition, are ever ordered together."""
    ids = rows.select(*KEYS, F.length("text").cast("long").alias("n_chars")).groupBy(*KEYS).agg(
        F.count("*").alias("n_rows"), F.max("n_chars").alias("n_chars"))
    parts = shared_table(ids.repartitionByRange(*KEYS).withColumn("part", F.spark_partition_id()), "order")
    key = F.struct(*KEYS)
    heads = parts.groupBy("part").agg(F.min(key).alias("head"))
    ring = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(ring)).alias("after"))
    inside = parts.withColumn("next", F.lead(key).over(Window.partitionBy("part").orderBy(*KEYS)))
    return inside.join(heads, "part").select(*KEYS, "n_rows", "n_chars", F.coalesce("next", "after").alias("next"))


def edited(rows: DataFrame, order: DataFrame) -> DataFrame:
    """(KEYS, edited): texts whose last quarter is replaced by the beginning of the next one.  Both joins
    read one shuffle of the texts; beside it only the beginnings move, to the documents before."""
    quarter = lambda n: F.floor(n / 4).cast("int")
    wanted = order.select(*[F.col(f"next.{k}").alias(k) for k in KEYS], F.struct(*KEYS).alias("to"), quarter(F.col("n_chars")).alias("q"))
    heads = (rows.join(wanted, KEYS).select(*[F.col(f"to.{k}").alias(k) for k in KEYS],
                                            F.col("text").substr(F.lit(1), F.col("q")).alias("head"))
             .groupBy(*KEYS).agg(F.first("head").alias("head")))
    n = F.length("text")
    kept = F.col("text").substr(F.lit(1), n - quarter(n))
    return rows.join(heads, KEYS).select(*KEYS, F.concat(kept, "head").alias("edited"))


def _masks(radius: int, blocks: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(block[i] for i in kept)) for kept in combinations(range(blocks), blocks - radius)]


def _buckets(fps: DataFrame, radius: int, blocks: int, part: int) -> tuple[DataFrame, DataFrame]:
    """Rows (t, key, fp, parts) of the buckets that hold two fingerprints or more, and their parts
    (t, key, other, fps array)."""
    masks = _masks(radius, blocks)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key"))
                       for t, m in enumerate(masks)])
    entries = fps.select("fp", F.explode(tables).alias("e")).select("fp", "e.t", "e.key")
    size = shared_table(entries.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    entries = shared_table(entries.join(size, ["t", "key"]).select(
        "t", "key", "fp", F.ceil(F.col("n") / part).cast("int").alias("parts")), "entries")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    return entries, entries.groupBy("t", "key", own.alias("other")).agg(F.collect_list("fp").alias("fps"))


def _met(entries: DataFrame, parts: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(fp, near array): the fingerprints that an entry meets within the radius, first in this table."""
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(radius, blocks)])
    spread = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    near = lambda y: (F.bit_count(F.col("fp").bitwiseXOR(y)).between(1, radius)) & F.forall(
        F.slice(masks, 1, F.col("t")), lambda m: F.col("fp").bitwiseXOR(y).bitwiseAND(m) != 0)
    return spread.join(parts, ["t", "key", "other"]).select("fp", F.filter("fps", near).alias("near"))


def within(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """(fp, other, bits): every pair of distinct fingerprints ``fps.fp`` within the radius, both ways.  A
    fingerprint has at most sum(C(64, i), i <= radius) others, whatever the corpus."""
    met = _met(*_buckets(fps.select("fp").distinct(), radius, blocks, part), radius, blocks)
    return met.select("fp", F.explode("near").alias("other")).withColumn(
        "bits", F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))))


def near_counts(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """(fp, n_near long): for each distinct fingerprint that has any, the number of others within the radius."""
    met = _met(*_buckets(fps.select("fp").distinct(), radius, blocks, part), radius, blocks)
    return met.filter(F.size("near") > 0).groupBy("fp").agg(F.sum(F.size("near")).cast("long").alias("n_near"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_near (other fingerprints of the corpus within ``RADIUS`` bits)."""
    prepare(docs.sparkSession)
    rows = keyed(docs)
    order = shared_table(following(rows), "following")
    own = shared_table(fingerprints(rows, KEYS), "fps")
    # The joined texts are summed up where they are: the digest is one more key, and no text is written.
    changed = edited(rows, order).withColumn("edited_sha256", F.sha2("edited", 256))
    other = shared_table(fingerprints(changed, [*KEYS, "edited_sha256"], "edited").withColumnRenamed("fp", "efp"), "edited")
    # As a table of its own the last join's sides are plain shuffles, so a hot fingerprint can be split.
    near = shared_table(near_counts(own).withColumnRenamed("fp", "nfp"), "near")
    after = order.select(F.struct(*KEYS).alias("me"), "n_rows", "n_chars", *[F.col(f"next.{k}").alias(k) for k in KEYS])
    after = after.join(own, KEYS).select(*[F.col(f"me.{k}").alias(k) for k in KEYS], "n_rows", "n_chars", F.col("fp").alias("afp"))
    out = shared_table(after.join(own, KEYS).join(other, KEYS), "results")
    out = out.join(near, out["fp"] == near["nfp"], "left")
    out = out.withColumn("doc_id", F.when(~F.col("__none"), F.col("__id"))).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("efp").alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("afp")).alias("near_next"),
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
