"""Mixing sources to target weights by systematic sampling.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and
share all words; a target stops at ``CAP`` times its source's size and the excess
is shared again by weight until none is above.  A document of a source with ratio
r = target / source size is expected r times.  Within a source the documents
stand in order of (size, md5 of doc_id, doc_id); one random offset u per source is
added to the prefix sum of expected copies, and the k-th document is emitted once
for each integer boundary that u + r*k crosses.  Order by size makes the sample
stratified by size, so that the words taken come near the target.

The prefix sum is distributed: a source's documents are dealt into slices of
(size, leading md5 digits) of bounded length, the slices' counts are summed in
order, and documents are numbered only within their slice; a source with a third
of all rows needs no large task.

Rows: null text has size 0; size-0 documents are expected r times like any other.
A source of size 0 gets target 0, and no copies.  Null source: a source of its own.
Null doc_id: md5 of the empty string.  Repeated rows are documents of their own
(which of two equal rows gets the extra copy makes no difference).  Empty table:
empty result."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from critiq.llm.common import n_words, shared_table, text_hash

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-42"
#: Documents that one slice holds, about.
SLICE = 50_000


def _order_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) one row per source -> with target double and weight."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(rank, F.lit(len(WEIGHTS))).cast("int") + 1)
    table = shared_table(sizes.withColumn("weight", weight), "sources")
    total, weights = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level, n_capped = (total / weights if total else 0.0), 0
    while total:
        # Sources above the cap at this level stay at the cap; the others share the rest.
        capped = F.lit(level) * F.col("weight") > CAP * F.col("source_size")
        n, held, rest = table.agg(F.count(F.when(capped, 1)),
                                  F.sum(F.when(capped, CAP * F.col("source_size")).otherwise(0)),
                                  F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if n == n_capped:
            break
        n_capped, level = n, (total - held) / rest
    return table.withColumn("target", F.least(F.lit(level) * F.col("weight"), (CAP * F.col("source_size")).cast("double")))


def plan(docs: DataFrame) -> DataFrame:
    """(doc_id, __th, source, size, source_size, target, copies long)."""
    base = shared_table(docs.select("doc_id", "source", text_hash(F.col("text")).alias("__th"),
                                    n_words(F.col("text")).alias("size"), _order_key(F.col("doc_id")).alias("m")), "sizes")
    aims = targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))).select(
        F.col("source").alias("s"), "source_size", "target")
    sized = base.groupBy("source", "size", F.substring("m", 1, 4).alias("p")).count()
    # The fewest md5 digits (0 to 4) that leave about SLICE documents of one size together.
    deep = sized.groupBy("source", "size").agg(F.sum("count").alias("c")).select(
        F.col("source").alias("ds"), F.col("size").alias("dz"),
        F.least(F.lit(4), F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("c") / SLICE)))).cast("int").alias("digits"))
    deep = shared_table(deep.filter("digits > 0"), "deep")

    def sliced(df, key):
        return (df.join(deep, df["source"].eqNullSafe(deep["ds"]) & (df["size"] == deep["dz"]), "left")
                .withColumn("slice", F.expr(f"substring({key}, 1, coalesce(digits, 0))")).drop("ds", "dz", "digits"))

    counts = sliced(sized, "p").groupBy("source", "size", "slice").agg(F.sum("count").alias("c"))
    before = Window.partitionBy("source").orderBy("size", "slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("cs"), F.col("size").alias("cz"), F.col("slice").alias("cl"),
                           F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("m", "doc_id", "__th"))
    ranked = sliced(base, "m").withColumn("own", own)
    ranked = ranked.join(counts, ranked["source"].eqNullSafe(counts["cs"]) & (ranked["size"] == counts["cz"])
                         & (ranked["slice"] == counts["cl"]))
    ranked = ranked.join(aims, ranked["source"].eqNullSafe(aims["s"]))
    k = (F.col("before") + F.col("own")).cast("double")
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8),
                    16, 10).cast("double") / 4294967296.0
    copies = F.floor(offset + F.col("r") * F.col("k")) - F.floor(offset + F.col("r") * (F.col("k") - 1))
    return (ranked.withColumn("k", k).withColumn("r", r)
            .withColumn("copies", F.least(copies.cast("long"), F.lit(CAP).cast("long")))
            .select("doc_id", "__th", "source", "size", "source_size", "target", "copies"))


def digest(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` (all its columns), each row once per copy that the mix takes, and
    ``copy`` (long, from 1; a column of that name is replaced).  Of rows that repeat id,
    text and source, each gets the copies that they have together, divided by their number (the
    first by their other columns get the remainder)."""
    wanted = (plan(docs).groupBy("doc_id", "__th", "source")
              .agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
              .withColumnsRenamed({"doc_id": "__id", "source": "__source"}))
    wanted = wanted.filter("__copies > 0 OR __rows > 1")
    named = docs.withColumn("__hash", text_hash(F.col("text")))
    both = named.join(wanted, named["doc_id"].eqNullSafe(wanted["__id"]) & (named["__hash"] == wanted["__th"])
                      & named["source"].eqNullSafe(wanted["__source"]))
    # Equal rows are told apart by a number only where there are any.
    whole_row = F.to_json(F.struct(*[named[c] for c in docs.columns]))
    same = Window.partitionBy("doc_id", "__hash", "source").orderBy(F.md5(whole_row.cast("binary")))
    one = both.filter("__rows = 1").withColumn("__n", F.col("__copies"))
    more = both.filter("__rows > 1").withColumn("__i", F.row_number().over(same))
    more = more.withColumn("__n", F.expr("__copies div __rows + if(__i <= __copies % __rows, 1, 0)")).drop("__i")
    out = one.unionByName(more).filter("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    return out.select(*[c for c in docs.columns if c != "copy"], "copy")


def _oracle(rounds: int = 12) -> str:
    """DuckDB SQL; the resharing is unrolled (a round adds capped sources; 20 sources need few)."""
    sql = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\x0C\r]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS z,
              CAST([1, 2, 3][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w
       FROM d GROUP BY source),
l0 AS (SELECT (SELECT sum(z) FROM s0) / (SELECT sum(w) FROM s0) AS lv)"""
    for i in range(rounds):
        sql += f""",
l{i + 1} AS (SELECT coalesce(((SELECT sum(z) FROM s0) - sum(CASE WHEN lv * w > 3 * z THEN 3 * z ELSE 0 END))
              / nullif(sum(CASE WHEN lv * w > 3 * z THEN 0.0 ELSE w END), 0), max(lv)) AS lv FROM s0, l{i})"""
    return sql + f""",
t AS (SELECT source, z, least(lv * w, CAST(3 * z AS DOUBLE)) AS target,
             CAST(('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM s0, l{rounds}),
k AS (SELECT d.doc_id, d.size, t.z, t.target, t.u, CASE WHEN t.z > 0 THEN t.target / t.z ELSE 0.0 END AS r,
             CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.m, d.doc_id) AS DOUBLE) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z AS source_size, target,
       CAST(least(floor(u + r * k) - floor(u + r * (k - 1)), 3) * size AS BIGINT) AS taken FROM k
"""


ORACLE = _oracle()
