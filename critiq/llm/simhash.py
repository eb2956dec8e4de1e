"""SimHash near-duplicates by pivot distance tables.

Fingerprint: 64 bits over the XXH64 (seed 42) of word shingles; a bit is set if
more than half of the shingle hashes have it.  Two fingerprints are linked at
``max_bits`` or fewer differing bits; linked documents form components.

Candidates.  Distances of random 64-bit fingerprints to any reference lie at
32 +- 4, so coordinates alone cannot keep the search below all pairs.  The
fingerprints are therefore first dealt out exactly: the bits are cut into b
blocks, and of two fingerprints that differ in at most d bits at least b - d
blocks agree, so each choice of b - d blocks is a hash key, and every linked
pair meets under at least one key.  Within a key the pivot table holds each
fingerprint's Hamming distances to ``PIVOTS`` reference fingerprints; a pair
whose coordinates differ by more than d anywhere cannot be within d bits
(triangle inequality) and is discarded; survivors are verified exactly.

A key with very many fingerprints is cut into blocks that meet pairwise, each
pair of blocks in its own group.  Within a group only a spanning forest of the
links is emitted (a found node is never compared again), which loses no
connection and grows with the nodes, not the pairs.

Rows: null text = empty text; a text without words has fingerprint zero, and is
linked like any other.  A null doc_id gets a fingerprint and component like
any row; a component's id is its least non-null doc_id (null if it has none).
Repeated rows give repeated result rows.  Empty table: empty result."""
from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import prepare, same_row, shared_table, text_hash
from critiq.llm.components import components

SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: Reference fingerprints of the pivot table (pseudo-random, fixed by the seed).
PIVOTS = np.random.default_rng(SEED).integers(0, 2**64, size=16, dtype=np.uint64)
#: Fingerprints that one group compares; a key with more is cut into block pairs.
GROUP_LIMIT = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        return digest(b" ".join(parts), SEED)
    whole = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())],
                      dtype="<u8")
    raw, n = hashes.view(np.uint8).reshape(-1, 8), len(hashes)
    if n < 512:
        counts = np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprint_udf(shingle: int):
    @F.pandas_udf("long")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in text], dtype=np.uint64).view(np.int64))
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", _fingerprint_udf(shingle)(F.col("text")).alias("fp"))


def _blocks(n: int, max_bits: int) -> int:
    """Number of bit blocks with the least estimated work for ``n`` fingerprints
    (a key costs about 1 us to deal out, a pair 20 ns).  Results do not depend on it."""
    work = {b: comb(b, max_bits) * (n + 0.02 * n * n / 2 ** (64 * (b - max_bits) // b + 1))
            for b in range(max_bits + 1, max_bits + 6)}
    return min(work, key=work.get)


def _masks(b: int, max_bits: int) -> list[int]:
    cuts = [round(64 * i / b) for i in range(b + 1)]
    block = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(b)]
    return [sum(block[i] for i in kept) for kept in combinations(range(b), b - max_bits)]


def pivot_table(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _near(table, fps, i, j, max_bits):
    """Of the index pairs (i, j), those that pass the pivots and the exact check."""
    ok = np.abs(table[i] - table[j]).max(axis=-1) <= max_bits
    i, j = (i[ok] if np.ndim(i) else i), j[ok]
    ok = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
    return (i[ok] if np.ndim(i) else i), j[ok]


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among distinct fingerprints of one group."""
    table = pivot_table(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    left, found = np.arange(len(fps)), ([], [])     # left: not yet reached, ordered by the first coordinate
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            lo, hi = np.searchsorted(table[left, 0], (table[x, 0] - max_bits, table[x, 0] + max_bits + 1))
            _, hits = _near(table, fps, x, left[lo:hi], max_bits)
            if len(hits):
                found[0].append(np.full(len(hits), fps[x]))
                found[1].append(fps[hits])
                stack.extend(hits.tolist())
                left = left[np.isin(left, hits, assume_unique=True, invert=True)]
    none = [np.empty(0, np.uint64)]
    return np.concatenate(found[0] or none), np.concatenate(found[1] or none)


def _small_groups(keys, fps, max_bits):
    """Links among neighbours of equal key, for all small groups at once."""
    table, out = pivot_table(fps), ([], [])
    i = np.arange(len(fps))
    for step in range(1, len(fps)):
        i = i[i + step < len(fps)]
        i = i[keys[i] == keys[i + step]]
        if not len(i):
            break
        a, b = _near(table, fps, i, i + step, max_bits)
        out[0].append(fps[a])
        out[1].append(fps[b])
    none = [np.empty(0, np.uint64)]
    return np.concatenate(out[0] or none), np.concatenate(out[1] or none)


def _links_of(max_bits: int):
    def of(keys, fps):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        small = np.repeat((sizes > 1) & (sizes <= 64), sizes)
        found = [_small_groups(keys[small], fps[small], max_bits)]
        found += [forest(np.unique(fps[s:s + n]), max_bits) for s, n in zip(starts, sizes) if n > 64]
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        held = []                                        # batches that all belong to the last key
        for batch in batches:
            k = batch.column("key").to_numpy(zero_copy_only=False)
            f = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(k):
                continue
            held.append((k, f))
            if k[-1] == held[0][0][0]:
                continue
            keys, fps = (np.concatenate(x) for x in zip(*held))
            cut = np.searchsorted(keys, keys[-1])
            yield of(keys[:cut], fps[:cut])
            held = [(keys[cut:], fps[cut:])]
        if held:
            yield of(*(np.concatenate(x) for x in zip(*held)))
    return run


def links(nodes: DataFrame, n: int, max_bits: int = MAX_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``nodes.fp`` that connect
    every pair within ``max_bits`` (directly or through other links)."""
    signed = [m - 2**64 if m >= 2**63 else m for m in _masks(_blocks(n, max_bits), max_bits)]
    keyed = nodes.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)])).alias("key"))
    big = shared_table(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > group_limit), "big")
    parts = F.ceil(2 * F.col("n") / F.lit(group_limit))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts"))
    dealt = (keyed.join(big, "key", "left")
             .withColumn("parts", F.when(F.col("n").isNull(), F.lit(1)).otherwise(parts).cast("long"))
             .withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .select(F.when(F.col("parts") == 1, F.col("key")).otherwise(
                 F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), "fp"))
    return (dealt.repartition("key").sortWithinPartitions("key")
            .mapInArrow(_links_of(max_bits), "a long, b long"))


def _classes(fps: DataFrame, max_bits: int, group_limit: int) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``fps`` (doc_id, fp)."""
    nodes = shared_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), nodes.count(), max_bits, group_limit))
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "least")
    ids = linked.groupBy("root").agg(F.min("least").alias("id"))
    linked = linked.join(ids, "root").select(F.col("fp").alias("lfp"), "root", "id")
    return (nodes.join(linked, nodes["fp"] == linked["lfp"], "left")
            .select("fp", F.coalesce("root", "fp").alias("root"),
                    F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("id")).alias("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per document: (doc_id, fp long, component_id long)."""
    fps = shared_table(fingerprints(docs, shingle), "fps")
    # As a table of its own the join's both sides are plain shuffles, so a hot fingerprint can be split.
    classes = shared_table(_classes(fps, max_bits, group_limit).withColumnRenamed("fp", "cfp"), "classes")
    return fps.join(classes, fps["fp"] == classes["cfp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
             group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``docs`` (all its columns) with one document of each component: that with
    the least doc_id (nulls last, then the least text hash); of rows that
    repeat id and text, one."""
    prepare(docs.sparkSession)
    fps = shared_table(docs.select("doc_id", text_hash(F.col("text")).alias("__th"),
                                   _fingerprint_udf(shingle)(F.col("text")).alias("fp")), "fps")
    classes = shared_table(_classes(fps, max_bits, group_limit).withColumnRenamed("fp", "cfp"), "classes")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__th"))
    kept = fps.join(classes, fps["fp"] == classes["cfp"]).groupBy("root").agg(F.min(rank).alias("r"))
    kept = kept.select(F.col("r.doc_id").alias("__id"), F.col("r.__th").alias("__th"))
    twice = shared_table(fps.groupBy("doc_id", "__th").count().filter("count > 1")
                         .select(F.col("doc_id").alias("__id"), "__th"), "twice")
    named = docs.withColumn("__hash", text_hash(F.col("text")))
    out = named.join(kept, same_row(named, kept), "left_semi")
    if not twice.isEmpty():
        once = out.join(twice, same_row(out, twice), "left_anti")
        again = out.join(twice, same_row(out, twice), "left_semi").dropDuplicates(["doc_id", "__hash"])
        out = once.unionByName(again)
    return out.drop("__hash")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
