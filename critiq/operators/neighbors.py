"""Exact k nearest neighbours by metric pivots.

Every training vector goes to the nearest of a bounded number of centres (its cell).  A cell is known by the
least and the greatest distance of its members to each of a few landmarks.  By the triangle inequality a
member of cell c is at least max_j(d(q, L_j) - hi_cj, lo_cj - d(q, L_j)) away from a query q, so no cell whose
bound exceeds the query's k-th distance so far has to be looked at.  The answer is exact; how much is
computed depends on the data (vectors in clusters: little; random directions in many dimensions: nearly everything).

Cells that lie next to each other make up blocks of about ``TRAIN_CHUNK`` rows, and a query is sent to
blocks, not to cells: first to the block of its own cell, then to all other blocks that its k-th distance
leaves.  So a vector is copied at most as often as there are blocks on the other side, whatever the number of
cells.  Inside a block the queries of ``QUERY_CHUNK`` rows look cell by cell, with one matrix product for the
candidates; only pairs that may be among the k nearest are computed in the SQL's own order of sums.  A
vector that many training rows share counts with its k + 1 lowest ids (no query can take more).

Centres and landmarks are rows of a sample of at most ``SAMPLE`` training vectors (landmarks: farthest
first), and only they and the cells' ranges travel to the tasks: at most ``MAX_CELLS`` rows, whatever the
corpus.  A cell with many rows is cut into blocks by its own counts, so no task holds a whole hot cell.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..session import checkpointed

SAMPLE = 4096
LANDMARKS = 16
MAX_CELLS = 1024
#: Rows of a task's block of queries and of training vectors.
QUERY_CHUNK = 16384
TRAIN_CHUNK = 16384
#: Queries whose distances to a block exist at once.
TILE = 256
#: Distances are compared after rounding to 9 places; bounds leave this much room.
SLACK = 1e-8


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0.0))


def _to_landmarks(v: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Distances without cancellation: the bounds are made of them."""
    return np.sqrt(((v[:, None, :] - landmarks[None]) ** 2).sum(2))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of ``x``, each the farthest from those before."""
    picked = [0]
    far = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(picked) < min(n, len(x)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((x - x[picked[-1]]) ** 2).sum(1)))
    return x[picked]


def cell_bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least possible distance of each query (rows: its landmark distances) to each cell."""
    out = np.zeros((len(q), len(lo)))
    for j in range(q.shape[1]):
        d = q[:, j][:, None]
        np.maximum(out, np.maximum(d - hi[:, j][None, :], lo[:, j][None, :] - d), out=out)
    return out


class _Space:
    """Centres, landmarks and, once the training rows are dealt out, the cells' ranges and blocks."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.centres, self.landmarks = sample[:cells], farthest_first(sample, LANDMARKS)
        self.used = self.lo = self.hi = self.first = self.many = None

    def deal(self, frames):
        for df in frames:
            for s in range(0, len(df), 1024):
                part = df.iloc[s:s + 1024]
                v = np.stack(part["_tv"].to_numpy())
                out = part.assign(_c=_distances(v, self.centres).argmin(1).astype(np.int32))
                out["_td"] = list(_to_landmarks(v, self.landmarks))
                yield out[["_c", "_t", "_tv", "_td"]]

    def lay_out(self, ranges: list) -> int:
        """Takes the cells' counts and ranges; deals the cells, along a walk from each to a near one, into blocks of
        about ``TRAIN_CHUNK`` rows.  A larger cell has blocks of its own.  Returns the number of blocks."""
        rest = list(range(len(ranges)))
        centres = self.centres[[r["_c"] for r in ranges]]
        far, walk = _distances(centres, centres), []
        while rest:
            at = rest[0] if not walk else min(rest, key=lambda i: far[walk[-1], i])
            rest.remove(at)
            walk.append(at)
        ranges = [ranges[i] for i in walk]
        self.used = np.array([r["_c"] for r in ranges])
        self.lo, self.hi = np.array([r["lo"] for r in ranges]), np.array([r["hi"] for r in ranges])
        first, many, block, filled = [], [], 0, 0
        for r in ranges:
            n = -(-r["n"] // TRAIN_CHUNK)
            if filled and (n > 1 or filled + r["n"] > TRAIN_CHUNK):
                block, filled = block + 1, 0
            first.append(block)
            many.append(n)
            block, filled = (block + n, 0) if n > 1 else (block, filled + r["n"])
        self.first, self.many = np.array(first), np.array(many)
        return block + (filled > 0)

    def homes(self, frames):
        """Block, or blocks of a large cell, that each query is sent to first."""
        for df in frames:
            for s in range(0, len(df), 4096):
                part = df.iloc[s:s + 4096]
                v = np.stack(part["_qv"].to_numpy())
                near = _distances(v, self.centres[self.used]).argmin(1)
                out = part.assign(_b=self.first[near].astype(np.int32))
                yield out[["_b", "_q", "_qv", "_kth"]]

    def others(self, frames):
        """All other blocks that the bounds leave."""
        ends = self.first + self.many
        for df in frames:
            for s in range(0, len(df), 1024):
                part = df.iloc[s:s + 1024]
                v = np.stack(part["_qv"].to_numpy())
                kth = part["_kth"].to_numpy(dtype=float)
                open_ = self.bounds(v) <= (kth * (1 + SLACK) + SLACK)[:, None]
                near = self.first[_distances(v, self.centres[self.used]).argmin(1)]
                at, cell = np.nonzero(open_)
                grown = np.repeat(np.arange(len(at)), self.many[cell])
                step = np.arange(len(grown)) - np.repeat(np.cumsum(self.many[cell]) - self.many[cell], self.many[cell])
                sent = np.unique(at[grown] * np.int64(ends.max()) + self.first[cell[grown]] + step)
                at, block = np.divmod(sent, ends.max())
                at, block = at[block != near[at]], block[block != near[at]]
                for t in range(0, len(at), 4096):
                    out = part.iloc[at[t:t + 4096]].copy()
                    out["_b"] = block[t:t + 4096].astype(np.int32)
                    yield out[["_b", "_q", "_qv", "_kth"]]

    def bounds(self, v: np.ndarray) -> np.ndarray:
        return cell_bounds(_to_landmarks(v, self.landmarks), self.lo, self.hi)


def knn(train: DataFrame, test: DataFrame, tid: str, qid: str, vec: str, k: int = 5,
        exclude_self: bool = False, target: int = 64, seed: int = fixed.SEED, report: dict | None = None) -> DataFrame:
    """W5 + J8: (qid, rank, tid, dist) for the k nearest training points of
    every query (Euclidean; ties by training id).  With ``exclude_self`` a
    query never matches the training row with the same id (leave-one-out).
    ``target``: rows of a cell, about, as long as ``MAX_CELLS`` are enough.  ``report`` gets the numbers
    of ``pairs`` there are and of distances ``computed``."""
    spark = train.sparkSession
    tr = train.select(F.col(tid).cast("long").alias("_t"), F.col(vec).cast("array<double>").alias("_tv"))
    queries = test.select(F.col(qid).cast("long").alias("_q"), F.col(vec).cast("array<double>").alias("_qv"))
    n = tr.count()
    sample = tr.orderBy(F.xxhash64("_t", F.lit(seed)), "_t").limit(SAMPLE).toPandas()
    if not n:
        return queries.filter("false").select(F.col("_q").alias(qid), F.lit(1).alias("rank"), F.col("_q").alias(tid),
                                              F.lit(0.0).alias("dist"))
    space = _Space(np.stack(sample["_tv"].to_numpy()), max(1, min(MAX_CELLS, len(sample), -(-n // target))))
    copies = Window.partitionBy("_tv").orderBy("_t")
    tr = tr.withColumn("_r", F.dense_rank().over(copies)).filter(F.col("_r") <= k + 1).drop("_r")
    tr = checkpointed(tr.mapInPandas(space.deal, "_c int, _t long, _tv array<double>, _td array<double>"))
    n_marks = len(space.landmarks)
    blocks = space.lay_out(sorted(tr.groupBy("_c").agg(                     # at most MAX_CELLS rows
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.min(F.col("_td")[j]) for j in range(n_marks)]).alias("lo"),
        F.array(*[F.max(F.col("_td")[j]) for j in range(n_marks)]).alias("hi")).collect()))
    place = spark.createDataFrame([(int(c), int(b), int(m)) for c, b, m in zip(space.used, space.first, space.many)],
                                  "_c int, _first int, _many int")
    tr = tr.select("_c", "_t", "_tv").join(F.broadcast(place), "_c").select(
        (F.col("_first") + F.pmod(F.xxhash64("_t"), F.col("_many"))).cast("int").alias("_b"), "_c", "_t", "_tv")
    computed = spark.sparkContext.accumulator(0)

    def searched(sent):
        """The ``k`` nearest of each query in the blocks it is sent to, one task per (block, query chunk)."""
        sent = checkpointed(sent)
        chunks = sent.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).alias("_n"))
        chunks = F.broadcast(spark.createDataFrame([(r["_b"], int(r["_n"])) for r in chunks.collect()],   # a row a block
                                                   "_b int, _n long"))
        qs = sent.join(chunks, "_b").select("_b", F.pmod(F.xxhash64("_q"), F.col("_n")).alias("_qc"), "_q", "_qv", "_kth")
        ts = tr.join(chunks, "_b").select("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_qc"),
                                          "_c", "_t", "_tv")
        return (qs.groupBy("_b", "_qc").cogroup(ts.groupBy("_b", "_qc"))
                .applyInPandas(_block(k, exclude_self, computed, space), "_q long, _t long, dist double"))

    win = Window.partitionBy("_q").orderBy(F.round("dist", 9), "_t")
    first = queries.withColumn("_kth", F.lit(float("inf"))).mapInPandas(
        space.homes, "_b int, _q long, _qv array<double>, _kth double")
    best = checkpointed(searched(first).withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= k))
    if blocks > 1:
        kth = best.groupBy("_q").agg(F.count(F.lit(1)).alias("_n"), F.max("dist").alias("_far"))
        left = queries.join(kth, "_q", "left").select(
            "_q", "_qv", F.when(F.col("_n") >= k, F.col("_far")).otherwise(F.lit(float("inf"))).alias("_kth"))
        more = searched(left.mapInPandas(space.others, "_b int, _q long, _qv array<double>, _kth double"))
        found = more.unionByName(best.drop("rank"))
        best = checkpointed(found.withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= k))
    if report is not None:
        report.update(pairs=n * queries.count(), computed=computed.value)
    return best.select(F.col("_q").alias(qid), "rank", F.col("_t").alias(tid), "dist")


def _block(k: int, exclude_self: bool, computed, space: _Space):
    at_cell = {int(c): i for i, c in enumerate(space.used)}

    def run(qdf: pd.DataFrame, tdf: pd.DataFrame) -> pd.DataFrame:
        out_q, out_t, out_d = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if not qdf.empty and not tdf.empty:
            tdf = tdf.sort_values(["_c", "_t"], kind="stable")
            tid = tdf["_t"].to_numpy(dtype=np.int64)
            tv = np.stack(tdf["_tv"].to_numpy())
            middle = tv.mean(0)                                    # near the origin the matrix product cancels less
            tm = tv - middle
            tn = (tm * tm).sum(1)
            cells, starts = np.unique(tdf["_c"].to_numpy(), return_index=True)
            ends = np.append(starts[1:], len(tid))
            held = np.array([at_cell[int(c)] for c in cells])
            for s in range(0, len(qdf), TILE):
                part = qdf.iloc[s:s + TILE]
                qid = part["_q"].to_numpy(dtype=np.int64)
                qv = np.stack(part["_qv"].to_numpy())
                qm = qv - middle
                qn = (qm * qm).sum(1)
                limit = part["_kth"].to_numpy(dtype=float) * (1 + SLACK) + SLACK
                bound = space.bounds(qv)[:, held]
                room = 1e-12 * (qn + tn.max()) + 1e-300            # error of the squares, as the product has them
                square = np.full((len(qid), len(tid)), np.inf)

                def fill(rows, a, b):
                    got = np.maximum(qn[rows, None] + tn[None, a:b] - 2 * qm[rows] @ tm[a:b].T, 0.0)
                    if exclude_self:
                        got[qid[rows, None] == tid[None, a:b]] = np.inf
                    square[rows, a:b] = got
                    computed.add(int(got.size))

                def tighten(rows, values):
                    """No limit beyond the k-th of ``values``, with the room twice."""
                    if values.shape[1] > k:
                        kth = np.partition(values, k - 1, axis=1)[:, k - 1]
                        limit[rows] = np.minimum(limit[rows], np.sqrt(kth + 2 * room[rows]) * (1 + SLACK) + SLACK)

                every = np.arange(len(qid))
                home = np.lexsort((_distances(qv, space.centres[cells]), bound))[:, 0]
                for at in np.unique(home):                         # each query's nearest cell gives it a first limit
                    rows = every[(home == at) & (bound[:, at] <= limit)]
                    if len(rows):
                        fill(rows, starts[at], ends[at])
                        tighten(rows, square[rows, starts[at]:ends[at]])
                open_ = bound <= limit[:, None]
                open_[every, home] = False
                if 2 * (open_ @ (ends - starts)).sum() > square.size:
                    fill(every, 0, len(tid))                       # most pairs: one product is faster than many
                else:
                    for at in np.nonzero(open_.any(0))[0]:
                        fill(every[open_[:, at]], starts[at], ends[at])
                near = square <= (limit ** 2 + room)[:, None]
                near &= np.isfinite(square)
                if near.sum() > 16 * k * len(qid):
                    tighten(every, square)
                    near = square <= (limit ** 2 + room)[:, None]
                    near &= np.isfinite(square)
                rows, cols = np.nonzero(near)
                if not len(rows):
                    continue
                dist = np.empty(len(rows))
                for t in range(0, len(rows), 1 << 18):
                    r, c = rows[t:t + (1 << 18)], cols[t:t + (1 << 18)]
                    acc = np.zeros(len(r))
                    for d in range(qv.shape[1]):                   # same left-to-right sum as the SQL fold
                        diff = qv[r, d] - tv[c, d]
                        acc += diff * diff
                    dist[t:t + (1 << 18)] = np.sqrt(acc)
                order = np.lexsort((tid[cols], np.round(dist, 9), rows))
                rows, cols, dist = rows[order], cols[order], dist[order]
                first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                out_q.append(qid[rows[first]])
                out_t.append(tid[cols[first]])
                out_d.append(dist[first])
        return pd.DataFrame({"_q": np.concatenate(out_q), "_t": np.concatenate(out_t), "dist": np.concatenate(out_d)})
    return run


def knn_vote(neighbors: DataFrame, train_labels: DataFrame, qid: str, tid: str, label: str) -> DataFrame:
    """C1 prediction: majority label among the neighbours (uniform weights),
    ties -> smallest label."""
    j = neighbors.join(train_labels.select(F.col(tid), F.col(label).alias("_l")), tid)
    votes = j.groupBy(qid, "_l").agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(qid).agg(F.max_by("_l", F.struct("_n", -F.col("_l"))).alias("predicted"))


def knn_label_sets(neighbors: DataFrame, train_labels: DataFrame, qid: str, tid: str, labels: str) -> DataFrame:
    """C1, multi-label: (qid, predicted) with the sorted labels that more than half of
    the query's neighbours have (one vote per label, uniform weights)."""
    n = neighbors.groupBy(qid).agg(F.count(F.lit(1)).alias("_n"))
    votes = (neighbors.join(train_labels.select(tid, F.explode(F.array_distinct(labels)).alias("_l")), tid)
             .groupBy(qid, "_l").agg(F.count(F.lit(1)).alias("_c")))
    sets = (votes.join(n, qid).filter(2 * F.col("_c") > F.col("_n")).groupBy(qid)
            .agg(F.array_sort(F.collect_list("_l")).alias("predicted")))
    return n.select(qid).join(sets, qid, "left").select(
        qid, F.coalesce("predicted", F.array().cast("array<string>")).alias("predicted"))
