"""Toxicity by a linear-chain conditional random field.

Labels are given by document; token labels follow from them.  Word forms (words, and beginnings that several
different words share) which mark toxic documents by their likelihood ratio (Dunning's G2, over groups of near
copies, each counted once) are the lexicon; its words in toxic documents are the toxic tokens of the sample, all other
tokens are clean.

The CRF has two states.  Every token of a text takes part: its emission is the sum of the weights of its hashed
features (the word, its beginnings of 3 to 7 letters, its ending, its shape), so that a word which was never seen is
tagged by its parts; the transitions are a 2x2 matrix.  It is fitted to windows around toxic tokens and to other stretches of both
kinds of documents by its exact gradient (forward-backward).

Forward-backward marginals over the whole text give the spans (``offsets``, code points, end exclusive) and, summed up,
the document's features (highest marginal, expected toxic tokens, their share).  A logistic layer turns
them into a score; it is fitted to features that a CRF of the other half of the sample gave (cross-fitting), so that it
has not seen the words it is judged by, and its threshold is checked there.

Training takes at most ``SAMPLE`` documents of either label (those with the least hash, by a
threshold set from exact counts) of at most ``SAMPLE_CHARS`` code points each.

Rows: null text = empty text: it scores as a text without tokens.  Documents without a label, and
null labels, are not learned from; null ids count as held out.  Of repeated label rows each counts.
Without labels of both kinds everything scores 0.  Repeated rows: as many result rows."""
from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import prepare
from critiq.llm.langid import held_out

SAMPLE = 1500
SAMPLE_CHARS = 20_000
LEAST_DOCS = 4
#: Of the likelihood ratio; and of the log-odds that a form marks a toxic document.
LEAST_G2 = 18.0
LEAST_ODDS = 2.0
#: A beginning of words stands for them only if this many different words share it.
LEAST_WORDS = 3
SIDE = 4            # tokens kept on either side of a toxic token for training
STRETCHES = 3       # other windows of each document
HASHES = 1 << 18
WIDTH = 8           # features of a token
#: Tokens (padded) that forward-backward holds at once.
HELD = 1 << 21
_WORD = re.compile(r"[^\W\d_]+")


def forms(word: str) -> list[str]:
    """What can stand for a word in the lexicon: itself, and its beginnings (marked by a star)."""
    return [word, *(word[:k] + "*" for k in range(3, min(len(word), 8)))]


def copies(words: list[list[str]]) -> np.ndarray:
    """Group number of each document: documents that share most minimal hashes of their word
    triples are near copies of one another."""
    signs, root = [], list(range(len(words)))
    for w in words:
        h = np.array([zlib.crc32(" ".join(w[i:i + 3]).encode()) for i in range(max(1, len(w) - 2))], np.uint64)
        signs.append([int(((h * np.uint64(2 * k + 1) * np.uint64(0x9E3779B1)) >> np.uint64(7) & np.uint64(0xFFFFFFFF)).min()) for k in range(16)])

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    seen: dict = {}
    for i, s in enumerate(signs):
        for k, h in enumerate(s):
            j = seen.setdefault((k, h), i)
            if j != i and find(i) != find(j) and sum(a == b for a, b in zip(s, signs[j])) >= 8:
                root[find(i)] = find(j)
    return np.array([find(i) for i in range(len(words))])


def lexicon(words: list[list[str]], toxic: np.ndarray, group: np.ndarray) -> list[str]:
    """Words and beginnings of words that mark the toxic documents; of forms that cover one another
    the most significant (then the longest)."""
    marked: dict = {}
    for w, t, g in zip(words, toxic, group):
        marked.setdefault((g, int(t)), set()).update(x for x in set(w) if len(x) >= 3)
    n1, n0 = (sum(t == k for _, t in marked) for k in (1, 0))
    c1, c0, share = Counter(), Counter(), defaultdict(set)
    for (_, t), own in marked.items():
        (c1 if t else c0).update({f for x in own for f in forms(x)})
        if t:
            for x in own:
                for f in forms(x)[1:]:
                    if len(share[f]) < LEAST_WORDS:
                        share[f].add(x)
    found = []
    for form, a in c1.items():
        b = c0.get(form, 0)
        if a < LEAST_DOCS or (form[-1] == "*" and len(share[form]) < LEAST_WORDS):
            continue
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        if odds < LEAST_ODDS:
            continue
        cells = np.array([[a, b], [n1 - a, n0 - b]], float)
        even = np.outer(cells.sum(1), cells.sum(0)) / cells.sum()
        g2 = 2 * (cells * np.log(np.maximum(cells, 1e-12) / even)).sum()
        if g2 >= LEAST_G2:
            found.append((-round(g2, 6), -len(form), form))
    out: list[str] = []
    for _, _, form in sorted(found):
        own = form.rstrip("*")
        covered = any(o[-1] == "*" and own.startswith(o[:-1]) for o in out)
        covering = form[-1] == "*" and any(o.startswith(own) for o in out)
        if not covered and not covering:
            out.append(form)
    return sorted(out)


def features(word: str) -> list[int]:
    """Hashed features of a token: ``WIDTH`` of them, 0 for none."""
    low = word.lower()
    shape = "upper" if len(word) > 1 and word.isupper() else "title" if word[:1].isupper() else "lower"
    parts = ["w:" + low, "e:" + low[-3:], "s:" + shape, *("b:" + low[:k] for k in range(3, 8) if len(low) >= k)]
    return [zlib.crc32(p.encode("utf-8")) % (HASHES - 1) + 1 for p in parts] + [0] * (WIDTH - len(parts))


def _logsumexp(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Chain:
    """Linear-chain CRF: a token's log-odds of being toxic are ``bias`` and the weights of its features."""

    def __init__(self):
        self.weights, self.bias, self.move = np.zeros(HASHES), np.zeros(1), np.zeros((2, 2))

    def odds(self, table: np.ndarray) -> np.ndarray:
        """Log-odds of tokens from their features (n, WIDTH)."""
        return np.where(table > 0, self.weights[table], 0.0).sum(1) + self.bias[0]

    def gradient(self, table: np.ndarray, x: np.ndarray, y: np.ndarray):
        """table: features of the distinct tokens; x, y (n, length): tokens and states.  Gradient of the mean
        log-likelihood for weights, bias and moves."""
        n, length = x.shape
        o = self.odds(table)[x]
        e = np.stack([np.zeros_like(o), o], axis=2)
        fwd, bwd = [e[:, 0]], [np.zeros((n, 2))]
        for t in range(1, length):
            fwd.append(e[:, t] + _logsumexp(fwd[-1][:, :, None] + self.move, 1))
        for t in range(length - 1, 0, -1):
            bwd.append(_logsumexp(self.move + (e[:, t] + bwd[-1])[:, None, :], 2))
        bwd.reverse()
        z = _logsumexp(fwd[-1], 1)
        g_token, g_move = np.zeros(len(table)), np.zeros((2, 2))
        for t in range(length):
            p = np.exp(fwd[t] + bwd[t] - z[:, None])
            g_token += np.bincount(x[:, t], y[:, t] - p[:, 1], len(table))
            if t:
                both = np.exp(fwd[t - 1][:, :, None] + self.move + (e[:, t] + bwd[t])[:, None, :] - z[:, None, None])
                g_move -= both.sum(axis=0)
                np.add.at(g_move, (y[:, t - 1], y[:, t]), 1)
        g = np.bincount(table.ravel(), np.repeat(g_token, table.shape[1]), HASHES)
        g[0] = 0
        return g / n, np.array([g_token.sum() / n]), g_move / n

    def fit(self, table: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int = 60, penalty: float = 1e-4) -> None:
        used = np.unique(table)                                    # only the features that occur move
        params = [np.zeros(len(used)), self.bias, self.move]
        m, v = ([np.zeros_like(p) for p in params] for _ in "mv")
        for t in range(1, steps + 1):
            self.weights[used] = params[0]
            g = list(self.gradient(table, x, y))
            g[0] = g[0][used]
            for p, q, a, s in zip(params, g, m, v):
                q = q - penalty * p
                a += 0.1 * (q - a)
                s += 0.01 * (q * q - s)
                p += 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        self.weights[used] = params[0]

    def marginals(self, odds: list[np.ndarray]) -> list[np.ndarray]:
        """P(toxic) of every token of every text, from the tokens' log-odds: texts of like length side by side."""
        out: list = [np.empty(0)] * len(odds)
        order = sorted((k for k in range(len(odds)) if len(odds[k])), key=lambda k: -len(odds[k]))
        move = np.exp(self.move - self.move.max())
        at = 0
        while at < len(order):
            longest = len(odds[order[at]])
            some = order[at:at + max(1, HELD // longest)]
            at += len(some)
            size = np.array([len(odds[k]) for k in some])
            e = np.zeros((longest, len(some)))
            for c, k in enumerate(some):
                e[:size[c], c] = np.clip(odds[k], -30, 30)
            e = np.exp(e)
            on = np.searchsorted(-size, -np.arange(longest), side="left")      # texts that reach each place
            fwd, bwd = np.empty((2, longest, len(some))), np.ones((2, longest, len(some)))
            a0, a1 = np.ones(len(some)), e[0].copy()
            s = a0 + a1
            fwd[0, 0], fwd[1, 0] = a0 / s, a1 / s
            for t in range(1, longest):
                n = on[t]
                p0, p1 = fwd[0, t - 1, :n], fwd[1, t - 1, :n]
                a0 = p0 * move[0, 0] + p1 * move[1, 0]
                a1 = (p0 * move[0, 1] + p1 * move[1, 1]) * e[t, :n]
                s = a0 + a1
                fwd[0, t, :n], fwd[1, t, :n] = a0 / s, a1 / s
            for t in range(longest - 1, 0, -1):
                n = on[t]
                b0, b1 = bwd[0, t, :n], bwd[1, t, :n] * e[t, :n]
                a0, a1 = move[0, 0] * b0 + move[0, 1] * b1, move[1, 0] * b0 + move[1, 1] * b1
                s = a0 + a1
                bwd[0, t - 1, :n], bwd[1, t - 1, :n] = a0 / s, a1 / s
            for c, k in enumerate(some):
                p = fwd[:, :size[c], c] * bwd[:, :size[c], c]
                out[k] = p[1] / p.sum(0)
        return out


class Model:
    """Chain and logistic layer; log-odds of the words met so far are kept by the task that reads them."""

    KEPT = 300_000

    def __init__(self, words: list[str], chain: Chain | None, layer: np.ndarray):
        self.words, self.chain, self.layer, self._odds = words, chain, layer, {}

    def __getstate__(self):
        return {**self.__dict__, "_odds": {}}

    def odds(self, texts: list[list[str]]) -> list[np.ndarray]:
        known = self._odds
        if len(known) > self.KEPT:
            known.clear()
        new = sorted({w for t in texts for w in t}.difference(known))
        if new:
            known.update(zip(new, self.chain.odds(np.array([features(w) for w in new])).tolist()))
        return [np.fromiter(map(known.__getitem__, t), float, len(t)) for t in texts]

    @staticmethod
    def summary(p: np.ndarray) -> list[float]:
        """Features of a document."""
        if not len(p):
            return [1.0, 0.0, 0.0, 0.0]
        clear = p[p > 0.01].sum()
        return [1.0, float(p.max()), float(np.log1p(clear)), float(min(1.0, 20 * clear / max(len(p), 20)))]

    def read(self, texts: list[str | None]) -> list[np.ndarray]:
        """Marginals of every token of every text."""
        if self.chain is None:
            return [np.empty(0)] * len(texts)
        return self.chain.marginals(self.odds([_WORD.findall(t or "") for t in texts]))

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int]]]]:
        out = []
        for text, p in zip(texts, self.read(texts)):
            hits = np.flatnonzero(p >= 0.5)
            spans = []
            if len(hits):
                places = [m.span() for m in _WORD.finditer(text)]
                spans = [places[k] for k in hits]
            z = float(np.clip(np.dot(self.layer, self.summary(p)), -500, 500))
            out.append((1 / (1 + float(np.exp(-z))), spans))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        return self.scores([text])[0]


def fit_chain(words: list[list[str]], toxic: np.ndarray, group: np.ndarray, seed: int = 42) -> tuple[list[str], Chain]:
    """Lexicon and CRF of tokenised documents."""
    found = set(lexicon([[w.lower() for w in t] for t in words], toxic, group))
    kinds: dict = {}
    x, y, rng, width = [], [], np.random.default_rng(seed), 2 * SIDE + 1
    is_toxic: dict = {}
    for w, t in zip(words, toxic):
        if not w:
            continue
        ids = np.array([kinds.setdefault(u, len(kinds) + 1) for u in w])   # 0 pads
        for u in set(w).difference(is_toxic):
            is_toxic[u] = any(f in found for f in forms(u.lower()))
        marks = np.array([is_toxic[u] for u in w])
        centres = np.r_[np.flatnonzero(marks)[:8], rng.integers(0, len(ids), STRETCHES)]
        padded, states = np.pad(ids, SIDE), np.pad(marks * int(t), SIDE)
        for c in centres:
            x.append(padded[c:c + width])
            y.append(states[c:c + width])
    chain = Chain()
    if x:
        x, y = np.array(x), np.array(y).astype(np.int64)
        used = np.unique(x)
        names = ["", *kinds]
        table = np.array([features(names[k]) if k else [0] * WIDTH for k in used])
        # Every other window is seen without its words and endings, so that beginnings carry weight of their own.
        bare = np.where(np.arange(WIDTH) < 2, 0, table)
        x = np.searchsorted(used, x) + len(used) * (np.arange(len(x)) % 2)[:, None]
        chain.fit(np.concatenate([table, bare]), x, y)
    return sorted(found), chain


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    words = [_WORD.findall(t) for t in texts]
    group = copies([[w.lower() for w in t] for t in words])
    half = np.array([zlib.crc32(str(g).encode()) % 2 for g in group])      # near copies stay on one side
    f = np.zeros((len(texts), 4))
    for k in (0, 1):
        other, own = np.flatnonzero(half != k), np.flatnonzero(half == k)
        _, chain = fit_chain([words[i] for i in other], toxic[other], group[other])
        read = Model([], chain, np.zeros(4)).read([texts[i] for i in own])
        f[own] = np.array([Model.summary(p) for p in read]).reshape(len(own), 4)
    beta = np.zeros(4)
    for _ in range(50):                                          # Newton's method
        p = 1 / (1 + np.exp(-f @ beta))
        grad = f.T @ (toxic - p) - 0.5 * beta * [0, 1, 1, 1]
        hess = (f * (p * (1 - p))[:, None]).T @ f + np.diag([1e-3, 0.5, 0.5, 0.5])
        beta = beta + np.linalg.solve(hess, grad)
    found, chain = fit_chain(words, toxic, group)
    return Model(found, chain, beta)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled documents that are not held out."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select(
        F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
    counts = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    if len(counts) < 2:
        return Model([], None, np.array([-50.0, 0, 0, 0]))
    draw = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("__toxic") == 1, SAMPLE / counts[1]).otherwise(SAMPLE / counts[0])
    known = known.filter(draw < share).limit(3 * SAMPLE)
    texts = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
    sample = texts.join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("text", "__toxic").toPandas()
    sample = sample.sort_values(["text", "__toxic"])
    sample = sample.drop_duplicates("text")              # copies are no further evidence
    if sample["__toxic"].nunique() < 2:
        return Model([], None, np.array([-50.0, 0, 0, 0]))
    model = fit(sample["text"].tolist(), sample["__toxic"].to_numpy())
    # The sample holds both labels alike; the bias goes back to the labels' real ratio.
    seen = sample["__toxic"].value_counts()
    model.layer[0] += np.log(counts[1] / counts[0]) - np.log(seen[1] / seen[0])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score double and offsets array<struct<start,end>> (columns of these names are replaced)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, offsets array<struct<start:int,end:int>>")
    def run(text: pd.Series) -> pd.DataFrame:
        got = shared.value.scores(list(text))
        return pd.DataFrame({"score": [s for s, _ in got],
                             "offsets": [[{"start": a, "end": b} for a, b in x] for _, x in got]})

    return (docs.withColumn("__toxic", run(F.col("text"))).withColumn("score", F.col("__toxic.score"))
            .withColumn("offsets", F.col("__toxic.offsets")).drop("__toxic"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"), train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
        F.size("offsets").cast("long").alias("n_spans"))
