"""Language identification by a byte convolutional network, trained in numpy.

The lower-cased text's UTF-8 bytes are cut into windows of ``SPAN`` bytes (the last
one padded).  The network embeds bytes, runs filters of widths 2, 3 and 4, takes each
filter's maximum over the window and ends in a softmax over the languages.  A text's
class probabilities are its windows' averages, weighed by the windows' bytes.

Prediction folds embedding and filters into tables: a filter of width w at a position
is a sum of table rows, picked by pairs of bytes.

Training: at most ``DOCS_PER_LANG`` documents a language (those with the least hash, by
a threshold on the hash set from exact counts) and ``WINDOWS_PER_DOC`` windows of each, some of
them cut short.  Every language is learned; with more than ``DOCS`` / ``DOCS_PER_LANG`` of them fewer documents of each
are taken, ``LEAST_DOCS`` at least.

Rows: null texts and texts without a letter are ``und`` with score 0.  Rows with null lang or
text are not learned from; a null doc_id counts as held out.  Without any row to learn from
everything is ``und``.  Repeated rows: as many result rows."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import prepare

SPAN = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
DOCS_PER_LANG = 300
WINDOWS_PER_DOC = 4
DOCS = 64 * DOCS_PER_LANG
LEAST_DOCS = 20
STEPS = 400
BATCH = 128
TRAIN_SPAN = 128
REACH = max(WIDTHS) - 1


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, mod ``folds``, is 0 (null id: true)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)) == 0


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8"), np.uint8)


class Network:
    """Parameters: E (256, e); per width w: W (w, e, f); b (3f); O (3f, classes); o."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.W = [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.b = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.O = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
        self.o = np.zeros(classes, np.float32)

    @property
    def parameters(self):
        return [self.E, *self.W, self.b, self.O, self.o]

    def _softmax(self, hidden):
        z = hidden @ self.O + self.o
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray):
        """x (n, span + REACH) bytes; y (n,) classes.  Mean cross-entropy's gradients."""
        n, span = len(x), x.shape[1] - REACH
        tops, spots = [], []
        for w, weight in zip(WIDTHS, self.W):
            table = np.einsum("be,wef->wbf", self.E, weight)
            conv = sum(table[k][x[:, k:k + span]] for k in range(w))
            spot = conv.argmax(axis=1)
            tops.append(np.take_along_axis(conv, spot[:, None], axis=1)[:, 0])
            spots.append(spot)
        hidden = np.maximum(np.concatenate(tops, axis=1) + self.b, 0)
        p = self._softmax(hidden)
        p[np.arange(n), y] -= 1
        p /= n
        g_hidden = (p @ self.O.T) * (hidden > 0)
        g_E, g_W = np.zeros_like(self.E), []
        rows = np.arange(n)[:, None]
        for k, (w, weight) in enumerate(zip(WIDTHS, self.W)):
            g = g_hidden[:, k * FILTERS:(k + 1) * FILTERS]
            g_w = np.zeros_like(weight)
            for i in range(w):
                byte = x[rows, spots[k] + i]
                g_w[i] = np.einsum("nfe,nf->ef", self.E[byte], g)
                np.add.at(g_E, byte.ravel(), (g[:, :, None] * weight[i].T[None]).reshape(-1, EMBED))
            g_W.append(g_w)
        return [g_E, *g_W, g_hidden.sum(axis=0), hidden.T @ p, p.sum(axis=0)]

    def fit(self, windows: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam on random batches; half of a batch's windows are cut to a random length."""
        rng = np.random.default_rng(seed)
        data = np.zeros((len(windows), TRAIN_SPAN + REACH), np.uint8)
        for row, w in zip(data, windows):
            row[:min(len(w), TRAIN_SPAN)] = w[:TRAIN_SPAN]
        m, v = ([np.zeros_like(p) for p in self.parameters] for _ in range(2))
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(data), BATCH)
            x = data[pick].copy()
            for row in x[::2]:
                row[rng.integers(8, TRAIN_SPAN):] = 0
            rate = 0.01 * (1 - t / (steps + 1))
            for p, g, a, s in zip(self.parameters, self.gradients(x, labels[pick]), m, v):
                a += 0.1 * (g - a)
                s += 0.001 * (g * g - s)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-7)

    def tables(self):
        """A: (65536, 3f) by the byte pair at a position; B: (65536, 2f) by the pair two bytes on."""
        one = [np.einsum("be,wef->wbf", self.E, w) for w in self.W]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        first = np.concatenate([pair(t[0], t[1]) for t in one], axis=1)
        second = np.concatenate([pair(one[1][2], np.zeros_like(one[1][2])), pair(one[2][2], one[2][3])], axis=1)
        return np.ascontiguousarray(first, np.float32), np.ascontiguousarray(second, np.float32)


class Predictor:
    def __init__(self, net: Network, languages: list[str]):
        self.net, self.languages, self._tables = net, languages, None

    def __getstate__(self):
        return {"net": self.net, "languages": self.languages, "_tables": None}   # tables are made in the worker

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """windows (n, SPAN + REACH) bytes, few at a time so that all stays in the cache."""
        if self._tables is None:
            self._tables = self.net.tables()
        first, second = self._tables
        out, many = [], 32
        for k in range(0, len(windows), many):
            x = windows[k:k + many].astype(np.int32)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            conv = first[pairs[:, :SPAN]]
            conv[:, :, FILTERS:] += second[pairs[:, 2:SPAN + 2]]
            out.append(self.net._softmax(np.maximum(conv.max(axis=1) + self.net.b, 0)))
        return np.concatenate(out)

    def __call__(self, texts) -> tuple[list[str], np.ndarray]:
        raw = [_raw(t) if t is not None and self.languages and any(map(str.isalpha, t)) else None for t in texts]
        counts = np.array([0 if r is None else -(-len(r) // SPAN) for r in raw])
        lang, score = ["und"] * len(raw), np.zeros(len(raw))
        at = 0
        while at < len(raw):                                     # about 4 MB of bytes at a time
            to = max(at + 1, int(np.searchsorted(np.cumsum(counts), counts[:at].sum() + 16384, "right")))
            if counts[at:to].sum():
                x = np.zeros((counts[at:to].sum(), SPAN + REACH), np.uint8)
                size, k = np.zeros(len(x)), 0
                for r, c in zip(raw[at:to], counts[at:to]):
                    if c:
                        flat = np.zeros(c * SPAN + REACH, np.uint8)
                        flat[:len(r)] = r
                        x[k:k + c] = np.lib.stride_tricks.sliding_window_view(flat, SPAN + REACH)[::SPAN]
                        size[k:k + c] = SPAN
                        size[k + c - 1] = len(r) - (c - 1) * SPAN
                        k += c
                p = self.probabilities(x) * size[:, None]
                doc = np.repeat(np.arange(to - at), counts[at:to])
                total = np.zeros((to - at, p.shape[1]))
                np.add.at(total, doc, p)
                weight = np.bincount(doc, size, minlength=to - at)
                for i in np.flatnonzero(counts[at:to]):
                    best = int(total[i].argmax())
                    lang[at + i], score[at + i] = self.languages[best], min(1.0, total[i, best] / weight[i])
            at = to
        return lang, score


def junk_windows(texts: list[str], n: int, seed: int = 5) -> list[str]:
    """``n`` texts in no language: by turns the characters of a sample text shuffled, random consonants, random
    letters, digits and signs, random characters of one stretch of Unicode, and random bytes."""
    rng, out = np.random.default_rng(seed), []
    pick = lambda chars, size: "".join(chars[i] for i in rng.integers(0, len(chars), size))
    blanked = lambda s: " ".join(s[a:b] for a, b in zip(ends, ends[1:]))
    for k in range(n):
        size = int(rng.integers(12, TRAIN_SPAN))
        ends = [0, *np.cumsum(rng.integers(2, 12, TRAIN_SPAN // 2))]
        if k % 5 == 0 and texts:
            chars = list(texts[int(rng.integers(len(texts)))])
            rng.shuffle(chars)
            made = "".join(chars)
        elif k % 5 == 1:
            made = blanked(pick("bcdfghjklmnpqrstvwxz", size))
        elif k % 5 == 2:
            made = blanked(pick("abcdefghijklmnopqrstuvwxyz0123456789!#$%&*+-/:;<=>?@^_{|}~"[::int(rng.choice([1, -1]))], size))
        elif k % 5 == 3:
            start = int(rng.integers(0x250, 0xD700))
            made = blanked("".join(chr(start + int(i)) for i in rng.integers(0, int(rng.choice([60, 200, 2000])), size)
                                   if start + int(i) < 0xD800))
        else:
            made = rng.integers(33, 256, size).astype(np.uint8).tobytes().decode("latin-1")
        out.append(made or "0")
    return out


def train(docs: DataFrame, junk: bool = False) -> Predictor:
    """Fit on a bounded sample of the rows that are not held out.  With ``junk`` the network has one more class,
    ``und``, learned from as many windows of ``junk_windows`` as a language has at most; a text is ``und`` if that
    class is the likeliest."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return Predictor(Network(1), [])
    languages = sorted(r["lang"] for r in counts)
    each = min(DOCS_PER_LANG, max(LEAST_DOCS, DOCS // len(counts)))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], each / r["count"])])
    # Of each text up to WINDOWS_PER_DOC spans, spread evenly over it.
    step = F.greatest(F.lit(TRAIN_SPAN), F.floor(F.length("text") / WINDOWS_PER_DOC)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_DOC - 1)),
                        lambda i: F.substr(F.col("text"), i * step + 1, F.lit(TRAIN_SPAN)))
    sample = known.filter(draw < wanted[F.col("lang")]).select("lang", spans.alias("spans"))
    sample = sample.limit(2 * max(DOCS, each * len(counts))).toPandas()
    pairs = [(_raw(s), languages.index(r.lang)) for r in sample.itertuples() for s in r.spans
             if any(map(str.isalpha, s))]
    if not pairs:
        return Predictor(Network(1), [])
    pairs.sort(key=lambda p: (p[1], p[0].tobytes()))
    if junk:
        known_texts = [p[0].tobytes().decode("utf-8", "ignore") for p in pairs]
        pairs += [(_raw(t), len(languages)) for t in junk_windows(known_texts, max(len(pairs) // len(languages), 200))]
        languages = languages + ["und"]
    net = Network(len(languages))
    net.fit([p[0] for p in pairs], np.array([p[1] for p in pairs]), steps=STEPS * (1 + junk))
    return Predictor(net, languages)


def predict(docs: DataFrame, predictor: Predictor) -> DataFrame:
    """``docs`` with lang_pred string and score double (columns of these names are replaced)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(predictor)

    @F.pandas_udf("lang_pred string, score double")
    def run(text: pd.Series) -> pd.DataFrame:
        lang, score = shared.value(list(text))
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return (docs.withColumn("__lang", run(F.col("text"))).withColumn("lang_pred", F.col("__lang.lang_pred"))
            .withColumn("score", F.col("__lang.score")).drop("__lang"))


def digest(docs: DataFrame) -> DataFrame:
    return predict(docs.select("doc_id", "text"), train(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least_score: float = 0.3, least_junk: float = 0.9,
               least_chars: int = TRAIN_SPAN) -> DataFrame:
    """``docs`` (all its columns) without the texts that have no language: those without a letter, those where
    nothing reaches a score of ``least_score``, and those of ``least_chars`` code points or more that are
    shuffled or random characters with a score of ``least_junk`` (a few words of boilerplate are not enough to tell)."""
    marked = docs.withColumn("__text", F.col("text"))
    found = predict(marked.withColumnsRenamed({c: f"__own_{c}" for c in ("lang_pred", "score") if c in docs.columns}),
                    train(docs, junk=True))
    sure = (F.col("score") >= least_junk) & (F.length("text") >= least_chars)
    found = found.filter((F.col("score") >= least_score) & ~((F.col("lang_pred") == "und") & sure))
    back = [F.col(f"__own_{c}").alias(c) if c in ("lang_pred", "score") else F.col(c) for c in docs.columns]
    return found.select(*back)
