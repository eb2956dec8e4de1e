import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from critiq.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out_accuracy(docs):
    got = langid.digest(docs).join(docs.select(F.col("doc_id").alias("i"), "lang", "text"), F.col("i") == F.col("doc_id"))
    rows = [r for r in got.collect() if r.held_out]
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network(3, seed=1)
    net.E, net.W = net.E.astype(float), [w.astype(float) for w in net.W]
    net.b, net.O, net.o = net.b.astype(float) + 0.3, net.O.astype(float), net.o.astype(float)
    x, y = rng.integers(97, 110, (5, 12 + langid.REACH), dtype=np.uint8), rng.integers(0, 3, 5)

    def loss():
        tops = []
        for w, weight in zip(langid.WIDTHS, net.W):
            conv = sum(np.einsum("npe,ef->npf", net.E[x[:, k:k + 12]], weight[k]) for k in range(w))
            tops.append(conv.max(axis=1))
        p = net._softmax(np.maximum(np.concatenate(tops, axis=1) + net.b, 0))
        return -np.log(p[np.arange(5), y]).mean()

    for p, g in zip(net.parameters, net.gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-5
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 1e-4


def test_tables_equal_network():
    rng = np.random.default_rng(2)
    net = langid.Network(4, seed=3)
    x = rng.integers(0, 256, (40, langid.SPAN + langid.REACH), dtype=np.uint8)
    tops = [sum(np.einsum("npe,ef->npf", net.E[x[:, k:k + langid.SPAN]], weight[k]) for k in range(w)).max(axis=1)
            for w, weight in zip(langid.WIDTHS, net.W)]
    want = net._softmax(np.maximum(np.concatenate(tops, axis=1) + net.b, 0))
    assert np.allclose(langid.Predictor(net, list("abcd")).probabilities(x), want, atol=1e-4)


def test_every_window_counts():
    net = langid.Network(2, seed=5)
    predictor = langid.Predictor(net, ["a", "b"])
    texts = ["xyz " * 300, "qqq " * 10, "é" * 1000]
    lang, score = predictor(texts)
    for t, s in zip(texts, score):
        raw = langid._raw(t)
        total = np.zeros(2)
        for k in range(0, len(raw), langid.SPAN):
            w = np.zeros((1, langid.SPAN + langid.REACH), np.uint8)
            piece = raw[k:k + langid.SPAN + langid.REACH]
            w[0, :len(piece)] = piece
            total += predictor.probabilities(w)[0] * min(langid.SPAN, len(raw) - k)
        assert abs(total.max() / len(raw) - s) < 1e-5


def test_language_messy(messy, nothing, docs):
    rows = langid.digest(messy).collect()
    assert len(rows) == messy.count()
    assert all((r.lang_pred == "und") == (r.doc_id in (4, 5, 6, 7) or (r.doc_id is None and r.lang_pred == "und")) for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert langid.digest(nothing).count() == 0
    kept = langid.identified(messy)
    assert kept.columns == messy.columns and not {4, 5, 6, 7} & {r.doc_id for r in kept.collect()}
    unlabelled = messy.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.digest(unlabelled).collect()} == {"und"}



def test_texts_in_no_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(8)
    drawn = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    texts = [drawn("bcdfghjklmnpqrstvwxz  ", 400) for _ in range(20)] + [drawn("abcdefgh0123456789#$%& ", 400) for _ in range(20)]
    texts += [drawn([chr(c) for c in range(a, a + 1000)], 300) for a in (0x4e00, 0x6000, 0xac00, 0x900)]
    texts += ["".join(rng.sample(r.text, len(r.text))) for r in docs.limit(20).collect()]
    junk = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(texts)], docs.schema)
    kept = {r.doc_id for r in langid.identified(docs.unionByName(junk)).select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {i for i in kept if i >= 0}
    assert sum(i < 0 for i in kept) <= 0.05 * len(texts)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.digest(docs, labels).join(labels.select(F.col("doc_id").alias("i"), "toxic"), F.col("i") == F.col("doc_id"))
    rows = [r for r in got.collect() if r.held_out]
    assert np.mean([r.toxic == r.predicted for r in rows]) > 0.95
    pos, neg = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) > 0.9


def chain(seed, n_words=6):
    """A random chain over few tokens, and their features."""
    rng = np.random.default_rng(seed)
    c = toxicity.Chain()
    table = np.array([toxicity.features(w) for w in ["idiot", "idiots", "clean", "Clean", "a", "été"][:n_words]])
    used = np.unique(table)
    c.weights[used], c.move, c.bias = rng.normal(size=len(used)), rng.normal(size=(2, 2)), rng.normal(size=1)
    return c, table


def test_marginals_against_enumeration():
    c, table = chain(1)
    texts = [[0, 1, 0, 0, 2, 3, 0], [1], [], [0, 0, 1], [2, 0, 4, 0, 5, 0, 1, 0, 0], [3, 3, 3]]
    odds = c.odds(table)
    got = c.marginals([odds[t] if t else np.empty(0) for t in texts])
    for ids, p in zip(texts, got):
        n, total, on = len(ids), 0.0, np.zeros(len(ids))
        for states in np.ndindex(*[2] * n):
            w = np.exp(sum(odds[i] * s for i, s in zip(ids, states)) + sum(c.move[a, b] for a, b in zip(states, states[1:])))
            total += w
            on += w * np.array(states)
        assert np.allclose(p, on / total)


def test_long_texts_stay_finite_and_batches_do_not_matter(monkeypatch):
    c, table = chain(2)
    rng = np.random.default_rng(3)
    odds = [c.odds(table)[rng.integers(0, 6, n)] * 9 for n in (40_000, 7, 7, 0, 300, 1)]
    whole = c.marginals(odds)
    monkeypatch.setattr(toxicity, "HELD", 50)
    for a, b in zip(whole, c.marginals(odds)):
        assert np.isfinite(a).all() and np.allclose(a, b)


def test_chain_gradient():
    c, table = chain(4)
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 6, (6, 5)), rng.integers(0, 2, (6, 5))

    def likelihood():
        total, odds = 0, c.odds(table)
        for xs, ys in zip(x, y):
            score = lambda s: sum(odds[i] * k for i, k in zip(xs, s)) + sum(c.move[a, b] for a, b in zip(s, s[1:]))
            total += score(ys) - np.log(sum(np.exp(score(s)) for s in np.ndindex(*[2] * 5)))
        return total / len(x)

    places = [(c.weights, (int(k),)) for k in np.unique(table)[1:]] + [(c.bias, (0,))] + [(c.move, at) for at in np.ndindex(2, 2)]
    found = c.gradient(table, x, y)
    for p, at in places:
        g = found[0 if p is c.weights else 1 if p is c.bias else 2]
        p[at] += 1e-5
        up = likelihood()
        p[at] -= 2e-5
        down = likelihood()
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_near_copies_are_one_piece_of_evidence():
    rng = np.random.default_rng(0)
    text = [f"word{k}" for k in rng.integers(0, 900, 120)]
    near = [[*text[:k], "other", *text[k + 1:]] for k in range(8)]
    other = [[f"word{k}" for k in rng.integers(0, 900, 120)] for _ in range(40)]
    group = toxicity.copies(near + other)
    assert len(set(group[:8])) == 1 and len(set(group)) == 41
    assert toxicity.lexicon(near + other, np.array([1] * 8 + [0] * 40), group) == []
    marked = [t + ["scum"] for t in other[:20]] + other[20:]
    assert toxicity.lexicon(marked, np.array([1] * 20 + [0] * 20), np.arange(40)) == ["scum"]


def test_words_with_known_parts_are_tagged():
    """Only inflected forms are seen in training; a new one of the same beginning is tagged."""
    rng = np.random.default_rng(1)
    fill = lambda n: " ".join(f"{a}{b}" for a, b in zip(rng.choice(["ba", "no", "ri", "tel"], n), rng.choice(["ko", "mi", "sa", "un"], n)))
    clean = [fill(30) for _ in range(150)]
    bad = [f"{fill(12)} zorm{e} {fill(12)}" for e in np.resize(["ig", "en", "a", "ost", "ul"], 100)]
    model = toxicity.fit(clean + bad, np.array([0] * 150 + [1] * 100))
    text = f"{fill(12)} zormix {fill(12)}"
    score, spans = model.score(text)
    assert score > 0.5 and [text[a:b] for a, b in spans] == ["zormix"] and model.score(fill(20))[0] < 0.5


def test_offsets_are_code_points():
    rng = np.random.default_rng(8)
    fill = lambda: " ".join(f"é{a}{b}" for a, b in zip(rng.choice(["ba", "no", "ri", "tel"], 9), rng.choice(["ko", "mi", "sa", "un"], 9)))
    texts = [fill() for _ in range(200)] + [f"ü {fill()} idiot {fill()}" for _ in range(100)]
    model = toxicity.fit(texts, np.array([0] * 200 + [1] * 100))
    text = "Çé İ! You Idiot, and idiot"
    score, spans = model.score(text)
    assert [text[a:b].lower() for a, b in spans if text[a:b].lower() == "idiot"] == ["idiot"] * 2 and score > 0.5
    assert model.score(fill())[0] < 0.5
    assert model.score("")[0] == model.score(None)[0] and 0 <= model.score("")[0] <= 1


@pytest.mark.parametrize("sf,toxic,clean", [("sf0.01", 0.6, 0.95), ("sf0.1", 0.9, 0.97)])
def test_toxic_and_clean_rows_apart(spark, sf, toxic, clean):
    d = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.digest(spark.read.parquet(f"{d}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").collect()
    right = lambda k: np.mean([r.predicted == k for r in got if r.toxic == k])
    assert right(1) >= toxic and right(0) >= clean, (right(1), right(0))


def test_toxicity_messy(spark, messy, nothing, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    out = toxicity.score(messy, model)
    assert out.count() == messy.count() and set(messy.columns) | {"offsets"} == set(out.columns)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 0, None), (None, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for lab in (empty, odd):
        assert {r.predicted for r in toxicity.digest(messy, lab).collect()} == {0}
    assert toxicity.digest(nothing, labels).count() == 0


def test_every_language_is_learned(spark):
    rows = [(k, f"some words of language number {k % 70}", f"l{k % 70:02}") for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs).languages == [f"l{k:02}" for k in range(70)]
