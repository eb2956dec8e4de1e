import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from critiq.llm import sketchsearch as S

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, top=50):
    """Every document scored for every item: [(item_id, rank, doc_id, score)]; docs (doc_id, text)."""
    tf = [Counter(plain_terms(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(x) for x in tf), sum(x.total() for x in tf)
    df = Counter(t for x in tf for t in x)
    out = []
    for item_id, text in items:
        found = []
        for k, x in enumerate(tf):
            m = 100 - 50 + (50 * x.total() * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * x[t]) // (1000 * x[t] + 20 * m))
                        for t in set(plain_terms(text)) if t in x)
            if score > 0:
                found.append((-score, docs[k][0] is None, docs[k][0] or 0, k))
        out += [(item_id, r, docs[k][0], -s) for r, (s, _, _, k) in enumerate(sorted(found)[:top], 1)]
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_terms():
    for t in (None, "", "A-b c9Z É_é\x85x \x00y\x7fz ``Ab", "ÀB c", "{a}[b]~c^d"):
        assert [x.decode() for x in S.terms(t)] == plain_terms(t)


def test_whole_table_against_plain_version(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = S.search(S.Index(docs), items).collect()
    assert order(got) == order(plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))


def test_bounds_are_never_below_scores():
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.choice([0, 3, 60, 900]))) for _ in range(120)]
    tf = [Counter(S.terms(t)) for t in texts]
    n_docs, n_terms, df = sum(bool(x) for x in tf), sum(x.total() for x in tf), Counter(t for x in tf for t in x)
    q = S.Items([" ".join(f"w{rng.randrange(900)}" for _ in range(30)) for _ in range(40)] + ["", None], df, n_docs, n_terms)
    bounds = q.bounds([S.sketch(x, S.length_factor(x.total(), n_docs, n_terms)) for x in tf])
    scores = np.array([q.exact(t) for t in texts])
    assert (bounds >= scores).all() and (bounds[:, -2:] == 0).all()
    assert S.impacts(np.array([10**9]), 50)[0] <= 255 * S.STEP


@pytest.mark.parametrize("top,stride", [(3, 1), (1, 32), (500, 7)])
def test_top_and_ties(spark, monkeypatch, top, stride):
    """Copies tie on the score and go by doc_id, across partitions."""
    monkeypatch.setattr(S, "STRIDE", stride)
    rng = random.Random(top)
    texts = [" ".join(rng.choice("a b c d e f g h i j".split()) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    docs = [(k, texts[k % 20] if k % 3 else texts[k % 60]) for k in range(300)]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.sample("a b c d e f g h i j x".split(), 3))) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    got = S.search(S.Index(df), spark.createDataFrame(items, "item_id long, text string"), top).collect()
    assert order(got) == order(plain_search(docs, items, top))


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    docs = [(k, f"w{k % 5} w{k % 7} common") for k in range(40)]
    items = [(f"i{k}", f"w{k} common") for k in range(8)] + [("i0", "w3")]
    got = S.search(S.Index(spark.createDataFrame(docs, "doc_id long, text string")),
                   spark.createDataFrame(items, "item_id string, text string"), 4).collect()
    assert order(got) == order(plain_search(docs, items, 4))


def test_few_documents_are_rescored(spark):
    """The thresholds do their work: of a task's documents only a part is scored exactly."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    tf = [Counter(S.terms(r.text)) for r in rows]
    n_docs, n_terms, df = sum(bool(x) for x in tf), sum(x.total() for x in tf), Counter(t for x in tf for t in x)
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").limit(5).collect()]
    q = S.Items(items, df, n_docs, n_terms)
    bounds = q.bounds([S.sketch(x, S.length_factor(x.total(), n_docs, n_terms)) for x in tf])
    scores = np.array([q.exact(r.text) for r in rows])
    least = np.sort(scores, axis=0)[-10]
    assert (bounds >= least).sum() < 0.2 * bounds.size


def test_messy(spark, messy, nothing, long_text):
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    items = [(1, "passage of ten words"), (2, None), (3, ""), (None, "text without an id"), (5, "und and den 12"), (5, "line9 word7")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for name in ("rank", "score", "doc_id", "rid", "item", "bound"):
        bench = bench.withColumn(name, bench["text"])
    got = S.search(S.Index(messy), bench).collect()
    assert order(got) == order(plain_search(docs, items)) and S.search(S.Index(messy), bench).columns == ["item_id", "rank", "doc_id", "score"]
    assert S.search(S.Index(nothing), bench).count() == 0
    assert S.search(S.Index(messy), bench.limit(0)).count() == 0
