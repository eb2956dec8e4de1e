"""The pipeline against a plain version of it, stage by stage on what the stage before kept."""
import math
from collections import Counter

import corpus_pipeline
from critiq.llm import decontam, langid, mixing, simhash
from tests.llm.test_linededup import brute as dedup
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import classes

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near dedup", "decontamination", "mixing"]


def test_run_against_plain_version(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = sorted(((r.doc_id, r.text, r.source) for r in table.collect()))
    lang, score = langid.train(table, junk=True)([t for _, t, _ in docs])
    docs = [d for d, a, s in zip(docs, lang, score) if s >= 0.3 and not (a == "und" and s >= 0.9 and len(d[1]) >= 128)]
    cut = dedup([(i, t) for i, t, _ in docs])
    docs = [(i, t, d[2]) for (i, _, gone, t), d in zip(cut, docs) if not (gone and not t.split())]
    group = classes([simhash.fingerprint(t) for _, t, _ in docs])
    docs = [d for k, d in enumerate(docs) if group[k] == k]
    index = decontam.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    docs = [d for d in docs if not index.find(d[1])]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.text, r.source) for r in got} <= set(docs)
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(t.split())
    want, copies = plain_targets(sizes), Counter(r.doc_id for r in got)
    assert sum(copies[i] for i, *_ in docs) == len(got)
    for s in sizes:
        ids = [i for i, _, x in docs if x == s]
        ratio = want[s] / sizes[s]
        assert all(math.floor(ratio - 1e-9) <= copies[i] <= min(3, math.ceil(ratio + 1e-9)) for i in ids)
        assert abs(sum(copies[i] for i in ids) - ratio * len(ids)) <= 1.0001
    assert all(sorted(r.copy for r in got if r.doc_id == i) == list(range(1, n + 1)) for i, n in list(copies.items())[:20])


def test_stages_on_messy_documents(spark, messy, nothing):
    for docs in (messy, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()
        assert mixing.mix(docs).count() >= 0
