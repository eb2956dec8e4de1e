"""Completions across runs: only unseen prompts are sent."""
import pytest

from critiq.operators.backend import model_map
from critiq.operators.store import CompletionStore


def test_second_run_asks_for_nothing(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def shout(prompts, seeds=None):
        import os
        import uuid
        if prompts:
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(prompts))
        return [p.upper() + (f"/{s}" if seeds else "") for p, s in zip(prompts, seeds or prompts)]

    def asked():
        out = sorted(p for f in log.iterdir() for p in f.read_text().split("\n"))
        for f in log.iterdir():
            f.rename(tmp_path / f.name)
        return out

    def run(store, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, prompt string")
        return [r.completion for r in model_map(df, "prompt", shout, store=store).orderBy("id").collect()]

    store = CompletionStore(str(tmp_path / "store"), "a")
    assert run(store, ["x", "y", "x", None, ""]) == ["X", "Y", "X", None, ""] and asked() == ["", "x", "y"]
    assert run(store, ["y", "x", ""]) == ["Y", "X", ""] and asked() == []
    assert run(CompletionStore(str(tmp_path / "store"), "a"), ["y", "z"]) == ["Y", "Z"] and asked() == ["z"]
    assert run(CompletionStore(str(tmp_path / "store"), "b"), ["y"]) == ["Y"] and asked() == ["y"]
    df = spark.createDataFrame([("p", 0), ("p", 1), ("p", 1)], "prompt string, k int")
    for want in (["p", "p"], []):
        got = model_map(df, "prompt", shout, seed="k", store=store).collect()
        assert sorted((r.k, r.completion) for r in got) == [(0, "P/0"), (1, "P/1"), (1, "P/1")] and asked() == want
    with pytest.raises(ValueError):
        model_map(df, "prompt", shout, dedupe=False, store=store)
    assert run(store, []) == []
