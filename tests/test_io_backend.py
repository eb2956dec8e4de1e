import json
import os
import tempfile

from pyspark.sql import functions as F

from critiq.operators.backend import BackendFactory, model_map
from critiq.sources import io


def test_tsv_quotes_newlines_tabs(spark):
    d = tempfile.mkdtemp(prefix="critiq-test-")
    p = os.path.join(d, "x.tsv")
    with open(p, "w") as f:
        f.write('ID\tReview Segment\tCombined Issue Types\n')
        f.write('1\t"line one\nline ""two"" \there"\tH1. X; Y\n')
        f.write('2\tNA\t\n')
    df = io.read_tsv(spark, p, io.ISSUE_SEGMENTS).orderBy("ID").collect()
    assert df[0]["Review Segment"] == 'line one\nline "two" \there'
    assert df[1]["Review Segment"] is None and df[1]["Combined Issue Types"] is None


def test_review_dict_parse(spark):
    rows = [("{'a': 'x', \"b\": \"it's\"}",), ("{'a': 'q \\' s'}",), ("{'a': None}",), ("{'a': ",), (None,)]
    df = spark.createDataFrame(rows, "r string")
    out = {r["r"]: r["review_map"] for r in io.parse_review_dict(df, "r").collect()}
    assert out[rows[0][0]] == {"a": "x", "b": "it's"}
    assert out[rows[1][0]] == {"a": "q ' s"}
    assert out[rows[2][0]] == {"a": None}
    assert out[rows[3][0]] is None and out[None] is None


def test_templates_json_and_questions_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="critiq-test-")
    p = os.path.join(d, "t.json")
    with open(p, "w") as f:
        json.dump({"H1. A": {"Knowledge": "Abstract", "Template": "T1"}, "B": {"Knowledge": "Template", "Template": "T2"}}, f)
    t = {r["template_key"]: (r["knowledge"], r["template"]) for r in io.read_templates(spark, p).collect()}
    assert t == {"H1. A": ("Abstract", "T1"), "B": ("Template", "T2")}
    qs = spark.createDataFrame([("X", 0, "q0"), ("X", 1, "q1")], "issue string, q_idx int, question string")
    io.write_questions(qs, os.path.join(d, "q"), "org/model v1")
    back = io.read_questions(spark, os.path.join(d, "q"), "org/model v1")
    assert sorted(r["question"] for r in back.collect()) == ["q0", "q1"]
    assert back.select("model").first()["model"] == "org_model_v1"


def test_model_map_dedupes(spark):
    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "k int, prompt string")
    out = model_map(df, "prompt", BackendFactory("upper", lambda: (lambda xs: [x.upper() for x in xs])))
    assert sorted((r["k"], r["completion"]) for r in out.collect()) == [(1, "P"), (2, "P"), (3, "Q")]
    plain = model_map(df, "prompt", lambda xs: [x + "!" for x in xs], keys=["k"], dedupe=False)
    assert sorted(r["completion"] for r in plain.collect()) == ["p!", "p!", "q!"]


def test_row_ids_and_sinks(spark):
    d = tempfile.mkdtemp(prefix="critiq-test-")
    df = spark.createDataFrame([("a", [1, 2]), ("b", [3])], "s string, v array<int>").repartition(2)
    ids = io.with_row_id(df)
    assert sorted(r["row_id"] for r in ids.collect()) == [0, 1]
    io.write_tsv(df, os.path.join(d, "out"))
    back = spark.read.option("sep", "\t").option("header", True).csv(os.path.join(d, "out"))
    assert sorted((r["s"], r["v"]) for r in back.collect()) == [("a", "[1,2]"), ("b", "[3]")]
    m = spark.createDataFrame([(0.5, 1.0, 0.25)], "section_accuracy double, section_f1 double, bio_f1 double")
    io.write_report(m, os.path.join(d, "rep"))
    lines = [r["value"] for r in spark.read.text(os.path.join(d, "rep")).collect()]
    assert lines == ["section_accuracy: 0.5000, section_f1: 1.0000", "bio_f1: 0.2500"]
    io.write_csv(m, os.path.join(d, "csv"))
    assert [r["bio_f1"] for r in spark.read.option("header", True).csv(os.path.join(d, "csv")).collect()] == ["0.25"]


def test_chat_and_knowledge(spark):
    from critiq.functions.prompts import chat
    from critiq.operators.feedback import knowledge_context
    from critiq.operators.judge import judge_prompt
    df = spark.createDataFrame([("Paper summary + Abstract", "S", "A", "{feedback} 100%")],
                               "k string, s string, a string, seg string")
    r = df.select(chat(F.lit("hi"), "sys").alias("m"), knowledge_context("k", "s", "a").alias("c"),
                  judge_prompt("Relevance", "seg", F.lit("fb")).alias("p")).first()
    assert [(x["role"], x["content"]) for x in r["m"]] == [("system", "sys"), ("user", "hi")]
    assert r["c"] == "S\nA"
    assert "Weakness: {feedback} 100%\nFeedback: fb" in r["p"]          # no second substitution (B25)


def test_model_map_with_seed(spark):
    df = spark.createDataFrame([(1, "p", 0), (2, "p", 1), (3, "p", 0)], "k int, prompt string, c int")
    out = model_map(df, "prompt", lambda xs, seeds: [f"{x}{s}" for x, s in zip(xs, seeds)], seed="c")
    assert sorted((r["k"], r["completion"]) for r in out.collect()) == [(1, "p0"), (2, "p1"), (3, "p0")]


def test_list_and_sample_maps(spark):
    from critiq.operators.backend import list_map, sample_map
    df = spark.createDataFrame([(1, "t", ["a", "b"]), (2, "t", ["a", "b"]), (3, None, []), (4, "u", None)],
                               "k int, t string, q array<string>")
    got = list_map(df, "t", "q", lambda ps: [p.upper() for p in ps], "out", lambda t, i: f"{t}-{i}")
    assert sorted((r["k"], r["out"]) for r in got.collect()) == [(1, ["T-A", "T-B"]), (2, ["T-A", "T-B"]), (3, []), (4, [])]
    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "k int, prompt string")
    got = sample_map(df, "prompt", 3, lambda ps, seeds: [f"{p}{s}" for p, s in zip(ps, seeds)], "out")
    assert sorted((r["k"], r["out"]) for r in got.collect()) == [(1, ["p0", "p1", "p2"]), (2, ["p0", "p1", "p2"]), (3, ["q0", "q1", "q2"])]


def test_row_ids_over_uneven_partitions(spark):
    df = spark.range(100).repartition(7, "id").union(spark.range(3).coalesce(1))
    ids = [r["row_id"] for r in io.with_row_id(df).collect()]
    assert sorted(ids) == list(range(103))


def test_list_map_never_holds_the_prompts_of_a_whole_batch():
    """Many items a text: prompts are rendered, sent and dropped call by call, and rows go out in order."""
    from critiq.operators import backend
    made, seen = [], []

    def prompts(k):
        for i in range(40):
            made.append(1)
            yield f"{k}-{i}" + "x" * 1000

    def fn(ps):
        seen.append((len(ps), len(made) - sum(n for n, _ in seen)))
        return [p[:6].rstrip("x") for p in ps]

    frames = list(backend._answered(((str(k), 40, prompts(k)) for k in range(1000)), fn, "a"))
    assert max(n for n, _ in seen) <= backend.BATCH and max(alive for _, alive in seen) <= backend.BATCH
    assert max(map(len, frames)) <= backend.BATCH
    got = [(h, list(a)) for f in frames for h, a in zip(f["_h"], f["a"])]
    assert got == [(str(k), [f"{k}-{i}" for i in range(40)]) for k in range(1000)]


def test_long_prompts_are_sent_before_the_call_is_full(monkeypatch):
    from critiq.operators import backend
    monkeypatch.setattr(backend, "BATCH_CHARS", 1000)
    calls = []

    def fn(ps):
        calls.append(sum(map(len, ps)))
        return ps
    list(backend._answered((("k", 9, iter(["y" * 400] * 9)) for _ in range(3)), fn, "a"))
    assert max(calls) <= 1400 and sum(calls) == 27 * 400


def test_sample_map_hands_on_each_call():
    """A batch of many prompts leaves the worker a call at a time."""
    from critiq.operators import backend
    frames = list(backend._sampled([f"h{k}" for k in range(2000)], [f"p{k}" for k in range(2000)], 15,
                                   lambda ps, seeds: [f"{p}:{s}" for p, s in zip(ps, seeds)], "out"))
    assert max(map(len, frames)) * 15 <= backend.BATCH
    got = [(h, list(o)) for f in frames for h, o in zip(f["_h"], f["out"])]
    assert got == [(f"h{k}", [f"p{k}:{i}" for i in range(15)]) for k in range(2000)]


def test_array_map_moves_inputs_once(spark):
    from pyspark.sql import functions as F
    from critiq.operators.backend import array_map
    df = spark.createDataFrame([(1, "s", "t"), (2, "s", "t"), (3, "u", None)], "k int, a string, b string")
    got = array_map(df, ["a", "b"], F.array(F.concat_ws("+", "a", "b"), F.col("a")), lambda ps: [p.upper() for p in ps], "out")
    assert got.columns == ["k", "out"]
    assert sorted((r["k"], r["out"]) for r in got.collect()) == [(1, ["S+T", "S"]), (2, ["S+T", "S"]), (3, ["U", "U"])]
