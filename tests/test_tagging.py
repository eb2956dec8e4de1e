from pyspark.sql import functions as F

from critiq.operators import tagging


def test_segments_from_tags_window(spark):
    # tags I I B O I -> segments {1,2}, {3}, {5}: an I after O opens a segment
    df = spark.createDataFrame([(1, i + 1, t, f"s{i + 1}") for i, t in enumerate("IIBOI")],
                               "r int, pos int, tag string, sentence string")
    w = tagging.assign_segments(df, "r", "pos", "tag")
    segs = tagging.segments_from_tags(w, "r", pos="pos").orderBy("seg_id").collect()
    assert [s["segment"] for s in segs] == ["s1 s2", "s3", "s5"]


def test_fold_context_is_previous_output(spark):
    # a step that copies the previous output unless the sentence says otherwise
    step = lambda prev, x: F.when(x["text"] == "new", F.lit("B")).otherwise(
        F.when(prev == "", F.lit("O")).otherwise(F.lit("I")))
    df = spark.createDataFrame([(["a", "new", "b", "c"],)], "s array<string>")
    out = df.select(tagging.fold_tags(F.transform("s", lambda t: F.struct(t.alias("text"))), step).alias("t")).collect()[0]["t"]
    assert [o["tag"] for o in out] == ["O", "B", "I", "I"]
    assert [o["seg"] for o in out] == [0, 1, 1, 1]


def test_review_rows_reset_and_skips(spark):
    # two reviews back to back: the second starts with empty context (B4);
    # a filtered middle row does not break the chain
    rows = [(1, 0, "one two three four."), (1, 2, "five six seven eight."),
            (2, 0, "alpha beta gamma delta."), (2, 1, "x y")]
    df = spark.createDataFrame(rows, "rid int, pos int, text string")
    t = tagging.tag_review_rows(df, "rid", "pos", "text").orderBy("rid", "pos").collect()
    assert [(r["rid"], r["pos"], r["bio_pred"]) for r in t] == [(1, 0, "B"), (1, 2, "I"), (2, 0, "B"), (2, 1, "O")]


def test_document_fold_matches_row_fold(spark):
    doc = "First one is long enough here. Tiny. Another sentence with words! And more words follow here."
    d = spark.createDataFrame([(7, doc)], "doc_id int, text string")
    a = tagging.tag_document_sentences(d).orderBy("pos").collect()
    rows = spark.createDataFrame([(7, r["pos"], r["sentence"]) for r in a], "doc_id int, pos int, sentence string")
    b = tagging.tag_review_rows(rows, "doc_id", "pos", "sentence").orderBy("pos").collect()
    assert [r["tag"] for r in a] == [r["bio_pred"] for r in b]
    assert [r["seg_id"] for r in a] == [r["seg_id"] for r in b]


def test_chunked_scan_equals_whole_fold(spark):
    import random
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma!", "delta,", "eps"]
    rows = []
    for rid in range(4):
        for p in range(rnd.randint(1, 40)):
            n = rnd.choice([1, 2, 4, 6, 12, 25])
            rows.append((rid, p * 3, " ".join(rnd.choice(words) for _ in range(n))))
    df = spark.createDataFrame(rows, "rid int, pos int, text string")
    whole = {(r["rid"], r["pos"]): (r["bio_pred"], r["section_pred"], r["seg_id"])
             for r in tagging.tag_review_rows(df, "rid", "pos", "text", chunk_rows=10 ** 9).collect()}
    for k in (1, 3, 7, 16):
        chunked = {(r["rid"], r["pos"]): (r["bio_pred"], r["section_pred"], r["seg_id"])
                   for r in tagging.tag_review_rows(df, "rid", "pos", "text", chunk_rows=k).collect()}
        assert chunked == whole, k
    # and the whole fold equals the in-row document fold
    docs = {}
    for rid, p, t in sorted(rows):
        docs.setdefault(rid, []).append(t)
    d = spark.createDataFrame([(rid, ts) for rid, ts in docs.items()], "rid int, s array<string>")
    ref = d.select("rid", F.posexplode(tagging.fold_tags(F.transform("s", tagging.sentence_features),
                                                         tagging.rules_bio_step)).alias("i", "t")).collect()
    by_pos = {}
    for rid, p, t in sorted(rows):
        by_pos.setdefault(rid, []).append(p)
    for r in ref:
        assert whole[(r["rid"], by_pos[r["rid"]][r["i"]])][0] == r["t"]["tag"]


def test_model_taggers_match_native(spark):
    def _python_rules_backend(prompts):
        """Answers the tagging prompts with the same rules as the native taggers
        (reads the sentence and the previous label back out of the prompt)."""
        import re
        out = []
        for p in prompts:
            sent = re.search(r"Sentence: (.*)\n(?:Label|Tag): $", p, re.S).group(1)
            m = re.search(r"Previous label: (.*)\n", p)
            prev = m.group(1) if m else ""
            n = len(sent.split())
            if p.startswith("Mark where"):
                if n < 3:
                    out.append("O")
                elif prev in ("", "O"):
                    out.append("B ")
                elif n > 20 or (prev == "I" and sent.endswith("!")):
                    out.append("B")
                elif "," in sent and n < 5:
                    out.append("i")
                else:
                    out.append("I")
            else:
                if n < 4 and prev:
                    out.append(prev)
                elif "," in sent and n > 15:
                    out.append("comments_suggestions_and_typos")
                elif sent.endswith("!"):
                    out.append("summary_of_strengths")
                else:
                    out.append("summary_of_weaknesses")
        return out

    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").withColumn("body", F.lit("section"))
    native = {(r["conv_id"], r["turn"]): (r["section_pred"], r["bio_pred"])
              for r in tagging.tag_review_rows(conv, "conv_id", "turn", "text").collect()}
    model = {(r["conv_id"], r["turn"]): (r["section_pred"], r["bio_pred"])
             for r in tagging.tag_reviews_with_model(conv, "conv_id", "turn", "text", "body",
                                                     _python_rules_backend).collect()}
    assert model == native
    ind_native = {(r["conv_id"], r["turn"]): (r["section_pred"], r["bio_pred"])
                  for r in tagging.tag_rows_independent(conv, "text").collect()}
    ind_model = {(r["conv_id"], r["turn"]): (r["section_pred"], r["bio_pred"])
                 for r in tagging.tag_rows_with_model(conv, "text", "body", _python_rules_backend).collect()}
    assert ind_model == ind_native


def test_long_document_equals_review_rows(spark):
    """More sentences than one slice of the fold, and exactly one slice."""
    say = lambda i: f"Sentence number {i} has {'many words here' * (i % 3)} end{'!' if i % 4 == 0 else '.'}"
    texts = [(1, " ".join(map(say, range(300)))), (2, "Short one. Two words here. x."),
             (3, " ".join(map(say, range(tagging.SLICE)))), (4, ""), (5, None)]
    d = spark.createDataFrame(texts, "doc_id int, text string")
    a = {(r["doc_id"], r["pos"]): (r["tag"], r["seg_id"], r["sentence"]) for r in tagging.tag_document_sentences(d).collect()}
    rows = spark.createDataFrame([(i, p, s) for (i, p), (_, _, s) in a.items()], "doc_id int, pos int, sentence string")
    b = {(r["doc_id"], r["pos"]): (r["bio_pred"], r["seg_id"])
         for r in tagging.tag_review_rows(rows, "doc_id", "pos", "sentence", chunk_rows=5).collect()}
    assert {k: v[:2] for k, v in a.items()} == b and len(a) == 300 + 3 + tagging.SLICE + 1


def test_larger_table_is_tagged_in_fine_tasks(spark, tmp_path, monkeypatch):
    """Beyond ``SPREAD_BYTES`` the texts were tagged in as few tasks as the file has splits."""
    from critiq.plans import catalog, tables
    text = "concat_ws(' ', transform(sequence(1, 20), i -> concat(sha2(concat(id, i), 256), ' is a word.'))) text"
    spark.range(400).selectExpr("id doc_id", text).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    real = catalog.tagging.tag_document_sentences
    monkeypatch.setattr(catalog.tagging, "tag_document_sentences",
                        lambda docs: seen.append(docs.rdd.getNumPartitions()) or real(docs))
    whole = sorted(map(tuple, catalog.doc_segments(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(tables, "SPREAD_BYTES", 1000)
    monkeypatch.setattr(tables, "FINE_BYTES", 20000)
    assert whole and sorted(map(tuple, catalog.doc_segments(spark, str(tmp_path)).collect())) == whole
    assert seen[1] > 2 * spark.sparkContext.defaultParallelism
