import random

import duckdb
import pytest

import corpus_pipeline
from critiq.llm import linededup


def brute(rows):
    """(doc_id, text) sorted by id -> text that is left, by comparing windows as word tuples."""
    seen, out = set(), []
    for doc_id, text in rows:
        starts, found = linededup.lines(text or "")
        n, width = len(found), min(3, len(found))
        gone = set()
        for i in range(n - width + 1 if n else 0):
            w = tuple(tuple(x) for x in found[i:i + width])
            if sum(map(len, w)) < linededup.MIN_WORDS:
                continue
            if w in seen:
                gone.update(range(i, i + width))
            seen.add(w)
        out.append((doc_id, n, len(gone), linededup.without(text, gone) if text else text))
    return out


def test_lines_cover_the_text(long_text):
    text = "A b. C d!  E\n\n f " + "w " * 40 + "\n" + long_text[:5000]
    starts, words = linededup.lines(text)
    assert starts == sorted(starts)
    ends = starts[1:] + [len(text)]
    assert [text[a:b].lower().encode().split() for a, b in zip(starts, ends)] == words
    assert max(map(len, words)) == linededup.WRAP


def test_passage_is_cut_where_it_repeats(spark):
    passage = " ".join(f"p{k}" for k in range(60)) + "."
    rows = [(1, "Own beginning here.\n" + passage + "\nOwn end one."), (2, "Other start of text. " + passage + " Tail stays."),
            (3, "\n".join([passage] * 2)), (4, "Nothing shared in this text at all.\nIt has lines of its own.")]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[4].text == rows[3][1]
    assert "p0 " not in got[2].text and got[2].text.startswith("Other start") and got[2].text.endswith("Tail stays.")
    assert got[3].text == "" and got[3].n_removed == got[3].n_lines


def test_against_brute_force(spark, messy):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in linededup.dedup_lines(docs).collect())
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = sorted(con.execute(linededup.ORACLE).fetchall())
    assert sorted(map(tuple, linededup.digest(docs).collect())) == want


def test_messy(messy, nothing):
    out = linededup.dedup_lines(messy)
    assert out.columns == [c for c in messy.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == messy.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_removed == 0 and [r.text for r in by[2]] == ["", ""]
    assert by[4][0].text is None and by[5][0].text == "" and by[6][0].text == " \n\t \n" and by[7][0].n_removed == 0
    assert by[1][0].removed == by[1][0].text                  # a column of that name is left alone
    assert linededup.dedup_lines(nothing).count() == 0


@pytest.mark.parametrize("sentence", [0, 12, 30])
@pytest.mark.parametrize("size", [51, 60, 90])
def test_passage_is_found_at_every_offset(size, sentence):
    rng = random.Random(size + sentence)
    word = lambda k: f"{rng.choice('abcdefghij')}{k}{rng.randrange(3000)}"
    passage = [f"p{word(k)}" + "." * (sentence and k % sentence == sentence // 2) for k in range(size)]
    rows = [(0, " ".join(passage))]
    for offset in range(16):
        rows.append((offset + 1, " ".join([word(k) for k in range(32 + offset)] + passage + [word(k) for k in range(40)])))
    for _, _, removed, left in brute(rows)[1:]:
        assert removed >= 3 and sum(w.startswith("p") for w in left.split()) <= 30
        assert sum(not w.startswith("p") for w in left.split()) >= 72


def test_line_cuts_follow_the_words_around_them():
    rng = random.Random(3)
    words = [str(rng.randrange(500)).encode() for _ in range(400)]
    whole = linededup.cuts(words)
    sizes = [b - a for a, b in zip(whole, [*whole[1:], 400])]
    assert linededup.REACH < min(sizes) and max(sizes) <= linededup.WRAP
    for k in range(1, 40):
        assert len(set(whole) & {k + c for c in linededup.cuts(words[k:])} - set(range(k + 60))) == sum(c >= k + 60 for c in whole)


@pytest.mark.parametrize("form", ["{}\n", "{}! ", "{} x. five words are in here. ", "{}. and four here now\n", "{}\n\nthree words more\n"])
def test_short_lines_are_covered(form):
    rng = random.Random(form)
    text = "".join(form.format(f"w{rng.randrange(900)}") for _ in range(60)).strip()
    starts, found = linededup.lines(text)
    n, at, _ = linededup.windows(text)
    assert set().union(*(range(i, i + 3) for i in at)) == set(range(n)) and max(map(len, found)) <= linededup.WRAP
    assert [text[a:b].lower().encode().split() for a, b in zip(starts, [*starts[1:], len(text)])] == found
    other = "a beginning of its own\n" * 3 + text
    got = brute([(1, text), (2, text), (3, other), (4, form.format("y") * 3 + text + "\n" + form.format("z") * 3)])
    assert got[1][3] == "" and got[2][2] and got[3][2]
    assert all(sum(w[1:2].isdigit() for w in x[3].split()) <= 30 for x in got[1:])


def test_short_texts_as_a_whole(spark):
    rows = [(1, "Yes. No.\nSure"), (2, "yes. no. sure"), (3, "yes. no. sure not"), (4, "a b"), (5, "1\n2\n3\n4\n5\n6"), (6, "1 2 3 4 5 6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs, short=True).collect()}
    assert got == dict(rows) | {2: "", 6: ""}
    out = corpus_pipeline.dedup_lines(spark, docs, "").collect()
    assert sorted(r.doc_id for r in out) == [1, 3, 4, 5]
