import re

import duckdb

from critiq.llm import linequality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base columns by the rules' wording."""
    words = WORD.findall(text or "")
    wins = {}
    for i in range(len(words) - 7):
        wins.setdefault(tuple(words[i:i + 8]), []).append(i)
    inside = {j for at in wins.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_base_and_oracle(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    res = con.execute(linequality.ORACLE)
    names = [d[0] for d in res.description]
    got = linequality.quality(docs)
    assert sorted(got.columns) == sorted(names)
    rows = got.select(*names).collect()
    assert sorted(map(tuple, rows)) == sorted(res.fetchall())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id])


def test_repeats_overlap(spark):
    cycle = " ".join("a b c d e".split() * 20)
    texts = [cycle, "x " * 30, " ".join(map(str, range(50))), "1 2 3 4 5 6 7 8 z 1 2 3 4 5 6 7 8 9", "1 2 3"]
    rows = linequality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(
        "*", "'s' AS source")).collect()
    for r in rows:
        assert r.n_repeat_words == plain(texts[r.doc_id])[4]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_boilerplate_depletes(spark):
    menu = "Home About Contact Imprint\nSign in to your account 12 today"
    own = lambda k: " ".join(f"own{chr(97 + k // 26)}{chr(97 + k % 26)}" for _ in range(3)) + " " + " ".join(
        f"{chr(97 + j)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for j in range(26))
    shared = "\n".join(f"Shared line {c * 3} of many hosts and pages" for c in "abcdefgh")
    rows = [(k, menu + "\n" + own(k), "h") for k in range(60)] + [(100 + k, shared + f"\nreal{k} words", "h") for k in range(55)]
    rows += [(200 + k, shared + f"\n{own(k)}", "other") for k in range(5)]
    got = {r.doc_id: r for r in linequality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k].kept and got[k].n_common_lines == 2 for k in range(60))       # its own words remain
    assert not any(got[100 + k].kept for k in range(55)) and not got[100].base_failed
    assert all(got[200 + k].kept and got[200 + k].n_common_lines == 0 for k in range(5))


def test_messy(messy, nothing):
    rows = linequality.quality(messy).collect()
    assert len(rows) == messy.count()
    texts = {}
    for r in messy.collect():
        texts.setdefault(r.doc_id, []).append(plain(r.text))
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in texts[r.doc_id]
        assert r.kept is not None and r.base_failed is not None
    assert linequality.quality(nothing).count() == 0


def test_share_means_the_same_for_small_and_large_hosts(spark):
    rows = [(k, f"menu line\nfirst own{chr(97 + k)}", "small") for k in range(8)]
    rows += [(100 + k, "\n".join([f"own line x{chr(97 + k // 26)}{chr(97 + k % 26)}"] + ["seven docs"] * (k < 7) + ["eight docs"] * (k < 8)), "large")
             for k in range(700)]
    got = {r.doc_id: r for r in linequality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k].n_common_lines == 1 and got[k].n_common_words == 2 for k in range(8))      # 8 of 8 documents, more than 5
    assert [got[100 + k].n_common_lines for k in (0, 6, 7, 8)] == [1, 1, 1, 0]                     # 8 of 700 is above 1 %, 7 is not
