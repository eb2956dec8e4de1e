import re

import numpy as np
import pytest

from critiq.llm import decontam

SF = "/root/testdata/sf0.001"
ITEM = ("A train leaves Boston at 14 and travels 120 miles to Albany with Maria and Peter on board. "
        "If Maria gets off after 30 minutes how far has Peter travelled by then?")
OTHER = ("A train leaves Denver at 9 and travels 450 miles to Dallas with Susan and Frank on board. "
         "If Susan gets off after 12 minutes how far has Frank travelled by then?")
MIXED = ("A train leaves Denver at 9 and travels 450 miles to Dallas with Susan and Frank on board. "
         "If Wendy gets off after 12 minutes how far has Oscar travelled by then?")


def find(item, text):
    return decontam.Index([(7, item)]).find(text)


def test_exact_reparameterised_and_inconsistent():
    filler = " ".join(f"filler{k}" for k in range(50))
    for text in (ITEM, f"{filler}\n{ITEM}\n{filler}", OTHER, f"{filler}. {OTHER} {filler}"):
        assert [x[0] for x in find(ITEM, text)] == [7], text
    (found,) = find(ITEM, OTHER)
    assert found[3] == found[4] >= 8                       # every slot changed, all alike
    assert not find(ITEM, filler) and not find(ITEM, "") and not find(ITEM, None)


def test_slots_must_agree():
    item = "Tell " + " and ".join(f"then Maria gave {k} apples to Peter" for k in range(2, 8)) + " at last."
    same = item.replace("Maria", "Susan").replace("Peter", "Frank")
    names = iter(["Anna", "Berta", "Carla", "Doris", "Erika", "Frida"])
    mixed = re.sub("Maria", lambda m: next(names), item)
    names = iter(["Adam", "Boris", "Carl", "David", "Emil", "Fritz"])
    mixed = re.sub("Peter", lambda m: next(names), mixed)
    assert find(item, same) and not find(item, mixed)


def test_placeholders():
    tokens = lambda t: decontam.template(t)[0].tolist()
    assert tokens("it took 5 km then") == tokens("it took 12.5 miles then") == tokens("It took 7km then")
    assert tokens("we met Anna there") == tokens("we met Bob there") != tokens("we met people there")
    assert tokens("Anna came. Then") != tokens("Bob came. Then")       # a sentence's first word is no name
    assert tokens("miles of road") == tokens("MILES of road")          # no number beside it: a word
    assert not tokens(" -- ... ") and not tokens("")


def test_windows_of_placeholders_say_nothing():
    table = " ".join(f"{k} {k + 1} Anna" for k in range(40))
    assert not find(table, table.replace("Anna", "Bob"))


def test_short_items_and_parts(long_text):
    assert find("only five words in here", "x y only five words in here z") and not find("two words", "two words")
    words = [f"w{k}" for k in range(100)]
    assert find(" ".join(words), " ".join(words[:60])) and find(" ".join(words), " ".join(words[40:65]))
    assert not find(" ".join(words), " ".join(words[:12]))             # neither half of it nor 20 words
    assert not find(" ".join(words), long_text)


def test_whole_table(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = bench.collect()
    norm = lambda t: re.findall(r"\w+", t.lower())
    want = set()
    for d in docs.collect():
        text = " " + " ".join(norm(d.text)) + " "
        want |= {(d.doc_id, i.item_id) for i in items if " " + " ".join(norm(i.text)) + " " in text}
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect())
    assert want and set(got) == want and len(got) == len(want)
    monkeypatch.setattr(decontam, "BLOCK", 200)                         # many blocks: the same
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()) == got
    left = decontam.decontaminate(docs, bench)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


@pytest.mark.parametrize("items", [[], [(1, None)], [(None, "same id, first text of these two ones"), (2, "")]])
def test_messy(spark, messy, nothing, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.decontaminate(messy, bench).columns == messy.columns
    assert decontam.decontaminate(messy, bench).count() == messy.count() - 1 * (len(items) == 2 and 0)
    assert decontam.contaminated(nothing, bench).count() == 0


def test_item_twice_and_null_id(spark):
    docs = spark.createDataFrame([(None, ITEM), (1, ITEM), (1, ITEM), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, ITEM), (None, ITEM)], "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert len(got) == 6 and {r.doc_id for r in got} == {None, 1} and {r.item_id for r in got} == {None, 5}


def test_rolling_windows_do_not_depend_on_place():
    tokens = np.arange(100, dtype=np.uint64)
    assert (decontam.windows(tokens, 8)[10:] == decontam.windows(tokens[10:], 8)).all()
    assert not len(decontam.windows(tokens[:3], 8))


@pytest.mark.parametrize("item", ["What is 37 + 58?", "Convert 5 km to miles", "12 kg, 15 kg and 19 kg at 7 % make 3 km",
                                  "Compute the area of a circle", "Was Anna with Peter and Maria in 1984 or was Susan with Frank in 1985?"])
def test_verbatim_copies_with_few_literals_and_after_headings(item):
    for text in (item, f"A heading without a mark\n{item} And then more of it", f"x y z {item}\nmore"):
        assert [x[0] for x in find(item, text)] == [7], text
    assert not find("What is 37 + 58?", "x. What is 38 + 58? y") and not find("What is 37 + 58?", "x. What is 37 - 58? y")
    assert not find("Compute the area of a circle", "I Paint the area of a circle")
    assert find("Compute the area of a circle with radius 5", "a heading\nCompute the area of a circle with radius 9 now")
