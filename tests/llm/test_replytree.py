import random

import duckdb
import pytest

from critiq.llm import replytree

FORM = "tree_id long, msg_id long, parent_id long, role string, text string, score double"


def brute(rows):
    """{tree: (leaf, texts from the root)} of the branch with the best mean score."""
    trees = {}
    for t, m, p, role, text, score in rows:
        trees.setdefault(t, {})[m] = (p, role or "", text or "", score or 0.0)
    out = {}
    for t, nodes in trees.items():
        inner = {p for p, *_ in nodes.values()}
        best = None
        for leaf in nodes:
            if leaf in inner:
                continue
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][0]
            if at in path:
                continue
            mean = sum(nodes[x][3] for x in path) / len(path)
            if best is None or (-mean, leaf) < best[0]:
                best = ((-mean, leaf), leaf, [(nodes[x][1], nodes[x][2]) for x in reversed(path)])
        if best:
            out[t] = best[1:]
    return out


def test_branches_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for t in range(12):
        for m in range(1, rng.randint(2, 40)):
            rows.append((t, m, rng.randint(max(0, m - 3), m - 1) or None, rng.choice(["user", "assistant"]), f"{t}.{m} <b>\\",
                         float(rng.randint(0, 9))))
    rng.shuffle(rows)
    got = {r.tree_id: (r.leaf, replytree.parse(r.formatted)) for r in
           replytree.format_paths(spark.createDataFrame(rows, FORM)).collect()}
    assert got == brute(rows)


def test_two_branches_are_ranked(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 1.0),
            (1, 4, 1, "assistant", "tie", 5.0)]
    got = replytree.format_paths(spark.createDataFrame(rows, FORM), branches=3).orderBy("rank").collect()
    assert [(r.rank, r.leaf) for r in got] == [(1, 2), (2, 4), (3, 3)]


def test_odd_trees(spark):
    rows = [(1, 1, 2, "user", "cycle", 1.0), (1, 2, 1, "user", "cycle", 1.0), (2, 5, 99, "user", "lost parent", None),
            (3, 1, None, None, None, None), (3, None, 1, "user", "no id", 1.0), (None, 1, None, "user", "no tree", 0.0),
            (4, 1, None, "user", "twice", 0.0), (4, 1, None, "user", "twice", 0.0)]
    got = {r.tree_id: replytree.parse(r.formatted) for r in replytree.format_paths(spark.createDataFrame(rows, FORM)).collect()}
    assert got == {2: [("user", "lost parent")], 3: [("", "")], None: [("user", "no tree")], 4: [("user", "twice")]}
    assert replytree.format_paths(spark.createDataFrame([], FORM)).count() == 0


@pytest.mark.parametrize("turns", [[], [("user", "")], [("assistant", replytree.EXTRA), ("a>b\\", "\n<turn x>\n</turn>\n\\")],
                                   [("user", "é" * 5), ("assistant", "\\\\<\\>"), ("assistant", "x" * 200_000)]])
def test_round_trip(turns):
    text, spans = replytree.render(turns)
    assert replytree.parse(text) == turns
    assert "".join(replytree.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_long_thread_and_query(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(300)] + [(2, 0, None, None), (2, 0, "user", "x"),
            (2, None, "user", None), (None, 1, "assistant", "null id"), (3, 1, "user", "same"), (3, 1, "user", "same")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    key = lambda r: (r[0] is not None, r[0] or 0)
    sql = replytree.ORACLE.replace("ORDER BY turn,", "ORDER BY turn NULLS FIRST,")
    assert sorted(map(tuple, replytree.digest(spark, conv).collect()), key=key) == sorted(con.execute(sql).fetchall(), key=key)


def test_extra_columns(spark):
    conv = spark.createDataFrame([(1, 0, "user", "a", "x", 3)], "conv_id long, turn long, role string, text string, depth string, leaf int")
    assert {r.conv_id: r.n_turns for r in replytree.digest(spark, conv).collect()} == {1: 1, -7: 2}
