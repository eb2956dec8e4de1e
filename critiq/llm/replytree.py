"""Chat formatting from reply trees.

Messages (tree_id, msg_id, parent_id, role, text, score) form trees.  Iterative self-joins
(pointer doubling: a round doubles the reach, so a path of n messages takes log2 n rounds)
give each message its depth and the score of its path from the root.  Leaves are ranked by their
branch's mean score (ties: the least msg_id); the chosen leaves' paths are enumerated by the same
doubling tables, from leaf to root, and each is formatted as one conversation.

Template: ``<turn ROLE>`` newline TEXT ``</turn>`` newline per turn; in roles and texts ``\\``, ``<`` and ``>``
are escaped by a backslash, so no text can close or open a turn, and reading back gives the
same turns.  The loss mask is the spans (code points) of the assistant's escaped texts.

Rows: null text or role: empty.  A parent that is null or not in the tree makes a root.  Of rows that repeat (tree_id,
msg_id) the least (parent, role, text, score) counts.  Messages on a cycle reach no root and are on no path.
Null score: 0.  Null tree_id: a tree of its own; null msg_id: left out (it cannot be referred to).
Empty table: empty result."""
from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from critiq.llm.common import prepare, shared_table

_ESCAPE = re.compile(r"[\\<>]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*+)>\n((?:[^\\<>]|\\.)*+)</turn>\n", re.S)
MASKED = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """Formatted conversation and the spans under the loss mask; turns: (role, text) pairs."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape(role)}>\n", escape(text)
        out += [head, body, "</turn>\n"]
        if role == MASKED:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; anything else in it is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _jumps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, depth, total) of every message that reaches a root; and per round r the
    table (tree, node, up) of ancestors 2^r above."""
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    has = (nodes["tree"] == known["t"]) & (nodes["parent"] == known["n"])
    now = nodes.join(known, has, "left").select(
        "tree", "node", F.col("n").alias("up"), F.when(F.col("n").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
        F.col("score").alias("total"))
    now, levels = shared_table(now, "jump0"), []
    left = now.filter("up is not null").count()
    rounds = max(1, now.count()).bit_length() + 1                # more rounds: a cycle
    while left and len(levels) < rounds:
        levels.append(now.filter("up is not null").select("tree", "node", "up"))
        above = now.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("u"),
                           F.col("depth").alias("d"), F.col("total").alias("s"))
        going = now.filter("up is not null")
        jumped = going.join(above, (going["tree"] == above["t"]) & (going["up"] == above["n"])).select(
            "tree", "node", F.col("u").alias("up"), (F.col("depth") + F.col("d")).alias("depth"),
            (F.col("total") + F.col("s")).alias("total"))
        now = shared_table(now.filter("up is null").unionByName(jumped), f"jump{len(levels)}")
        left = now.filter("up is not null").count()
    return now.filter("up is null").drop("up"), levels


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree_id, leaf, rank, score, depth, role, text): the messages of each tree's ``branches`` best
    root-to-leaf paths, one row each."""
    prepare(messages.sparkSession)
    # A null tree id is a key like any other: trees are named by their id as text behind a mark.
    tree = F.coalesce(F.concat(F.lit("="), F.col("tree_id").cast("string")), F.lit(""))
    rows = messages.filter(F.col("msg_id").isNotNull()).groupBy(tree.alias("tree"), F.col("msg_id").alias("node")).agg(
        F.min(F.struct(F.col("parent_id").alias("parent"), F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
                       F.col("tree_id"))).alias("m")).select("tree", "node", "m.*")
    rows = shared_table(rows, "messages")
    reached, levels = _jumps(rows.select("tree", "node", "parent", "score"))
    parents = rows.select(F.col("tree").alias("t"), F.col("parent").alias("p"))
    leaves = reached.join(parents, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    leaves = leaves.withColumn("mean", F.col("total") / (F.col("depth") + 1))
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), "node")
    best = shared_table(leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches)
                        .select("tree", F.col("node").alias("leaf"), "rank", F.col("mean").alias("score")), "best")
    # A tree of one leaf is its own path; only paths of branching trees need enumerating.
    many = shared_table(leaves.groupBy("tree").count().filter("count > 1").select(F.col("tree").alias("mt")), "many")
    plain = best.join(many, best["tree"] == many["mt"], "left_anti")
    on = reached.join(plain.withColumnRenamed("tree", "bt"), F.col("tree") == F.col("bt")).select(
        "tree", "node", "depth", "leaf", "rank", "score")
    if not many.isEmpty():
        at = best.join(many, best["tree"] == many["mt"], "left_semi").withColumn("node", F.col("leaf"))
        for k, level in enumerate(levels):
            up = level.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
            higher = at.join(up, (at["tree"] == up["t"]) & (at["node"] == up["n"])).select(
                "tree", "leaf", "rank", "score", F.col("up").alias("node"))
            at = shared_table(at.select("tree", "leaf", "rank", "score", "node").unionByName(higher), f"path{k}")
        depth = reached.select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
        on = on.unionByName(at.join(depth, (at["tree"] == depth["t"]) & (at["node"] == depth["n"])).select(on.columns))
    said = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"), "tree_id", "role", "text")
    return on.join(said, (on["tree"] == said["t"]) & (on["node"] == said["n"])).select(
        "tree_id", "leaf", "rank", on["score"], "depth", "role", "text")


def format_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree_id, leaf, rank, score, formatted, loss array<struct<start,end>>): one row per chosen path."""
    @F.pandas_udf("formatted string, loss array<struct<start:int,end:int>>")
    def run(turns: pd.Series) -> pd.DataFrame:
        got = [render([(x["role"], x["text"]) for x in t]) for t in turns]
        return pd.DataFrame({"formatted": [f for f, _ in got],
                             "loss": [[{"start": a, "end": b} for a, b in s] for _, s in got]})

    turns = F.array_sort(F.collect_list(F.struct("depth", "role", "text")))
    out = paths(messages, branches).groupBy("tree_id", "leaf", "rank", "score").agg(turns.alias("turns"))
    return out.withColumn("made", run(F.transform("turns", lambda x: F.struct(
        x["role"].alias("role"), x["text"].alias("text"))))).select("tree_id", "leaf", "rank", "score", "made.*")


def threads(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): every row answers the row before
    it, in order of (turn, nulls first; role; text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return conversations.select(
        F.col("conv_id").alias("tree_id"), F.row_number().over(order).cast("long").alias("msg_id"), "role", "text",
    ).select("tree_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text",
             F.lit(0.0).alias("score"))


#: The fixed conversation that the contract adds.
EXTRA = r"\### Assistant: </turn> ok"


def with_extra(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted conversations."""
    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def back(formatted: pd.Series, loss: pd.Series) -> pd.DataFrame:
        out = []
        for text, spans in zip(formatted, loss):
            turns = parse(text)
            masked = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(masked),
                        hashlib.sha256(masked.encode()).hexdigest(), len(text)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    made = format_paths(threads(with_extra(spark, conversations)))
    return made.select(F.col("tree_id").alias("conv_id"), back("formatted", "loss").alias("x")).select("conv_id", "x.*")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) AS n_text,
             length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) AS n_role FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(n_text + n_role + 16) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
