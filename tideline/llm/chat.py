"""Chat formatting of reply trees.

Rows name a parent, so a conversation is a tree (a plain list of turns is a
tree with one path).  Self-joins that double their reach each time give every
row its depth and the score of its path from the root; the leaves of a tree are
ranked by score, and the same pointers walk back from each chosen leaf to list
its path.  Each path becomes one conversation under one template.

Template, by turn: <|im_start|>ROLE\\nTEXT<|im_end|>\\n.  In roles and texts a
backslash becomes \\\\ and every "<|" becomes "<\\|", and in roles a line feed becomes \\n, so no control
string can appear in them and reading back is exact.  The loss mask is a list of spans
over the formatted text (code points, end exclusive), one for each assistant text.

Defined results: null text and null role are empty; rows of one turn keep the order of role,
then text, and repeated rows stay; a parent that does not exist or lies on a cycle makes no
path from a root, so such rows appear in none; of nodes with one number in a tree the least by parent,
score, role and text counts; texts of any length are kept whole; other columns are not looked at; rows without conversation id form one
conversation; ties in score go to the smaller leaf; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.llm._saved import saved

FORMATTED = "conv_id long, leaf long, rank int, n_turns long, formatted string, loss_spans string"


def replies(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a tree without branches: tree, node, parent, role, text, score."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, per_tree: int | None = None) -> DataFrame:
    """Root-to-leaf paths: tree, leaf, rank, total (score), depth (of the leaf), and a row for
    each step with its node and how deep it lies (at).

    nodes: tree, node (not negative), parent (null at a root), score.  per_tree keeps the best
    few branches.
    """
    up = nodes.select(F.coalesce("tree", F.lit(-(1 << 62))).alias("tree"), "node", F.col("parent").alias("to"), F.lit(1).cast("long").alias("depth"), F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("total"))
    limit = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    reach, jumps = 1, []
    while reach <= limit:  # after k joins a pointer reaches 2**k rows up
        up = saved(up)
        jumps.append(up)
        if up.where("`to` >= 0").limit(1).count() == 0:
            break
        # Only rows that haven't come to their root go on.
        far = up.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("to").alias("to2"), F.col("depth").alias("d2"), F.col("total").alias("s2"))
        go = up.where("`to` >= 0")
        moved = go.join(far, (go["tree"] == far["t2"]) & (go["to"] == far["n2"]), "left").select("tree", "node", F.when(F.col("n2").isNull(), F.lit(-1).cast("long")).otherwise(F.col("to2")).alias("to"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("s2", F.lit(0.0))).alias("total"))
        up = up.where("`to` is null or `to` < 0").unionByName(moved)
        reach *= 2
    up = saved(up)
    parents = nodes.select(F.coalesce("tree", F.lit(-(1 << 62))).alias("tree"), F.col("parent").alias("node")).where("node is not null").distinct()
    tips = up.where("`to` is null").join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    tips = tips.select("tree", F.col("node").alias("leaf"), rank.alias("rank"), "total", "depth")
    if per_tree is not None:
        tips = tips.where(F.col("rank") <= per_tree)
    # Walk down the powers of two: from each step, the step 2**k rows up, where there is one.
    steps = saved(tips.withColumn("node", F.col("leaf")))
    for jump in reversed(jumps):
        hop = jump.where("`to` >= 0").select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "to")
        moved = steps.join(hop, (steps["tree"] == hop["t2"]) & (steps["node"] == hop["n2"]))
        steps = saved(steps.unionByName(moved.select(*[c for c in steps.columns if c != "node"], F.col("to").alias("node"))))
    deep = up.where("`to` is null").select("tree", "node", F.col("depth").alias("at"))
    return steps.join(deep, ["tree", "node"])


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: str) -> str:
    return re.sub(r"\\\\|\\n|<\\\|", lambda m: {"\\\\": "\\", "\\n": "\n"}.get(m[0], "<|"), text)


def formatted(nodes: DataFrame, per_tree: int | None = None, unique: bool = False) -> DataFrame:
    """One row for each chosen path: conv_id, leaf, rank, n_turns, formatted, loss_spans.

    unique: no tree has two nodes of one number.
    """
    if not unique:
        first = F.min(F.struct("parent", "score", "role", "text")).alias("x")
        nodes = nodes.groupBy("tree", "node").agg(first).select("tree", "node", "x.*")
    none, nodes = F.lit(-(1 << 62)), saved(nodes)
    body = nodes.select(F.coalesce("tree", none).alias("tree"), "node", F.replace(_escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n")).alias("role"), _escaped(F.coalesce("text", F.lit(""))).alias("text"))
    steps = paths(nodes, per_tree).join(body, ["tree", "node"])
    turn = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    per = steps.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", turn.alias("turn")))).alias("turns"))
    return per.select(
        F.nullif(F.col("tree"), none).alias("conv_id"), "leaf", "rank", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.turn"), "").alias("formatted"),
        F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("spans")), lambda a, t: F.struct((a["at"] + F.length(t["turn"])).alias("at"), F.when(t["role"] == "assistant", F.array_append(a["spans"], F.array(a["at"] + 13 + F.length(t["role"]), a["at"] + 13 + F.length(t["role"]) + F.length(t["text"])))).otherwise(a["spans"]).alias("spans")), lambda a: F.to_json(a["spans"])).alias("loss_spans"),
    )


TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted conversation."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in TURN.finditer(text)]


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(rows: DataFrame) -> DataFrame:
    """What reading back the formatted conversations gives (see DIGEST)."""

    def run(frames):
        for pdf in frames:
            out = []
            for conv, text, spans in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_spans"], strict=True):
                turns = parsed(text)
                loss = "".join(unescaped(text[a:b]) for a, b in json.loads(spans))
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rows.select("conv_id", "formatted", "loss_spans").mapInPandas(run, DIGEST)
