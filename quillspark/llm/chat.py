"""Chat formatting of reply trees.

Messages are nodes with a parent. Iterative self-joins double each node's jump to an ancestor
(after k rounds it spans 2**k replies), which yields every node's root, depth and path score
in a logarithmic number of rounds; the best-scored leaves of each tree are chosen, and the
jumps kept from the rounds are walked back to enumerate the chosen root-to-leaf paths. Each
path becomes one formatted conversation with loss spans over its assistant texts.

Template: <|turn|>role\\ntext<|end|>\\n for each turn. Inside roles and texts a backslash is
doubled and a control string gets a backslash after its first character, so decoding is to
drop one backslash of each.

Cases: a null text or role is empty; equal turns are told apart by role and text; a message
whose parent is missing is a root; a tree without rows isn't there; rows of a null conversation are
one conversation; of paths with one score the one with the least leaf is better; a null turn comes first; an empty table gives no
rows; other columns, whatever their names, are ignored. Everything is DataFrame operations.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.llm.common import cut

TURN, END = "<|turn|>", "<|end|>"
#: Strings that chat templates give a meaning to.
CONTROL = ["<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def quoted(s: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in "_<>" else c for c in s)


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\\\")
    for first in ("<", "["):
        rest = "|".join(quoted(c[1:]) for c in CONTROL if c[0] == first)
        text = F.regexp_replace(text, f"{quoted(first)}({rest})", f"{first}\\\\$1")
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, node, depth) of the `best` root-to-leaf paths of each tree.

    nodes: tree, node, parent (null or missing: root), score. Rank: path score, then the least leaf.
    """
    here = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"), F.lit(True).alias("there"))
    jumps = nodes.join(here, [F.col("t").eqNullSafe(F.col("tree")), F.col("parent") == F.col("p")], "left").select("tree", "node", F.expr("if(there, parent, null)").alias("up"), F.lit(1).alias("hops"), F.col("score").cast("double").alias("total"))
    active = cut(jumps)
    steps, over = [], [active.where("up is null")]
    while True:
        live = active.where("up is not null")
        steps.append(live.select("tree", "node", "up"))
        if live.isEmpty():
            break
        far = active.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("u"), F.col("hops").alias("h"), F.col("total").alias("s"))
        moved = cut(live.join(far, [F.col("t").eqNullSafe(F.col("tree")), F.col("n") == F.col("up")], "left").select("tree", "node", F.col("u").alias("up"), F.expr("hops + coalesce(h, 0)").alias("hops"), F.expr("total + coalesce(s, 0)").alias("total")))
        over.append(moved.where("up is null"))
        # trees whose every node has met its root take part in no more rounds
        still = moved.where("up is not null").select(F.col("tree").alias("t")).distinct()
        active = cut(active.where("up is null").unionByName(moved).join(still, F.col("t").eqNullSafe(F.col("tree")), "left_semi"))
    jumps = functools.reduce(DataFrame.unionByName, over)
    parents = steps[0].select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = jumps.join(parents, [F.col("t").eqNullSafe(F.col("tree")), F.col("n") == F.col("node")], "left_anti")
    if best == 1:  # a map-side combined maximum, as a tree may have many leaves
        chosen = leaves.groupBy("tree").agg(F.min_by("node", F.struct(-F.col("total"), "node")).alias("leaf"))
    else:
        chosen = leaves.withColumn("r", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), "node"))).where(F.col("r") <= best).select("tree", F.col("node").alias("leaf"))
    marked = cut(chosen.withColumn("node", F.col("leaf")))
    for step in reversed(steps[:-1]):
        s = step.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        # cut off each time, or the plan doubles; the longest jumps come first, when there are few rows
        marked = cut(marked.unionByName(marked.join(s, [F.col("t").eqNullSafe(F.col("tree")), F.col("n") == F.col("node")]).select("tree", "leaf", F.col("up").alias("node"))))
    depth = jumps.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("hops").alias("depth"))
    return marked.join(depth, [F.col("t").eqNullSafe(F.col("tree")), F.col("n") == F.col("node")]).select("tree", "leaf", "node", "depth")


def format_paths(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """tree, leaf, n_turns, formatted, loss_spans (array of begin and length in characters, in order)."""
    n = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = chosen.join(n, [F.col("t").eqNullSafe(F.col("tree")), F.col("n") == F.col("node")]).select("tree", "leaf", "depth", "role", F.concat(F.lit(TURN), escape(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    w = W.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("begin", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("begin").cast("long").alias("begin"), F.length("body").cast("long").alias("length"))
    all_turns = F.array_sort(F.collect_list(F.struct("depth", "piece", F.when(F.col("role") == "assistant", span).alias("span"))))
    grouped = turns.groupBy("tree", "leaf").agg(all_turns.alias("x"))
    return grouped.select("tree", "leaf", F.size("x").cast("long").alias("n_turns"), F.array_join(F.col("x.piece"), "").alias("formatted"), F.filter("x.span", lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """turns (array of role and text) and loss (all text under the mask), decoded from the formatted string."""
    parts = F.slice(F.split("formatted", quoted(TURN)), 2, 2147483647 - 2)
    body = F.transform(parts, lambda p: p.substr(F.lit(1), F.length(p) - len(END) - 1))
    turn = F.transform(body, lambda b: F.struct(unescape(F.substring_index(b, "\n", 1)).alias("role"), unescape(b.substr(F.instr(b, "\n") + 1, F.length(b))).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["begin"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("*", turn.alias("turns"), F.array_join(masked, "").alias("loss"))


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text as chains: each row replies to the one before it."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").select(F.col("conv_id").alias("tree"), F.row_number().over(w).cast("long").alias("node"), "role", "text").withColumn("parent", F.expr("if(node = 1, null, node - 1)")).withColumn("score", F.length(F.coalesce("text", F.lit(""))))
