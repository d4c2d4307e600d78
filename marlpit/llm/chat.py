"""Chat formatting over reply trees.

Messages point to the message they answer. Root-to-leaf paths are enumerated by
iterative self-joins that double their reach, so the rounds grow with the
logarithm of the depth; branches are ranked by the sum of their messages'
scores, and each chosen path becomes one formatted conversation with a loss
mask.

    <|im_start|>ROLE
    TEXT<|im_end|>

Inside roles and texts a backslash is doubled and "<|" becomes "<\\|"; a line
feed inside a role becomes "\\n". This is undone by unescape.

Null roles and texts are empty; a null score counts 0. A message whose parent is
missing is a root. Messages whose ancestors form a cycle are on no path. Ties of
branches go to the longer path, then to the smaller leaf id. Extra columns are
not carried; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def chain_messages(turns: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by turn.

    Rows of one turn (repeats included) follow each other by role, then text. A null id is a tree of its own.
    """
    rows = turns.select(
        F.col(tree).alias("tree"),
        F.col(order).alias("at"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    numbered = rows.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy("at", "role", "text")).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(links: DataFrame) -> DataFrame:
    """(tree, leaf, node, back): every root-to-leaf path of links (tree, node, parent); back is the distance to the leaf."""
    key = F.coalesce(F.col("tree").cast("string"), F.lit("null "))
    links = cut(links.select(key.alias("key"), "tree", "node", "parent"))
    known = links.select("key", F.col("node").alias("parent")).distinct()
    jumps = links.where(F.col("parent").isNotNull()).join(known, ["key", "parent"], "left_semi").select("key", "node", F.col("parent").alias("above"))
    roots = links.join(jumps.select("key", "node"), ["key", "node"], "left_anti").select("key", F.col("node"))
    leaves = links.join(jumps.select("key", F.col("above").alias("node")).distinct(), ["key", "node"], "left_anti")
    reach = cut(leaves.select("key", "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")))
    largest = links.groupBy("key").count().agg(F.max("count")).first()[0] or 1
    for k in range(math.ceil(math.log2(largest)) + 1 if largest > 1 else 0):
        jumps = cut(jumps)
        if jumps.isEmpty():
            break
        further = reach.join(jumps, ["key", "node"]).select("key", "tree", "leaf", F.col("above").alias("node"), (F.col("back") + 2**k).alias("back"))
        reach = cut(reach.unionByName(further))
        upper = jumps.select("key", F.col("node").alias("above"), F.col("above").alias("top"))
        jumps = jumps.join(upper, ["key", "above"]).select("key", "node", F.col("top").alias("above"))
    rooted = reach.join(roots, ["key", "node"], "left_semi").select("key", "leaf")
    return reach.join(rooted, ["key", "leaf"], "left_semi").select("key", "tree", "leaf", "node", "back")


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, n_turns, formatted, loss_spans): the best branches of messages (tree, node, parent, role, text, score).

    loss_spans are (start, size) in code points of formatted, over the escaped texts of assistant turns.
    """
    paths = reply_paths(messages)
    scored = messages.select(
        F.coalesce(F.col("tree").cast("string"), F.lit("null ")).alias("key"), "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
    ranks = (
        paths.join(scored.select("key", "node", "score"), ["key", "node"])
        .groupBy("key", "leaf")
        .agg(F.sum("score").alias("total"), F.count("*").alias("size"))
        .withColumn("branch", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("total"), F.desc("size"), "leaf")))
        .where(F.col("branch") <= branches)
    )
    chosen = paths.join(ranks.select("key", "leaf", "branch"), ["key", "leaf"])
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    turns = chosen.join(scored, ["key", "node"]).select("key", "tree", "leaf", "branch", "back", "role", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    piece = F.concat("head", "body", F.lit(END + "\n"))
    placed = turns.withColumn("piece", piece).withColumn("until", F.sum(F.length("piece")).over(Window.partitionBy("key", "leaf").orderBy(F.desc("back"))))
    span = F.struct((F.col("until") - F.length("piece") + F.length("head")).alias("start"), F.length("body").cast("long").alias("size"))
    lined = placed.select("key", "tree", "leaf", "branch", F.struct((-F.col("back")).alias("at"), "piece", F.when(F.col("role") == "assistant", span).alias("span")).alias("turn"))
    grouped = lined.groupBy("key", "leaf").agg(F.first("tree").alias("tree"), F.first("branch").alias("branch"), F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select(
        "tree",
        "leaf",
        "branch",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.piece", "").alias("formatted"),
        F.array_compact("turns.span").alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, recovered from formatted conversations alone."""
    pieces = F.transform(F.filter(F.split("formatted", r"<\|im_start\|>"), lambda _, k: k > 0), lambda p: F.substring_index(p, END, 1))
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.instr(p, "\n") + F.lit(1))).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int") + 1, s["size"].cast("int"))))
    return formatted.select("*", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))
