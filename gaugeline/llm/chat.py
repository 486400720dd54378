"""Chat formatting from reply trees, with DataFrame functions only.

Messages form trees by parent.  Root-to-leaf paths are enumerated by self-joins that
double their reach each round, branches are ranked by the sum of their messages'
scores (ties: the smaller leaf), and each chosen path is formatted as one
conversation with a loss mask over the assistant's texts.

    <s>[role]text</s>[role]text</s>...

In texts and roles "\\", "[", "<" (and in roles "]") become "\\b", "\\o", "\\l" ("\\c"), so
a control string can't occur inside them; unescape() is exact.

Defined results: null text or role is empty; rows of one turn follow in the order of
role and text, repeated rows included; a null conv_id is a conversation of its own; null
turns come first; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

ESCAPES = (("\\", "\\b"), ("[", "\\o"), ("<", "\\l"), ("]", "\\c"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, coded in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def as_tree(rows: DataFrame) -> DataFrame:
    """(tree, node, parent, role, text, score): a conversation's rows, each a reply to the one before."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    n = F.row_number().over(order).cast("long")
    return rows.select(
        F.struct("conv_id").alias("tree"), n.alias("node"), F.when(n > 1, n - 1).alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score"),
    )


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node on the way from each leaf to its root, up steps above the leaf.

    After round k a leaf has met its 2^k nearest ancestors and every node knows the one 2^k above it."""
    link = nodes.select("tree", "node", "parent")
    leaf = link.join(link.select("tree", F.col("parent").alias("node")).where("node is not null").distinct(), ["tree", "node"], "left_anti")
    met = staged(leaf.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "chat-paths")
    jump = staged(link.where("parent is not null").select("tree", "node", F.col("parent").alias("to")), "chat-jumps")
    reach, rounds = 1, 0
    while True:
        none = F.lit(None).cast("long")
        further = met.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + reach).alias("up"), none.alias("to"), F.lit(True).alias("is_path"))
        above = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("top"))
        jump = jump.join(above, ["tree", "to"]).select("tree", none.alias("leaf"), "node", none.alias("up"), F.col("top").alias("to"), F.lit(False).alias("is_path"))
        made = staged(further.unionByName(jump), f"chat-round{rounds}")  # one write a round
        further = made.where("is_path").select("tree", "leaf", "node", "up")
        if not further.limit(1).count():
            return met
        met = met.unionByName(further)
        jump = made.where("not is_path").select("tree", "node", "to")
        reach, rounds = 2 * reach, rounds + 1


def best_branches(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, branch, turn, role, text): the keep best paths of each tree by summed score."""
    way = staged(paths(nodes), "chat-ways")
    way = way.join(nodes.select("tree", "node", "role", "text", "score"), ["tree", "node"])
    rank = way.groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.max("up").alias("depth"))
    rank = rank.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))).where(F.col("branch") <= keep)
    return way.join(rank, ["tree", "leaf"]).select("tree", "branch", (F.col("depth") - F.col("up")).alias("turn"), "role", "text")


def format_branches(turns: DataFrame) -> DataFrame:
    """(tree, branch, formatted, mask): mask holds [start, end) code-point offsets of assistant texts."""
    head = F.concat(F.lit("["), escape(F.col("role"), role=True), F.lit("]"))
    body = escape(F.col("text"))
    before = Window.partitionBy("tree", "branch").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t = turns.select("tree", "branch", "turn", "role", head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + 4
    start = F.lit(3) + F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    t = t.withColumn("start", start.cast("long")).withColumn("stop", (start + F.length("body")).cast("long"))
    piece = F.struct("turn", F.concat("head", "body", F.lit("</s>")).alias("piece"))
    span = F.when(F.col("role") == "assistant", F.struct("start", F.col("stop").alias("end")))
    g = t.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.sort_array(F.collect_list(span)).alias("mask"))
    return g.select("tree", "branch", F.concat(F.lit("<s>"), F.array_join(F.col("pieces.piece"), "")).alias("formatted"), "mask")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.split(F.substring(formatted, 4, 2**31 - 1), "</s>", -1)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    close = lambda p: F.instr(p, F.lit("]"))
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substr(p, F.lit(2), close(p) - 2)).alias("role"), unescape(F.substr(p, close(p) + 1)).alias("text"),
    ))


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped."""
    return F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) for rows(conv_id, turn, role, text)."""
    nodes = staged(as_tree(rows), "chat-nodes")
    return format_branches(best_branches(nodes)).select(F.col("tree.conv_id").alias("conv_id"), "formatted", "mask")
