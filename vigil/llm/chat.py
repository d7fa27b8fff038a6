"""Reply trees as conversations: self-joins enumerate root-to-leaf paths, branches are ranked by score, each chosen path is formatted.

All of it is DataFrame operations. Self-joins double their reach each time (parent, grandparent, 4th ancestor, ...), so a
path of n messages takes about 2 log2(n) joins, and only chosen leaves are expanded into rows. Joins are on single
messages: no branch, however often replied to, gathers its replies anywhere before the chosen paths are formatted.

Control strings of the template all begin with "<|". In a text, "<", any number of backslashes and "|" get one more
backslash, so that "<|" can't stand in it; reading takes that backslash away again. Roles are escaped likewise for "|>".
Null texts and roles are empty; messages whose parent is missing are roots; messages on a cycle of parents have no path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

END = "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r"\|(\\*)>", r"|\\$1>")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"\|\\(\\*)>", r"|$1>"))


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, node, up) for each message on each chosen path; up: steps above the leaf.

    messages: tree, node (unique string), parent (node or null), score (double). A path's score is the mean of its
    messages' scores; the top paths of each tree are chosen, ties by leaf. Nodes on cycles are left out.
    """
    base = written(messages.select("tree", "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).alias("score")), "messages")
    most = base.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    rounds = math.ceil(math.log2(most)) if most > 1 else 0
    known = base.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    jump = base.join(known, "parent", "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("to"), "score", F.lit(1).cast("long").alias("n"))
    jumps, done = [], None
    for _ in range(rounds):
        jump = written(jump, "jump")
        ended = jump.where(F.col("to").isNull())  # has reached its root, so takes no part in further rounds
        done = ended if done is None else done.unionByName(ended)
        jumps.append(going := jump.where(F.col("to").isNotNull()))
        up = done.unionByName(going).select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("score").alias("_score"), F.col("n").alias("_n"))
        jump = going.join(up, "to").select("tree", "node", F.col("_to").alias("to"), (F.col("score") + F.col("_score")).alias("score"), (F.col("n") + F.col("_n")).alias("n"))
    last = written(jump, "jump").where(F.col("to").isNull())  # what still points on goes round in a cycle
    whole = last if done is None else done.unionByName(last)
    leaves = whole.join(base.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("n")), "node"))
    paths = leaves.withColumn("_r", rank).where(F.col("_r") <= top).select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(rounds)):
        paths = written(paths, "paths")
        more = paths.join(jumps[k].select("node", "to"), "node").select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = paths.unionByName(more)
    return paths


def formatted(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, formatted, loss_spans) per chosen path.

    messages: node, role, text. loss_spans: (start, length) in code points of each assistant text, as escaped, in order.
    """
    m = messages.select("node", escape_role(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    m = m.withColumn("head", F.concat(F.lit("<|"), "role", F.lit("|>\n")))
    turns = paths.join(m, "node").groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("i"), "role", "head", "text"))).alias("turns"))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["text"]) + len(END)).cast("long").alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["text"]).cast("long").alias("length")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return turns.select(
        "tree", "leaf", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> out of a formatted conversation."""
    parts = F.filter(F.split(text, r"<\|end\|>\n"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape_role(F.regexp_extract(x, r"(?s)\A<\|(.*?)\|>\n", 1)).alias("role"),
            unescape(F.regexp_replace(x, r"(?s)\A<\|.*?\|>\n", "")).alias("text"),
        ),
    )


def read_loss(text: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """A table of turns as trees without branches: each row answers the one before it by turn (ties by role, then text)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("_i", F.row_number().over(w))
    name = lambda i: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit("/"), i.cast("string"))
    return numbered.select(
        F.col("conv_id").alias("tree"), name(F.col("_i")).alias("node"), F.when(F.col("_i") > 1, name(F.col("_i") - 1)).alias("parent"),
        F.lit(1.0).alias("score"), "role", "text",
    )
