"""Conversations from reply trees.

Nodes (conv, node, parent, role, text, score) form trees; a node whose parent isn't there is a root. Self-
joins double the length of jumps toward the root, and a second round of joins fills in the ancestors of each
leaf, so paths of n turns take log n rounds and one row per turn. Branches are ranked by the mean score of
their turns; the best ones are formatted, one conversation each. Nodes that hang from a cycle belong to no
path.

The template marks each turn. Control strings inside texts get one more backslash behind their first
character, which reading back removes, so no text can end a turn or open another. The loss mask lists the
characters that assistants said. Null texts are empty; a null role is kept apart from an empty one. A
conversation is one string, made in one task. An empty table gives no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.ship import durable

CONTROL = r"([\[<])(\\*)(/?(?:INST\]|ROLE|s>))"
ESCAPED = r"([\[<])\\(\\*)(/?(?:INST\]|ROLE|s>))"
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|\[ROLE[^\]]*\] .*? \[/ROLE\]"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def head(role: Column) -> Column:
    """What opens a turn. Other roles than the two usual ones are named, in letters that can't close it."""
    other = F.coalesce(F.concat(F.lit("[ROLE "), F.url_encode(role), F.lit("] ")), F.lit("[ROLE] "))
    return F.when(role == "user", "[INST] ").when(role == ASSISTANT, "<s> ").otherwise(other)


def tail(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == ASSISTANT, " </s>").otherwise(" [/ROLE]")


def chains(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows of linear conversations as nodes; each turn replies to the one before. Ties go by role and text."""
    order = Window.partitionBy(conv).orderBy(turn, "role", "text")
    node = F.row_number().over(order).cast("long")
    rows = turns.select(F.col(conv).alias("conv"), node.alias("node"), "role", "text")
    return rows.select("conv", "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node on the way from each leaf to its root, `up` steps above the leaf.

    `nodes` has tree, node and parent. Rounds go on until no jump leads anywhere; each is written once.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = durable(nodes.select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi"), "jumps")
    jumps, reach, size = [], 1, nodes.count()
    while not jump.isEmpty() and reach <= size:
        jumps.append(jump)
        onward = jump.select("tree", F.col("node").alias("parent"), F.col("parent").alias("far"))
        jump = jump.join(onward, ["tree", "parent"]).select("tree", "node", F.col("far").alias("parent"))
        jump, reach = durable(jump, "jumps"), 2 * reach
    members = nodes.select("tree", "node")
    if jumps:
        inner = jumps[0].select("tree", F.col("parent").alias("node")).distinct()
        members = members.join(inner, ["tree", "node"], "left_anti")
    members = members.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for i in reversed(range(len(jumps))):
        above = members.join(jumps[i], ["tree", "node"])
        above = above.select("tree", "leaf", F.col("parent").alias("node"), F.col("up") + (1 << i))
        members = durable(members.union(above.toDF("tree", "leaf", "node", "up")), "path-members")
    return members


def ranked_branches(members: DataFrame, nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, score, rank) of the best branches of each tree; ties go to the smaller leaf."""
    roots = nodes.join(
        nodes.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_anti"
    ).select("tree", "node", F.lit(True).alias("root"))
    facts = nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = members.join(facts, ["tree", "node"]).join(roots, ["tree", "node"], "left")
    scored = rows.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.max("root").alias("rooted"))
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")
    ranked = scored.where("rooted").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= best).select("tree", "leaf", "score", "rank")


def conversations(nodes: DataFrame, best: int = 1) -> DataFrame:
    """The best branches of each tree: conv, leaf, score, rank, formatted, loss (begin, length in characters)."""
    keyed = nodes.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")))
    keyed = durable(keyed, "reply-nodes")
    members = paths(keyed)
    chosen = ranked_branches(members, keyed, best)
    said = F.coalesce("text", F.lit(""))
    rows = members.join(chosen, ["tree", "leaf"]).join(keyed.drop("score", "parent"), ["tree", "node"])
    rows = rows.withColumn("opening", head(F.col("role"))).withColumn("body", escape(said))
    rows = rows.withColumn("piece", F.concat("opening", "body", tail(F.col("role"))))
    before = (
        Window.partitionBy("tree", "leaf")
        .orderBy(F.col("up").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    begin = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("opening")
    span = F.when(F.col("role") == ASSISTANT, F.struct(begin.alias("begin"), F.length("body").alias("length")))
    rows = rows.withColumn("span", span)
    turn = F.struct((-F.col("up")).alias("place"), "piece", "span")
    whole = rows.groupBy("tree", "leaf").agg(
        F.first("conv").alias("conv"),
        F.first("score").alias("score"),
        F.first("rank").alias("rank"),
        F.sort_array(F.collect_list(turn)).alias("turns"),
    )
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    text = F.array_join(F.transform("turns", lambda t: t["piece"]), "")
    return whole.select("conv", "leaf", "score", "rank", text.alias("formatted"), spans.alias("loss"))


def turns_of(formatted: str) -> Column:
    """array<struct<role, text>> read back from a formatted conversation; a null role stays null."""

    def read(turn: Column) -> Column:
        def body(opening: str, closing: str) -> Column:
            return unescape(F.regexp_extract(turn, f"(?s)^{opening}(.*){closing}$", 1))

        name = F.url_decode(F.regexp_extract(turn, r"^\[ROLE ([^\]]*)\]", 1))
        return (
            F.when(
                turn.startswith("[INST]"),
                F.struct(F.lit("user").alias("role"), body(r"\[INST\] ", r" \[/INST\]").alias("text")),
            )
            .when(
                turn.startswith("<s>"),
                F.struct(F.lit(ASSISTANT).alias("role"), body("<s> ", " </s>").alias("text")),
            )
            .otherwise(
                F.struct(
                    F.when(~turn.startswith("[ROLE]"), name).alias("role"),
                    body(r"\[ROLE[^\]]*\] ", r" \[/ROLE\]").alias("text"),
                )
            )
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), read)


def loss_text(formatted: str, loss: str) -> Column:
    """All text under the loss mask, unescaped."""
    parts = F.expr(f"transform({loss}, s -> substring({formatted}, cast(s.begin as int) + 1, s.length))")
    return F.array_join(F.transform(parts, unescape), "")
