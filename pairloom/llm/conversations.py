"""Chat formatting of reply trees.

Self-joins that double their reach add up the scores from every leaf to its root,
branches are ranked by them, and the path of each chosen one is enumerated and
becomes one conversation with marked turns and a loss mask over the assistant's
texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import field, packed, written

ASSISTANT = "assistant"
# The template: a turn is ### role, a line end, the text, </turn>, a line end.
OPEN, CLOSE = "### ", "</turn>\n"
# What stands for a character of the template inside texts, backslash first.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, mark in pairs:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, mark in reversed(pairs):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (tree, node, above, worth, n) of the node 1, 2, 4, … steps above each
    node that has one, with the scores and the number of the nodes from ``node`` up to
    below ``above``. Also the nodes that lie on a circle or lead into one, if any:
    they have a node above them at more steps than their tree has nodes."""
    known = nodes.select("tree", F.col("node").alias("above"))
    step = written(
        nodes.select(
            "tree", "node", F.col("parent").alias("above"),
            F.coalesce("score", F.lit(0.0)).alias("worth"), F.lit(1).cast("bigint").alias("n"),
        ).join(known, ["tree", "above"]),
        "jumps",
    )
    jumps: list[DataFrame] = []
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while not step.isEmpty():
        if 1 << len(jumps) > largest:
            return jumps, step.select("tree", "node")
        jumps.append(step)
        further = step.select(
            "tree", F.col("node").alias("above"), F.col("above").alias("top"),
            F.col("worth").alias("more"), F.col("n").alias("more_n"),
        )
        step = written(
            step.join(further, ["tree", "above"]).select(
                "tree", "node", F.col("top").alias("above"),
                (F.col("worth") + F.col("more")).alias("worth"), (F.col("n") + F.col("more_n")).alias("n"),
            ),
            "jumps",
        )
    return jumps, None


def _leaves(nodes: DataFrame, lost: DataFrame | None) -> DataFrame:
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = nodes.select("tree", "node").join(parents, ["tree", "node"], "left_anti")
    return leaves if lost is None else leaves.join(lost, ["tree", "node"], "left_anti")


def branches(nodes: DataFrame, jumps: list[DataFrame], lost: DataFrame | None) -> DataFrame:
    """(tree, leaf, worth, n_turns) of every branch: the mean score of its nodes and
    their number. A leaf climbs by the longest jump it has, then the next shorter
    one, so it is one row at any depth and no path is listed."""
    at = _leaves(nodes, lost).select(
        "tree", F.col("node").alias("leaf"), "node",
        F.lit(0.0).alias("worth"), F.lit(0).cast("bigint").alias("n"),
    )
    for jump in reversed(jumps):
        up = jump.select(
            "tree", "node", F.col("above"), F.col("worth").alias("more"), F.col("n").alias("more_n")
        )
        at = at.join(up, ["tree", "node"], "left").select(
            "tree", "leaf", F.coalesce("above", "node").alias("node"),
            (F.col("worth") + F.coalesce("more", F.lit(0.0))).alias("worth"),
            (F.col("n") + F.coalesce("more_n", F.lit(0))).alias("n"),
        )
    roots = nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("own"))
    return at.join(roots, ["tree", "node"]).select(
        "tree", "leaf", ((F.col("worth") + F.col("own")) / (F.col("n") + 1)).alias("worth"),
        (F.col("n") + 1).alias("n_turns"),
    )


def paths_of(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, leaf) to (tree, leaf, node, up): every node on the way from each leaf to
    its root. Each round doubles the reach."""
    paths = written(
        leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("up")),
        "paths",
    )
    for i, jump in enumerate(jumps):
        longer = written(
            paths.join(jump, ["tree", "node"]).select(
                "tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << i)).alias("up")
            ),
            "paths",
        )
        paths = paths.unionByName(longer)
    return paths


def paths_to_root(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, node, parent) to (tree, leaf, node, up): every node on the way
    from a leaf up to its root. The number of joins is the logarithm of the depth. Rows
    whose parent is missing are roots; circles, and leaves that lead into one, have no
    root and are left out. (tree, node) must be unique and not null."""
    nodes = nodes.select("tree", "node", "parent", F.lit(0.0).alias("score"))
    jumps, lost = _jumps(nodes)
    return paths_of(_leaves(nodes, lost).withColumnRenamed("node", "leaf"), jumps)


def _never_null(name: str) -> Column:
    """A key that joins where ``name`` is null; values come before the null."""
    return F.struct(F.isnull(name).alias("absent"), F.col(name).alias("id"))


def _unique_nodes(messages: DataFrame) -> DataFrame:
    """Messages with keys (tree, node) that are unique and never null: structs
    with the value in ``id``. Written, so the numbers of null nodes hold."""
    copy = F.row_number().over(
        Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score")
    )
    # Null nodes are numbered apart, all others are number 1.
    numbered = messages.withColumn("copy", copy).where("node is null or copy = 1")
    key = lambda name, nth: F.struct(
        F.isnull(name).alias("absent"), F.col(name).alias("id"), nth.alias("nth")
    )
    return written(
        numbered.select(
            _never_null("tree").alias("tree"), key("node", F.col("copy")).alias("node"),
            F.when(F.col("parent").isNotNull(), key("parent", F.lit(1))).alias("parent"),
            "role", "text", "score",
        ),
        "messages",
    )


def format_trees(messages: DataFrame, paths_per_tree: int = 1) -> DataFrame:
    """``messages`` (tree, node, parent, role, text, score) to one row per chosen
    path: ``tree``, ``leaf``, ``rank``, ``n_turns``, ``formatted`` and ``mask``
    (start and length in characters of each assistant text as it stands in
    ``formatted``).

    Branches of a tree are ranked by the mean score of their messages (null: 0),
    then by length, then by the smaller leaf. Null roles and texts count as empty.
    Rows with a null tree are one tree, whose ``tree`` stays null. Of rows that
    repeat a (tree, node) the first by parent, role, text and score counts, nulls
    first. A null node has no children, so every row with one is a branch of its
    own with a null ``leaf``, repeated rows too; they come after equal branches
    with a leaf, in the order of the columns named. Circles, and branches that lead
    into one, have no root and are left out. An empty table gives an empty result.
    """
    messages = _unique_nodes(messages.select("tree", "node", "parent", "role", "text", "score"))
    jumps, lost = _jumps(messages)
    order = Window.partitionBy("tree").orderBy(F.desc("worth"), F.desc("n_turns"), "leaf")
    ranked = branches(messages, jumps, lost).withColumn("rank", F.row_number().over(order))
    chosen = written(ranked.where(F.col("rank") <= paths_per_tree).drop("worth"), "chosen")
    turns = paths_of(chosen, jumps).join(chosen, ["tree", "leaf"]).join(
        messages.select("tree", "node", "role", "text"), ["tree", "node"]
    )
    text = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit("")), ROLE_ESCAPES), F.lit("\n"))
    turn = F.struct(
        F.negative("up").alias("at"), head.alias("head"), text.alias("text"),
        (F.col("role") == ASSISTANT).alias("learn"),
    )
    whole = turns.groupBy("tree", "leaf", "rank", "n_turns").agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )
    parts = F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(CLOSE)))
    # Length of all turns before each one, by one fold over the turns.
    begins = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["end"] + F.length(t["head"]) + F.length(t["text"]) + len(CLOSE)).alias("end"),
            F.when(
                t["learn"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["end"] + F.length(t["head"])).alias("start"),
                            F.length(t["text"]).cast("bigint").alias("length"),
                        )
                    ),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return whole.select(
        F.col("tree.id").alias("tree"), F.col("leaf.id").alias("leaf"), "rank", "n_turns",
        F.array_join(parts, "").alias("formatted"), begins["spans"].alias("mask"),
    )


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations of single turns (conv_id, turn, role, text) as reply trees
    without branches: every row answers the row before it, by turn, then role,
    then text. Other columns are left out. Rows with a null conv_id are one
    conversation, as in a GROUP BY."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = packed(conversations).select(
        field("conv_id").alias("tree"), field("turn").alias("turn"),
        F.coalesce(field("role"), F.lit("")).alias("role"),
        F.coalesce(field("text"), F.lit("")).alias("text"),
    )
    numbered = rows.withColumn("node", F.row_number().over(order).cast("bigint"))
    return numbered.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    spans = F.transform(
        mask,
        lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
    )
    return F.array_join(spans, "")
