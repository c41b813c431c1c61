"""Chat formatting of reply trees, in DataFrame operations only.

Messages form trees by parent links. Iterative self-joins double the reach of every node's
pointer, so a thread of n turns needs about log2(n) rounds; branches are ranked by the summed
score of their messages and each chosen root-to-leaf path becomes one conversation.

Template, per turn: ``<s>`` role ``[INST]`` text ``[/INST]</s>``. In roles and texts a
backslash is doubled and each control string gets one backslash after its first character, so
no control string survives inside them and the escaping can be undone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize

#: The control strings of the template.
TURN_OPEN, BODY_OPEN, BODY_CLOSE, TURN_CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (TURN_OPEN, TURN_CLOSE, BODY_OPEN, BODY_CLOSE)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROLS, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _same(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda x, y: x & y, (left[a].eqNullSafe(right[b]) for a, b in pairs))


def unique_nodes(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each (tree, node): the least of those that repeat it, by ``columns`` in order,
    nulls first. Rows without a node go."""
    least = F.min(F.struct(*columns)).alias("_row")
    return nodes.filter("node is not null").groupBy("tree", "node").agg(least).select("tree", "node", *(F.col(f"_row.{c}").alias(c) for c in columns))


def root_paths(nodes: DataFrame, max_branches: int | None = None) -> DataFrame:
    """All chosen root-to-leaf paths of the trees in ``nodes`` (tree, node, parent, score).

    Returns (tree, leaf, node, pos, branch_rank, branch_score), pos counting from the root.
    A parent that is null or absent makes a root. Branches rank by the sum of their scores
    (a null score counts 0), ties to the smaller leaf; ``max_branches`` keeps the best per
    tree. Of rows that repeat (tree, node), the one with the least (parent, score) counts; rows without
    a node are left out, as are nodes on or below a cycle of replies, which belong to no
    root-to-leaf path. Other columns are ignored; an empty table gives an empty result.
    """
    nodes = unique_nodes(nodes, ["parent", "score"])
    parents = nodes.select(F.col("tree").alias("pt"), F.col("node").alias("pn"))
    joined = nodes.join(parents, _same(nodes, parents, ("tree", "pt"), ("parent", "pn")), "left")
    state = materialize(
        joined.select("tree", "node", F.when(nodes["parent"].isNotNull(), F.col("pn")).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("length")),
        "chat-up",
    )
    first, levels = state, []
    most = state.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    # Round r holds the pointers over 2**r steps; more than log2(nodes) rounds only a cycle needs.
    for _ in range(max(1, int(most).bit_length())):
        open_rows = state.filter("up is not null")
        if open_rows.isEmpty():
            break
        levels.append(open_rows.select(F.col("tree").alias("lt"), F.col("node").alias("ln"), F.col("up").alias("lu")))
        far = state.select(F.col("tree").alias("ft"), F.col("node").alias("fn"), F.col("up").alias("fu"), F.col("total").alias("fx"), F.col("length").alias("fl"))
        stepped = open_rows.join(far, _same(open_rows, far, ("tree", "ft"), ("up", "fn"))).select("tree", "node", F.col("fu").alias("up"), (F.col("total") + F.col("fx")).alias("total"), (F.col("length") + F.col("fl")).alias("length"))
        state = materialize(state.filter("up is null").unionByName(stepped), "chat-up")

    inner = first.filter("up is not null").select(F.col("tree").alias("it"), F.col("up").alias("iu")).distinct()
    done = state.filter("up is null")
    leaves = done.join(inner, _same(done, inner, ("tree", "it"), ("node", "iu")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("total").desc(), F.col("node")))
    chosen = leaves.withColumn("branch_rank", rank)
    if max_branches is not None:
        chosen = chosen.filter(F.col("branch_rank") <= max_branches)
    found = [materialize(chosen.select("tree", F.col("node").alias("leaf"), "node", (F.col("length") - 1).alias("pos"), "branch_rank", F.col("total").alias("branch_score")), "chat-path")]
    for r, level in enumerate(levels):
        # What is known reaches 2**r nodes up from the leaf; this adds the next 2**r.
        paths = reduce(DataFrame.unionByName, found)
        above = paths.join(level, _same(paths, level, ("tree", "lt"), ("node", "ln")))
        found.append(materialize(above.select("tree", "leaf", F.col("lu").alias("node"), (F.col("pos") - (1 << r)).alias("pos"), "branch_rank", "branch_score"), "chat-path"))
    return reduce(DataFrame.unionByName, found)


def format_reply_trees(messages: DataFrame, max_branches: int | None = None, trained_role: str = "assistant") -> DataFrame:
    """Format every chosen branch of every reply tree as one conversation.

    ``messages`` has (tree, node, parent, score, role, text), as ``root_paths`` takes them.
    Returns (tree, leaf, branch_rank, branch_score, n_turns, formatted, loss_spans): the
    spans are [start, end) in code points of ``formatted`` and cover exactly the escaped texts
    of ``trained_role``. A null role or text is empty; extra columns are ignored; rows that repeat
    (tree, node) count once, as in ``root_paths``; an empty table gives an empty result.
    """
    messages = materialize(unique_nodes(messages, ["parent", "score", "role", "text"]), "chat-messages")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    paths = root_paths(messages.select("tree", "node", "parent", "score"), max_branches)
    said = messages.select(F.col("tree").alias("mt"), F.col("node").alias("mn"), blank("role").alias("role"), blank("text").alias("text"))
    turns = paths.join(said, _same(paths, said, ("tree", "mt"), ("node", "mn"))).select(
        "tree", "leaf", "pos", "branch_rank", "branch_score",
        F.concat(F.lit(TURN_OPEN), escape(F.col("role")), F.lit(BODY_OPEN)).alias("head"), escape(F.col("text")).alias("body"),
        (F.col("role") == trained_role).alias("trained"),
    )
    tail = BODY_CLOSE + TURN_CLOSE
    turn = F.concat("head", "body", F.lit(tail))
    before = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length(turn).cast("long")).over(before), F.lit(0).cast("long")) + F.char_length("head")
    placed = turns.select("*", start.alias("start"))
    span = F.struct(F.col("start").alias("start"), (F.col("start") + F.char_length("body")).alias("end"))
    gathered = placed.groupBy("tree", "leaf").agg(
        F.first("branch_rank").alias("branch_rank"), F.first("branch_score").alias("branch_score"), F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("pos", turn.alias("turn")))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("trained"), span))).alias("loss_spans"),
    )
    return gathered.select("tree", "leaf", "branch_rank", "branch_score", "n_turns", F.array_join("turns.turn", "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, TURN_CLOSE), lambda x: x != "")

    def one(piece: Column) -> Column:
        inside = F.substr(piece, F.lit(len(TURN_OPEN) + 1))
        role = F.substring_index(inside, BODY_OPEN, 1)
        text = F.substring_index(F.substring_index(inside, BODY_OPEN, -1), BODY_CLOSE, 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, one)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between the spans."""
    parts = F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(parts, "")


def linear_messages(turns: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as reply trees of one branch each: every
    turn answers the one before it. Rows of one conversation order by turn, then role and
    text, so repeated turn numbers keep all their rows."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text").select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )
