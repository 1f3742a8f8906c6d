"""Chat formatting of reply trees.

A message answers another one, so the messages of a tree form many conversations: one for each path from
the root to a leaf. Paths are found by self-joins on message keys alone, with jumps that double in length
each round; branches are ranked by the mean score of their messages; texts join the chosen paths last.

A turn is written as ``<s>role``, a new line, the text, ``</s>`` and a new line. Where a text holds a control
string, a backslash goes behind its first character; where such backslashes are there already, one more is
added. Reading takes one away again, so every text comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from qscore.operators.skew import first_rows
from qscore.shared import materialize

_OPEN, _CLOSE = "<s>", "</s>\n"
_CONTROL = r"(/?(?:s>|INST\]))"
_TURN = r"(?s)<s>([^\n]*)\n(.*?)</s>\n"
_ROUNDS = 62


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def _write_role(role: Column) -> Column:
    """On one line, and without control strings."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _read_role(role: Column) -> Column:
    marked = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\n"))
    return F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("\\\n"), F.lit("\\"))


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, id, steps) for the ``best`` paths of each tree; steps count back from the leaf.

    ``messages`` has tree (not null), id (unique in the tree), parent and score. A message whose parent
    is null or not there is a root. Paths are ranked by mean score (null counts 0), the smaller leaf first
    where scores are equal. Messages that answer each other in a circle have no root and are on no path.
    """
    nodes = materialize(messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "replies")
    parents = nodes.select("tree", F.col("parent").alias("id")).where("id is not null").distinct()
    jumps = materialize(
        nodes.select("tree", F.col("id").alias("at"), F.col("parent").alias("id"))
        .join(nodes.select("tree", "id"), ["tree", "id"])
        .select("tree", "at", F.col("id").alias("to")),
        "reply-jumps",
    )
    reached = nodes.join(parents, ["tree", "id"], "left_anti")
    reached = materialize(
        reached.select("tree", F.col("id").alias("leaf"), F.col("id").alias("at"), F.lit(0).cast("long").alias("steps")),
        "reply-paths",
    )
    for k in range(_ROUNDS):
        if jumps.isEmpty():
            break
        further = reached.join(jumps, ["tree", "at"]).select(
            "tree", "leaf", F.col("to").alias("at"), (F.col("steps") + (1 << k)).alias("steps")
        )
        reached = materialize(reached.unionByName(further), "reply-paths")
        onward = jumps.select("tree", F.col("at").alias("to"), F.col("to").alias("_to"))
        jumps = materialize(
            jumps.join(onward, ["tree", "to"]).select("tree", "at", F.col("_to").alias("to")), "reply-jumps"
        )
        # A chain that has gone further than there are messages goes in a circle.
        if (1 << k) > nodes.count():
            reached = reached.join(jumps.select("tree", F.col("at").alias("leaf")), ["tree", "leaf"], "left_anti")
            break
    scored = reached.join(nodes.select("tree", F.col("id").alias("at"), "score"), ["tree", "at"])
    ends = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("_score"))
    order = [F.col("_score").desc(), F.col("leaf")]
    chosen = first_rows(ends, ["tree"], order, best, ["leaf"])
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
    chosen = materialize(chosen.select("tree", "leaf", "rank"), "reply-chosen")
    return reached.join(chosen, ["tree", "leaf"]).select("tree", "leaf", "rank", F.col("at").alias("id"), "steps")


def format_trees(messages: DataFrame, best: int = 1, trained: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, rank, formatted, and loss, the spans (start, end) of code points
    of ``formatted`` that hold the texts of the role ``trained``.

    ``messages`` has tree, id, parent, role, text and score (see :func:`paths`); other columns are not looked
    at. A null text or role is empty, a null tree is a tree of its own, an empty table gives no rows. Ids
    must be unique within a tree. A path is one value, as long as its texts together.
    """
    key = F.coalesce(F.concat(F.lit("t"), F.col("tree").cast("string")), F.lit("n"))
    turns = messages.select(
        F.col("tree").alias("_tree"), key.alias("tree"), "id", "parent", "score",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    found = paths(turns, best)
    head = F.concat(F.lit(_OPEN), _write_role(F.col("role")), F.lit("\n"))
    written = (
        turns.drop("parent", "score").join(found, ["tree", "id"])
        .withColumn("_head", head)
        .withColumn("_body", escape(F.col("text")))
        .withColumn("_turn", F.concat("_head", "_body", F.lit(_CLOSE)))
    )
    order = Window.partitionBy("tree", "leaf").orderBy(F.col("steps").desc())
    before = F.coalesce(F.sum(F.length("_turn")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + F.length("_head")
    span = F.struct(start.alias("start"), (start + F.length("_body")).alias("end"))
    written = written.withColumn("_span", F.when(F.col("role") == trained, span))
    turn = F.struct(-F.col("steps"), F.col("_turn"), F.col("_span"))
    return (
        written.select("_tree", "tree", "leaf", "rank", turn.alias("_t"))
        .groupBy("tree", "leaf")
        .agg(F.first("_tree").alias("_tree"), F.first("rank").alias("rank"), F.sort_array(F.collect_list("_t")).alias("_t"))
        .select(
            F.col("_tree").alias("tree"), "leaf", "rank",
            F.array_join(F.col("_t._turn"), "").alias("formatted"),
            F.filter(F.col("_t._span"), lambda s: s.isNotNull()).alias("loss"),
        )
    )


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation, as an array of (role, text)."""
    found = F.arrays_zip(
        F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1)).alias("role"),
        F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2)).alias("text"),
    )
    return F.transform(found, lambda t: F.struct(_read_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def under_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages of trees without branches from (conv_id, turn, role, text): each turn answers the one before.
    Equal and null turns follow each other in a fixed order, null turns first."""
    order = Window.partitionBy("conv_id").orderBy("turn", F.xxhash64("role", "text"))
    number = F.row_number().over(order).cast("long")
    return rows.select(
        F.col("conv_id").alias("tree"), number.alias("id"), "role", "text", F.lit(0.0).alias("score")
    ).withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1))
