"""Chat formatting: reply trees to conversations, in DataFrame functions alone.

Messages name their parents. Iterative self-joins follow these: after round k every message knows its ancestor 2**k
steps up and every leaf its path of 2**(k+1) messages, so a path of any depth takes a logarithm of rounds. Branches are
ranked by the scores on their paths, and each chosen path becomes one conversation.

Format of a turn: ``### role``, a line break, the text, a line break, ``</turn>`` and a line break. In a text,
``###`` and ``</turn>`` get a backslash before the backslashes before them, and lose it when read. So in a
text no ``</turn>`` follows a line break, and every real one does. In a role, ``%`` and line breaks are
written as ``%25`` and ``%0A``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

END = "\n</turn>\n"


def escape_text(c: Column) -> Column:
    # Only the first of a run of backslashes begins a match, and a run is never tried in part: long runs take linear time.
    return F.regexp_replace(c, r"(?<!\\)(\\*+)(###|</turn>)", r"\\$1$2")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!\\)\\(\\*+)(###|</turn>)", "$1$2")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def threads(turns: DataFrame, tree_column: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """Rows of linear conversations as reply trees (tree_id, msg_id, parent_id, role, text, score): each row answers the row
    before it, by turn and then role and text, so equal turns have a fixed order and repeated rows stay apart."""
    own = turns.select(F.col(tree_column).cast("long").alias("tree_id"), F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    place = F.row_number().over(Window.partitionBy("tree_id").orderBy(*order)).cast("long")
    return own.withColumn("msg_id", place).select("tree_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, msg_id, height): every message on the way from a leaf up to its root, the leaf at height 0."""
    nodes = messages.select("tree_id", "msg_id", "parent_id")
    ids = nodes.select("tree_id", "msg_id").distinct()
    up = nodes.where("parent_id is not null and parent_id <> msg_id").select("tree_id", "msg_id", F.col("parent_id").alias("up"))
    known = ids.select("tree_id", F.col("msg_id").alias("up"))
    on = lambda a, b, x, y: a["tree_id"].eqNullSafe(b["tree_id"]) & (a[x] == b[y])
    parents = up.join(known, on(up, known, "up", "up"), "left_semi")  # a parent that is not there: the message is a root
    step = cut(parents.distinct(), "chat-parents")
    inner = step.select("tree_id", F.col("up").alias("msg_id")).distinct()
    leaves = ids.join(inner, on(ids, inner, "msg_id", "msg_id"), "left_anti")
    found = leaves.select("tree_id", F.col("msg_id").alias("leaf_id"), "msg_id", F.lit(0).cast("long").alias("height"))
    reach, most = 1, ids.count()
    while reach <= most and not step.isEmpty():  # a way longer than all messages would run in a circle
        further = found.alias("p").join(step.alias("s"), F.col("p.tree_id").eqNullSafe(F.col("s.tree_id")) & (F.col("p.msg_id") == F.col("s.msg_id")))
        found = cut(found.union(further.select("p.tree_id", "p.leaf_id", F.col("s.up").alias("msg_id"), F.col("p.height") + reach)), "chat-paths")
        a, b = step.alias("a"), step.alias("b")
        step = cut(a.join(b, F.col("a.tree_id").eqNullSafe(F.col("b.tree_id")) & (F.col("a.up") == F.col("b.msg_id"))).select("a.tree_id", "a.msg_id", F.col("b.up").alias("up")), "chat-steps")
        reach *= 2
    return found


def _chosen(on_path: DataFrame, messages: DataFrame, best: int | None, score) -> DataFrame:
    """on_path's rows of the chosen branches, with branch_rank and branch_score. Only ids and scores are moved: no text is copied for a branch that is
    not chosen."""
    scored = messages.select(F.col("tree_id").alias("t_"), F.col("msg_id").alias("m_"), F.coalesce("score", F.lit(0.0)).alias("score"))
    branches = on_path.join(scored, on_path["tree_id"].eqNullSafe(scored["t_"]) & (on_path["msg_id"] == scored["m_"])).groupBy("tree_id", "leaf_id").agg(score("score").alias("branch_score"))
    ranked = branches.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.col("branch_score").desc(), "leaf_id")))
    if best is not None:
        ranked = ranked.where(F.col("branch_rank") <= best)
    ranked = ranked.select(F.col("tree_id").alias("t_"), F.col("leaf_id").alias("l_"), "branch_rank", "branch_score")
    return on_path.join(ranked, on_path["tree_id"].eqNullSafe(ranked["t_"]) & (on_path["leaf_id"] == ranked["l_"])).drop("t_", "l_")


def format_branches(messages: DataFrame, best: int | None = 1, score=F.sum) -> DataFrame:
    """One row per chosen branch: tree_id, leaf_id, branch_rank, branch_score, formatted, loss_spans.

    messages: tree_id, msg_id (unique in its tree), parent_id (null, absent or itself: a root), role, text, score. Branches of a tree are ranked by
    score of their messages' scores (null: 0), highest first, ties by smaller leaf_id; best None keeps all. Null texts and
    roles are empty. loss_spans are the (start, end) code points of the assistant's texts in formatted. Messages
    in a circle have no leaf and are in no branch. An empty table gives no rows. Other columns are not read.
    """
    on_path = _chosen(paths(messages), messages, best, score)
    body = messages.select(F.col("tree_id").alias("t_"), F.col("msg_id").alias("m_"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = on_path.join(body, on_path["tree_id"].eqNullSafe(body["t_"]) & (on_path["msg_id"] == body["m_"])).drop("t_", "m_")
    head = F.concat(F.lit("### "), escape_role(F.col("role")), F.lit("\n"))
    pieces = whole.select("tree_id", "leaf_id", "branch_rank", "branch_score", "height", (F.col("role") == "assistant").alias("loss"), head.alias("head"), escape_text(F.col("text")).alias("body"))
    branch = Window.partitionBy("tree_id", "leaf_id").orderBy(F.col("height").desc())
    size = F.length("head") + F.length("body") + len(END)
    placed = pieces.withColumn("start", F.coalesce(F.sum(size).over(branch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    span = F.when(F.col("loss"), F.struct(F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("end")))
    turn = F.struct((-F.col("height")).alias("k"), F.concat("head", "body", F.lit(END)).alias("turn"))
    rows = placed.groupBy("tree_id", "leaf_id", "branch_rank", "branch_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return rows.select("tree_id", "leaf_id", "branch_rank", "branch_score", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss_spans")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.split(formatted, END)
    at = lambda x: F.instr(x, "\n")
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda x: F.struct(unescape_role(F.substring(x, F.lit(5), at(x) - 5)).alias("role"), unescape_text(F.substring(x, at(x) + 1, F.length(x))).alias("text")),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(branches: DataFrame) -> DataFrame:
    """What formatted conversations say when read back: sizes and hashes of turns and of the text under the loss mask."""
    read = branches.select(F.col("tree_id").alias("conv_id"), "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
