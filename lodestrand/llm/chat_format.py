"""Chat formatting over reply trees, with built-in functions only.

Messages name their parent. Iterative self-joins by pointer doubling (log2 of the deepest path) give each message its
depth and the score of its path from the root. A conversation's branches, one for each leaf, are ranked by mean score;
the chosen ones are walked back up by the same doubled pointers, so only chosen paths are ever laid out. Texts stay
out of the iterations and join at the end.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Control strings inside a text get a backslash after
their first character (one more, if some are there already), which unescape() takes off again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize, numbered

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What follows the first character, < or [, of a control string: fixed values.
_REST = r"(/?s>|/?INST\]|</?SYS>>|\|im_(?:start|end)\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def as_chain(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it (by turn, then role and text).

    Null turns come first; a null conv_id is a conversation of its own; null roles and texts are empty. Repeated rows are
    turns of their own. conv_id may have any type that can be compared, a struct too.
    """
    clean = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    clean = numbered(clean, "node", "messages")
    before = F.lag("node").over(W.partitionBy("conv_id").orderBy("turn", "role", "text", "node"))
    return clean.select("conv_id", "node", before.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _tree(messages: DataFrame) -> DataFrame:
    """messages -> id, conv_id, node, up (the parent's id, if it is there), score; one row a message, without texts.

    A conversation's node that stands in several rows is one message: the row that is smallest by parent, score, role and
    text, as far as messages has these. Nodes of other conversations, and rows without a node, are other messages.
    """
    rows = numbered(messages, "id", "messages")
    known = rows.where("node is not null")
    if known.groupBy("conv_id", "node").count().where("count > 1").isEmpty():
        return rows
    by = [F.asc_nulls_last(c) for c in ("parent", "score", "role", "text") if c in messages.columns]
    once = known.withColumn("copy", F.row_number().over(W.partitionBy("conv_id", "node").orderBy(*by, "id"))).where("copy = 1").drop("copy")
    return materialize(rows.where("node is null").unionByName(once), "messages")


def _linked(rows: DataFrame) -> DataFrame:
    above = rows.where("node is not null").select(F.col("conv_id").alias("conv"), F.col("node").alias("parent_node"), F.col("id").alias("up"))
    met = rows.join(above, rows["conv_id"].eqNullSafe(above["conv"]) & (rows["parent"] == above["parent_node"]), "left")
    return met.select("id", "conv_id", "node", "up", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))


def _paths(nodes: DataFrame, branches: int) -> DataFrame:
    """nodes (id, conv_id, node, up, score) -> conv_id, branch, leaf, path_score, id, pos."""
    now = nodes.select("id", "up", F.col("score").alias("total"), F.lit(1).alias("len"))
    n, jumps = nodes.count(), []
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        if now.where("up is not null").isEmpty():
            break
        jumps.append(now.where("up is not null").select("id", "up"))
        # Paths that have reached their root stay as they are; only the others take another jump.
        above = now.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("len").alias("len2"))
        jumped = now.where("up is not null").join(above, "up").select("id", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("len") + F.col("len2")).alias("len"))
        now = materialize(now.where("up is null").unionByName(jumped), "tree")
    parents = nodes.where("up is not null").select(F.col("up").alias("id"))
    leaves = now.where("up is null").join(parents, "id", "left_anti").join(nodes.select("id", "conv_id", F.col("node").alias("leaf")), "id")
    leaves = leaves.withColumn("path_score", F.col("total") / F.col("len"))
    best = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("path_score"), F.desc("len"), "leaf", "id"))
    chosen = leaves.withColumn("branch", best).where(F.col("branch") <= branches)
    path = materialize(chosen.select("conv_id", "branch", "leaf", "path_score", "id", (F.col("len") - 1).alias("pos")), "paths")
    for k in reversed(range(len(jumps))):
        up = path.join(jumps[k], "id").select("conv_id", "branch", "leaf", "path_score", F.col("up").alias("id"), (F.col("pos") - 2**k).alias("pos"))
        path = materialize(path.unionByName(up), "paths")
    return path


def choose_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """messages (conv_id, node, parent, score) -> conv_id, branch (1 is the best), leaf, path_score, node, pos.

    Branches rank by their mean score, then length, then the smaller leaf. A parent that isn't in the conversation makes
    a root. A message whose ancestors form a circle belongs to no path. Repeated messages count once, and conversations
    may use the same nodes: see _tree. Null scores are 0; an empty table gives no rows; other columns are not returned.
    """
    nodes = materialize(_linked(_tree(messages)), "tree")
    return _paths(nodes, branches).join(nodes.select("id", "node"), "id").select("conv_id", "branch", "leaf", "path_score", "node", "pos")


def format_conversations(messages: DataFrame, branches: int = 1, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages (conv_id, node, parent, role, text, score) -> one row per chosen path.

    conv_id, branch, path_score, n_turns, formatted, loss_spans: (start, length) in UTF-8 bytes of formatted, from 0,
    of each text to learn from, in order. Empty texts have spans of length 0; null roles and texts are empty. Trees,
    repeated messages and ties: see choose_paths. Texts of any length are kept whole; a path is one row, so it must fit
    in a task. An empty table gives no rows, and other columns are not read.
    """
    messages = _tree(messages.select("conv_id", "node", "parent", "role", "text", "score"))
    path = _paths(materialize(_linked(messages.drop("role", "text")), "tree"), branches)
    turns = path.join(messages.select("id", escape_role(F.coalesce("role", F.lit(""))).alias("r"), escape(F.coalesce("text", F.lit(""))).alias("t"), F.coalesce("role", F.lit("")).isin(*learn_from).alias("learn")), "id")
    turns = turns.withColumn("piece", F.concat(F.lit(OPEN), "r", F.lit("\n"), "t", F.lit(CLOSE)))
    by = ["conv_id", "branch"]
    before = F.coalesce(F.sum(F.octet_length("piece").cast("long")).over(W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = before + F.octet_length("r") + len(OPEN) + 1
    turns = turns.withColumn("span", F.when(F.col("learn"), F.struct(start.alias("start"), F.octet_length("t").cast("long").alias("length"))))
    whole = turns.groupBy(*by).agg(F.first("path_score").alias("path_score"), F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "piece", "span"))).alias("all"))
    return whole.select("conv_id", "branch", "path_score", "n_turns", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"), F.filter(F.transform("all", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"), F.lit(1))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(piece, F.length(role) + 2)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted.cast("binary"), (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
