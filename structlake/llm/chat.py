r"""Chat formatting over reply trees.

Messages point to the message they answer. Iterative self-joins by pointer doubling
give every message the summed score and the length of its path to the root: after
round k it knows its 2^k-th ancestor, so a chain of n messages takes log2(n) rounds of
one row a message. Leaves are ranked by these sums within their tree. Only the chosen
leaves are then expanded to their paths, by the same jumps; each becomes one
conversation.

A turn is ``### role: text </turn>`` and a line feed. Inside roles and texts a
backslash goes before every backslash, every ``#`` and ``</turn>`` (and before
``:`` in roles), so control strings never occur there unescaped, and dropping
the backslashes gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

OPEN, CLOSE = "### ", " </turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(\\|#|</turn>)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(F.coalesce(role, F.lit("")), r"(\\|#|:|</turn>)", r"\\$1")


def unique_messages(messages: DataFrame, tree_col: str, id_col: str) -> DataFrame:
    """Of the rows that repeat a tree's message id the least one, column by column; null ids go."""
    rest = [c for c in messages.columns if c not in (tree_col, id_col)]
    one = messages.filter(F.col(id_col).isNotNull()).groupBy(tree_col, id_col).agg(F.min(F.struct(*rest)).alias("_row") if rest else F.count("*").alias("_row"))
    return one.select(*(F.col(c) if c in (tree_col, id_col) else F.col(f"_row.{c}").alias(c) for c in messages.columns))


def reply_paths(messages: DataFrame, tree_col: str, id_col: str, parent_col: str, score_col: str | None = None, branches: int = 1, unique: bool = False) -> DataFrame:
    """tree, leaf, node, depth (0 at the root), rank: nodes of the chosen paths.

    A message without a parent, or whose parent is absent, is a root. Of a tree's
    paths the ``branches`` with the highest summed score stay, ties by the
    smallest leaf (null scores count as 0). Messages in a cycle have no root and
    are left out, and rows with a null id. Of rows that repeat a tree's id only one counts
    (``unique_messages``); ``unique`` says that there are none.
    """
    messages = messages if unique else unique_messages(messages, tree_col, id_col)
    nodes = messages.filter(F.col(id_col).isNotNull()).select(F.col(tree_col).alias("tree"), F.col(id_col).alias("node"), F.col(parent_col).alias("up"), F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)).alias("score") if score_col else F.lit(0.0).alias("score"))
    present = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    size = nodes.groupBy("tree").agg(F.count("*").alias("size")).select(F.col("tree").alias("_t"), "size")
    linked = nodes.join(present, same("tree", "_t") & (F.col("up") == F.col("_n")), "left").select("tree", "node", F.col("_n").alias("up"), "score")
    # score and length of the path up to, and without, the ancestor ``up``
    nodes = written(linked.join(size, same("tree", "_t")).select("tree", "node", "up", "score", F.lit(1).cast("long").alias("length"), "size"), "messages")
    parents = nodes.filter("up is not null").select(F.col("tree").alias("_t"), F.col("up").alias("_n")).distinct()
    step, jumps, summed = 1, [], nodes
    while True:
        # a path is shorter than its tree, so a cycle ends the search too
        open_ = summed.filter((F.col("up").isNotNull()) & (F.col("size") > step))
        if open_.isEmpty():
            break
        jumps.append(open_.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_u")))
        far = summed.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("score").alias("_s"), F.col("length").alias("_k"))
        longer = open_.join(far, same("tree", "_t") & (F.col("up") == F.col("_n"))).select("tree", "node", F.col("_u").alias("up"), (F.col("score") + F.col("_s")).alias("score"), (F.col("length") + F.col("_k")).alias("length"), "size")
        summed = written(summed.filter((F.col("up").isNull()) | (F.col("size") <= step)).unionByName(longer), "reply-sums")
        step *= 2
    leaves = summed.filter("up is null").join(parents, same("tree", "_t") & (F.col("node") == F.col("_n")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.asc("node"))
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    paths = written(chosen.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"), "length", "rank"), "reply-leaves")
    for k, jump in enumerate(jumps):
        more = paths.filter(F.col("length") - F.col("back") > 1 << k).join(jump, same("tree", "_t") & (F.col("node") == F.col("_n")))
        paths = written(paths.unionByName(more.select("tree", "leaf", F.col("_u").alias("node"), (F.col("back") + (1 << k)).alias("back"), "length", "rank")), "reply-paths")
    return paths.select("tree", "leaf", "node", (F.col("length") - 1 - F.col("back")).alias("depth"), "rank")


def format_paths(turns: DataFrame, keys: list[str], depth_col: str, role_col: str, text_col: str) -> DataFrame:
    """keys, formatted, loss_spans: a conversation per path.

    loss_spans are (start, end) in code points of the assistants' escaped texts. A
    conversation is one row, so it has to fit a task.
    """
    piece = F.concat(F.lit(OPEN), escape_role(F.col(role_col)), F.lit(": "), escape(F.col(text_col)), F.lit(CLOSE))
    row = F.struct(F.col(depth_col).alias("d"), piece.alias("p"), (F.length(escape_role(F.col(role_col))) + len(OPEN) + 2).alias("from"), F.length(piece).alias("n"), (F.col(role_col) == LOSS_ROLE).alias("loss"))
    ordered = turns.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    walked = F.aggregate(
        "_all",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["n"]).alias("at"),
            F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["from"]).alias("start"), (acc["at"] + x["n"] - len(CLOSE)).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return ordered.select(*keys, F.array_join(F.transform("_all", lambda x: x["p"]), "").alias("formatted"), walked["spans"].alias("loss_spans"))


def chat_conversations(messages: DataFrame, tree_col: str = "conv_id", id_col: str = "message", parent_col: str = "parent", role_col: str = "role", text_col: str = "text", score_col: str | None = None, branches: int = 1) -> DataFrame:
    """tree, leaf, rank, formatted, loss_spans: chosen paths as conversations.

    Null roles and texts count as ''. Other columns are ignored. A repeated id gives one
    turn, whatever its rows say (``unique_messages``).
    """
    used = dict.fromkeys([tree_col, id_col, parent_col, role_col, text_col, *([score_col] if score_col else [])])
    messages = written(unique_messages(messages.select(*used), tree_col, id_col), "unique-messages")
    paths = reply_paths(messages, tree_col, id_col, parent_col, score_col, branches, unique=True)
    said = messages.select(F.col(tree_col).alias("_t"), F.col(id_col).alias("_n"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"))
    turns = paths.join(said, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    return format_paths(turns, ["tree", "leaf", "rank"], "depth", "_role", "_text").withColumnRenamed("tree", tree_col)


def read_turns(formatted: Column) -> Column:
    """array of (role, text): the turns of a formatted conversation."""
    body = r"(?s)### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n"
    roles, texts = F.regexp_extract_all(formatted, F.lit(body), 1), F.regexp_extract_all(formatted, F.lit(body), 2)
    # the blank before the closing mark belongs to the mark
    return F.transform(F.arrays_zip(roles.alias("r"), texts.alias("t")), lambda x: F.struct(unescape(x["r"]).alias("role"), unescape(F.substring(x["t"], F.lit(1), F.length(x["t"]) - 1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def chain_messages(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations as trees: each row answers the one before it (parent, message).

    Rows go by turn (null first), ties by role and text, so every row is kept. Columns
    other than the four are left out, so none can clash with the two new ones.
    """
    order = Window.partitionBy(conv_col).orderBy(F.asc_nulls_first(turn_col), role_col, text_col)
    return rows.select(conv_col, turn_col, role_col, text_col).withColumn("message", F.row_number().over(order)).withColumn("parent", F.when(F.col("message") > 1, F.col("message") - 1))
