"""Reply trees to conversations: paths by iterative self-joins, ranked, formatted under a loss mask.

Everything is DataFrame and SQL functions. A message knows its parent; each round of the self-join
doubles the distance that a message sees towards its root, adding up the scores on the way, so that
a tree of depth d takes log2(d) rounds of rows of fixed size. Leaves are ranked within their tree by
the mean score of their path. Only the chosen leaves are then walked back to their roots, over the
tables of the same rounds from the longest jump to the shortest, which names each message of a path
once: the work is that of the paths that are returned, not of all pairs of a tree.

Template. A turn is BEGIN, its role, a line feed, its text and END. Texts and roles may hold any
string: a backslash is put after the first character of each control string in them, however many
backslashes are there already, and taken out again on reading.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unimass.session import materialize

# The marks of this template, and the control strings of common ones.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]",
            "<<SYS>>", "<</SYS>>")


def _alternatives(form: str) -> str:
    """One alternative for each first character (H) of control strings, with what may follow it (T)."""
    tails = {h: "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == h) for h in sorted({c[0] for c in CONTROLS})}
    return "|".join(form.replace("H", re.escape(h)).replace("T", t) for h, t in tails.items())


MASKED = _alternatives(r"(?:H)(?=\\*(?:T))")
MARKED = _alternatives(r"(?<=H)\\(?=\\*(?:T))")


def escape(text):
    """The text without any control string; `unescape` takes it back."""
    return F.regexp_replace(text, F.lit(MASKED), F.lit(r"$0\\"))


def unescape(text):
    return F.regexp_replace(text, F.lit(MARKED), F.lit(""))


def escape_role(role):
    """A role on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role):
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def chains(turns: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages (tree, id, parent, role, text, score) of linear conversations: each answers the one before.

    Rows of the same turn follow each other by role and text, nulls first; none is dropped. Null
    ids make a conversation of their own.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(order, "role", "text")).cast("long")
    named = turns.select(F.col(tree).alias("tree"), F.col(order).alias(order), text("role").alias("role"),
                         text("text").alias("text"))
    return named.withColumn("id", place).select(
        "tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text",
        F.lit(None).cast("double").alias("score"))


def numbered(messages: DataFrame) -> DataFrame:
    """Messages, written once, with a node number each; see `best_paths` for odd rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    score = F.col("score").cast("double")
    finite = F.when(~F.isnan(score) & (F.abs(score) < float("inf")), score)
    rows = messages.select("tree", "id", "parent", text("role"), text("text"),
                           F.coalesce(finite, F.lit(0.0)).alias("score"))
    return materialize(rows.withColumn("node", F.monotonically_increasing_id()), "messages")


def jumps(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (node, up, total, steps) with `up` 2^k messages above, for k = 0, 1 and so on; and whole paths.

    total and steps are the scores and the number of the messages from the node to the last one
    before up. A node that reaches its root leaves the rounds and is in the second result with the
    sums of its whole path; a round joins only the nodes that are still on their way.
    """
    first = rows.groupBy("tree", "id").agg(F.min("node").alias("up")).where("id is not null")
    below = rows.select("node", F.col("tree").alias("own"), "parent", "score")
    state = materialize(below.join(
        first, F.col("own").eqNullSafe(F.col("tree")) & (F.col("parent") == F.col("id")), "left").select(
        "node", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")), "jump")
    tables, done, before = [], None, None
    while True:
        arrived = state.where("up is null")
        done = arrived if done is None else done.union(arrived)
        state = state.where("up is not null")
        moving = state.count()
        if moving == 0 or moving == before:  # unchanged: only cycles are left
            return tables, done.select("node", "total", "steps")
        tables.append(state)
        before = moving
        above = done.union(state).select(F.col("node").alias("up"), F.col("up").alias("farther"),
                                         F.col("total").alias("more"), F.col("steps").alias("further"))
        state = materialize(state.join(above, "up").select(
            "node", F.col("farther").alias("up"), (F.col("total") + F.col("more")).alias("total"),
            (F.col("steps") + F.col("further")).alias("steps")), "jump")


def best_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(path, rank, path_score, place, tree, role, text): the messages of the best root-to-leaf paths.

    Of each tree the `best` leaves of the highest mean score along their path are taken, ties to the
    leaf of the smaller id and then to the row first read; rank counts from 1, place from 0 at the
    root. A message whose parent is null or missing is a root. Repeated rows of an id are messages
    of their own, and their answers belong to the first one. A null id has no answers, null trees
    are one tree, a missing or non-finite score counts as 0, null roles and texts are empty.
    Messages on or behind a cycle reach no root and are on no path. Other columns are ignored.
    """
    rows = numbered(messages)
    tables, whole = jumps(rows)
    leaves = whole if not tables else whole.join(
        tables[0].select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    leaves = leaves.select("node", (F.col("total") / F.col("steps")).alias("path_score"), "steps")
    ranked = leaves.join(rows.select("node", "tree", "id"), "node")
    place = F.row_number().over(Window.partitionBy("tree").orderBy(
        F.desc("path_score"), F.asc_nulls_last("id"), "node"))
    chosen = ranked.withColumn("rank", place).where(F.col("rank") <= best)
    steps = materialize(chosen.select(F.col("node").alias("path"), "node", "rank", "path_score",
                                      (F.col("steps") - 1).alias("place")), "path")
    for k in range(len(tables) - 1, -1, -1):
        found = steps.join(tables[k].select("node", "up"), "node").select(
            "path", F.col("up").alias("node"), "rank", "path_score", (F.col("place") - (1 << k)).alias("place"))
        steps = materialize(steps.union(found), "path")
    return steps.join(rows.select("node", "tree", "role", "text"), "node").drop("node")


def formatted(paths: DataFrame, learned: str = "assistant") -> DataFrame:
    """(path, tree, rank, path_score, formatted, loss): one conversation for each path.

    `loss` has one entry for each turn: the span (first, end) of its text in `formatted`, in code
    points with the end left out, if the role is the learned one, or else null. A conversation is
    one row and has to fit in it.
    """
    head = F.concat(F.lit(BEGIN), escape_role("role"), F.lit("\n"))
    cut = paths.select("path", "tree", "rank", "path_score", "place", (F.col("role") == learned).alias("mask"),
                       head.alias("head"), escape("text").alias("body"))
    size = lambda c: F.length(c).cast("long")
    whole = size("head") + size("body") + len(END)
    before = F.sum(whole).over(Window.partitionBy("path").orderBy("place")) - whole
    first = before + size("head")
    span = F.when(F.col("mask"), F.struct(first.alias("first"), (first + size("body")).alias("end")))
    turns = cut.select("path", "tree", "rank", "path_score", F.struct(
        "place", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span")).alias("turn"))
    return turns.groupBy("path").agg(
        F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.first("path_score").alias("path_score"),
        F.array_sort(F.collect_list("turn")).alias("turns")).select(
        "path", "tree", "rank", "path_score",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["span"]).alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """(path, place, role, text, learned) and other columns: the turns, from `formatted` and `loss` alone.

    `learned` is the unescaped text under the loss mask, null where nothing of the turn is.
    """
    beside = [c for c in conversations.columns if c not in ("formatted", "loss")]
    parts = F.split("formatted", re.escape(END))
    each = conversations.select(*beside, F.posexplode(F.arrays_zip(
        F.slice(parts, F.lit(1), F.size(parts) - 1).alias("part"), F.col("loss"))).alias("place", "turn"))
    each = each.select(*beside, "place", F.col("turn.part").alias("part"), F.col("turn.loss").alias("span"))
    whole = F.length("part").cast("long") + len(END)
    first = F.sum(whole).over(Window.partitionBy("path").orderBy("place")) - whole
    line = F.instr("part", "\n")
    cut = lambda at, n: F.substring(F.col("part"), at.cast("int"), n.cast("int"))
    return each.withColumn("first", first).select(
        *beside, "place",
        unescape_role(cut(F.lit(len(BEGIN) + 1), line - len(BEGIN) - 1)).alias("role"),
        unescape(cut(line + 1, F.length("part"))).alias("text"),
        unescape(cut(F.col("span.first") - F.col("first") + 1,
                     F.col("span.end") - F.col("span.first"))).alias("learned"))


def digests(conversations: DataFrame) -> DataFrame:
    """(path, tree, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back."""
    sized = conversations.select("path", "tree", "rank", "formatted", "loss",
                                 F.length("formatted").cast("long").alias("formatted_chars"))
    turn = F.struct("place", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("text"), "learned")
    found = read_back(sized).groupBy("path").agg(
        F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.count("*").alias("n_turns"),
        F.first("formatted_chars").alias("formatted_chars"), F.array_sort(F.collect_list(turn)).alias("turns"))
    joined = lambda c: F.array_join(F.transform("turns", lambda t: t[c]), "")
    return found.select(
        "path", "tree", "rank", "n_turns", F.sha2(joined("text"), 256).alias("turns_sha256"),
        F.length(joined("learned")).cast("long").alias("loss_chars"),
        F.sha2(joined("learned"), 256).alias("loss_sha256"), "formatted_chars")
