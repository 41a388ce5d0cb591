"""Chat formatting of reply trees, by DataFrame functions alone.

Iterative self-joins double the distance to an ancestor in each round, so a path of n messages takes log2(n) joins; the
rounds carry ids, depths and scores only. Branches of a tree are ranked by the sum of their messages' scores, and each
chosen root-to-leaf path becomes one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts the opening of a control string
is broken up by an escape character, which is itself escaped; ordinary texts stay as they are and every text can be had
back. The loss mask is the list of code-point ranges of the assistant's texts in the formatted string.

Null roles and texts are empty. A message whose parent is absent is a root. Messages whose chain of parents never ends
(a cycle) lie on no root-to-leaf path. Rows that repeat (tree, id) are distinct messages only if their ids differ; of
repeated ids, the row that sorts first is used. Null tree ids form one tree. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textquarry.llm.common import stash

#: Fixed values of the template.
START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "␛"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit("<|"), F.lit(f"<{ESCAPE}p"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "p"), F.lit("|")), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(ESCAPE + "n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(ESCAPE + "n"), F.lit("\n")))


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """messages(tree, id, parent, score) -> (tree, leaf, branch_rank, branch_score, id, depth) of the chosen paths."""
    nodes = messages.groupBy("tree", "id").agg(F.min(F.struct("parent", "score")).alias("m")).select("tree", "id", "m.parent", F.coalesce("m.score", F.lit(0.0)).cast("double").alias("score"))
    nodes = stash(nodes, "chat-nodes")  # every join below is between tables of the messages' size: merged, never broadcast
    keys = nodes.select(F.col("tree").alias("t"), F.col("id").alias("i"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    step = nodes.join(keys.hint("merge"), same("tree", "t") & (F.col("parent") == F.col("i")), "left").select("tree", "id", F.col("i").alias("up"), "score", F.lit(1).cast("long").alias("depth"))
    # rounds[k]: the nodes that had an ancestor at distance 2^(k-1), with the one at 2^k, or null where the root is nearer
    rounds = [stash(step, "chat-round")]
    ended = rounds[0].where("up is null")
    n = nodes.count()
    while rounds[-1].where("up is not null").limit(1).count() and 1 << (len(rounds) - 1) <= n:
        live = rounds[-1].where("up is not null")
        over = ended.unionByName(live).select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("depth").alias("d2"))
        step = live.join(over.hint("merge"), same("tree", "t") & (F.col("up") == F.col("i"))).select("tree", "id", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("depth") + F.col("d2")).alias("depth"))
        rounds.append(stash(step, "chat-round"))
        ended = ended.unionByName(rounds[-1].where("up is null"))
    whole = ended  # what still has an ancestor now is on a cycle
    parents = rounds[0].where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("i"))
    leaves = whole.join(parents, same("tree", "t") & (F.col("id") == F.col("i")), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "id"))
    chosen = leaves.withColumn("branch_rank", rank).where(F.col("branch_rank") <= best)
    walk = chosen.select("tree", F.col("id").alias("leaf"), "branch_rank", F.col("score").alias("branch_score"), "id", "depth")
    for k in reversed(range(len(rounds) - 1)):
        hop = rounds[k].where("up is not null").select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        both = walk.join(hop.hint("merge"), same("tree", "t") & (F.col("id") == F.col("i")), "left")
        each = F.array(F.struct(F.col("id").alias("id"), F.col("depth").alias("depth")), F.struct(F.col("up").alias("id"), (F.col("depth") - (1 << k)).alias("depth")))
        walk = both.select("tree", "leaf", "branch_rank", "branch_score", F.explode(each).alias("n")).where("n.id is not null").select("tree", "leaf", "branch_rank", "branch_score", "n.id", "n.depth")
    return walk


def format_paths(messages: DataFrame, chosen: DataFrame, learned: str = LEARNED) -> DataFrame:
    """One row for each path: tree, leaf, branch_rank, branch_score, n_turns, formatted, loss_spans(start, stop)."""
    texts = messages.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = chosen.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")))
    # of rows that repeat an id the first counts; told here, where they lie side by side in any case
    order = W.partitionBy("tree", "leaf").orderBy("depth", "role", "text")
    rows = rows.withColumn("again", F.coalesce(F.lag("depth").over(order) == F.col("depth"), F.lit(False))).where(~F.col("again"))
    rows = rows.select("tree", "leaf", "branch_rank", "branch_score", "depth", (F.col("role") == learned).alias("learned"), F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    order = W.partitionBy("tree", "leaf").orderBy("depth")
    begin = F.sum(F.length("piece")).over(order) - F.length("piece") + F.length("head")
    rows = rows.withColumn("start", begin).withColumn("stop", F.col("start") + F.length("body"))
    turns = rows.groupBy("tree", "leaf").agg(F.min("branch_rank").alias("branch_rank"), F.min("branch_score").alias("branch_score"), F.array_sort(F.collect_list(F.struct("depth", "piece", "learned", "start", "stop"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    return turns.select("tree", "leaf", "branch_rank", "branch_score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """messages(tree, id, parent, score, role, text), formatted; ``best`` branches of each tree."""
    return format_paths(messages, paths(messages.select("tree", "id", "parent", F.col("score").cast("double").alias("score")), best))


def as_tree(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees in which each turn replies to the one before."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("id"), "role", "text")
    return rows.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda x: F.struct(
        unescaped_role(F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescaped(F.substr(x, F.locate("\n", x) + 1)).alias("text"),
    ))


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted strings and their loss masks."""
    loss = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    df = formatted.select(F.col("tree").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(loss, "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
