"""Reply trees formatted as conversations, with DataFrame functions alone.

Messages form trees by parent pointers. Root-to-leaf paths are found by iterated self-joins on
message ids with pointer doubling: after step k every node knows its ancestor 2^k levels up, and
each leaf's known path is extended by a join with those pointers, so a chain of n messages takes
log2(n) joins. Messages are unique keys in all those joins, so a tree of any size is spread over
all tasks. Branches are ranked by score and chosen paths are joined into one text each.

Template, per turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Inside a text every
``<\\...\\|`` gets one more backslash, so ``<|`` never occurs there and unescaping takes one away;
inside a role a newline is written ``<n>``, and ``<\\...\\n>`` gets one more backslash first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(escape(role), r"<(\\*)n>", r"<\\$1n>"), F.lit("\n"), F.lit("<n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(F.replace(role, F.lit("<n>"), F.lit("\n")), r"<\\(\\*)n>", r"<$1n>"))


def chains(messages: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row replies to the one before it.

    Rows are ordered by turn, then role, then text, nulls first, so ties and repeated rows have a
    defined order and all are kept. Null conv_id is one conversation of its own. Other columns are ignored.
    """
    rows = messages.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    node = lambda n: F.struct(F.col("conv_id").alias("tree"), n.alias("n"))
    return rows.withColumn("place", place.cast("long")).select(
        F.col("conv_id").alias("tree_id"), node(F.col("place")).alias("node_id"), F.when(F.col("place") > 1, node(F.col("place") - 1)).alias("parent_id"), "role", "text", F.lit(0.0).alias("score")
    )


def paths(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """(leaf, node_id, up) for each root-to-leaf path: the nodes of the leaf's path and their distance from it.

    tree: node_id (unique, not null), parent_id. A parent that is null or not there makes a root. Nodes
    on a cycle, or below one, have no root-to-leaf path and are left out.
    """
    nodes = tree.select("node_id", "parent_id")
    known = nodes.select(F.col("node_id").alias("p"))
    up = scratch.save("jump", nodes.join(known, F.col("parent_id") == F.col("p"), "left").select("node_id", F.col("p").alias("to"), F.lit(1).cast("long").alias("up")))
    leaf = nodes.join(nodes.select(F.col("parent_id").alias("node_id")), "node_id", "left_anti")
    found = scratch.save("paths", leaf.select(F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("up")))
    step, total = 1, tree.count()
    # ``up`` holds pointers over exactly ``step`` levels; ``found`` all path nodes nearer than ``step``.
    up = up.filter(F.col("to").isNotNull())
    while step <= total and up.limit(1).count():
        far = found.join(up.select("node_id", "to"), "node_id").select("leaf", F.col("to").alias("node_id"), (F.col("up") + step).alias("up"))
        found = scratch.save("paths", found.unionByName(far))
        b = up.select(F.col("node_id").alias("to"), F.col("to").alias("next"))
        up = scratch.save("jump", up.join(b, "to").select("node_id", F.col("next").alias("to"), (F.lit(step) * 2).cast("long").alias("up")))
        step *= 2
    return found


def format_trees(tree: DataFrame, keep: int | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen root-to-leaf path: tree_id, leaf, score, rank, n_turns, formatted, loss (boolean per turn), sizes.

    tree: tree_id, node_id (any type that joins, unique), parent_id, role, text, score (optional). A path's
    score is the sum of its nodes' scores (null: 0); paths of a tree are ranked by score, highest first, then
    by leaf; ``keep`` takes the best so many, None all. Null role or text: empty. The mask covers the bodies
    of turns whose role is in ``loss_roles``; ``sizes`` gives each turn's code points (all, head, body), from
    which ``loss_spans`` makes ranges of ``formatted``.
    Empty table: no rows.
    """
    spark = tree.sparkSession
    scratch = Scratch(spark)
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in tree.columns else F.lit(0.0)
    link = scratch.save("links", tree.select("tree_id", "node_id", "parent_id", score.alias("score")))
    found = paths(link, scratch)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = tree.select("node_id", F.col("tree_id"), score.alias("score"), F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"), escape(text).alias("body"), role.isin(*loss_roles).alias("loss"))
    root = found.join(link.select("node_id", "parent_id"), "node_id").join(link.select(F.col("node_id").alias("parent_id"), F.lit(1).alias("one")), "parent_id", "left")
    whole = root.filter(F.col("one").isNull()).select("leaf")
    turns = found.join(whole, "leaf", "left_semi").join(body, "node_id")
    one = turns.groupBy("leaf").agg(
        F.first("tree_id").alias("tree_id"), F.sum("score").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("k"), "head", "body", "loss"))).alias("turns")
    )
    if keep is not None:
        rank = F.row_number().over(W.partitionBy("tree_id").orderBy(F.col("score").desc(), F.col("leaf")))
        one = one.withColumn("rank", rank).filter(F.col("rank") <= keep)
    else:
        one = one.withColumn("rank", F.lit(None).cast("int"))
    sizes = F.transform("turns", lambda x: F.struct((F.length(x["head"]) + F.length(x["body"]) + len(END)).cast("long").alias("all"), F.length(x["head"]).cast("long").alias("head"), F.length(x["body"]).cast("long").alias("body"), x["loss"].alias("loss")))
    return one.select(
        "tree_id", "leaf", "score", "rank", F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"])), END), F.lit(END)).alias("formatted"),
        F.transform("turns", lambda x: x["loss"]).alias("loss"), sizes.alias("sizes"),
    )


def loss_spans(formatted: DataFrame) -> DataFrame:
    """One row per loss-bearing turn: leaf, lo, hi, code points of ``formatted``."""
    rows = formatted.select("leaf", F.posexplode("sizes").alias("k", "s"))
    before = F.coalesce(F.sum("s.all").over(W.partitionBy("leaf").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.select("leaf", (before + F.col("s.head")).alias("lo"), (before + F.col("s.head") + F.col("s.body")).alias("hi"), F.col("s.loss").alias("loss")).filter("loss").drop("loss")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: array of struct(role, text)."""
    blocks = F.split(F.substring(formatted, F.lit(1), F.length(formatted) - len(END)), r"<\|im_end\|>\n", -1)
    body = lambda x: F.substring(x, F.lit(len(START) + 1), F.length(x))
    role = lambda x: F.substring_index(x, "\n", 1)
    return F.transform(F.transform(blocks, body), lambda x: F.struct(unescape_role(role(x)).alias("role"), unescape(F.substring(x, F.length(role(x)) + 2, F.length(x))).alias("text")))
