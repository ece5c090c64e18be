"""Chat formatting of reply trees.

A tree is (tree, node, parent) rows. Its root-to-leaf paths come from iterative
self-joins with doubling: in round k every (leaf, node) pair already found is
joined to the ancestor 2**k above the node, so a path of n turns takes log2(n)
rounds and each (leaf, node) pair is made once. Branches are ranked by score
inside their tree and each chosen path becomes one conversation in which a
template marks the turns and control strings inside texts are escaped.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

TURN, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates. None may appear whole inside a text.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in s)


#: A backslash gets another before it; a control string gets one after its first character.
_CONTROL_AT = "|".join(f"(?<={_quoted(x[0])})(?={_quoted(x[1:])})" for x in CONTROL)


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL_AT, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def root_paths(nodes: DataFrame) -> DataFrame:
    """nodes: tree, node, parent (null or unknown: a root). One row (tree, leaf, node, up) per node on each root-to-leaf path; up counts from the leaf.

    Paths that never reach a root (parents in a cycle) are left out.
    """
    keys = nodes.select("tree", "node", "parent")
    known = keys.select("tree", F.col("node").alias("parent"))
    jump = written(keys.filter("parent is not null").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("to")), "chat-jump")
    leaves = keys.join(jump.select("tree", F.col("to").alias("node")).distinct(), ["tree", "node"], "left_anti")
    found = [written(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "chat-found")]
    largest = keys.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    tops = keys.join(jump.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node")
    for k in range(math.ceil(math.log2(largest)) + 1 if largest > 1 else 0):
        if jump.isEmpty():
            break
        so_far = reduce(DataFrame.unionByName, found)
        found.append(written(so_far.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up")), "chat-found"))
        onward = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("further"))
        jump = written(jump.join(onward, ["tree", "to"]).select("tree", "node", F.col("further").alias("to")), "chat-jump")
    paths = reduce(DataFrame.unionByName, found)
    rooted = paths.join(tops, ["tree", "node"]).select("tree", "leaf").distinct()
    return paths.join(rooted, ["tree", "leaf"], "left_semi")


def best_branches(paths: DataFrame, scores: DataFrame, per_tree: int) -> DataFrame:
    """The per_tree best (tree, leaf, branch rank) by mean node score, ties to the smaller leaf."""
    scored = paths.join(scores, ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    return scored.withColumn("branch", rank).filter(F.col("branch") <= per_tree)


def formatted(nodes: DataFrame, per_tree: int = 1, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """nodes: tree, node, parent, role, text, score. One conversation per chosen path:
    tree, leaf, branch, formatted, n_turns and loss_spans (code-point ranges of the text to learn from).

    Null roles and texts count as empty; an empty table gives no rows.
    """
    paths = root_paths(nodes)
    chosen = best_branches(paths, nodes.select("tree", "node", "score"), per_tree).select("tree", "leaf", "branch")
    said = nodes.select("tree", "node", escaped(F.coalesce("text", F.lit(""))).alias("said"), F.coalesce("role", F.lit("")).alias("role"))
    turns = paths.join(chosen, ["tree", "leaf"]).join(said, ["tree", "node"])
    head = F.concat(F.lit(TURN), F.regexp_replace(escaped(F.col("role")), "\n", "\\\\\n"), F.lit("\n"))
    turns = turns.withColumn("head", head).withColumn("turn", F.concat("head", "said", F.lit(END)))
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("start", F.sum(F.length("turn")).over(order) - F.length("turn") + F.length("head"))
    rows = turns.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn", "role", "start", F.length("said").alias("n")))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x.role.isin(*learn_from)), lambda x: F.struct(x.start.cast("long").alias("start"), (x.start + x.n).cast("long").alias("end")))
    return rows.select("tree", "leaf", "branch", F.array_join(F.transform("t", lambda x: x.turn), "").alias("formatted"), F.size("t").cast("long").alias("n_turns"), spans.alias("loss_spans"))


def read_back(text: Column) -> Column:
    """Formatted text to an array of (role, text)."""
    pieces = F.split(text, _quoted(END))
    head = r"(?s)^" + _quoted(TURN) + r"((?:[^\\\n]|\\.)*+)\n(.*)$"
    return F.transform(
        F.filter(pieces, lambda p: p != ""),
        lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_extract(p, head, 2)).alias("text")),
    )


def chains(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: every turn answers the one before (ties by role, then text).

    Rows without a conv_id form one conversation; repeated rows are turns of their own.
    """
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    order = Window.partitionBy("tree").orderBy(F.col("turn"), F.col("role"), F.col("text"))
    rows = conversations.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """Formats all conversations and conversation -1, and returns digests of what is read back from the output.

    chains says what ties, repeated rows and null ids give; null texts and roles are empty, long texts stay whole,
    other columns are ignored; an empty table gives conversation -1 alone.
    """
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], given.schema)
    out = formatted(written(chains(given.unionByName(extra)), "chat-nodes"))
    turns = read_back(F.col("formatted"))
    out = out.withColumn("turns", turns)
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s.start.cast("int") + 1, (s.end - s.start).cast("int")))), "")
    out = out.withColumn("loss", loss)
    return out.select(
        F.when(F.col("tree") != "none", F.col("tree").cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(text: str) -> str:
    """The same escapes by plain replacement: no control string overlaps another."""
    text = f"replace({text}, chr(92), chr(92) || chr(92))"
    for x in CONTROL:
        text = f"replace({text}, '{x}', '{x[0]}' || chr(92) || '{x[1:]}')"
    return text


OP1_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_escaped_sql('text')} AS said, replace({_escaped_sql('role')}, chr(10), chr(92) || chr(10)) AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len("<|im_start|>") + 1 + len("<|im_end|>") + 1} + length(head) + length(said)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
