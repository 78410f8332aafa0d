"""Reply trees to training conversations: enumerate root-to-leaf paths, rank them by score, format each chosen path.

A formatted turn is ``### role:``, the text and ``</turn>`` on lines of their own. Control strings inside texts and roles
are escaped with a backslash, reversibly, so a text can never open or close a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from quillmesh.llm.common import written

OPEN, CLOSE = "###", "</turn>"


def chain(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as trees: each turn replies to the one before it. Equal turns are ordered by role, then text.

    Null turns come first; a null conversation is one of its own; an empty table gives an empty result; other columns are
    ignored.
    """
    col = lambda n: F.col(f"`{n}`")
    nodes = rows.select(col(conv_col).alias("tree_id"), col(turn_col).alias("turn"), col(role_col).alias("role"), col(text_col).alias("text"))
    order = w.Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    nodes = nodes.withColumn("node_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return nodes.select("tree_id", "node_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _at(tree: str, node: str, other_tree: str, other_node: str) -> Column:
    return F.col(tree).eqNullSafe(F.col(other_tree)) & (F.col(node) == F.col(other_node))


def paths(nodes: DataFrame, top_paths: int = 1) -> DataFrame:
    """tree_id, rank, leaf, node_id, up (steps from the leaf): the nodes of the ``top_paths`` best root-to-leaf paths of each tree.

    A path is ranked by the mean score of its nodes; ties go to the longer path, then the smaller leaf. Self-joins double the
    reach of every node's link to an ancestor, with the sum of scores on the way, so a tree of depth d takes log2(d) rounds;
    leaves then add up their path in log2(d) jumps, and only paths that were chosen are enumerated. A path is rows, never one
    long array.

    A node whose parent does not exist is a root; what hangs on a cycle has no root and so no path. Of a node repeated with
    several parents the smallest counts, of several scores the largest, a null score is 0. A null tree_id is a tree of its
    own. An empty table gives no paths.
    """
    links = nodes.groupBy("tree_id", "node_id").agg(F.min("parent_id").alias("parent_id"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    links = written(links, "chat-links")
    known = links.select(F.col("tree_id").alias("t"), F.col("node_id").alias("known"))
    steps = links.join(known, _at("tree_id", "parent_id", "t", "known"), "left_semi")
    steps = steps.select(F.col("tree_id").alias("t"), F.col("node_id").alias("below"), F.col("parent_id").alias("above"), F.col("score").alias("total"))
    most = links.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    jumps, reach = [written(steps, "chat-jumps")], 1
    while 2 * reach < 2 * most:
        on = jumps[-1].select(F.col("t").alias("t2"), F.col("below").alias("middle"), F.col("above").alias("top"), F.col("total").alias("more"))
        further = jumps[-1].join(on, _at("t", "above", "t2", "middle")).select("t", "below", F.col("top").alias("above"), (F.col("total") + F.col("more")).alias("total"))
        further = written(further, "chat-jumps")
        if further.isEmpty():
            break
        jumps.append(further)
        reach *= 2
    parents = jumps[0].select("t", F.col("above").alias("p")).distinct()
    leaves = links.join(parents, _at("tree_id", "node_id", "t", "p"), "left_anti")
    ends = leaves.select("tree_id", F.col("node_id").alias("leaf"), F.col("node_id").alias("at"), F.lit(0.0).alias("sum"), F.lit(1).cast("long").alias("n"))
    for k in range(len(jumps) - 1, -1, -1):  # the longest jumps first, as the digits of the depth
        there = F.col("above").isNotNull()
        ends = ends.join(jumps[k], _at("tree_id", "at", "t", "below"), "left").select(
            "tree_id", "leaf", F.coalesce("above", "at").alias("at"), F.when(there, F.col("sum") + F.col("total")).otherwise(F.col("sum")).alias("sum"),
            F.when(there, F.col("n") + 2**k).otherwise(F.col("n")).alias("n"),
        )
        ends = written(ends, "chat-ends")
    roots = links.join(jumps[0].select("t", "below"), _at("tree_id", "node_id", "t", "below"), "left_anti")
    roots = roots.select(F.col("tree_id").alias("t"), F.col("node_id").alias("root"), F.col("score").alias("last"))
    whole = ends.join(roots, _at("tree_id", "at", "t", "root")).withColumn("mean", (F.col("sum") + F.col("last")) / F.col("n"))
    best = w.Window.partitionBy("tree_id").orderBy(F.desc("mean"), F.desc("n"), "leaf")
    chosen = whole.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_paths)
    found = written(chosen.select("tree_id", "rank", "leaf", F.col("leaf").alias("node_id"), F.lit(0).cast("long").alias("up")), "chat-paths")
    for k, jump in enumerate(jumps):
        further = found.join(jump, _at("tree_id", "node_id", "t", "below")).select("tree_id", "rank", "leaf", F.col("above").alias("node_id"), (F.col("up") + 2**k).alias("up"))
        found = written(found.unionByName(further), "chat-paths")
    return found


def escape(col: Column) -> Column:
    out = F.replace(F.coalesce(col.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in (OPEN, CLOSE):
        out = F.replace(out, F.lit(control), F.lit("".join("\\" + c for c in control)))
    return out


def conversations(nodes: DataFrame, top_paths: int = 1) -> DataFrame:
    """The ``top_paths`` best paths of each tree, formatted: tree_id, rank, n_turns, formatted, loss_spans (code points [start, end) of assistant texts, still escaped).

    Null texts and roles are empty. Of nodes repeated with one id, each is a turn, ordered by role, then text. An empty table
    gives an empty result.
    """
    nodes = nodes.select("tree_id", "node_id", "parent_id", "role", "text", "score")
    steps = paths(nodes, top_paths).select(F.col("tree_id").alias("t"), "rank", F.col("node_id").alias("n"), (-F.col("up")).alias("pos"))
    text, role = escape(F.col("text")), F.replace(F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit("\n"), F.lit("\\\n"))
    head, tail = F.concat(F.lit(OPEN + " "), role, F.lit(":\n")), f"\n{CLOSE}\n"
    turns = steps.join(nodes, _at("tree_id", "node_id", "t", "n")).select(
        "tree_id", "rank", "pos", F.coalesce("role", F.lit("")).alias("role"), F.concat(head, text, F.lit(tail)).alias("turn"),
        F.length(head).cast("long").alias("head"), F.length(text).cast("long").alias("body"),
    )
    before = w.Window.partitionBy("tree_id", "rank").orderBy("pos", "role", "turn").rowsBetween(w.Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("head") + F.col("body") + len(tail)).over(before), F.lit(0)) + F.col("head")
    placed = turns.withColumn("start", start).select("tree_id", "rank", F.struct("start", "role", "body", "turn").alias("s"))
    formed = placed.groupBy("tree_id", "rank").agg(F.array_sort(F.collect_list("s")).alias("s"))
    said = F.filter("s", lambda x: x["role"] == "assistant")
    spans = F.transform(said, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["body"]).alias("end")))
    whole = F.array_join(F.transform("s", lambda x: x["turn"]), "")
    return formed.select("tree_id", "rank", F.size("s").cast("long").alias("n_turns"), whole.alias("formatted"), spans.alias("loss_spans"))


_MARK = re.compile(r"\\.|" + re.escape(CLOSE), re.DOTALL)
_ROLE_END = re.compile(r"\\.|:\n", re.DOTALL)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN + " ", at):
            raise ValueError(f"no turn starts at {at}")
        body = next(m for m in _ROLE_END.finditer(formatted, at + len(OPEN) + 1) if m[0] == ":\n")
        end = next(m for m in _MARK.finditer(formatted, body.end()) if m[0] == CLOSE)
        turns.append((unescape(formatted[at + len(OPEN) + 1 : body.start()]), unescape(formatted[body.end() : end.start() - 1])))
        at = end.end() + 1
    return turns


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for tree, text, spans in zip(pdf["tree_id"], pdf["formatted"], pdf["loss_spans"], strict=True):
            turns = parse(text)
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            rows.append((tree, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formed: DataFrame) -> DataFrame:
    """Digests of what a reader of the formatted output gets, one row for each conversation. A conversation without assistant texts has an empty loss."""
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formed.select("tree_id", "formatted", "loss_spans").mapInPandas(_digests, kind)
