"""Chat formatting of reply trees: paths by iterative self-joins, ranking, one conversation for each path."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.llm.common import stored

START, STOP = "<|im_start|>", "<|im_end|>"
#: Control strings of this and of other common templates; no text shows one unescaped in the output.
CONTROL = r"<(\\*)(\|im_start\|>|\|im_end\|>|/?s>)"
INST = r"\[(\\*)(/?INST\])"
_TURN = re.compile(r"<\|im_start\|>((?:(?!<\|im_end\|>).)*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: Column) -> Column:
    """Puts one backslash into every control string, after its first character; backslashes already there stay."""
    out = F.regexp_replace(text, CONTROL, r"<\\$1$2")
    return F.regexp_replace(out, INST, r"[\\$1$2")


def unescape(text: str) -> str:
    """The inverse of ``escape``: takes one backslash out of every escaped control string."""
    out = re.sub(r"<\\(\\*)(\|im_start\|>|\|im_end\|>|/?s>)", r"<\1\2", text)
    return re.sub(r"\[\\(\\*)(/?INST\])", r"[\1\2", out)


def escape_role(role: Column) -> Column:
    """``escape``, with line breaks and backslashes of the role spelled out, as a role ends at its line's end."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    """The inverse of ``escape_role``."""
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def linear_tree(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> ``(conv_id, node, parent, role, text, score)``: each row replies to the one before.

    Rows of a conversation stand by turn (null turns first); rows with the same turn stand by role and text, and
    all of them are kept. Rows without conv_id are one conversation. A null text or role is empty. ``node`` is the row's place,
    ``parent`` the place before (null for the first). No rows give no rows.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score"),
    )


#: What stands for conv_id where rows are matched, as null equals nothing there.
KEY = ["conv", "unnamed"]


def tree_nodes(tree: DataFrame) -> DataFrame:
    """``tree(conv_id, node, parent, role, text, score)`` -> KEY and ``(node, parent, role, text, score)``, each node once, stored.

    A node that comes more than once is its first row by parent, score, role and text (nulls before others). A null score is 0. Rows
    without a node are left out, as nothing can reply to them or end in them.
    """
    rows = tree.where("node is not null").select(F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv"), F.col("conv_id").isNull().alias("unnamed"), "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    first = rows.groupBy(*KEY, "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("r"))
    return stored(first.select(*KEY, "node", "r.*"), "tree")


def _max_doublings(nodes: DataFrame) -> int:
    return max(1, (nodes.groupBy(*KEY).count().agg(F.max("count")).first()[0] or 1).bit_length())


def chosen_paths(nodes: DataFrame, *, top: int = 1) -> DataFrame:
    """``tree_nodes`` rows -> KEY and ``(path, leaf, depth, node)`` of the ``top`` best paths.

    Depths and summed scores from the root come from self-joins that double the distance to the
    ancestor each time, so a reply chain of n turns takes log2(n) joins. Leaves are ranked by the mean
    score on their path (more turns, then the smaller leaf break ties); the chosen leaves then
    gather their ancestors over the same doubled pointers. ``path`` counts from 1.
    A parent that isn't in the conversation is as none: the node is a root. Nodes on or below a
    cycle reach no root and are on no path.
    """
    known = nodes.select(*KEY, F.col("node").alias("parent"), F.lit(True).alias("there"))
    base = nodes.select(*KEY, "node", "parent", "score").join(known, [*KEY, "parent"], "left")
    base = stored(base.select(*KEY, "node", F.when(F.col("there"), F.col("parent")).alias("parent"), "score"), "replies")
    jumps, settled = [], None
    state = base.select(*KEY, "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), "score")
    for _ in range(_max_doublings(base)):
        climbing = state.where("up is not null")
        if climbing.isEmpty():
            break
        jumps.append(climbing.select(*KEY, "node", "up"))
        rooted = state.where("up is null")
        settled = rooted if settled is None else settled.unionByName(rooted)
        above = settled.unionByName(climbing).select(*KEY, F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("score").alias("s2"))
        joined = climbing.join(above, [*KEY, "up"])  # nodes that know their root take no further part
        state = stored(joined.select(*KEY, "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("score") + F.col("s2")).alias("score")), "pointers")
    rooted = state.where("up is null")
    state = rooted if settled is None else settled.unionByName(rooted)
    leaves = state.join(base.select(*KEY, F.col("parent").alias("node")), [*KEY, "node"], "left_anti")
    rank = Window.partitionBy(*KEY).orderBy((F.col("score") / F.col("depth")).desc(), F.col("depth").desc(), "node")
    best = leaves.withColumn("path", F.row_number().over(rank)).where(F.col("path") <= top)
    found = best.select(*KEY, "path", F.col("node").alias("leaf"), "node")
    for jump in jumps:
        above = found.join(jump, [*KEY, "node"]).select(*KEY, "path", "leaf", F.col("up").alias("node"))
        found = stored(found.unionByName(above), "paths")  # each round reads the one before twice: unstored, the plan would double
    return found.join(state.select(*KEY, "node", "depth"), [*KEY, "node"])


def format_paths(tree: DataFrame, *, top: int = 1, loss_role: str = "assistant") -> DataFrame:
    """``tree(conv_id, node, parent, role, text, score)`` -> ``(conv_id, path, n_turns, formatted, loss)``.

    ``formatted`` marks each turn of the path as ``<|im_start|>role\\ntext<|im_end|>\\n`` with control strings
    inside roles and texts escaped; ``loss`` lists the (start, length) code-point spans of the escaped ``loss_role``
    texts. A formatted conversation is one value, so its turns meet in one row, and nothing larger does. Rows without conv_id
    are a conversation like others, and come out with a null conv_id. Other columns are not looked at. No rows give no rows.
    """
    nodes = tree_nodes(tree)
    paths = chosen_paths(nodes, top=top)
    texts = nodes.select(*KEY, "node", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    turns = paths.join(texts, [*KEY, "node"])
    whole = turns.groupBy(*KEY, "path").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    one = F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(f"{STOP}\n")))
    sizes = F.transform("turns", lambda t: F.struct((F.length(t["role"]) + len(START) + 1).alias("head"), F.length(t["text"]).alias("n"), (t["role"] == loss_role).alias("loss")))
    spans = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, s: F.struct((acc["at"] + s["head"] + s["n"] + len(STOP) + 1).alias("at"), F.when(s["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + s["head"]).alias("start"), s["n"].alias("length"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"],
    )
    return whole.select(F.when(~F.col("unnamed"), F.col("conv")).alias("conv_id"), "path", F.size("turns").cast("long").alias("n_turns"), F.array_join(one, "").alias("formatted"), spans.alias("loss"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation, unescaped."""
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def digests(formatted: DataFrame) -> DataFrame:
    """Reads ``format_paths`` output back: what its turns and its loss mask hold, as counts and SHA-256 digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                said = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: ``digests(format_paths(linear_tree(...)))`` of the registered query in DuckDB's SQL: a chain has one path, its rows in order.
ORACLE = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(replace(replace(role, chr(92), '__'), chr(10), '__')) + length(text)
         + len(regexp_extract_all(role || ' ' || text, '<(\\*)(\|im_start\|>|\|im_end\|>|/?s>)')) + len(regexp_extract_all(role || ' ' || text, '\[(\\*)(/?INST\])')) AS n
  FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + 24)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
