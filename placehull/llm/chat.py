"""Chat formatting of reply trees.

Messages form trees by parent. Iterative self-joins by doubling (a message's ancestor 1, 2, 4, ... steps above) find each
leaf's depth, root and branch score (the sum of its messages' scores); branches are ranked inside their tree,
and the chosen root-to-leaf paths are enumerated from the same ancestors, so the number of joins grows with the logarithm of
the depth. Each chosen path is formatted as one conversation with loss spans over assistant texts.

Template: ``<|im_start|>role LF text<|im_end|> LF`` per turn. Inside roles and texts a backslash is doubled and
control strings are broken by ``\\.`` after their first character, line feeds of roles are ``\\,``; reading back undoes it.

A path is one output row, so its messages meet in one row; nothing else is gathered per tree.
Nulls and ties: a null tree is a tree of its own; a row without a message id is no message; null texts and roles count as empty; messages whose parent is null or missing from the tree are roots; a message of a parent cycle has
no root and belongs to no path; equal scores rank by leaf id. Rows with one (tree, message) id are one message: the
least (role, text) is used. An empty table gives no conversations. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placehull.llm.base import table
from placehull.session import stage

#: Strings that chat templates use as controls.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<pad>", "<unk>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    text = _CONTROL.sub(lambda m: f"{m[0][0]}\0{m[0][1:]}", text.replace("\\", "\\\\").replace("\0", "\\0"))
    return text.replace("\0", "\\.")


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: {".": "", ",": "\n", "0": "\0"}.get(m[1], m[1]), text)


def best_paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, score, pos, node) of chosen branches from (tree, node, parent, score); pos 0 is the root.

    ``keep``: branches per tree, best score first; all by default.
    """
    return _paths(_keyed(messages), keep).withColumn("tree", F.col("tree.tree"))


def _keyed(messages: DataFrame) -> DataFrame:
    """The tree as a struct: joins then match a null tree with itself."""
    return messages.filter("node is not null").withColumn("tree", F.struct("tree"))


def _paths(messages: DataFrame, keep: int | None) -> DataFrame:
    """``best_paths`` over keyed trees. Each round of either loop is written, so plans do not grow with the depth."""
    nodes = messages.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    nodes = stage(nodes, "nodes")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    linked = nodes.join(known, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("p")), "left")
    # up: the ancestor 2 ** k steps above, null past the root; sum: scores of the messages passed, own included
    first = linked.select("tree", "node", F.col("p").alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("depth"))
    first = stage(first, "steps")
    # Only messages that have not met their root go on to the next round, so rounds shrink as conversations end.
    done, steps = first.filter("up is null"), [first.filter("up is not null")]
    open_before, still = None, steps[0].count()
    while still and still != open_before:  # a round that closes none has met nothing but cycles
        here = steps[-1]
        above = here.unionByName(done).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("sum").alias("s2"), F.col("depth").alias("d2"))
        both = here.join(above, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n")))
        both = both.select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("s2")).alias("sum"), (F.col("depth") + F.col("d2")).alias("depth"))
        both = stage(both, "steps")
        done = done.unionByName(both.filter("up is null"))
        steps.append(both.filter("up is not null"))
        open_before, still = still, steps[-1].count()
    parents = linked.filter("p is not null").select("tree", F.col("p").alias("node")).distinct()
    leaves = done.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), F.col("sum").alias("score"), "depth")
    if keep is not None:
        order = W.partitionBy("tree").orderBy(F.desc("score"), "leaf")
        leaves = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep).drop("rank")
    paths = leaves.select("tree", "leaf", "score", "depth", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    for k in range(len(steps) - 1, -1, -1):
        jump = steps[k].select("tree", "node", "up")
        higher = paths.join(jump, ["tree", "node"]).filter("up is not null")
        higher = higher.select("tree", "leaf", "score", "depth", F.col("up").alias("node"), (F.col("above") + 2**k).alias("above"))
        paths = stage(paths.unionByName(higher), "paths")
    return paths.select("tree", "leaf", "score", (F.col("depth") - 1 - F.col("above")).alias("pos"), "node")


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = [], []
        for turns in batch.column("turns").to_pylist():
            out, at, marked = [], 0, []
            for turn in turns:
                role, text = turn["role"] or "", turn["text"] or ""
                head, body = f"{OPEN}{escape(role).replace(chr(10), chr(92) + ',')}\n", escape(text)
                if role == "assistant":
                    marked.append({"start": at + len(head), "stop": at + len(head) + len(body)})
                out += [head, body, CLOSE]
                at += len(head) + len(body) + len(CLOSE)
            texts.append("".join(out))
            spans.append(marked)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        rest = [batch.column(c) for c in ("tree", "leaf", "score")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array(spans, kind)], names=["tree", "leaf", "score", "formatted", "loss_spans"])


def format_trees(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, score, formatted, loss_spans) per chosen path, from (tree, node, parent, role, text, score).

    loss_spans are [start, stop) in code points of ``formatted``, over the escaped assistant texts.
    """
    tree, leaf = (messages.schema[c].dataType.simpleString() for c in ("tree", "node"))
    messages = _keyed(messages)
    paths = _paths(messages, keep)
    said = messages.groupBy("tree", "node").agg(F.min(F.struct("role", "text")).alias("said"))
    turns = paths.join(said, ["tree", "node"]).select("tree", "leaf", "score", F.struct("pos", "said.role", "said.text").alias("turn"))
    turns = turns.groupBy("tree", "leaf").agg(F.first("score").alias("score"), F.sort_array(F.collect_list("turn")).alias("turns"))
    return turns.withColumn("tree", F.col("tree.tree")).mapInArrow(
        _formatted, f"tree {tree}, leaf {leaf}, score double, formatted string, loss_spans array<struct<start: bigint, stop: bigint>>"
    )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[] for _ in range(6)]
        for tree, text, spans in zip(batch.column("tree").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
            turns = [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]
            loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            for column, value in zip(out, (tree, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                column.append(value)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of loss text, parsed from the formatted conversations."""
    return formatted.mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations as trees of one branch: each row's parent is the row before it by (turn, role, text)."""
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    w = W.partitionBy("conv_id").orderBy(*order)
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(w).cast("long").alias("node"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_trees(chains(rows)))


ORACLE = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped as (
  select *, regexp_replace(replace(text, '\', '\\'), '(<)(\|)|(\|)(>)|(<)(s>|/s>|pad>|unk>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\5\7\\.\2\4\6\8', 'g') as body
  from rows
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(12 + length(role) + 1 + length(body) + 11)::bigint as formatted_chars
from escaped group by conv_id
"""
