"""Chat formatting into a prefix tree. Its units are characters: no tokenizer is part of it.

A conversation is a chain of turns; the name of a turn is a hash of all turns up to it, so that
conversations with equal first turns share those nodes. Each node is emitted once, depth first, with
the place of its characters in the emitted text, the position ids (the place within the conversation)
and the intervals of the emitted text that its ancestors fill, to which its attention is held.

How it stays even: a conversation is streamed turn by turn and never held; nodes are merged by partial
aggregation; the depth-first order is a range sort on a key that grows only where the tree branches;
places are sums over the sorted rows, taken by partition first, so only a number per partition meets.

Template: ``<|role|>text<|end|>`` for a turn. Within roles and texts ``\\``, ``<`` and ``[`` are written
``\\\\``, ``\\l`` and ``\\b``, and ``|`` in a role ``\\p``, so no text can hold a mark of this template or of another that starts with
``<`` or ``[``; the way back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, salted, spread

#: The role whose texts the loss covers.
LEARNED = "assistant"
_BACK = {"\\\\": "\\", "\\l": "<", "\\b": "[", "\\p": "|"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lbp]", lambda m: _BACK[m[0]], text)


def format_turn(role: str, text: str) -> str:
    return f"<|{escape(role).replace('|', '\\p')}|>{escape(text)}<|end|>"


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of one emitted turn."""
    # A role's own "|" is escaped, so the first mark ends the role.
    body = segment[2 : -len("<|end|>")]
    at = body.index("|>")
    return unescape(body[:at]), unescape(body[at + 2 :])


def _turns(table: DataFrame) -> DataFrame:
    """conversation rows with null roles and texts as empty ones."""
    return table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _by_conversation(frame: DataFrame, *order: str) -> DataFrame:
    return frame.repartition("conv_id").sortWithinPartitions("conv_id", *order)


NODE_TURNS = "conv_id long, depth int, node binary, parent binary, start long, length long, segment string"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names the turns of each conversation; the rows come sorted by conversation and turn."""
    first, conv, depth, at, node = True, None, 0, 0, b""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if first or conv_id != conv:
                first, conv, depth, at, node = False, conv_id, 0, 0, b""
            segment = format_turn(role, text)
            parent, node = node, hashlib.sha256(node + segment.encode()).digest()[:16]
            for column, value in zip(out, (conv_id, depth, node, parent, at, len(segment), segment), strict=True):
                column.append(value)
            depth, at = depth + 1, at + len(segment)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "node", "parent", "start", "length", "segment"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The depth-first key of the nodes that a conversation owns; rows sorted by conversation and depth.

    Along a conversation the number of conversations through a node never grows, and the tree can branch only
    where it falls. So the key is the names of the nodes where it falls; the depth orders the rest.
    """
    first, conv, key, last = True, None, b"", -1
    for batch in batches:
        keys, owned = [], []
        for conv_id, node, n, owner in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "node", "n", "owner")), strict=True):
            if first or conv_id != conv:
                first, conv, key, last = False, conv_id, b"", -1
            if n != last:
                key, last = key + node, n
            owned.append(owner == conv_id)
            keys.append(key)
        own = pa.array(owned, pa.bool_())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "depth", "start", "length", "n")), pa.array(keys, pa.binary())], ["node", "depth", "start", "length", "n", "key"]).filter(own)


def _met(turns: DataFrame, nodes: DataFrame, hot: DataFrame) -> DataFrame:
    """Turns with their nodes; the turns of a node that many conversations share are dealt over salts."""
    return salted(turns, ["node"], hot, "conv_id").drop("hot").join(spread(nodes, ["node"], hot), ["node", "salt"]).drop("salt")


def prefix_tree(table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The turns (``NODE_TURNS`` without the segment), the nodes, of which each is emitted once, and the hot nodes.

    nodes: node, depth, start (position id of its first character), length, n (conversations through it) and
    place (of its first character in the emitted text, depth first). Turns that share a conversation and a turn
    number are ordered by role and text.
    """
    turns = cut(_by_conversation(_turns(table), "turn", "role", "text").mapInArrow(_chain, NODE_TURNS))
    # A null conversation id is a conversation of its own; -2**63 stands for it as an owner.
    named = turns.withColumn("conv_id", F.coalesce("conv_id", F.lit(-(2**63))))
    shared = named.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner"))
    hot = hot_keys(turns, ["node"])
    counted = _met(named.select("conv_id", "depth", "node", "start", "length"), shared, hot)
    keyed = _by_conversation(counted, "depth").mapInArrow(_keys, "node binary, depth int, start long, length long, n long, key binary")
    ordered = cut(keyed.repartitionByRange("key", "depth").sortWithinPartitions("key", "depth"))
    sums = dict(ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("length").alias("n")).collect())  # a number per partition
    bases, total = {}, 0
    for part in sorted(sums):
        bases[part], total = total, total + sums[part]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = bases.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            ends = pc.add(pc.cumulative_sum(batch.column("length")), at)
            yield batch.append_column("place", pc.subtract(ends, batch.column("length")))
            at = ends[-1].as_py() if batch.num_rows else at

    nodes = ordered.mapInArrow(placed, "node binary, depth int, start long, length long, n long, key binary, place long").drop("key")
    segments = turns.groupBy("node").agg(F.min("segment").alias("segment"))
    return turns.drop("segment"), nodes.join(segments, "node"), hot


def _masked(nodes: DataFrame) -> DataFrame:
    """Adds loss: begin and end of the learned characters within the segment, or null."""
    begin = F.instr("segment", "|>") + 1
    learned = F.struct(begin.alias("begin"), (F.length("segment") - len("<|end|>")).alias("end"))
    return nodes.withColumn("loss", F.when(F.col("segment").startswith(f"<|{LEARNED}|>"), learned))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, shared_chars long, intervals array<struct<begin:long,end:long>>"
_INTERVALS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads each conversation back from the emitted nodes; rows sorted by conversation and depth."""
    state: dict | None = None

    def done() -> pa.RecordBatch:
        row = [state["conv"], state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["shared"], [{"begin": a, "end": b} for a, b in state["intervals"]]]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), _INTERVALS)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])

    for batch in batches:
        ready = []
        for conv_id, start, segment, n, place, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "start", "segment", "n", "place", "loss")), strict=True):
            if state is None or conv_id != state["conv"]:
                if state:
                    ready.append(done())
                state = {"conv": conv_id, "turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "shared": 0, "intervals": []}
            if start != state["chars"]:
                raise ValueError("a position id is out of order")
            role, text = read_turn(segment)
            state["turns"] += 1
            state["all"].update(f"{role}\n{text}\n".encode())
            if mask is not None:
                learned = unescape(segment[mask["begin"] : mask["end"]])
                state["loss_chars"] += len(learned)
                state["loss"].update(learned.encode())
            state["chars"] += len(segment)
            state["shared"] += len(segment) if n > 1 else 0
            if state["intervals"] and state["intervals"][-1][1] == place:  # follows its parent at once
                state["intervals"][-1][1] = place + len(segment)
            else:
                state["intervals"].append([place, place + len(segment)])
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
    if state:
        yield done()


def format_chats(table: DataFrame) -> DataFrame:
    """One row per conversation, read back from the tree: its turns and digests, formatted_chars, shared_chars and
    ``intervals``: where its turns lie in the emitted text, which is what its last turn may attend to.

    Null roles and texts count as empty; rows with a null conversation id form one conversation; null turn numbers
    come first, and rows that repeat a turn number are ordered by role and text. An empty table gives no rows;
    other columns are not read.
    """
    turns, nodes, hot = prefix_tree(table)
    full = _met(turns.select("conv_id", "depth", "node", "start"), _masked(nodes).select("node", "n", "place", "segment", "loss"), hot)
    return _by_conversation(full, "depth").mapInArrow(_read, READ)


def emitted(table: DataFrame) -> DataFrame:
    """The tree itself, one row per node: place, start, length, segment, loss (begin and end of the learned
    characters within the segment, or null) and ancestors (the intervals of the emitted text before the node)."""
    turns, nodes, hot = prefix_tree(table)
    full = _met(turns.select("conv_id", "depth", "node"), nodes.select("node", "place", "length"), hot)

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, conv, spans = True, None, []
        for batch in batches:
            found = []
            for conv_id, place, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "length")), strict=True):
                if first or conv_id != conv:
                    first, conv, spans = False, conv_id, []
                found.append([{"begin": a, "end": b} for a, b in spans])
                if spans and spans[-1][1] == place:
                    spans[-1][1] = place + length
                else:
                    spans.append([place, place + length])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, _INTERVALS)], ["node", "ancestors"])

    ancestors = _by_conversation(full, "depth").mapInArrow(above, "node binary, ancestors array<struct<begin:long,end:long>>").groupBy("node").agg(F.min("ancestors").alias("ancestors"))
    return _masked(nodes).join(ancestors, "node").select("place", "depth", "start", "length", "n", "segment", "loss", "ancestors")
