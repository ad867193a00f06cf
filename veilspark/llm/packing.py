"""Best-fit packing by exact complements, planned on the histogram of lengths.

Pieces of one length are alike, so the plan works on counts: at most ``capacity`` different lengths,
whatever the corpus holds. Single, pair and triple sums of the lengths are indexed by their sum. For each
length, longest first, the index is asked for combinations that fill the gap exactly, and each is consumed
as often as the availability counts allow; what no exact combination fills goes through best-fit decreasing
on counts. Exact triples and pairs can use up small pieces that large ones need later, so the plan is made
with combinations of up to three, two and one, and the one with the fewest sequences holds. With singles
alone it is as good as best-fit decreasing, so it never needs more sequences than that.

Pieces then take their places by their rank within their length. A task numbers its own pieces of each
length; where a task's numbers begin is a running sum over tasks, taken and joined back in Spark, so the
driver and the broadcast plan hold a number per length and never one per task or piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .bpe import TextEncoder
from .common import cut, sliced, text_bytes

CAPACITY = 2048
END_ID = 0
#: Bytes of text that a task encodes at once.
BLOCK_BYTES = 2 << 20
#: Where a piece stands for the plan: its task, and its rank among the task's pieces of its length.
RANKED = [StructField("__part", IntegerType()), StructField("__rank", LongType())]


class Step(NamedTuple):
    """``times`` sequences that each hold pieces of these lengths."""

    lengths: tuple[int, ...]
    times: int


class Sums:
    """Sums of one, two and three lengths below ``capacity``, each with its combinations, under availability counts.

    A pair is listed under its sum by one member, a triple by one member and the sum of the other two; the most even
    combination comes first, as uneven ones use up small pieces. A combination that has run out never comes
    back, so each list is read from where its first ones have run out.
    """

    def __init__(self, count: np.ndarray) -> None:
        self.count = count.tolist()
        capacity = len(count) - 1
        there = np.flatnonzero(count)
        i, j = np.tril_indices(len(there))
        self.pairs = _Index(there[i], there[i] + there[j], capacity)
        sums = np.unique((there[i] + there[j])[there[i] + there[j] < capacity])
        member, total = np.repeat(there, len(sums)), (there[:, None] + sums).ravel()
        largest = 3 * member >= total  # a triple is listed under a member of at least a third, so each is found
        self.triples = _Index(member[largest], total[largest], capacity)

    def single(self, gap: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        return (gap,) if self.count[gap] > used.count(gap) else None

    def pair(self, gap: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        count, index, first = self.count, self.pairs, True
        for at in range(index.at[gap], index.end[gap]):
            a = index.member[at]
            b = gap - a
            if not count[a] or not count[b] or (a == b and count[a] < 2):
                if first:
                    index.at[gap] = at + 1
                continue
            first = False
            if count[a] - used.count(a) > (a == b) and count[b] > used.count(b):
                return a, b
        return None

    def triple(self, gap: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        count, index, first = self.count, self.triples, True
        for at in range(index.at[gap], index.end[gap]):
            a = index.member[at]
            if not count[a] or self.pairs.at[gap - a] == self.pairs.end[gap - a]:
                if first:
                    index.at[gap] = at + 1
                continue
            first = False
            if count[a] > used.count(a) and (found := self.pair(gap - a, (*used, a))):
                return a, *found
        return None

    def take(self, lengths: tuple[int, ...]) -> int:
        """Consumes a combination as often as its lengths are there."""
        times = min(self.count[x] // lengths.count(x) for x in set(lengths))
        for x in lengths:
            self.count[x] -= times
        return times


class _Index:
    """Members by sum, from the least to the greatest; ``at`` and ``end`` bound a sum's list."""

    def __init__(self, member: np.ndarray, total: np.ndarray, capacity: int) -> None:
        below = total < capacity
        member, total = member[below], total[below]
        order = np.lexsort((member, total))
        self.member = member[order].tolist()
        ends = np.searchsorted(total[order], np.arange(capacity + 1), side="right").tolist()
        self.at, self.end = [0, *ends[:-1]], ends


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Steps that pack ``counts`` pieces of each length; every piece is in exactly one place."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] += n
    full = [Step((capacity,), int(count[capacity]))] if count[capacity] else []
    count[capacity] = 0
    lengths = np.arange(capacity + 1)
    least = max(-(-int(count @ lengths) // capacity), int(count[2 * lengths > capacity].sum()))
    best: list[Step] | None = None
    for most in (3, 2, 1):
        found = _complemented(count, capacity, most)
        if best is None or _sequences(found) < _sequences(best):
            best = found
        if _sequences(best) == least:
            break
    return full + best


def _sequences(steps: list[Step]) -> int:
    return sum(s.times for s in steps)


def _complemented(count: np.ndarray, capacity: int, most: int) -> list[Step]:
    """Steps with exact complements of up to ``most`` pieces, and best fit for what is left."""
    sums, steps = Sums(count), []
    for find in (sums.single, sums.pair, sums.triple)[:most]:
        for length in range(capacity - 1, 0, -1):
            while sums.count[length] and (found := find(capacity - length, (length,))):
                lengths = (length, *found)
                steps.append(Step(lengths, sums.take(lengths)))
    return steps + _best_fit(np.array(sums.count, np.int64), capacity)


def _best_fit(count: np.ndarray, capacity: int) -> list[Step]:
    """Best-fit decreasing where equal open sequences are one group with a number of times."""
    open_: dict[int, list[list]] = {}  # gap: groups [lengths, times]
    gaps: list[int] = []  # sorted gaps that have groups
    done: list[Step] = []

    def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if gap == 0:
            done.append(Step(lengths, times))
            return
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append([lengths, times])

    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            i = bisect_right(gaps, length - 1)
            if i == len(gaps):  # no gap is wide enough: new sequences, each as full of this length as it goes
                each = min(capacity // length, left)
                put(capacity - each * length, (length,) * each, left // each)
                left %= each
                continue
            gap = gaps[i]
            lengths, times = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(i)
            each = min(gap // length, left)
            take = min(times, left // each)
            if take < times:
                put(gap, lengths, times - take)
            put(gap - each * length, lengths + (length,) * each, take)
            left -= each * take
    return done + [Step(lengths, times) for groups in open_.values() for lengths, times in groups]


class Places:
    """Where the piece of a given rank within its length goes."""

    def __init__(self, steps: list[Step]) -> None:
        first, rows = 0, {}
        for step in steps:
            offset = 0
            runs: dict[int, list[int]] = {}
            for x in step.lengths:
                runs.setdefault(x, []).append(offset)
                offset += x
            for x, offsets in runs.items():
                rows.setdefault(x, []).append((len(offsets) * step.times, len(offsets), first, offsets))
            first += step.times
        self.sequences = first
        self.of = {}
        for x, parts in rows.items():
            flat = [o for *_, offsets in parts for o in offsets]
            n, each, seq = (np.array([p[i] for p in parts], np.int64) for i in range(3))
            self.of[x] = (np.cumsum(n), np.cumsum(n) - n, each, seq, np.cumsum(each) - each, np.array(flat, np.int64))

    def __call__(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence ids and offsets."""
        end, start, each, seq, at, offsets = self.of[length]
        i = np.searchsorted(end, rank, side="right")
        within = rank - start[i]
        return seq[i] + within // each[i], offsets[at[i] + within % each[i]]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranked: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each text's pieces of at most ``capacity`` tokens; with ``ranked`` also
    their ranks, taken by the same worker."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(tokenizer_path)  # an idle worker holds no words
        for batch in sliced(batches, BLOCK_BYTES):
            ids, n = encoder.ids(batch.column("text").to_pylist())
            # Each text's ids, then the end.
            ends = np.cumsum(n + 1)
            ids, n = np.insert(ids, ends - np.arange(len(n)) - 1, np.uint32(END_ID)), n + 1
            pieces = -(-n // capacity)
            piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(np.repeat(n, pieces) - start, capacity)
            at = 4 * (np.repeat(ends - n, pieces) + start)
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), pieces)))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    if not ranked:
        return texts.mapInArrow(rows, PIECES)
    return texts.mapInArrow(lambda batches: _numbered(rows(batches)), StructType([*StructType.fromDDL(PIECES), *RANKED]))


def _within(length: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """The rank of each row among the rows of its length, after those in ``seen``."""
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
    rank = np.zeros(len(length), np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        x = int(length[order[a]])
        rank[order[a:b]] = seen[x] + np.arange(b - a)
        seen[x] += int(b - a)
    return rank


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a length, and their ``RANKED``."""
    part, seen = TaskContext.get().partitionId(), defaultdict(int)
    for batch in batches:
        rank = _within(batch.column("length").to_numpy(), seen)
        yield batch.append_column("__part", pa.array(np.full(len(rank), part, np.int32))).append_column("__rank", pa.array(rank))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any rows with a ``length`` from 1 to ``capacity``, ranked or not) with sequence_id and offset."""
    if "__rank" in pieces.columns:
        ranked, pieces = pieces, pieces.drop("__part", "__rank")
    else:
        ranked = pieces.mapInArrow(_numbered, StructType([*pieces.schema, *RANKED]))
    # Ranks must hold still from here on: the rows are written once, with their ranks.
    ranked = cut(ranked)
    counted = ranked.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    total = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    shared = ranked.sparkSession.sparkContext.broadcast(Places(plan(total, capacity)))  # a few numbers per length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__at").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = order[a:b]
                sequence[at], offset[at] = places(int(length[at[0]]), rank[at])
            yield batch.drop_columns(["__at"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    placed = ranked.join(first, ["length", "__part"]).select(*pieces.columns, (F.col("__first") + F.col("__rank")).alias("__at"))
    return placed.mapInArrow(place, StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def best_fit_pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids end in id 0, so null and empty texts give one piece of one token. Only texts of more
    than ``capacity`` tokens are cut. Ids may be null or repeat, each row is packed by itself; an empty
    table gives no rows; other columns are not read.
    """
    return pack(pieces_of(docs, tokenizer_path, id_col, text_col, capacity, ranked=True), capacity)
