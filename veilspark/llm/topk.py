"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each component that is above zero. Equal codes are merged and keep their
``k + 1`` least ids, which is all that a result can need. The distinct codes are dealt into shards of
bounded size; in a shard every segment of the codes has a table from value to rows. A query grows the
radius by which it flips its segments, one segment at a time. When radius r is done in the first j of m
segments and r - 1 in the rest, every code within m * r + j - 1 bits has been met (fewer differing bits
would leave some segment within its radius); the search ends once the k-th verified distance lies
within that. The stated query set runs against all shards, and shard winners are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Neighbours of a query; every EACH-th id is a query.
K, EACH = 10, 100
#: Distinct codes in a shard at most (about), and shards at least.
SHARD, SHARDS = 1 << 20, 16


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64) -> DataFrame:
    """id and code (``dims`` bits, in whole 64-bit words) of the rows that have an id and a vector.

    Missing, null and NaN components are no more than zero; more than ``dims`` components are an error.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-dims // 64) * 64
        for batch in batches:
            bits = np.zeros((batch.num_rows, width), bool)
            for i, vector in enumerate(batch.column("vector").to_pylist()):
                if len(vector) > dims:
                    raise ValueError(f"a vector has more than {dims} components")
                bits[i, : len(vector)] = [x is not None and x > 0 for x in vector]
            packed = np.packbits(bits, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([p.tobytes() for p in packed], pa.binary())], ["id", "code"])

    known = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    return known.mapInArrow(rows, "id long, code binary")


@cache
def flips(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` bits with ``radius`` of them set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), radius)], np.int64)


class Shard:
    """The index of one shard: distinct codes, their ids, and a table for each segment."""

    def __init__(self, found: list[bytes], ids: list[list[int]]) -> None:
        self.ids = ids
        self.words = np.frombuffer(b"".join(found), np.uint64).reshape(len(found), -1)
        # Segments of about log2(n) bits keep the tables from being empty or crowded.
        self.bits = 16 if len(found) > 4096 else 8
        self.segments = self.words.view(np.uint16 if self.bits == 16 else np.uint8)
        self.order, self.starts = [], []
        for column in self.segments.T:
            order = np.argsort(column, kind="stable").astype(np.int32)
            self.order.append(order)
            self.starts.append(np.searchsorted(column[order], np.arange((1 << self.bits) + 1)).astype(np.int32))
        self.count = np.fromiter(map(len, ids), np.int64, len(ids))

    def _probe(self, segment: int, values: np.ndarray) -> np.ndarray:
        """Rows whose segment has one of these values."""
        a, b = self.starts[segment][values], self.starts[segment][values + 1]
        n = b - a
        hit = n > 0
        a, n = a[hit], n[hit]
        if not len(n):
            return np.zeros(0, np.int32)
        return self.order[segment][np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

    def search(self, query_id: int, code: bytes, k: int) -> list[tuple[int, int]]:
        """The k nearest (distance, id) but for the query's own id, by distance and then id."""
        word = np.frombuffer(code, np.uint64)
        own = word.view(self.segments.dtype)
        m, n = self.segments.shape[1], len(self.ids)
        met = np.zeros(n, bool)
        rows, distances = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(self.bits + 1):
            for j in range(m):
                new = self._probe(j, int(own[j]) ^ flips(self.bits, radius))
                new = np.unique(new[~met[new]])
                if len(new):
                    met[new] = True
                    rows = np.concatenate([rows, new])
                    distances = np.concatenate([distances, np.bitwise_count(self.words[new] ^ word).sum(axis=1)])
                covered = m * radius + j
                if len(rows) == n or int(self.count[rows[distances <= covered]].sum()) > k:
                    best = []
                    limit = np.sort(np.repeat(distances, self.count[rows]))
                    far = limit[min(k, len(limit) - 1)]  # one more than k, as the own id may be among them
                    for r, d in zip(rows[distances <= far].tolist(), distances[distances <= far].tolist(), strict=True):
                        best += [(d, i) for i in self.ids[r] if i != query_id]
                    return sorted(best)[:k]
        raise AssertionError("every code lies within the largest radius")


def top_k(vectors: DataFrame, k: int = K, each: int = EACH, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, shard: int = SHARD, shards: int = SHARDS) -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance: for every id divisible by ``each`` its k nearest others.

    Ties go to the lesser id. Rows without an id or a vector take no part; an id that repeats with one code counts
    once, with several codes it can be met with each; an id is never its own neighbour. Fewer than k others give
    fewer rows; an empty table gives none; other columns are not read.
    """
    rows = cut(codes(vectors, id_col, vector_col, dims).distinct())
    first = Window.partitionBy("code").orderBy("id")  # Spark limits the ranks before the exchange, so a hot code sends few rows
    merged = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    n = max(shards, -(-rows.count() // shard))
    index = merged.select(F.pmod(F.xxhash64("code"), F.lit(n)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "code", "ids")
    queries = rows.where(F.col("id") % each == 0).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "code", F.lit(None).cast("array<bigint>").alias("ids"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, ids, index = None, [], [], None
        for batch in batches:
            out: list[list] = [[], [], []]
            for part, kind, query, code, own in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "id", "code", "ids")), strict=True):
                if part != at:
                    at, found, ids, index = part, [], [], None
                if kind == 0:
                    found.append(code)
                    ids.append(own)
                    continue
                if index is None and found:
                    index = Shard(found, ids)
                for distance, neighbor in index.search(query, code, k) if index else []:
                    for column, value in zip(out, (query, neighbor, distance), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], ["query_id", "neighbor_id", "distance"])

    winners = index.union(queries).repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(search, "query_id long, neighbor_id long, distance int")
    nearest = winners.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))  # an id may have several codes
    return nearest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
