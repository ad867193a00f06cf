"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints link at ``BITS`` = 3 or fewer differing bits. A 64-bit fingerprint is cut into two
halves; of any three differing bits, one half holds at most one. Each half is indexed under its 32
one-wildcard variants (one bit blanked, its place noted), so two fingerprints whose halves differ in
at most one bit share a variant: an equality join finds them, and every candidate is verified.

Equal fingerprints are merged first. Within a variant no pairs are written: a spanning forest of its
verified links is enough for the components. A variant with more than ``REFINE`` fingerprints is dealt
anew: the other half is cut into two quarters, one of which again holds at most one differing bit, and
each is indexed by its 16 one-wildcard variants. Such a group shares 46 bits and so has at most 2**18
members, which bounds every task whatever the corpus holds.

Components come from alternating large-star and small-star rounds on the links, in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, salted, sliced, spread, text_bytes

BITS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints under one variant above which it is dealt anew by quarters.
REFINE = 4096


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle in a row, repeats included; of fewer words the whole sequence, without words nothing."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    # In the space-joined words a shingle is a slice.
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The SimHash: a bit is set if over half the hashes have it."""
    n = len(hashes)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        bits = np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included; without words zero."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(rows, "doc_id long, fp long")


def _forest(codes: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sorted distinct codes, each component as a star around its least code.

    Each code is compared once with all that no component has yet, so nothing larger than one row of distances is held.
    """
    found: list[tuple[int, int]] = []
    rest = codes
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        stack = [seed]
        while stack and len(rest):
            near = np.bitwise_count(rest ^ stack.pop()) <= bits
            if near.any():
                stack.extend(rest[near])
                found += [(int(c), int(seed)) for c in rest[near]]
                rest = rest[~near]
    return found


def _edges(batches: Iterator[pa.RecordBatch], bits: int, refine: int | None) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, fp): links within a key as (key null, a, b), and with ``refine`` the rows of larger keys as they are (b null)."""
    kept_key: int | None = None
    kept: list[np.ndarray] = []
    size, large = 0, False

    def close() -> Iterator[pa.RecordBatch]:
        if size > 1 and not large:
            codes = np.unique(np.concatenate(kept).view(np.uint64))
            if len(codes) > 1 and (links := _forest(codes, bits)):
                a, b = np.array(links, np.uint64).view(np.int64).T
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], ["key", "a", "b"])

    def passed(key: int, codes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), key)), pa.array(codes), pa.nulls(len(codes), pa.int64())], ["key", "a", "b"])

    for batch in batches:
        keys, codes = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        if not len(keys):
            continue
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        runs = np.diff(edges)
        # Only the first and last run can go on in another batch; others matter if they have two rows.
        for k in sorted({0, len(runs) - 1} | set(np.flatnonzero(runs > 1).tolist())):
            a, b, key = edges[k], edges[k + 1], int(keys[edges[k]])
            if key != kept_key:
                yield from close()
                kept_key, kept, size, large = key, [], 0, False
            size += b - a
            if refine and size > refine:
                large = True
                for codes_before in kept:
                    yield passed(key, codes_before)
                kept = []
                yield passed(key, codes[a:b])
            else:
                kept.append(codes[a:b])
    yield from close()


def _variants(fps: DataFrame) -> DataFrame:
    """Each fingerprint under its 64 keys: half, place of the wildcard, the half without it."""
    # bits 38: half; 33-37: place; 0-31: the half with the place blanked
    return fps.select("fp", F.explode(F.array(*[F.lit(j) for j in range(64)])).alias("j")).select(
        F.expr("(cast(j as long) << 33) | ((case when j < 32 then fp & 4294967295 else shiftrightunsigned(fp, 32) end) & ~(1L << (j % 32)))").alias("key"), "fp"
    )


def _refined(rows: DataFrame) -> DataFrame:
    """Rows (key, fp) of large variants under keys that also hold a one-wildcard variant of a quarter of the other half.

    The wildcard of the first key can be the only bit that differs there, so at most ``BITS`` lie in the other half.
    """
    other = "(case when (key >> 38) = 0 then shiftrightunsigned(fp, 32) else fp & 4294967295 end)"
    quarter = f"((case when i < 16 then {other} else shiftrightunsigned({other}, 16) end) & 65535 & ~(1L << (i % 16)))"
    return rows.select("key", "fp", F.explode(F.array(*[F.lit(i) for i in range(32)])).alias("i")).select(
        # a 64-bit key would not hold both: the second key is hashed with the first, and links are verified anyway
        F.expr(f"xxhash64(key, i, {quarter})").alias("key"),
        "fp",
    )


def links(fps: DataFrame, bits: int = BITS, refine: int = REFINE) -> DataFrame:
    """Links (a, b) between distinct fingerprints, b < a as unsigned numbers: enough to connect all that lie within ``bits``."""
    if bits > 3:
        raise ValueError("two halves with one wildcard prove links up to three bits")
    first = _variants(fps).repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _edges(it, bits, refine), "key long, a long, b long")
    first = cut(first)
    large = first.where("b is null").select("key", F.col("a").alias("fp"))
    second = _refined(large).repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _edges(it, bits, None), "key long, a long, b long")
    return first.where("b is not null").select("a", "b").union(second.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for all nodes that have an edge (a, b).

    Alternates large-star and small-star until nothing changes. Neighbours are never gathered: each half
    round is a minimum by node, which combines map side, and an equality join that Spark may split.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while True:
        # Large-star: a node's larger neighbours move to the least of its neighbours and itself.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # Small-star: a node and its smaller neighbours move to the least of these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, refine: int = REFINE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least id that can be reached over links, the row's own included; null ids do not
    count unless a component has no other. Null texts and texts without words have fingerprint zero and
    link like any other. Ids may repeat; an empty table gives no rows; other columns are not read.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(fps.select("fp"), bits, refine))
    # Fingerprints without a link are their own component.
    placed = cut(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    # A fingerprint that many rows share, as that of empty texts, is dealt over salts.
    hot = hot_keys(rows, ["fp"])
    return salted(rows, ["fp"], hot, "doc_id").drop("hot").join(spread(named, ["fp"], hot), ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The near-dedup stage: words of a shingle, least Jaccard similarity of two texts' distinct shingles.
NEAR_SHINGLE = 5
SIMILAR = 0.8
#: Bands of ROWS minima each. A pair at SIMILAR shares no band with probability (1 - 0.8**4)**32 = 5e-8.
BANDS, ROWS = 32, 4
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
#: Rows up to which a side of a join is broadcast.
SMALL = 1 << 18


def bands(codes: np.ndarray) -> np.ndarray:
    """The MinHash band keys of a set of hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(codes), 4096):
        least = np.minimum(least, ((codes[i : i + 4096] ^ _MIX[0][:, None]) * _MIX[1][:, None]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ least[j::ROWS]) * _MIX[1][j]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _node(codes: np.ndarray) -> int:
    """The name of a shingle set, given as sorted distinct hashes; that of the empty one is zero."""
    return xxhash.xxh64_intdigest(codes.tobytes(), SEED) if len(codes) else 0


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text as bytes, and name, a digest of the text, which tells rows of one id apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).withColumn("name", F.md5("text"))


def _signatures(named: DataFrame) -> DataFrame:
    """doc_id, name, node (the name of the shingle set), fp (the fingerprint) and keys (the bands) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2 << 20):
            hashes = [shingle_hashes(t, NEAR_SHINGLE) for t in batch.column("text").to_pylist()]
            codes = [np.unique(h) for h in hashes]
            nodes, fps = (np.array(x, np.uint64).view(np.int64) for x in ([_node(c) for c in codes], [majority(h) for h in hashes]))
            keys = pa.array([bands(c) if len(c) else [] for c in codes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), pa.array(nodes), pa.array(fps), keys], ["doc_id", "name", "node", "fp", "keys"])

    return named.mapInArrow(rows, "doc_id long, name string, node long, fp long, keys array<long>")


def _sets(named: DataFrame) -> DataFrame:
    """node and codes (the shingle set) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2 << 20):
            codes = [np.unique(shingle_hashes(t, NEAR_SHINGLE)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(c) for c in codes], np.uint64).view(np.int64)), pa.array([c.tobytes() for c in codes], pa.binary())], ["node", "codes"])

    return named.mapInArrow(rows, "node long, codes binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Of rows sorted by their first column: each value with its rows."""
    key: int | None = None
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist() if len(keys) else []
        for a, b in zip(edges, edges[1:]):
            if kept and keys[a] != key:
                yield key, kept
                kept = []
            key = int(keys[a])
            kept.append(batch.slice(a, b - a))
    if kept:
        yield key, kept


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, node): the nodes of each key with several, under a hash of the nodes, as pairs often share many keys."""
    for _, parts in _runs(batches):
        if sum(p.num_rows for p in parts) > 1:
            nodes = np.unique(np.concatenate([p.column("node").to_numpy() for p in parts]))
            if len(nodes) > 1:
                group = np.full(len(nodes), xxhash.xxh64_intdigest(nodes.tobytes(), SEED), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(nodes)], ["group", "node"])


def similar_forest(sets: list[np.ndarray], least: float = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with a Jaccard similarity of ``least`` or more, as places."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(code.max() + 2))
    posts, own = owner[order], np.split(code, np.cumsum(sizes)[:-1])
    found, free = [], np.ones(len(sets), bool)
    for seed in range(len(sets)):
        stack = [seed] if free[seed] else []
        free[seed] = False
        while stack and free.any():
            at = stack.pop()
            common = np.zeros(len(sets), np.int64)
            for c in own[at]:
                common[posts[starts[c] : starts[c + 1]]] += 1  # a set holds a code once
            near = np.flatnonzero(free & (common >= least * (sizes + sizes[at] - common) - 1e-9))
            free[near] = False
            found += [(at, int(k)) for k in near]
            stack.extend(near.tolist())
    return found


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (group, node, codes) sorted by group: verified links."""
    for _, parts in _runs(batches):
        nodes = np.concatenate([p.column("node").to_numpy() for p in parts])
        links = similar_forest([np.frombuffer(c, np.uint64) for p in parts for c in p.column("codes").to_pylist()])
        if links:
            a, b = nodes[np.array(links).T]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _small(frame: DataFrame) -> DataFrame:
    """``frame``, written, and broadcast if it has few rows: the other side then need not be shuffled."""
    frame = cut(frame)
    return F.broadcast(frame) if frame.count() <= SMALL else frame


def _proposed(rows: DataFrame) -> DataFrame:
    """group, node: sets that may be similar stand in one group.

    The fingerprints' one-wildcard index proposes those within ``BITS`` bits. As similarity 0.8 goes with up to 17
    and more of 64 bits, too far for any segments that select, MinHash bands propose the others.
    """
    fps = rows.where(F.size("keys") > 0).select("fp", "node").distinct()
    near = links(fps.select("fp").distinct()).select(F.xxhash64("a", "b").alias("group"), F.explode(F.array("a", "b")).alias("fp"))
    equal = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("fp").alias("group"), "fp")
    linked = near.unionByName(equal).join(fps, "fp").select("group", "node")
    keyed = rows.select(F.explode("keys").alias("key"), "node")
    banded = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_groups, "group long, node long")
    return cut(linked.unionByName(banded).distinct())


def similar_links(named: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between nodes: enough to connect all with a similarity of ``SIMILAR``, each verified on the whole sets."""
    groups = _proposed(rows)
    # Only proposed sets are made again from their texts.
    wanted = _small(rows.join(_small(groups.select("node").distinct()), "node").groupBy("node").agg(F.min("name").alias("name")).select("name"))
    sets = _sets(named.join(wanted, "name", "left_semi")).dropDuplicates(["node"])
    return groups.join(sets, "node").select("group", "node", "codes").repartition("group").sortWithinPartitions("group").mapInArrow(_similar, "a long, b long").distinct()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies: the row with the least id, with all its columns.

    Texts link if their distinct five-word shingles have a Jaccard similarity of 0.8 or more, which is decided on
    whole sets; groups are what links connect. Texts without words are copies of each other. Null ids come after
    all others. Rows that share an id are told apart by their texts; rows that share both are one document here,
    which stays or goes whole (exact deduplication leaves one of them).
    """
    named = _named(docs, id_col, text_col)
    rows = cut(_signatures(named))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "name")
    nodes = rows.groupBy("node").agg(F.min(order).alias("least"))
    roots = components(similar_links(named, rows))
    placed = cut(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    # Only nodes with several rows or links can lose a row.
    first = placed.groupBy("root").agg(F.min("least").alias("first"))
    copies = rows.join(placed.select("node", "root"), "node").join(first, "root").where(~order.eqNullSafe(F.col("first")))
    gone = _small(copies.select(F.col("doc_id").alias("__gone"), F.col("name").alias("__name")).distinct())
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["__gone"]) & (F.md5(text_bytes(text_col)) == gone["__name"]), "left_anti")
