"""Exact deduplication that stays even under heavy groups of copies.

Stages, each grouping by the whole normalised text and not by its digest alone:

1. map side: Spark's partial aggregation merges equal texts inside each task;
2. salted groups: (digest, text, salt) are merged after the exchange. The most frequent digests (``HOT``
   of them) are dealt over ``salts`` salts; any other digest has at most one ``HOT``-th of the rows and one salt;
3. salt winners: at most ``salts`` rows per hot text meet and give the row that stays. A text with one
   salt is done after stage 2, so texts cross the network once.

The result is joined back on the digest and a second hash. The last step proves that such a key
stands for one content only, and the query fails rather than mixing two texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import SALTS, hot_keys, salted, sliced, spread, text_bytes

#: What names a text: a digest and a second, unrelated hash, both of the normalised bytes.
Digest = Callable[[bytes], bytes]


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Digest, keep_text: bool) -> DataFrame:
    """doc_id, the normalised text if wanted, its digest and second hash, and its SHA-256 in hex.

    A-Z are lower-cased bytewise (``bytes.lower`` leaves all other bytes alone), which Python does
    many times faster than translate().
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            norms = [x.lower() for x in batch.column("text").to_pylist()]
            hexes = [hashlib.sha256(x).hexdigest() for x in norms]
            columns = [batch.column("doc_id"), pa.array(map(digest, norms), pa.binary()), pa.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True) for x in norms], pa.int64())]
            columns.append(pa.array(norms, pa.binary()) if keep_text else pa.array(hexes))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "other", "norm" if keep_text else "text_sha256"])

    last = "norm binary" if keep_text else "text_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(rows, f"doc_id long, digest binary, other long, {last}")


KEY = ["digest", "other"]


def hot_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> DataFrame:
    return hot_keys(_keyed(docs, id_col, text_col, digest, False), KEY)


def winners(docs: DataFrame, hot: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Digest = sha256) -> DataFrame:
    """One row per distinct normalised text: digest, other, keep_id, group_size."""
    dealt = salted(_keyed(docs, id_col, text_col, digest, True), KEY, hot, "doc_id", salts)
    merged = dealt.groupBy("digest", "other", "norm", "salt").agg(F.max("doc_id").alias("id"), F.count(F.lit(1)).alias("n"), F.max("hot").alias("hot"))
    # The flag is an aggregate, so that both branches read one exchange.
    done = merged.where("hot is null").select("digest", "other", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    met = merged.where("hot").groupBy("digest", "other", "norm").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    texts = done.unionByName(met.drop("norm"))
    return (
        texts.groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        # A failing id: every use of the result reads it, so no plan leaves the proof out.
        .select("digest", "other", F.when(F.col("contents") == 1, F.col("keep_id")).otherwise(F.raise_error(F.lit("two texts share a digest and a second hash")).cast("long")).alias("keep_id"), "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Digest = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and equal each other. A null id is below all others; if a group has
    null ids only, keep_id is null and one of its rows stays. Rows that repeat an id within a group
    all count and one of them stays. An empty table gives no rows; other columns are not read.
    """
    hot = hot_digests(docs, id_col, text_col, digest)
    rows = salted(_keyed(docs, id_col, text_col, digest, False), KEY, hot, "doc_id", salts)
    rows = rows.groupBy("doc_id", *KEY, "salt", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    joined = rows.join(spread(winners(docs, hot, id_col, text_col, salts, digest), KEY, hot, salts), [*KEY, "salt"])
    return joined.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct normalised text."""
    stay = winners(docs, hot_digests(docs, id_col, text_col), id_col, text_col, salts).select(F.col("digest").alias("__d"), F.col("other").alias("__o"), F.col("keep_id").alias("__keep"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text=text_col):
            norms = [(x or "").encode().lower() for x in batch.column(text_col).to_pylist()]
            batch = batch.append_column("__digest", pa.array(map(sha256, norms), pa.binary()))
            yield batch.append_column("__other", pa.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True) for x in norms], pa.int64()))

    schema = StructType([*docs.schema, StructField("__digest", BinaryType()), StructField("__other", LongType())])
    on = (F.col("__digest") == F.col("__d")) & (F.col("__other") == F.col("__o")) & F.col(id_col).eqNullSafe(F.col("__keep"))
    return docs.mapInArrow(marked, schema).join(stay, on, "left_semi").dropDuplicates([id_col, "__digest", "__other"]).drop("__digest", "__other")
