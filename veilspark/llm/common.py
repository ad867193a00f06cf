"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \x09-\x0D. ``bytes.split()`` cuts at exactly these.
WORD_SPACE = "\x20\x09-\x0d"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all nodes share: spark.checkpoint.dir. Where it is unset a single machine gets one of its own; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        found = "file://" + tempfile.mkdtemp(prefix="veilspark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(frame: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and cuts the lineage there."""
    spark = frame.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return frame.checkpoint()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: Keys that are salted at most, rows that a key needs for it, and its salts.
HOT, HOT_ROWS, SALTS = 1024, 32, 16


def hot_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """The ``HOT`` most frequent keys of ``frame``, written once: at most ``HOT`` rows, so they can be broadcast.

    Any other key has at most one ``HOT``-th of the rows.
    """
    counts = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return cut(counts.orderBy(F.desc("n"), *keys).limit(HOT).where(F.col("n") >= HOT_ROWS).select(*keys, F.lit(True).alias("hot")))


def salted(frame: DataFrame, keys: list[str], hot: DataFrame, by: str, salts: int = SALTS) -> DataFrame:
    """Adds ``hot`` and ``salt``: rows of a hot key are dealt over the salts by the column ``by``."""
    return frame.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(by, F.lit(7)), F.lit(salts))).otherwise(0))


def spread(frame: DataFrame, keys: list[str], hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """Adds ``salt``: rows of a hot key come once for each salt. ``frame`` has one row for each key."""
    every = F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")
    return frame.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.when(F.col("hot"), every).otherwise(F.array(F.lit(0).cast("long"))))).drop("hot")


def id_text(col: str) -> Column:
    """The id as text, empty for null: the input of the crc32 that deals rows into folds."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(col: str, n: int) -> Column:
    return F.crc32(id_text(col).cast("binary")) % n


def text_bytes(col: str) -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def sliced(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20, text: int | str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each has about ``most_bytes`` of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if batch.nbytes <= most_bytes or n <= 1:
            if n:
                yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < n:
            yield batch.slice(start)


def single_threaded() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
