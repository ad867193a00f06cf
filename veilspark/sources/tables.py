"""Reading tables, and writing results without the raw content they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_results(frame: DataFrame, path: str, raw: list[str], mode: str = "errorifexists") -> None:
    """Writes Parquet without the raw columns, so no sink can take them along."""
    frame.drop(*raw).write.mode(mode).parquet(path)
