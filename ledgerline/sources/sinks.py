"""Writers. Spark's committer makes each of them appear as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.lists import json_list


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Array columns as JSON text, so a CSV file can hold them."""
    return df.select(*[json_list(n).alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    csv_ready(df).write.mode("overwrite").csv(path, header=True)


def write_summary(df: DataFrame, path: str) -> None:
    """Summary rows as JSON documents."""
    df.write.mode("overwrite").json(path)


def head_export(df: DataFrame, keys: list[str], n: int = 100) -> DataFrame:
    """The first `n` rows in key order, as a readable extract."""
    return df.orderBy(*keys).limit(n)


def read_summaries(spark, paths: list[str]) -> DataFrame:
    """Run summaries (one JSON document each) as one comparison table: run, model and its metrics."""
    raw = spark.read.json(paths, multiLine=True)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run"), "metrics.*")
