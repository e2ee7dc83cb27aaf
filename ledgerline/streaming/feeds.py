"""Structured Streaming jobs for the inputs that arrive piece by piece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.functions import scalars as S
from ledgerline.operators.cleaning import keep_latest
from ledgerline.operators.news import attach_audit
from ledgerline.session import truncate_lineage
from ledgerline.sources.files import DAILY_NAMES, FILE_COLUMNS, daily_bars

def bar_stream(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Lines of daily files as they arrive, one file per day; `upsert_bars` reads them by their headers."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).option("pathGlobFilter", DAILY_NAMES).text(root)
    return raw.select("value", *[F.col(c).alias(n) for n, c in FILE_COLUMNS.items()], F.col("_metadata.file_modification_time").alias("arrived"))


def upsert_bars(table: str):
    """foreachBatch sink: keep-last upsert into date partitions.

    Only the dates of the batch are read back and rewritten (dynamic partition overwrite), so a day's file costs a day
    of the stored table, and a replayed batch gives the same result.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = daily_bars(batch.withColumn("at_line", F.monotonically_increasing_id())).withColumn("batch", F.lit(batch_id))
        fresh = fresh.na.drop(subset=["ticker", "date", "close"])
        dates = [r["date"] for r in fresh.select("date").distinct().collect()]  # the days of one micro-batch
        if not dates:
            return
        if exists(spark, table):
            stored = spark.read.parquet(table).where(F.col("date").isin(dates))
            fresh = stored.select(*fresh.columns).unionByName(fresh)
        latest = keep_latest(fresh, ["ticker", "date"], ["batch", "arrived", "path", "at_block", "at_line"])
        settled = truncate_lineage(latest)  # the stored partitions are read and rewritten in one step
        settled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(table)

    return run


# Keyed state on the executors' disks, of which a batch uploads only its changes; one memory bound for all stores of an executor.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def first_articles(articles: DataFrame) -> DataFrame:
    """The first arrival of each (directory ticker, stable key); the same code serves a stream and a table.

    A stream keeps one entry per key without a watermark, so a backfill is never late, and emits a key only in the batch
    where it appears first: there its earliest and latest batch time agree. The work of a batch follows its rows, not
    what is stored. Batch times come from the checkpoint, so a repeated batch emits the same rows. Rows without a
    readable time count like all others, a missing ticker is a ticker of its own.
    """
    keyed = articles.withColumn("news_key", S.news_key("id", "article_url", "published_utc", "title"))
    rest = ["arrival", *[c for c in keyed.columns if c not in ("dir_ticker", "news_key", "arrival")]]
    entries = keyed.withColumn("_now", F.current_timestamp()).groupBy("dir_ticker", "news_key").agg(
        F.min(F.struct(*rest)).alias("_first"),
        F.min("_now").alias("_appeared"), F.max("_now").alias("_last"),
    )
    fresh = entries.where(F.col("_appeared") == F.col("_last"))
    return fresh.select(*[F.col(c) if c in ("dir_ticker", "news_key") else F.col(f"_first.{c}").alias(c) for c in keyed.columns])


def write_batches(table: str):
    """foreachBatch sink: the batch id names the partition, so a replay overwrites itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("batch", F.lit(batch_id))
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return run


def ingest_articles(articles: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Start the feed: articles never seen under this checkpoint, however old, are added to `table`; all that has
    arrived is worked off, then the query ends. The checkpoint and the table belong together."""
    spark = articles.sparkSession
    before = {key: spark.conf.get(key, None) for key in DISK_STATE}
    for key, value in DISK_STATE.items():
        spark.conf.set(key, value)
    try:  # a query copies the session's settings when it starts
        writer = first_articles(articles).writeStream.outputMode("update").trigger(availableNow=True)
        return writer.foreachBatch(write_batches(table)).option("checkpointLocation", checkpoint).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def day_bars(events: DataFrame, lateness: str | None, key: str = "event_type") -> DataFrame:
    """Bars per key in tumbling day windows; the same code serves a stream and a table.

    A stream drops events later than `lateness`; None keeps every day open, which a table does anyway.
    """
    source = events.withWatermark("ts", lateness) if lateness and events.isStreaming else events
    return (
        source.groupBy(F.window("ts", "1 day"), key)
        .agg(
            F.max(F.struct("ts", "event_id", "value"))["value"].alias("close"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.sum("value").alias("volume"),
            F.count("*").alias("transactions"),
        )
        .select(key, F.to_date("window.start").alias("date"), "close", "high", "low", "volume", "transactions")
    )


def count_outcomes(companies: DataFrame, table: str):
    """foreachBatch sink: article outcomes per batch; the batch id names the partition, so a replay overwrites itself."""

    write = write_batches(table)

    def run(batch: DataFrame, batch_id: int) -> None:
        write(attach_audit(batch, companies), batch_id)

    return run
