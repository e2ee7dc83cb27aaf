"""Exact deduplication as a stream with keyed state on disk (operator 8).

Arrivals carry the SHA-256 of the text, the document id as stable identifier, and a locator (source file and length in
bytes). A streaming aggregation without watermark holds one entry for each digest, so an entry never expires; RocksDB
keeps the state on the executors' disks and its change log in the shared folder. Texts are not part of the state: when a
digest is hit again, the full bytes of the rows that share it are compared in a second pass.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

from ledgerline.llm.shared import may_hold, new_folder, parted, private, stored, without

#: State on disk, only changes uploaded after a batch, log files without space reserved ahead, one bound on the memory of all
#: stores of an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}
ARRIVAL = "doc_id long, digest string, n_bytes long, source_file string, arrival long"


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def body(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def file_of(docs: DataFrame) -> Column:
    """The file of a row, empty for tables that are not read from files directly."""
    try:
        docs.select("_metadata.file_path")
    except AnalysisException:
        return F.lit("")
    return F.col("_metadata.file_path")


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per document: id, digest, locator. `arrival` tells repeated rows with one id apart."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest(body()).alias("digest"), F.octet_length(body()).cast("long").alias("n_bytes"),
        file_of(docs).alias("source_file"), F.monotonically_increasing_id().alias("arrival"),
    )


def run_state(spark: SparkSession, landed: str, state: str, groups: str, files_per_batch: int = 1000) -> None:
    """Feed what has landed since the last call through the keyed state; may be called again with the same folders.

    Every micro-batch writes the entries that it changed, in a folder of its own, so a repeated batch overwrites itself.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{groups}/batch={number}")

    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files_per_batch).parquet(landed)
        entries = stream.groupBy("digest").agg(
            F.max(F.struct("doc_id", "arrival", "n_bytes", "source_file")).alias("keeper"), F.count("*").alias("group_size"))
        query = (entries.writeStream.outputMode("update").foreachBatch(keep)
                 .option("checkpointLocation", state).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def entries(spark: SparkSession, groups: str) -> DataFrame:
    """The latest entry of each digest; group sizes only grow, so the largest is the latest."""
    written = spark.read.schema("digest string, keeper struct<doc_id:long,arrival:long,n_bytes:long,source_file:string>, group_size long, batch int")
    return (written.parquet(groups).groupBy("digest").agg(F.max(F.struct("group_size", "keeper")).alias("e"))
            .select("digest", "e.group_size", "e.keeper"))


def colliding(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests held by texts with different bytes. Smallest and largest text are combined before the shuffle, so
    a group of copies moves one text per task, and documents whose digest was never hit don't move."""
    hits = state.where("group_size > 1").select("digest")
    shared = may_hold(docs.select(digest(body()).alias("digest"), body().alias("text")), "digest", hits)
    ends = shared.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    return ends.where("a <> b").select("digest")


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex, files_per_batch: int = 1000) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept, keeper (locator of the text that stays), arrival.

    Null text counts as empty, so empty and null texts form one group. Of equal texts the row with the largest id stays;
    of repeated rows with one id, one stays. A null id is smaller than any other. No documents: no rows.
    """
    spark = docs.sparkSession
    home = new_folder(spark, "exact-dedup")
    arrivals(docs, digest).write.parquet(f"{home}/landed")
    landed = spark.read.schema(ARRIVAL).parquet(f"{home}/landed")
    run_state(spark, f"{home}/landed", f"{home}/state", f"{home}/groups", files_per_batch)
    if landed.isEmpty():
        state = spark.createDataFrame([], "digest string, group_size long, keeper struct<doc_id:long,arrival:long,n_bytes:long,source_file:string>")
    else:
        state = entries(spark, f"{home}/groups")
    clashes = stored(colliding(docs, state, digest), "exact-dedup-clashes")
    decided = landed.join(state, "digest")
    if not clashes.isEmpty():
        decided = decided.join(clashes, "digest", "left_anti").unionByName(by_bytes(docs, landed, clashes, digest))
    return decided.select(
        "doc_id", "digest", F.col("keeper.doc_id").alias("keep_id"), "group_size",
        (F.col("keeper.arrival") == F.col("arrival")).alias("kept"), "keeper", "arrival")


def by_bytes(docs: DataFrame, landed: DataFrame, clashes: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The groups of colliding digests, by the whole text instead of the digest."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(body()).alias("digest"), body().alias("text"))
    texts = texts.join(clashes, "digest").distinct()
    rows = landed.join(clashes, "digest").join(texts, on=[landed["doc_id"].eqNullSafe(texts["doc_id"]), landed["digest"] == texts["digest"],
                                                          landed["n_bytes"] == F.octet_length(texts["text"])])
    rows = rows.select(landed["*"], texts["text"])
    state = rows.groupBy("digest", "text").agg(
        F.max(F.struct("doc_id", "arrival", "n_bytes", "source_file")).alias("keeper"), F.count("*").alias("group_size"))
    return rows.join(state, ["digest", "text"]).drop("text").select("digest", *[c for c in landed.columns if c != "digest"], "group_size", "keeper")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns as they were."""
    decided = deduplicate(docs).groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    decided = stored(decided, "exact-dedup-decided")
    key = [F.col("doc_id").cast("long"), sha256_hex(body())]
    kept = without(docs, key, decided.where("not kept").select("doc_id", "digest"))
    again = decided.where("kept and rows > 1").select("doc_id", "digest")
    if again.isEmpty():
        return kept
    some, rest = parted(kept, key, again)
    digest = private("digest")
    return rest.unionByName(some.withColumn(digest, key[1]).dropDuplicates(["doc_id", digest]).drop(digest))
