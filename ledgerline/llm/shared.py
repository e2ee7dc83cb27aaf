"""What the operators have in common: the shared folder, written tables, fixed-size filters."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import cache, reduce

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

#: Words of all contracts: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as `spark.checkpoint.dir` names it.

    Only a local session without the setting gets a folder of its own below /tmp; a cluster without it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is not None:
        named = sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ledgerline-shared-", dir="/tmp")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def private(name: str) -> str:
    """A column name that no table of a caller has."""
    return f"_{name}_{uuid.uuid4().hex}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_in(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def slot_of(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits))


def parted(df: DataFrame, on: list[Column], keys: DataFrame, bits: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rows of `df` whose `on` may be among the rows of `keys`, and those for which it surely is not.

    The broadcast side has at most 2**bits slots of 8 bytes, however many keys there are; with more keys than slots
    fewer rows are surely not among them. Rows move to no other task.
    """
    slot = private("slot")
    small = F.broadcast(keys.select(slot_of([F.col(c) for c in keys.columns], bits).alias(slot)).distinct())
    marked = df.withColumn(slot, slot_of(on, bits))
    return marked.join(small, slot, "left_semi").drop(slot), marked.join(small, slot, "left_anti").drop(slot)


def may_hold(df: DataFrame, key: str, keys: DataFrame, bits: int = 20) -> DataFrame:
    """Rows of `df` whose key may be among the keys: drops most others before a shuffle, never one that is there."""
    return parted(df, [F.col(key)], keys.select(key), bits)[0]


def without(df: DataFrame, on: list[Column], keys: DataFrame) -> DataFrame:
    """Rows of `df` whose `on` is not among the rows of `keys`; null equals null. Only rows that may be among them are shuffled."""
    names = [private(c) for c in keys.columns]
    some, rest = parted(df, on, keys)
    same = [o.eqNullSafe(F.col(n)) for o, n in zip(on, names, strict=True)]
    return rest.unionByName(some.join(keys.toDF(*names), reduce(lambda a, b: a & b, same), "left_anti"))


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # no glibc
        return None


_given_back = 0.0


def give_back(every: float = 0.0) -> None:
    """Return freed memory of this process to the system, at most once in `every` seconds.

    Arrays below 32 MB are freed to the allocator only, and an idle Python worker would keep that memory from its executor.
    """
    global _given_back
    if time.monotonic() - _given_back < every:
        return
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)
    _given_back = time.monotonic()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over batches, which gives its freed memory back when the task ends."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def tidy_groups(run: Callable) -> Callable:
    """`run` over one group, which gives freed memory back from time to time."""

    def one(rows):
        out = run(rows)
        give_back(0.25)
        return out

    return one
