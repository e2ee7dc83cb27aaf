"""Stored bars in month partitions, and scans that read only the months a set of observations needs.

A folder holds `bars` (one folder per month) and `reach` (first and last bar of every ticker). Months are derived from the
observations at run time and meet the partition column in a semi join, so Spark lists and opens only the folders of
needed months, also where the observations leave gaps of years. The reach table answers what a pruned scan cannot: whether
a ticker has any bar at all, and when its last one was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.sinks import write_table

MONTH = "bar_month"


def write_bars(bars: DataFrame, root: str) -> None:
    """Store bars (one row per ticker and date; rows without a date can't be placed and are left out).

    Rows meet by month and a hash of the ticker, so a month is written by several tasks and a hot ticker by many.
    """
    placed = bars.where(F.col("date").isNotNull()).withColumn(MONTH, F.date_format("date", "yyyy-MM"))
    write_table(placed.repartition(MONTH, F.pmod(F.xxhash64("ticker"), F.lit(16))), f"{root}/bars", [MONTH])
    reach = bars.groupBy("ticker").agg(F.min("date").alias("first_bar"), F.max("date").alias("last_bar"))
    write_table(reach, f"{root}/reach")


def read_reach(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/reach")


def needed_months(obs: DataFrame, days_before: int, days_after: int) -> DataFrame:
    """The months that reach from `days_before` ahead of a period end to `days_after` behind it.

    At most one row per calendar month, however many observations there are; distinct periods fold map-side.
    """
    if days_before < 0 or days_after < 0:
        raise ValueError("days must not be negative")
    ends = obs.select("period_end").where(F.col("period_end") >= F.lit("0001-01-01").cast("date")).distinct()
    start, end = F.trunc(F.date_sub("period_end", days_before), "month"), F.date_add("period_end", days_after)
    months = F.explode(F.sequence(start, end, F.expr("INTERVAL 1 MONTH")))
    return ends.select(months.alias("_start")).select(F.date_format("_start", "yyyy-MM").alias(MONTH)).distinct()


def read_needed_bars(spark: SparkSession, root: str, obs: DataFrame, days_before: int, days_after: int = 372) -> DataFrame:
    """Stored bars of the months around the observations.

    `days_after` must cover the label horizon and its buffer. `days_before` must cover the anchor's greatest age and the
    longest rolling frame (126 trading days, some 190 days); a feature whose frame starts earlier comes out missing.
    The list of months has a proven bound (twelve a year), so it is broadcast.
    """
    months = F.broadcast(needed_months(obs, days_before, days_after))
    return spark.read.parquet(f"{root}/bars").join(months, MONTH, "left_semi").drop(MONTH)
