"""Mixing sources to target weights by entropy balancing (operator 10).

The rates of the documents stay as near to one as the targets allow, in the sense of relative entropy: the solution of
that convex problem tilts them exponentially by size, rate = min(cap, exp(lambda * size / mean size of the source)).
Safeguarded Newton steps on the dual find each source's lambda. They run over a histogram of (source, size), all sources
at once; sums are of rounded integers, so their order does not matter and reruns agree. Rates become whole copies by
running totals in order of size, and a second running total over small documents takes up what rounding left. Rows that agree
in id, source and size are one entry with a count, so nothing in the order depends on how the table is stored.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from ledgerline.llm.shared import private, stored, words_in

UNIT = 1 << 20
#: Entries of one window task.
BUCKET_ROWS = 2000
#: Rows of an entry that are numbered in one array.
RUN = 1 << 15


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], cap: float) -> DataFrame:
    """source, n, source_size, target. A source's target stops at cap * source_size; the rest is shared by weight again.

    With the sources in order of cap * size / weight, those below the common level are full; the level follows from
    running totals. The table has one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n"))
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    full = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest, everything = full.rowsBetween(W.unboundedPreceding, -1), full.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    return (
        totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
        .withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))))
        .select("source", "n", "source_size", "target")
    )


def rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    tilt = F.when(mean > 0, lam * size / mean).otherwise(F.lit(0.0))
    return F.when(lam.isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(tilt, F.lit(40.0)))))


def dual_solution(sizes: DataFrame, targets: DataFrame, cap: float, steps: int = 80, tolerance: float = 1e-7) -> DataFrame:
    """source, source_size, target, mean, lam (null: the target is the cap, every rate is the cap).

    A step leaves the bracket of signs seen so far only for its middle, and moves lambda at most to twice its distance
    from one, so the iteration cannot run away where the derivative vanishes. A source is done when its words are within
    `tolerance` of the target, or within the unit of the rounded sums. Sources still open after `steps` are an error.
    """
    histogram = stored(sizes.groupBy("source", "size").agg(F.sum("times").alias("docs")), "mixing-histogram")
    state = targets.select(
        "source", "source_size", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"),
        F.when(F.col("target") < F.col("source_size") * (cap * (1 - 1e-12)), F.lit(0.0)).alias("lam"))
    state = stored(state, "mixing-dual")
    for _ in range(steps):
        at = histogram.withColumnRenamed("source", "_s").join(state.where("lam is not null and mean > 0"), F.col("_s").eqNullSafe(F.col("source")))
        x, r = F.col("size") / F.col("mean"), rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        whole = lambda c: F.sum(F.round(c * F.col("docs") * UNIT).cast("long"))
        sums = at.groupBy("source").agg(whole(x * r).alias("f"), whole(F.when(r < cap, x * x * r).otherwise(0.0)).alias("slope"))
        sums = sums.select(F.col("source").alias("_s"), (F.col("f") / UNIT).alias("f"), (F.col("slope") / UNIT).alias("slope"))
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("gap", F.col("f") - F.col("target") / F.col("mean"))
        lam, reach = F.col("lam"), 1 + F.abs(F.col("lam"))
        newton = F.when(F.col("slope") > 0, lam - F.col("gap") / F.col("slope")).otherwise(F.when(F.col("gap") > 0, F.lit(-1e12)).otherwise(F.lit(1e12)))
        step = F.greatest(lam - reach, F.least(lam + reach, newton))
        moved = moved.withColumn("lo", F.when(F.col("gap") < 0, lam).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") > 0, lam).otherwise(F.col("hi")))
        near = F.abs(F.col("gap")) <= F.greatest(F.col("target") / F.col("mean") * tolerance, F.lit(1 / UNIT))
        inside = F.when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        moved = moved.withColumn("done", F.col("gap").isNull() | near).withColumn("lam", F.when(F.col("done"), lam).otherwise(inside))
        state = stored(moved.select(*state.columns, "done"), "mixing-dual")
        if state.where("not done").isEmpty():
            break
        state = state.drop("done")
    else:
        raise RuntimeError(f"entropy balancing did not reach its targets in {steps} steps")
    return state.select("source", "source_size", "target", "mean", "lam")


def running_total(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Running total of a whole-number column within each source, by size class and bucket, then size, hash, id and copies.

    An entry counts `times` over. Buckets hold some thousand entries however large the source is: totals of buckets give the offsets, windows stay inside.
    """
    bucket = ["source", "class", "bucket"]
    amount = F.col(value) * F.col("times")
    sums = rows.groupBy(*bucket).agg(F.sum(amount).alias("_sum"))
    offsets = sums.select(
        *[F.col(c).alias(f"_{c}") for c in bucket],
        F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("class", "bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*bucket).orderBy("size", "order", "doc_id", *[c for c in ("copies",) if c in rows.columns]).rowsBetween(W.unboundedPreceding, 0)
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class")) & (F.col("bucket") == F.col("_bucket"))
    return (rows.withColumn("_run", F.sum(amount).over(inside)).join(offsets, same)
            .withColumn(out, F.col("_run") + F.col("_offset")).drop("_run", "_offset", *[f"_{c}" for c in bucket]))


def bucketed(rows: DataFrame) -> DataFrame:
    """Add size class (steps of a fifth), a hash order, and a bucket within the class."""
    rows = rows.withColumn("class", F.floor(F.log2(F.col("size") + 1) * 4)).withColumn("order", F.xxhash64("doc_id", "size"))
    counts = rows.groupBy("source", "class").agg(F.count("*").alias("_n")).select(F.col("source").alias("_source"), F.col("class").alias("_class"), "_n")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class"))
    return (rows.join(counts, same).withColumn("bucket", F.pmod(F.shiftright("order", 8), F.ceil(F.col("_n") / BUCKET_ROWS)))
            .drop("_source", "_class", "_n"))


def each_row(entries: DataFrame, value: str, total: str) -> DataFrame:
    """One row per row of an entry, its running total up to that row."""
    first, k = private("first"), private("k")
    runs = entries.withColumn(first, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"), F.lit(RUN).cast("long"))))
    rows = runs.withColumn(k, F.explode(F.sequence(F.col(first), F.least(F.col(first) + (RUN - 1), F.col("times")))))
    return rows.withColumn(total, F.col(total) - (F.col("times") - F.col(k)) * F.col(value)).drop(first, k, "times")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken.

    Sources in code point order, null last, get the weights in turn and share `share` times all words; see
    `source_targets`. Empty and null texts have size 0, rate 1 and take nothing. Repeated rows count each, and so do
    rows without id. Rows of one id, source and size may differ in copies; which of them has more is not told. Any layout of the
    input gives the same rows. A source without words has target 0. No documents: no rows.
    """
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                           words_in(F.col("text")).alias("size"))
    sizes = stored(measured.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")), "mixing-sizes")
    targets = stored(source_targets(sizes, share, weights, cap), "mixing-targets")
    solved = dual_solution(sizes, targets, cap).withColumnRenamed("source", "_s")
    rows = sizes.join(solved, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("rate", rate(F.col("lam"), F.col("size"), F.col("mean"), cap)).withColumn("units", F.round(F.col("rate") * UNIT).cast("long"))
    rows = running_total(bucketed(rows.drop("lam", "mean")), "units", "total")
    half, top = UNIT // 2, int(cap)
    copies = F.floor((F.col("total") + half) / UNIT) - F.floor((F.col("total") - F.col("units") + half) / UNIT)
    rows = each_row(rows, "units", "total").withColumn("copies", copies.cast("long")).drop("total", "units")
    rounded = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("times")), "mixing-copies")
    words = F.sum(F.col("copies") * F.col("size") * F.col("times"))
    left = rounded.groupBy("source").agg((F.round(F.first("target")) - words).cast("long").alias("left"))
    rows = rounded.join(left.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    free = F.when(F.col("left") > 0, F.col("copies") < top).otherwise(F.col("copies") > 0)
    rows = running_total(rows.withColumn("free", F.when(free, F.col("size")).otherwise(0)), "free", "spent")
    rows = each_row(rows, "free", "spent")
    moves = (F.col("free") > 0) & (F.col("spent") <= F.abs("left"))
    copies = F.col("copies") + F.when(moves, F.signum("left").cast("long")).otherwise(0)
    return rows.withColumn("copies", copies.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def mixed(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """The documents of the mix, each as often as it is taken; repeated rows with one id share their copies evenly, rounded down."""
    name, every, times, copy = private("id"), private("all"), private("rows"), private("copy")
    copies = mix(docs, share, weights, cap).groupBy(F.col("doc_id").alias(name)).agg(F.sum("copies").alias(every), F.count("*").alias(times))
    rows = docs.join(copies, docs["doc_id"].cast("long").eqNullSafe(F.col(name)))
    each = F.floor(F.col(every) / F.col(times)).cast("int")
    return rows.where(each > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), each))).select(*docs.columns)
