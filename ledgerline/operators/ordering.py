"""Global ranks, exact quantiles and exact top fractions without a single-task sort.

The rows are first folded to one row per distinct value (a value that fills a third of the table becomes one row).
The distinct values fall into cells of a fixed logarithmic grid, and a full cell is cut again into equal parts of its own
range, as many as its number of values asks for, so values that lie close together (ids, epoch times, scores near one)
spread as well. A window sums inside each part, and a table with one row per part supplies the offset. Nothing is
sampled or collected, and a recomputed task finds the same parts, since they follow from exact counts and bounds.
The folded table is written once and read by every later step. The tables of cells and of parts go to all tasks in
broadcasts: their rows follow from the range of the values and from one row in `PART_VALUES`, not from the number of rows.
`by` names groups that are few by meaning (models, features, folds); with `many` groups these tables are joined as
adaptive execution sees fit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.scalars import fraction_rows
from ledgerline.session import stored_columns

CELL, PART = "_cell", "_part"
# Distinct values of one part, on average.
PART_VALUES = 65536
# Cells per factor e. A double spans fewer than 1,500 such factors per sign, so a group never has more than about
# 400,000 cells; ordinary data occupies some thousand.
RESOLUTION = 128
_SHIFT = 1 << 23


def grid_cell(value: Column) -> Column:
    """Order-preserving cell of a number: equal or larger values never get a smaller cell.

    Infinity and NaN share the outermost cell (Spark orders NaN last inside it).
    """
    v = value.cast("double")
    step = F.floor(F.least(F.ln(F.abs(v)), F.lit(800.0)) * RESOLUTION) + _SHIFT
    return F.when(v > 0, step).when(v < 0, -step).otherwise(F.lit(0).cast("bigint"))


def cumulative_counts(df: DataFrame, value: str, by: list[str] | None = None,
                      weights: dict[str, Column] | None = None, many: bool = False) -> DataFrame:
    """One row per distinct value: each weight `w`, `w_before` (over smaller values) and `w_total`.

    Exact. `weights` maps output names to per-row numbers, `n` counts rows by default.
    """
    by = list(by or [])
    weights = weights or {"n": F.lit(1)}
    counts, offsets = _counts_and_offsets(df, value, by, weights, many)
    return _running(counts, offsets, value, by, list(weights), many)


def _counts_and_offsets(df: DataFrame, value: str, by: list[str], weights: dict[str, Column], many: bool) -> tuple[DataFrame, DataFrame]:
    """The distinct values with their part, and per part the sums of all earlier parts, of itself and of the group."""
    counts = stored_columns(
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(*[F.sum(w).alias(k) for k, w in weights.items()])
        .withColumn(CELL, grid_cell(F.col(value)))
    )
    counts = _cut_again(counts, value, by, many)
    place = [CELL, PART]
    totals = counts.groupBy(*by, *place).agg(*[F.sum(k).alias(f"_t_{k}") for k in weights])
    group = W.partitionBy(*by)
    earlier = group.orderBy(*place).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(b).alias(f"_k_{b}") for b in by],
        *[F.col(p).alias(f"_k{p}") for p in place],
        *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_off_{k}") for k in weights],
        *[f"_t_{k}" for k in weights],
        *[F.sum(f"_t_{k}").over(group).alias(f"{k}_total") for k in weights],
    )
    return counts, offsets


def _running(counts: DataFrame, offsets: DataFrame, value: str, by: list[str], names: list[str], many: bool) -> DataFrame:
    """Running sums of the distinct values in the parts of `offsets`."""
    match = (F.col(CELL) == F.col(f"_k{CELL}")) & (F.col(PART) == F.col(f"_k{PART}"))
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    inside = W.partitionBy(*by, CELL, PART).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    within = counts.withColumns({f"_in_{k}": F.coalesce(F.sum(k).over(inside), F.lit(0)) for k in names})
    joined = within.join(offsets if many else F.broadcast(offsets), match)
    return joined.select(
        *by,
        value,
        *names,
        *[(F.col(f"_off_{k}") + F.col(f"_in_{k}")).alias(f"{k}_before") for k in names],
        *[f"{k}_total" for k in names],
    )


def _cut_again(counts: DataFrame, value: str, by: list[str], many: bool = False) -> DataFrame:
    """Add the part of the cell: by relative position between the cell's smallest and largest value."""
    v = F.col(value).cast("double")
    spans = counts.groupBy(*by, CELL).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count("*").alias("_m"))
    spans = spans.select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col(CELL).alias("_k_cell"), "_lo", "_hi", "_m")
    match = F.col(CELL) == F.col("_k_cell")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    width = F.col("_hi") - F.col("_lo")
    finite = (width > 0) & (width < F.lit(float("inf"))) & ~F.isnan(width)
    part = F.when(finite, F.floor((v - F.col("_lo")) / width * F.ceil(F.col("_m") / PART_VALUES))).otherwise(F.lit(0).cast("bigint"))
    return counts.join(spans if many else F.broadcast(spans), match).withColumn(PART, part).drop("_lo", "_hi", "_m", "_k_cell", *[f"_k_{b}" for b in by])


def with_average_ranks(df: DataFrame, ranks: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Average rank for ties, ascending from 1, of several columns (`ranks`: value column -> rank column).

    Rows with a NULL value get a NULL rank. A rank table has one row per value, so only the row side of the join can
    be skewed, which adaptive execution splits.
    """
    by = list(by or [])
    out = df
    for i, (value, rank) in enumerate(ranks.items()):
        table = cumulative_counts(df, value, by).select(
            *[F.col(b).alias(f"_r{i}_{b}") for b in by],
            F.col(value).alias(f"_r{i}"),
            (F.col("n_before") + (F.col("n") + 1) / 2).alias(rank),
        )
        match = F.col(value) == F.col(f"_r{i}")
        for b in by:
            match = match & F.col(b).eqNullSafe(F.col(f"_r{i}_{b}"))
        out = out.join(table, match, "left").drop(f"_r{i}", *[f"_r{i}_{b}" for b in by])
    return out


def with_cdf(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Empirical distribution per distinct value: share of rows with at most this value."""
    c = cumulative_counts(df, value, by)
    return c.select(*(by or []), value, "n", ((F.col("n_before") + F.col("n")) / F.col("n_total")).alias("cdf"))


def _at_position(value: str, position: Column) -> Column:
    inside = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
    return F.max(F.when(inside, F.col(value)))


def quantiles(df: DataFrame, value: str, probabilities: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group and one column per named probability.

    Only the parts that hold a wanted position are sorted.
    """
    by = list(by or [])
    counts, offsets = _counts_and_offsets(df, value, by, {"n": F.lit(1)}, False)
    bounds = {name: [f((F.col("n_total") - 1) * F.lit(float(p))) for f in (F.floor, F.ceil)] for name, p in probabilities.items()}
    holds = [(F.col("_off_n") <= at) & (at < F.col("_off_n") + F.col("_t_n")) for pair in bounds.values() for at in pair]
    wanted = offsets.where(reduce(lambda a, b: a | b, holds))
    keys = [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by]
    match = reduce(lambda a, b: a & b, keys, (F.col(CELL) == F.col(f"_k{CELL}")) & (F.col(PART) == F.col(f"_k{PART}")))
    c = _running(counts.join(F.broadcast(wanted), match, "left_semi"), wanted, value, by, ["n"], False)
    aggregates = []
    for name, (low, high) in bounds.items():
        aggregates += [_at_position(value, low).alias(f"_lo_{name}"), _at_position(value, high).alias(f"_hi_{name}")]
    found = c.groupBy(*by).agg(F.max("n_total").alias("_n"), *aggregates)
    columns = []
    for name, p in probabilities.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        columns.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*by, F.col("_n").alias("n_values"), *columns)


def top_fraction(df: DataFrame, score: str, key: str, fraction: float, by: list[str] | None = None) -> DataFrame:
    """The max(1, bround(n * fraction)) rows with the highest score; equal scores are taken in `key` order.

    Two cut values per group (score, then key among the rows on the cut) are found first and fetched, one row per
    group; the selection itself is then a filter, so no task holds or sorts the selected rows. `key` is numeric and
    unique inside a group.
    """
    by = list(by or [])
    groups = by or ["_all"]
    base = (df if by else df.withColumn("_all", F.lit(0))).withColumn("_down", -F.col(score))
    k = fraction_rows("n_total", fraction)
    cut = _fetched(
        cumulative_counts(base, "_down", groups)
        .where((F.col("n_before") < k) & (F.col("n_before") + F.col("n") >= k))
        .select(*groups, F.col("_down").alias("_cut"), (k - F.col("n_before")).alias("_need"))
    )
    on_cut = base.join(F.broadcast(cut), groups).where(F.col("_down") == F.col("_cut"))
    tied = cumulative_counts(on_cut.select(*groups, "_cut", "_need", key), key, [*groups, "_cut", "_need"])
    key_cut = _fetched(
        tied.where((F.col("n_before") < F.col("_need")) & (F.col("n_before") + F.col("n") >= F.col("_need"))).select(
            *groups, "_cut", F.col(key).alias("_key_cut")
        )
    )
    chosen = base.join(F.broadcast(key_cut), groups).where(
        (F.col("_down") < F.col("_cut")) | ((F.col("_down") == F.col("_cut")) & (F.col(key) <= F.col("_key_cut")))
    )
    return chosen.select(*df.columns)


def _fetched(per_group: DataFrame) -> DataFrame:
    """A table with one row per group as a local relation, so later plans do not repeat its computation."""
    return per_group.sparkSession.createDataFrame(per_group.collect(), per_group.schema)
