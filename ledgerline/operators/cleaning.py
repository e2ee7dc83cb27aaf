"""Key cleaning, deduplication, filters and key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S


def resolve_column(columns: list[str], candidates: list[str], required: bool = True) -> str | None:
    """First candidate that occurs, compared without case."""
    known = {c.lower(): c for c in columns}
    hit = next((known[c.lower()] for c in candidates if c.lower() in known), None)
    if hit is None and required:
        raise ValueError(f"expected one of {candidates}; the table has {columns}")
    return hit


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]], optional: tuple[str, ...] = ()) -> DataFrame:
    """Select logical columns from whatever physical names occur."""
    chosen = {name: resolve_column(df.columns, cands, name not in optional) for name, cands in wanted.items()}
    return df.select(*[F.col(src).alias(name) for name, src in chosen.items() if src])


def union_sources(frames: dict[str, DataFrame], tag: str = "source_dataset") -> DataFrame:
    tagged = [f.withColumn(tag, F.lit(name)) for name, f in frames.items()]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_timeframe(df: DataFrame, timeframe: str = "annual", column: str = "timeframe") -> DataFrame:
    return df.where(F.lower(F.trim(F.col(column))) == timeframe.lower())


def drop_missing_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.na.drop(subset=keys)


def _fold(df: DataFrame, keys: list[str], order: list[Column], pick) -> DataFrame:
    """One row per key by a struct extreme: folded map-side, so a hot key never meets in one task as rows.
    `order` must be total for the result to be reproducible; the whole row is the last tiebreak."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row"))
    folded = df.groupBy(*keys).agg(pick(ranked).alias("_best"))
    return folded.select(*keys, *[F.col(f"_best._row.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _fold(df, keys, [F.col(c) for c in order], F.max)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _fold(df, keys, [F.col(c) for c in order], F.min)


def clean_observations(df: DataFrame, timeframe: str | None = "annual", order: tuple[str, ...] = ("fiscal_year",)) -> DataFrame:
    """Normalized keys, one timeframe, no missing key, one row per (ticker, period_end)."""
    out = df.withColumn("ticker", S.normalize_ticker("ticker"))
    if timeframe:
        out = keep_timeframe(out, timeframe)
    return keep_latest(drop_missing_keys(out, ["ticker", "period_end"]), ["ticker", "period_end"], list(order))


def cleaning_audit(df: DataFrame, timeframe: str = "annual") -> DataFrame:
    """Counts of one cleaning pass: read, after the filter, dropped for a missing key, folded duplicates, kept."""
    flagged = df.select(
        S.normalize_ticker("ticker").alias("ticker"),
        "period_end",
        (F.lower(F.trim("timeframe")) == timeframe).alias("keep"),
    ).withColumn("valid", F.col("keep") & F.col("ticker").isNotNull() & F.col("period_end").isNotNull())
    per_key = flagged.groupBy("ticker", "period_end", "keep", "valid").agg(F.count("*").alias("n"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows_read"),
        count(F.col("keep")).alias("rows_after_filter"),
        count(F.col("keep") & ~F.col("valid")).alias("rows_dropped_invalid"),
        (count(F.col("valid")) - F.count_if("valid")).alias("rows_deduplicated"),
        F.count_if("valid").alias("rows_kept"),
    )


def only_requested(df: DataFrame, requested: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows whose key is requested. Spark broadcasts the key list when it is small and shuffles when it is not."""
    return df.join(requested.select(key).distinct(), key, "left_semi")


# Identifier columns that travel with predictions and reports.
CARRIED = ["ticker", "cik", "fiscal_year", "period_end", "timeframe", "split"]


def carried_columns(df: DataFrame) -> list[str]:
    """The identifier columns this table has."""
    return [c for c in CARRIED if c in df.columns]


def without(df: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(excluded.select(*keys).distinct(), keys, "left_anti")


def first_tickers(df: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    """Rows of the first `n` tickers in sort order; Spark knows the limit and broadcasts the list only if it is small."""
    wanted = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(wanted, key, "left_semi")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The `n` rows whose seeded digest of the key is smallest: the same rows on any cluster and in any layout."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"duplicate keys {keys}")
    return df


def deduplicate_entity_period(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row per (ticker, period_end), latest in `order`, and the counts of what was folded."""
    keys = ["ticker", "period_end"]
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    audit = counts.agg(
        F.sum("n").cast("long").alias("rows_before"),
        F.count("*").alias("rows_after"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        (F.sum("n") - F.count("*")).cast("long").alias("rows_dropped"),
    )
    return keep_latest(df, keys, order), audit


def prediction_rows(df: DataFrame, split: str | None, models: list[str], keys: list[str]) -> DataFrame:
    out = df if split in (None, "all") else df.where(F.lower(F.trim("split")) == split)
    out = out.withColumns({c: S.to_number(c) for c in ["y_true", *models]})
    return out.na.drop(subset=[*keys, "y_true", *models])


def matching_articles(df: DataFrame, keep_mismatched: bool = False) -> DataFrame:
    return df if keep_mismatched else df.where(article_matches("dir_ticker", "tickers"))


def article_matches(ticker, tickers) -> Column:
    from ledgerline.functions.lists import ticker_list

    listed = ticker_list(tickers)
    return (F.size(listed) == 0) | F.array_contains(listed, F.col(ticker))


def published_between(df: DataFrame, start: str, end: str, column: str = "published_utc") -> DataFrame:
    return df.where(S.parse_date(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def latest_years(df: DataFrame, n: int, ticker: str = "ticker", year: str = "fiscal_year") -> DataFrame:
    """Rows of the latest `n` fiscal years of a ticker; rows without a year stay.

    Years are ranked on the distinct (ticker, year) pairs, a few per ticker, and joined back.
    """
    pairs = df.where(F.col(year).isNotNull()).select(ticker, year).distinct()
    w = W.partitionBy(ticker).orderBy(F.desc(year))
    old = pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > n).select(ticker, year)
    return df.join(old, [ticker, year], "left_anti")
