"""News attachment, sentiment scoring and sentiment features."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import lists as L
from ledgerline.functions import scalars as S
from ledgerline.operators.cleaning import article_matches
from ledgerline.operators.joins import attach_news

MAX_NEWS = 4
# Columns of an older news layout that are removed.
OBSOLETE_COLUMNS = ("news_items_json", "news_sentiment", "news_reasoning")
# Default lexicon of the word scorer.
POSITIVE_WORDS = ("gain", "gains", "growth", "profit", "profits", "strong", "beat", "beats", "upgrade", "record", "rise")
NEGATIVE_WORDS = ("loss", "losses", "decline", "weak", "miss", "misses", "downgrade", "lawsuit", "fall", "risk", "debt")


def _reasoned(articles: DataFrame, companies: DataFrame) -> DataFrame:
    """Articles with their key, year and the first reason that would skip them (before duplicates)."""
    known = companies.select(F.col("ticker").alias("dir_ticker")).distinct().withColumn("_known", F.lit(True))
    typed = articles.withColumns(
        {
            "dir_ticker": F.upper(F.trim("dir_ticker")),
            "published_utc": F.trim(F.coalesce("published_utc", F.lit(""))),
            "description": F.trim(F.coalesce("description", F.lit(""))),
        }
    ).withColumns(
        {
            "published_date": S.parse_date("published_utc"),
            "news_key": S.news_key("id", "article_url", "published_utc", "title"),
        }
    )
    reason = (
        F.when(F.col("_known").isNull(), F.lit("not_in_dataset"))
        .when(~article_matches("dir_ticker", "tickers"), F.lit("mismatched"))
        .when(F.col("published_date").isNull(), F.lit("missing_date"))
        .when(F.col("description") == "", F.lit("missing_description"))
    )
    return typed.join(known, "dir_ticker", "left").withColumns(
        {"reason": reason, "news_target_year": F.year("published_date")}
    )


def usable_articles(articles: DataFrame, companies: DataFrame) -> DataFrame:
    """First arrival per (ticker, year, article key) among the articles that pass every check."""
    ok = _reasoned(articles, companies).where("reason IS NULL")
    first = ok.groupBy("dir_ticker", "news_target_year", "news_key").agg(
        F.min(F.struct("arrival", "published_date", "published_utc", "description")).alias("_a")
    )
    return first.select("dir_ticker", "news_target_year", "news_key", "_a.*")


def newest_articles(articles: DataFrame, companies: DataFrame, n: int = MAX_NEWS) -> DataFrame:
    """Newest `n` per (ticker, year) by date, then time text, then arrival.

    A salted first pass keeps `n` per salt, so a group that holds a third of the articles is spread over many
    tasks and the second pass sees at most `n` rows per salt.
    """
    salts = 64
    a = usable_articles(articles, companies).withColumn("_salt", F.pmod(F.xxhash64("news_key"), F.lit(salts)))
    key = ["dir_ticker", "news_target_year"]
    rank_columns = [-F.unix_date("published_date"), F.desc("published_utc"), F.col("arrival")]
    from pyspark.sql import Window as W

    first = a.withColumn("_r", F.row_number().over(W.partitionBy(*key, "_salt").orderBy(*rank_columns))).where(F.col("_r") <= n)
    return first.withColumn("position", F.row_number().over(W.partitionBy(*key).orderBy(*rank_columns))).where(
        F.col("position") <= n
    ).drop("_r", "_salt")


def news_lists(articles: DataFrame, companies: DataFrame, n: int = MAX_NEWS) -> DataFrame:
    """One row per (ticker, year) with the ordered lists."""
    items = newest_articles(articles, companies, n).groupBy("dir_ticker", "news_target_year").agg(
        F.array_sort(F.collect_list(F.struct("position", "description", "published_utc", F.year("published_date").alias("y")))).alias("_i")
    )
    return items.select(
        F.col("dir_ticker").alias("ticker"),
        "news_target_year",
        F.size("_i").alias("news_count"),
        F.col("_i.description").alias("news_description"),
        F.col("_i.published_utc").alias("news_published_utc"),
        F.col("_i.y").alias("news_year"),
    )


def attach_latest_news(companies: DataFrame, articles: DataFrame, n: int = MAX_NEWS) -> DataFrame:
    """Company rows with up to `n` newest articles of their fiscal year, else of their period's year."""
    keyed = companies.drop(*OBSOLETE_COLUMNS).withColumn(
        "news_target_year", F.coalesce(F.col("fiscal_year"), F.year("period_end"))
    )
    return attach_news(keyed, news_lists(articles, companies, n)).drop("news_target_year")


def attach_audit(articles: DataFrame, companies: DataFrame) -> DataFrame:
    """Count of articles per outcome: kept, duplicate, or the reason they were skipped."""
    r = _reasoned(articles, companies)
    per_key = r.groupBy("reason", F.when(F.col("reason").isNull(), F.struct("dir_ticker", "news_target_year", "news_key")).alias("k")).agg(
        F.count("*").alias("n")
    )
    skipped = per_key.where("reason IS NOT NULL").groupBy("reason").agg(F.sum("n").cast("long").alias("n_articles"))
    used = per_key.where("reason IS NULL").agg(F.count("*").alias("kept"), (F.sum("n") - F.count("*")).cast("long").alias("duplicate"))
    return skipped.unionByName(used.unpivot([], ["kept", "duplicate"], "reason", "n_articles"))


def tokens(text) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: t != "")


def lexicon_score(text, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS) -> Column:
    """(pos - neg) / (pos + neg) over all words of the text, 0 when no word is listed. Row-local, no shuffle."""
    words = tokens(text)
    count = lambda listed: F.size(F.filter(words, lambda t: t.isin(*listed)))
    p, n = count(positive), count(negative)
    return F.coalesce(F.try_divide((p - n).cast("double"), p + n), F.lit(0.0))


def score_articles(lists: DataFrame, keys: list[str], column: str = "news_description", positive=POSITIVE_WORDS,
                   negative=NEGATIVE_WORDS) -> DataFrame:
    """Score list per row, in the order of the article list."""
    scores = F.transform(column, lambda text: lexicon_score(text, positive, negative))
    return lists.select(*keys, F.coalesce(scores, F.array().cast("array<double>")).alias("news_sentiment_score"))


def score_with(lists: DataFrame, keys: list[str], scorer, column: str = "news_description") -> DataFrame:
    """As `score_articles` with any batch scorer `list of texts -> list of floats`, through Arrow batches."""
    flat = lists.select(*keys, F.posexplode(column).alias("pos", "text"))
    schema = T.StructType([*flat.drop("text").schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="text").assign(score=scorer(pdf["text"].tolist()))

    grouped = flat.mapInPandas(run, schema).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "score"))).alias("_s")
    )
    out = lists.select(*keys).join(grouped, keys, "left")
    return out.select(*keys, F.coalesce(F.col("_s.score"), F.array().cast("array<double>")).alias("news_sentiment_score"))


def sentiment_features(df: DataFrame, scores: str = "news_sentiment_score") -> DataFrame:
    """Ten list statistics; 0 for an empty list."""
    a = F.coalesce(F.col(scores), F.array().cast("array<double>"))
    d = df.withColumn("_a", a)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return d.withColumns(
        {
            "news_sentiment_mean": zero(L.list_mean("_a")),
            "news_sentiment_std": zero(L.list_std("_a")),
            "news_sentiment_min": zero(F.array_min("_a")),
            "news_sentiment_max": zero(F.array_max("_a")),
            "news_sentiment_last": zero(F.try_element_at("_a", F.lit(-1))),
            "news_sentiment_sum": L.list_sum("_a"),
            "news_sentiment_pos_share": zero(L.list_share("_a", lambda x: x > 0)),
            "news_sentiment_neg_share": zero(L.list_share("_a", lambda x: x < 0)),
            "news_sentiment_nonzero_share": zero(L.list_share("_a", lambda x: x != 0)),
            "has_news_sentiment": (F.size("_a") > 0).cast("double"),
        }
    ).drop("_a")


def news_features(df: DataFrame, scores: str = "news_sentiment_score", texts: str = "news_description") -> DataFrame:
    """Twelve features from a score list and a text list."""
    d = df.withColumns(
        {
            "_a": F.coalesce(F.col(scores), F.array().cast("array<double>")),
            "_n": F.coalesce(F.size(scores), F.lit(0)).cast("double"),
            "_t": F.coalesce(F.size(texts), F.lit(0)).cast("double"),
        }
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    magnitude = F.transform("_a", lambda x: F.abs(x))
    coverage = F.when(F.col("_t") > 0, F.col("_n") / F.col("_t")).otherwise((F.col("_n") > 0).cast("double"))
    return d.withColumns(
        {
            "news_items_n": F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.col("_t")),
            "news_items_from_scores_n": F.col("_n"),
            "news_items_from_text_n": F.col("_t"),
            "news_sent_mean": zero(L.list_mean("_a")),
            "news_sent_min": zero(F.array_min("_a")),
            "news_sent_max": zero(F.array_max("_a")),
            "news_sent_std": zero(L.list_std("_a")),
            "news_sent_sum": L.list_sum("_a"),
            "news_sent_abs_mean": zero(L.list_mean(magnitude)),
            "news_sent_pos_share": zero(L.list_share("_a", lambda x: x > 0)),
            "news_sent_neg_share": zero(L.list_share("_a", lambda x: x < 0)),
            "news_sent_text_coverage": coverage,
        }
    ).drop("_a", "_n", "_t")


def news_coverage(df: DataFrame, scores: str = "news_sentiment_score", texts: str = "news_description") -> DataFrame:
    n, t = F.coalesce(F.size(scores), F.lit(0)), F.coalesce(F.size(texts), F.lit(0))
    return df.agg(
        F.count("*").alias("rows_total"),
        F.count_if(t > 0).alias("rows_with_text_items"),
        F.count_if(n > 0).alias("rows_with_score_items"),
        F.count_if((t == 0) & (n == 0)).alias("rows_without_text_and_scores"),
        F.count_if((t > 0) & (n > 0) & (t != n)).alias("rows_with_text_score_length_mismatch"),
        F.sum(t).cast("long").alias("total_text_items"),
        F.sum(n).cast("long").alias("total_score_items"),
    )


def ingest_metadata(incoming: DataFrame, written: DataFrame, start: str, end: str) -> DataFrame:
    """Per directory ticker: articles seen, skipped as out of range or without a readable date, and newly stored.

    Both inputs fold map-side to one row per ticker. A ticker whose articles were all seen before has 0 new ones.
    """
    day = S.parse_date("published_utc")
    inside = F.coalesce(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))
    seen = incoming.groupBy("dir_ticker").agg(F.count("*").alias("seen_total"), F.count_if(~inside).alias("out_of_range_skipped"))
    stored = written.groupBy(F.col("dir_ticker").alias("_ticker")).agg(F.count("*").alias("new_items_written"))
    out = seen.join(stored, F.col("dir_ticker").eqNullSafe(F.col("_ticker")), "left").drop("_ticker")
    return out.withColumns({"new_items_written": F.coalesce("new_items_written", F.lit(0)), "since": F.lit(start), "until": F.lit(end)})


def new_articles(incoming: DataFrame, stored_keys: DataFrame, start: str, end: str, cap: int | None = None) -> DataFrame:
    """Incremental ingest: in range, not stored yet, first arrival per key.

    `cap` is the per-run fetch limit of a ticker; articles beyond it stay unstored and come with the next run.
    """
    from ledgerline.operators.cleaning import keep_first, published_between

    keyed = published_between(incoming, start, end).withColumn("news_key", S.news_key("id", "article_url", "published_utc", "title"))
    fresh = keep_first(keyed, ["dir_ticker", "news_key"], ["arrival"]).join(stored_keys, ["dir_ticker", "news_key"], "left_anti")
    if cap is None:
        return fresh
    from pyspark.sql import Window as W

    salted = fresh.withColumn("_salt", F.pmod(F.xxhash64("news_key"), F.lit(64)))
    near = salted.withColumn("_r", F.row_number().over(W.partitionBy("dir_ticker", "_salt").orderBy("arrival"))).where(F.col("_r") <= cap)
    return (
        near.withColumn("_r", F.row_number().over(W.partitionBy("dir_ticker").orderBy("arrival")))
        .where(F.col("_r") <= cap)
        .drop("_r", "_salt")
    )
