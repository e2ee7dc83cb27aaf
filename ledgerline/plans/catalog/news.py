"""Queries over articles, list texts and sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import lists as L
from ledgerline.functions import scalars as S
from ledgerline.operators import cleaning as C
from ledgerline.operators import news as N
from ledgerline.plans.catalog import query
from ledgerline.plans.catalog.ctes import with_parts
from ledgerline.plans.catalog.shared import R, rounded
from ledgerline.sources.sinks import csv_ready
from ledgerline.sources.tables import DEMO_NEGATIVE, DEMO_POSITIVE
from ledgerline.streaming.feeds import first_articles

_KEY = "coalesce(nullif(id, ''), sha256(coalesce(article_url, '') || '|' || coalesce(published_utc, '') || '|' || coalesce(title, '')))"
_MATCH = "(len(tickers) = 0 OR list_contains(list_transform(tickers, lambda x: upper(trim(x))), dir_ticker))"
_PARTS = {
    "typed": "SELECT * REPLACE (trim(coalesce(published_utc, '')) AS published_utc, trim(coalesce(description, '')) AS description) FROM articles",
    "reasoned": f"""SELECT *, {_KEY} AS news_key, try_cast(substr(published_utc, 1, 10) AS DATE) AS published_date,
        CASE WHEN dir_ticker NOT IN (SELECT ticker FROM base) THEN 'not_in_dataset' WHEN NOT {_MATCH} THEN 'mismatched'
             WHEN try_cast(substr(published_utc, 1, 10) AS DATE) IS NULL THEN 'missing_date' WHEN description = '' THEN 'missing_description' END AS reason FROM typed""",
    "uniq": "SELECT *, CAST(year(published_date) AS INTEGER) AS y FROM reasoned WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY dir_ticker, year(published_date), news_key ORDER BY arrival) = 1",
    "newest": "SELECT *, row_number() OVER (PARTITION BY dir_ticker, y ORDER BY published_date DESC, published_utc DESC, arrival) AS position FROM uniq QUALIFY position <= 4",
}
_COUNT_WORDS = lambda words: f"len(list_filter(regexp_split_to_array(lower(description), '[^a-z]+'), lambda t: t IN ({', '.join(repr(w) for w in words)})))"
_SCORED = {
    **_PARTS,
    "counted": f"SELECT *, {_COUNT_WORDS(DEMO_POSITIVE)} AS p, {_COUNT_WORDS(DEMO_NEGATIVE)} AS n FROM newest",
    "scored": "SELECT *, CASE WHEN p + n = 0 THEN 0.0 ELSE CAST(p - n AS DOUBLE) / (p + n) END AS score FROM counted",
    "lists_": "SELECT dir_ticker AS ticker, y AS fiscal_year, list(score ORDER BY position) AS s, CAST(count(*) AS DOUBLE) AS k FROM scored GROUP BY 1, 2",
    "company_lists": "SELECT b.ticker, b.fiscal_year, coalesce(l.s, CAST([] AS DOUBLE[])) AS s, coalesce(l.k, 0) AS k FROM base b LEFT JOIN lists_ l ON l.ticker = b.ticker AND l.fiscal_year = b.fiscal_year",
}
KEYS_SQL = "ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year"


@query("B14_news_key", with_parts("articles", f"SELECT arrival, {_KEY} AS news_key FROM articles"))
def _(t):
    return t.articles.select("arrival", S.news_key("id", "article_url", "published_utc", "title").alias("news_key"))


@query("C4_keep_first", with_parts("base articles", "SELECT arrival, dir_ticker, CAST(y AS BIGINT) AS news_target_year, news_key FROM uniq", _PARTS))
def _(t):
    return rounded(N.usable_articles(t.articles, t.companies).select("arrival", "dir_ticker", "news_target_year", "news_key"))


@query("C12_matching_articles", with_parts("articles", f"SELECT arrival FROM articles WHERE {_MATCH}"))
def _(t):
    return C.matching_articles(t.articles).select("arrival")


@query("C13_published_range", with_parts("articles", "SELECT arrival FROM articles WHERE try_cast(substr(published_utc, 1, 10) AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1999-06-30'"))
def _(t):
    return C.published_between(t.articles, "1996-03-01", "1999-06-30").select("arrival")


@query("G3_newest_per_group", with_parts("base articles", "SELECT dir_ticker, CAST(y AS BIGINT) AS news_target_year, position, arrival FROM newest", _PARTS))
def _(t):
    return rounded(N.newest_articles(t.articles, t.companies).select("dir_ticker", "news_target_year", "position", "arrival"))


_NEWS_LISTS = """SELECT dir_ticker AS ticker, y AS fiscal_year, count(*) AS news_count, string_agg(sha256(description), ',' ORDER BY position) AS digests,
    string_agg(published_utc, ',' ORDER BY position) AS times, string_agg(CAST(y AS VARCHAR), ',' ORDER BY position) AS years FROM newest GROUP BY 1, 2"""


@query("D11_news_lookup", with_parts("base articles", "SELECT b.ticker, CAST(b.fiscal_year AS BIGINT) AS fiscal_year, coalesce(n.news_count, 0) AS news_count, coalesce(n.times, '') AS times FROM base b LEFT JOIN grouped n ON n.ticker = b.ticker AND n.fiscal_year = b.fiscal_year", {**_PARTS, "grouped": _NEWS_LISTS}))
def _(t):
    out = N.attach_latest_news(t.companies, t.articles)
    return rounded(out.select("ticker", "fiscal_year", "news_count", F.array_join("news_published_utc", ",").alias("times")))


@query("M1_attach_news", with_parts("base articles", "SELECT b.ticker, CAST(b.fiscal_year AS BIGINT) AS fiscal_year, coalesce(n.news_count, 0) AS news_count, coalesce(n.digests, '') AS digests, coalesce(n.times, '') AS times, coalesce(n.years, '') AS years FROM base b LEFT JOIN grouped n ON n.ticker = b.ticker AND n.fiscal_year = b.fiscal_year", {**_PARTS, "grouped": _NEWS_LISTS}))
def _(t):
    out = N.attach_latest_news(t.companies, t.articles)
    digest = F.array_join(F.transform("news_description", lambda x: F.sha2(x, 256)), ",")
    years = F.array_join(F.transform("news_year", lambda y: y.cast("string")), ",")
    return rounded(out.select("ticker", "fiscal_year", "news_count", digest.alias("digests"), F.array_join("news_published_utc", ",").alias("times"), years.alias("years")))


@query("M2_attach_audit", with_parts("base articles", """SELECT reason, count(*) AS n_articles FROM reasoned WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'kept', count(*) FROM uniq
    UNION ALL SELECT 'duplicate', (SELECT count(*) FROM reasoned WHERE reason IS NULL) - (SELECT count(*) FROM uniq)""", _PARTS))
def _(t):
    return N.attach_audit(t.articles, t.companies)


@query("M3_news_columns", with_parts("base", f"SELECT {KEYS_SQL}, 0 AS obsolete FROM base"))
def _(t):
    old = t.companies.withColumns({c: F.lit("x") for c in N.OBSOLETE_COLUMNS})
    out = N.attach_latest_news(old, t.articles)
    left = F.lit(sum(c in out.columns for c in N.OBSOLETE_COLUMNS)).cast("int")
    return rounded(out.select("ticker", "fiscal_year")).withColumn("obsolete", left)


def _scored(t):
    lists = N.attach_latest_news(t.companies, t.articles).select("ticker", "fiscal_year", "news_description")
    scores = N.score_articles(lists, ["ticker", "fiscal_year"], positive=DEMO_POSITIVE, negative=DEMO_NEGATIVE)
    return scores, lists


@query("M4_article_scores", with_parts("base articles", f"SELECT {KEYS_SQL}, coalesce(list_aggregate(list_transform(s, lambda x: printf('%.12f', x)), 'string_agg', ','), '') AS scores FROM company_lists", _SCORED))
def _(t):
    text = F.array_join(F.transform("news_sentiment_score", lambda x: F.format_string("%.12f", x)), ",")
    return rounded(_scored(t)[0].select("ticker", "fiscal_year", text.alias("scores")))


@query("M4_document_scores", f"SELECT doc_id, {R('CASE WHEN p + n = 0 THEN 0.0 ELSE CAST(p - n AS DOUBLE) / (p + n) END', 6, 'score')} FROM (SELECT doc_id, {_COUNT_WORDS(DEMO_POSITIVE).replace('description', 'text')} AS p, {_COUNT_WORDS(DEMO_NEGATIVE).replace('description', 'text')} AS n FROM documents)")
def _(t):
    return rounded(t.read("documents").select("doc_id", N.lexicon_score("text", DEMO_POSITIVE, DEMO_NEGATIVE).alias("score")))


def _share(test: str) -> str:
    return f"CASE WHEN len(s) = 0 THEN 0 ELSE CAST(len(list_filter(s, lambda x: x {test})) AS DOUBLE) / len(s) END"


_SENTIMENT = {
    "mean": "coalesce(list_avg(s), 0)", "std": "coalesce(list_stddev_pop(s), 0)", "min": "coalesce(list_min(s), 0)", "max": "coalesce(list_max(s), 0)",
    "last": "coalesce(s[-1], 0)", "sum": "coalesce(list_sum(s), 0)", "pos_share": _share("> 0"), "neg_share": _share("< 0"), "nonzero_share": _share("<> 0"),
}


@query("M5_sentiment_features", with_parts("base articles", f"SELECT {KEYS_SQL}, {', '.join(R(e, 6, 'news_sentiment_' + n) for n, e in _SENTIMENT.items())}, CAST(len(s) > 0 AS DOUBLE) AS has_news_sentiment FROM company_lists", _SCORED))
def _(t):
    return rounded(N.sentiment_features(_scored(t)[0]).drop("news_sentiment_score"))


def _news_table(t):
    """Score lists next to text lists; rows of early years lost their scores."""
    scores, lists = _scored(t)
    both = scores.join(lists, ["ticker", "fiscal_year"])
    return both.withColumn("news_sentiment_score", F.when(F.col("fiscal_year") > 1996, F.slice("news_sentiment_score", 1, 3)))


_TRIMMED = {**_SCORED, "trimmed": "SELECT ticker, fiscal_year, k, CASE WHEN fiscal_year > 1996 THEN s[1:3] ELSE CAST([] AS DOUBLE[]) END AS s FROM company_lists"}
_B_SQL = {
    "news_items_n": "CASE WHEN len(s) > 0 THEN len(s) ELSE k END", "news_items_from_scores_n": "len(s)", "news_items_from_text_n": "k",
    "news_sent_mean": "coalesce(list_avg(s), 0)", "news_sent_min": "coalesce(list_min(s), 0)", "news_sent_max": "coalesce(list_max(s), 0)",
    "news_sent_std": "coalesce(list_stddev_pop(s), 0)", "news_sent_sum": "coalesce(list_sum(s), 0)", "news_sent_abs_mean": "coalesce(list_avg(list_transform(s, lambda x: abs(x))), 0)",
    "news_sent_pos_share": _share("> 0"), "news_sent_neg_share": _share("< 0"),
    "news_sent_text_coverage": "CASE WHEN k > 0 THEN len(s) / k WHEN len(s) > 0 THEN 1 ELSE 0 END",
}


@query("M6_news_features", with_parts("base articles", f"SELECT {KEYS_SQL}, {', '.join(R(e, 6, n) for n, e in _B_SQL.items())} FROM trimmed", _TRIMMED))
def _(t):
    return rounded(N.news_features(_news_table(t)).drop("news_sentiment_score", "news_description"))


@query("M7_news_coverage", with_parts("base articles", """SELECT count(*) AS rows_total, count(*) FILTER (k > 0) AS rows_with_text_items, count(*) FILTER (len(s) > 0) AS rows_with_score_items,
    count(*) FILTER (k = 0 AND len(s) = 0) AS rows_without_text_and_scores, count(*) FILTER (k > 0 AND len(s) > 0 AND k <> len(s)) AS rows_with_text_score_length_mismatch,
    CAST(sum(k) AS BIGINT) AS total_text_items, CAST(sum(len(s)) AS BIGINT) AS total_score_items FROM trimmed""", _TRIMMED))
def _(t):
    return N.news_coverage(_news_table(t))


# --- list texts over real events: JSON, quoted literals, bare numbers, junk and missing cells ------------------------

def _cells(t):
    v = F.col("value").cast("string")
    text = (F.when(F.col("event_type") == "click", F.concat(F.lit("["), v, F.lit(", 1, \"x\", NaN]")))
            .when(F.col("event_type") == "view", F.concat(F.lit("['"), v, F.lit("', None, '-2.5']")))
            .when(F.col("event_type") == "error", v).when(F.col("event_type") == "signup", F.lit("not a list")))
    return t.day_events.select("event_id", text.alias("cell"))


def _text_of(items):
    return F.array_join(F.transform(items, lambda x: F.format_string("%.4f", x)), ",")


_JSON_CASE = "CASE WHEN event_type = 'click' THEN printf('%.4f', value) || ',1.0000' WHEN event_type = 'view' THEN printf('%.4f', value) || ',-2.5000' {0} ELSE '' END"


@query("I1_parse_list", "SELECT event_id, CAST(CASE WHEN event_type = 'click' THEN 4 WHEN event_type = 'view' THEN 3 ELSE 0 END AS BIGINT) AS n_items FROM events")
def _(t):
    return _cells(t).select("event_id", F.size(L.parse_list("cell")).cast("bigint").alias("n_items"))


@query("I2_parse_score_list", f"SELECT event_id, {_JSON_CASE.format('')} AS scores FROM events")
def _(t):
    return _cells(t).select("event_id", _text_of(L.parse_score_list("cell")).alias("scores"))


@query("I3_parse_scores", "SELECT event_id, " + _JSON_CASE.format("WHEN event_type = 'error' THEN printf('%.4f', value)") + " AS scores FROM events")
def _(t):
    return _cells(t).select("event_id", _text_of(L.parse_scores("cell")).alias("scores"))


@query("I4_parse_texts", "SELECT p_partkey, p_name || '|' || p_type || ', ' || p_brand AS texts FROM part")
def _(t):
    cell = F.concat(F.col("p_name"), F.lit(', "'), F.col("p_type"), F.lit(", "), F.col("p_brand"), F.lit('", '))
    return t.read("part").select("p_partkey", F.array_join(L.parse_texts(cell), "|").alias("texts"))


@query("I5_ticker_list", with_parts("articles", "SELECT arrival, CASE WHEN len(tickers) = 0 THEN '' WHEN len(tickers) = 1 THEN tickers[1] ELSE upper(tickers[1]) || ',OTHER' END AS listed FROM articles"))
def _(t):
    return t.articles.select("arrival", F.array_join(L.ticker_list("tickers"), ",").alias("listed"))


@query("I6_flatten_and_regroup", "SELECT doc_id, string_agg(CAST(len(s) AS VARCHAR), ',' ORDER BY i) AS sentence_lengths FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS i FROM documents) GROUP BY 1")
def _(t):
    flat = t.read("documents").select("doc_id", F.posexplode(F.split("text", "[.]")).alias("pos", "s"))
    back = flat.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.char_length("s").cast("string").alias("n")))).alias("a"))
    return back.select("doc_id", F.array_join("a.n", ",").alias("sentence_lengths"))


@query("I7_json_lists", "SELECT conv_id, '[' || string_agg('\"' || role || '\"', ',' ORDER BY turn) || ']' AS roles FROM conversations GROUP BY 1")
def _(t):
    c = t.read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role")))["role"].alias("roles"))
    return csv_ready(c)


@query("I8_issue_codes", """SELECT o_orderkey, codes, CASE WHEN codes = '' THEN 'ok' ELSE split_part(codes, ';', 1) END AS status FROM (SELECT o_orderkey, concat_ws(';', CASE WHEN o_totalprice > 300000 THEN 'large' END,
    CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END) AS codes FROM orders)""")
def _(t):
    codes = L.issue_codes([("large", F.col("o_totalprice") > 300000), ("pending", F.col("o_orderstatus") == "P"), ("urgent", F.col("o_orderpriority") == "1-URGENT")])
    return t.read("orders").select("o_orderkey", L.joined_codes(codes, ";").alias("codes"), L.leading_status(codes).alias("status"))


_KEYED = {"keyed": f"SELECT *, {_KEY} AS nk FROM articles"}
_INGESTED = """SELECT * FROM keyed k WHERE try_cast(substr(published_utc, 1, 10) AS DATE) BETWEEN DATE '1997-01-01' AND DATE '2001-12-31'
    AND NOT EXISTS (SELECT 1 FROM keyed s WHERE s.title LIKE 'A%' AND s.dir_ticker = k.dir_ticker AND s.nk = k.nk)
    QUALIFY row_number() OVER (PARTITION BY dir_ticker, nk ORDER BY arrival) = 1"""


def _ingested(t):
    a = t.articles
    stored = a.where(F.col("title").startswith("A")).select("dir_ticker", S.news_key("id", "article_url", "published_utc", "title").alias("news_key")).distinct()
    return N.new_articles(a, stored, "1997-01-01", "2001-12-31")


@query("M8_incremental_ingest", with_parts("articles", f"SELECT arrival FROM ({_INGESTED})", _KEYED))
def _(t):
    return _ingested(t).select("arrival")


@query("M8_ingest_metadata", with_parts("articles", """SELECT a.dir_ticker, count(*) AS seen_total, count(*) FILTER (coalesce(try_cast(substr(published_utc, 1, 10) AS DATE) NOT BETWEEN DATE '1997-01-01' AND DATE '2001-12-31', true)) AS out_of_range_skipped,
    (SELECT count(*) FROM ingested i WHERE i.dir_ticker = a.dir_ticker) AS new_items_written, '1997-01-01' AS since, '2001-12-31' AS until FROM articles a GROUP BY a.dir_ticker""", {**_KEYED, "ingested": _INGESTED}))
def _(t):
    return N.ingest_metadata(t.articles, _ingested(t), "1997-01-01", "2001-12-31")


@query("T2_article_feed", with_parts("articles", f"SELECT arrival, dir_ticker, {_KEY} AS news_key FROM articles QUALIFY row_number() OVER (PARTITION BY dir_ticker, {_KEY} ORDER BY arrival) = 1"))
def _(t):
    return first_articles(t.articles).select("arrival", "dir_ticker", "news_key")
