"""Readers for the file layouts of bars, statements, news, datasets and ticker lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import scalars as S
from ledgerline.operators.cleaning import keep_latest, resolve_column

# Accepted column names of a daily file, first match wins.
BAR_COLUMNS = {
    "ticker": ["ticker", "symbol", "sym_root", "sym"],
    "close": ["close", "c"],
    "high": ["high", "h"],
    "low": ["low", "l"],
    "volume": ["volume", "v"],
    "transactions": ["transactions", "n"],
    "raw_date": ["date", "window_start", "timestamp", "t"],
}
OPTIONAL_BAR_COLUMNS = ("volume", "transactions", "raw_date")

NEWS_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "article_url", "published_utc", "title", "description")]
    + [T.StructField("tickers", T.ArrayType(T.StringType())), T.StructField("_corrupt", T.StringType())]
)


def file_date(name: Column) -> Column:
    """Trade date of a file called `<ISO date>.csv` or `.csv.gz`; NULL for any other name."""
    return F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})\.csv(\.gz)?$", 1).try_cast("date")


def path_ticker(level: int) -> Column:
    """Directory name `level` steps above the file."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    name = F.try_element_at(parts, F.lit(-1 - level))
    return S.normalize_ticker(F.replace(name, F.lit("__SLASH__"), F.lit("/")))


def csv_fields(line: Column) -> Column:
    """Fields of a CSV line; commas inside double quotes don't part."""
    fields = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(fields, lambda x: F.regexp_replace(F.trim(x), r'^"(.*)"$', "$1"))


def daily_bars(lines: DataFrame) -> DataFrame:
    """Lines of daily files (path, name, at_block, at_line, value, ...) to typed bars; other columns stay.

    Each file's first line names its columns, in any accepted naming and order, so files with different headers may be
    mixed. Files whose name is no date are skipped; a file without a ticker or close column is an error.
    """
    dated = lines.where(file_date(F.col("name")).isNotNull() & (F.trim("value") != ""))
    first = dated.groupBy("path").agg(F.min(F.struct("at_block", "at_line", "value")).alias("_first"))
    rows = dated.join(first, "path").where((F.col("at_block") != F.col("_first.at_block")) | (F.col("at_line") != F.col("_first.at_line")))
    header = F.transform(csv_fields(F.regexp_replace("_first.value", "^\\x{FEFF}", "")), lambda x: F.lower(F.trim(x)))
    rows = rows.withColumns({"_names": header, "_cells": csv_fields(F.col("value"))})

    def cell(column: str) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name in BAR_COLUMNS[column]:
            at = F.array_position("_names", name)
            out = out.when(at > 0, F.get("_cells", (at - 1).cast("int")))
        if column in OPTIONAL_BAR_COLUMNS:
            return out
        return out.otherwise(F.raise_error(F.concat(F.lit(f"no column for {column} in "), F.col("path"))))

    date = F.coalesce(S.trade_date(cell("raw_date")), file_date(F.col("name")))
    keep = [c for c in lines.columns if c not in ("value", "name")]
    return rows.select(
        S.normalize_ticker(cell("ticker")).alias("ticker"), date.alias("date"),
        *[S.to_number(cell(n)).alias(n) for n in ("close", "high", "low", "volume", "transactions")], *keep,
    )


DAILY_NAMES = "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9].csv*"
FILE_COLUMNS = {"path": "_metadata.file_path", "name": "_metadata.file_name", "at_block": "_metadata.file_block_start"}


def read_daily_files(spark: SparkSession, root: str, tickers: DataFrame | None = None) -> DataFrame:
    """Flat daily files below `root`; the last row of a (ticker, date) in file order stays."""
    raw = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter=DAILY_NAMES)
    lines = raw.select("value", *[F.col(c).alias(n) for n, c in FILE_COLUMNS.items()], F.monotonically_increasing_id().alias("at_line"))
    kept = daily_bars(lines).na.drop(subset=["ticker", "date", "close"])
    if tickers is not None:
        kept = kept.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    return keep_latest(kept, ["ticker", "date"], ["path", "at_block", "at_line"]).drop("path", "at_block", "at_line")


def read_ticker_day_json(spark: SparkSession, root: str) -> DataFrame:
    """Layout <ticker>/<YYYY-MM>/<DD>.json with one bar per file; date from the document, else the path, else epoch."""
    schema = "close double, c double, `from` string, `date` string, t string, window_start string"
    raw = spark.read.schema(schema).json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    path = F.col("_metadata.file_path")
    path_date = F.concat_ws("-", F.regexp_extract(path, r"/(\d{4}-\d{2})/\d{2}\.json$", 1), F.regexp_extract(path, r"/(\d{2})\.json$", 1))
    date = F.coalesce(S.parse_date("from"), S.parse_date("date"), path_date.try_cast("date"), S.trade_date("t"), S.trade_date("window_start"))
    bars = raw.select(path_ticker(2).alias("ticker"), date.alias("date"), F.coalesce(S.finite("close"), S.finite("c")).alias("close"), path.alias("_path"))
    return keep_latest(bars.na.drop(), ["ticker", "date"], ["_path"]).drop("_path")


def read_ticker_files(spark: SparkSession, root: str) -> DataFrame:
    """Layout <ticker>.csv with `date` and `close`."""
    raw = spark.read.csv(root, header=True, pathGlobFilter="*.csv")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    bars = raw.select(S.normalize_ticker(name).alias("ticker"), S.parse_date("date").alias("date"), S.to_number("close").alias("close"),
                      F.monotonically_increasing_id().alias("_line"))
    return keep_latest(bars.na.drop(), ["ticker", "date"], ["_line"]).drop("_line")


def list_files(spark: SparkSession, root: str, pattern: str) -> bool:
    """Whether a file matching the pattern lies below root, through Spark's file listing (any file system)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return not found.select("path").limit(1).isEmpty()


def detect_layout(spark: SparkSession, root: str) -> str:
    """daily_flatfiles, ticker_daily_json, ticker_files or missing, probed in this order."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return "missing"
    if list_files(spark, root, "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9].csv*"):
        return "daily_flatfiles"
    if list_files(spark, root, "[0-9][0-9].json"):
        return "ticker_daily_json"
    return "ticker_files" if list_files(spark, root, "*.csv") else "missing"


def read_bars(spark: SparkSession, root: str) -> DataFrame:
    """Bars from whichever layout the directory has; an empty table when it has none."""
    reader = {"daily_flatfiles": read_daily_files, "ticker_daily_json": read_ticker_day_json, "ticker_files": read_ticker_files}
    layout = detect_layout(spark, root)
    if layout == "missing":
        return spark.createDataFrame([], "ticker string, date date, close double")
    return reader[layout](spark, root)


def read_statements(spark: SparkSession, root: str, fields: list[str]) -> DataFrame:
    """One JSON document per ticker with a `results` list; unreadable documents give no rows.

    The schema is given, not inferred, so the files are read once.
    """
    entry = T.StructType([T.StructField(n, T.StringType()) for n in ("fiscal_year", "period_end", "cik")] + [T.StructField(f, T.DoubleType()) for f in fields])
    schema = T.StructType([T.StructField("results", T.ArrayType(entry))])
    raw = spark.read.schema(schema).json(root, multiLine=True, mode="PERMISSIVE", recursiveFileLookup=True, pathGlobFilter="*.json")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    docs = raw.select(S.normalize_ticker(F.replace(name, F.lit("__SLASH__"), F.lit("/"))).alias("ticker"), "results")
    return docs.select("ticker", F.posexplode("results").alias("position", "row")).select("ticker", "position", "row.*")


def read_news(spark: SparkSession, root: str) -> DataFrame:
    """Layout <ticker>/news.jsonl; `malformed` marks lines that are no JSON, blank lines are skipped by the reader."""
    raw = spark.read.schema(NEWS_SCHEMA).json(root, recursiveFileLookup=True, pathGlobFilter="*.jsonl", columnNameOfCorruptRecord="_corrupt")
    return raw.select(
        path_ticker(1).alias("dir_ticker"), F.monotonically_increasing_id().alias("arrival"),
        "id", "article_url", "published_utc", "title", "description", "tickers", F.col("_corrupt").isNotNull().alias("malformed"),
    )


def read_dataset(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV (with header) or Parquet, only the needed columns."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)
    return df if columns is None else df.select(*[F.col(resolve_column(df.columns, [c])).alias(c) for c in columns])


def parse_dataset_specs(specs: list[str]) -> dict[str, str]:
    """`NAME=PATH` entries."""
    out: dict[str, str] = {}
    for spec in specs:
        name, sep, path = spec.partition("=")
        if not sep or not name.strip() or not path.strip():
            raise ValueError(f"expected NAME=PATH, got {spec!r}")
        out[name.strip()] = path.strip()
    return out


def read_datasets(spark: SparkSession, specs: list[str]) -> dict[str, DataFrame]:
    return {name: read_dataset(spark, path) for name, path in parse_dataset_specs(specs).items()}


def ticker_list(lines: DataFrame, text: str = "value", position: str = "position") -> DataFrame:
    """Tickers of list text (commas, `#` comments) with the position where each first occurs."""
    bare = F.regexp_replace(F.col(text), "#.*$", "")
    items = lines.select(position, F.posexplode(F.split(bare, r"[,\s]+")).alias("i", "raw"))
    named = items.select(position, "i", S.normalize_ticker("raw").alias("ticker")).where("ticker IS NOT NULL")
    return named.groupBy("ticker").agg(F.min(F.struct(position, "i")).alias("first_at"))


def read_ticker_list(spark: SparkSession, path: str) -> DataFrame:
    """Ticker list from .txt, .csv (ticker or symbol column) or .json (array of texts), in order of first occurrence."""
    if path.endswith(".csv"):
        raw = spark.read.csv(path, header=True)
        column = resolve_column(raw.columns, ["ticker", "symbol", "tickers"], required=False) or raw.columns[0]
        lines = raw.select(F.monotonically_increasing_id().alias("position"), F.col(column).alias("value"))
    elif path.endswith(".json"):
        raw = spark.read.text(path, wholetext=True)
        lines = raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "value"))
    else:
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("position"), "value")
    return ticker_list(lines).orderBy("first_at").select("ticker")
