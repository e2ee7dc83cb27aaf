"""Array and list-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.scalars import _col, finite

EMPTY_TEXTS = "array<string>"
EMPTY_NUMBERS = "array<double>"


def _parsed(c) -> Column:
    """The array of a list-like text, NULL if the text is no list. As written first; a bare None between commas or
    brackets counts as null only where that fails, so words inside texts stay."""
    text = F.trim(_col(c))
    plain = F.regexp_replace(text, r"(?<=[\[,])\s*None\s*(?=[,\]])", "null")
    read = lambda t: F.from_json(t, "array<string>")
    return F.when(text.startswith("["), F.coalesce(read(text), read(plain)))


def parse_list(c) -> Column:
    """List-like text (JSON, or a literal with single quotes or None) as an array; anything else is empty."""
    return F.coalesce(_parsed(c), F.array().cast(EMPTY_TEXTS))


def finite_numbers(items) -> Column:
    """Array of texts to array of the finite numbers among them, in order."""
    numbers = F.transform(_col(items), lambda x: finite(F.trim(x).try_cast("double")))
    return F.filter(numbers, lambda x: x.isNotNull())


def parse_score_list(c) -> Column:
    return finite_numbers(parse_list(c))


def parse_scores(c) -> Column:
    """As `parse_score_list`, and a bare number counts as a list of one. Missing gives an empty list."""
    listed = parse_score_list(c)
    bare = finite(F.trim(_col(c)).try_cast("double"))
    return F.when((F.size(listed) == 0) & bare.isNotNull(), F.array(bare)).otherwise(listed)


def parse_texts(c) -> Column:
    """JSON list of texts, else comma separated text with double quotes honoured; trimmed, non-empty."""
    text = F.trim(_col(c))
    listed = _parsed(c)
    fields = F.split(text, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    unquoted = F.transform(fields, lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[\"']+|[\"']+$", "")))
    chosen = F.when(listed.isNotNull(), F.transform(listed, lambda x: F.trim(x))).otherwise(unquoted)
    return F.coalesce(F.filter(chosen, lambda x: x != ""), F.array().cast(EMPTY_TEXTS))


def ticker_list(c) -> Column:
    """Distinct upper-cased tickers in their first order."""
    cleaned = F.transform(_col(c), lambda x: F.upper(F.trim(x)))
    kept = F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull() & (x != "")))
    return F.coalesce(kept, F.array().cast(EMPTY_TEXTS))


def json_list(c) -> Column:
    return F.to_json(_col(c))


def issue_codes(pairs) -> Column:
    """Array of the codes whose condition holds, in the given order."""
    marked = F.array(*[F.when(cond, F.lit(code)) for code, cond in pairs])
    return F.filter(marked, lambda x: x.isNotNull())


def joined_codes(codes, separator: str) -> Column:
    return F.array_join(_col(codes), separator)


def leading_status(codes, ok: str = "ok") -> Column:
    return F.coalesce(F.get(_col(codes), F.lit(0)), F.lit(ok))


def list_mean(c) -> Column:
    a = _col(c)
    return F.try_divide(list_sum(a), F.size(a))


def list_sum(c) -> Column:
    return F.aggregate(_col(c), F.lit(0.0), lambda acc, x: acc + x)


def list_std(c) -> Column:
    """Population standard deviation."""
    a = _col(c)
    mean = list_mean(a)
    squares = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.sqrt(F.try_divide(squares, F.size(a)))


def list_share(c, condition) -> Column:
    a = _col(c)
    return F.try_divide(F.size(F.filter(a, condition)), F.size(a))
