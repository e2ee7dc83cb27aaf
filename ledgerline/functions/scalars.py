"""Column expressions for cleaning keys, numbers, dates and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing ticker.
MISSING_TICKER_WORDS = ("", "NAN", "NONE", "<NA>", "NULL")

EPS = 1e-12
RATIO_EPS = 1e-8


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ticker(c) -> Column:
    text = F.upper(F.trim(_col(c).cast("string")))
    return F.when(~text.isin(*MISSING_TICKER_WORDS), text)


def normalize_key(c, kind: str) -> Column:
    """Key column by kind: `ticker`, `year` or plain `text`."""
    if kind == "ticker":
        return normalize_ticker(c)
    if kind == "year":
        return parse_year(c)
    return F.trim(_col(c).cast("string"))


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    v = _col(c)
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def to_number(c) -> Column:
    return finite(_col(c).try_cast("double"))


def safe_div(num, den, tolerance: float = EPS) -> Column:
    """Missing when a side is missing or the denominator is within `tolerance` of zero."""
    n, d = _col(num), _col(den)
    return F.when(F.abs(d) > tolerance, F.try_divide(n, d))


def div_nonzero(num, den) -> Column:
    return F.try_divide(_col(num), _col(den))


def div_finite(num, den) -> Column:
    return finite(F.try_divide(_col(num), _col(den)))


def signed_growth(current, previous) -> Column:
    cur, prev = _col(current), _col(previous)
    return (cur - prev) / F.greatest(F.abs(prev), F.lit(EPS))


def first_present(*cols) -> Column:
    return F.coalesce(*[_col(c) for c in cols])


def sum_present(*cols) -> Column:
    """Sum of the parts that are present; missing only when all are missing."""
    parts = [_col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.when(F.coalesce(*parts).isNotNull(), total)


def clip(c, low=None, high=None) -> Column:
    """Clip and keep NULL (`greatest` and `least` skip NULL on their own)."""
    v = _col(c)
    out = v
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(v.isNotNull(), out)


def log1p_floor(c) -> Column:
    return F.log1p(clip(c, low=0.0))


def expm1(c) -> Column:
    return F.expm1(_col(c))


def present_flag(c) -> Column:
    return _col(c).isNotNull().cast("int")


def zero_filled(c) -> Column:
    return F.coalesce(to_number(c), F.lit(0.0))


def target_on_model_scale(c, log_target: bool) -> Column:
    filled = zero_filled(c)
    return F.log1p(F.greatest(filled, F.lit(0.0))) if log_target else filled


def trade_date(c) -> Column:
    """Trade date from ISO text or an epoch number; the epoch unit follows the size of the number."""
    text = F.trim(_col(c).cast("string"))
    numeric = text.rlike(r"^[0-9]{9,}(\.[0-9]+)?$")
    n = text.try_cast("double")
    per_day = (
        F.when(n >= 1e17, F.lit(86400e9))
        .when(n >= 1e14, F.lit(86400e6))
        .when(n >= 1e11, F.lit(86400e3))
        .otherwise(F.lit(86400.0))
    )
    from_epoch = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(n / per_day).cast("int"))
    return F.when(numeric, from_epoch).otherwise(F.to_date(F.try_to_timestamp(text)))


def parse_date(c) -> Column:
    """ISO date prefix, else a full ISO timestamp."""
    text = F.trim(_col(c).cast("string"))
    return F.coalesce(text.substr(1, 10).try_cast("date"), F.to_date(F.try_to_timestamp(text)))


def parse_year(c, fallback_date=None) -> Column:
    year = to_number(F.trim(_col(c).cast("string"))).try_cast("int")
    return year if fallback_date is None else F.coalesce(year, F.year(_col(fallback_date)))


def year_first_day(y) -> Column:
    return F.make_date(_col(y), F.lit(1), F.lit(1))


def year_last_day(y) -> Column:
    return F.make_date(_col(y), F.lit(12), F.lit(31))


def valid_iso_date(c) -> Column:
    text = _col(c)
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(), F.lit(False))


def valid_year(c, low: int = 1900, high: int = 2100) -> Column:
    return F.coalesce(_col(c).between(low, high), F.lit(False))


def lag_days(later, earlier) -> Column:
    return F.datediff(_col(later), _col(earlier))


def news_key(item_id, url, published, title) -> Column:
    """The article's id, else a sha256 of url, time and title joined by a pipe."""
    parts = [F.coalesce(_col(c), F.lit("")) for c in (url, published, title)]
    return F.coalesce(F.nullif(_col(item_id), F.lit("")), F.sha2(F.concat_ws("|", *parts), 256))


def path_safe_ticker(c) -> Column:
    return F.replace(_col(c), F.lit("/"), F.lit("__SLASH__"))


def slug(c) -> Column:
    cleaned = F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(cleaned, r"^_+|_+$", ""), F.lit("")), F.lit("item"))


def threshold_tag(value: float) -> str:
    return f"{value:.2f}".replace(".", "p")


def fraction_rows(n, fraction) -> Column:
    """max(1, n * fraction rounded half to even)."""
    return F.greatest(F.lit(1), F.bround(_col(n) * fraction).cast("long"))


def capex_magnitude(c) -> Column:
    return F.abs(_col(c))
