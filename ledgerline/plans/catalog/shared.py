"""Rounding and date text that both engines print alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r(c, digits: int = 6, name: str | None = None) -> Column:
    """Rounded double under its own name."""
    column = F.col(c) if isinstance(c, str) else c
    out = F.round(column.cast("double"), digits)
    return out.alias(name or c) if name or isinstance(c, str) else out


def d(c, name: str | None = None) -> Column:
    """Date as ISO text."""
    column = F.col(c) if isinstance(c, str) else c
    return F.date_format(column, "yyyy-MM-dd").alias(name or c if isinstance(c, str) else name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, all dates as text, all integers as bigint."""
    out = []
    for n, t in df.dtypes:
        if t in ("double", "float") or t.startswith("decimal"):
            out.append(r(n, digits))
        elif t == "date":
            out.append(d(n))
        elif t in ("int", "smallint", "tinyint"):
            out.append(F.col(n).cast("bigint").alias(n))
        else:
            out.append(F.col(n))
    return df.select(*out)


def R(expression: str, digits: int = 6, name: str | None = None) -> str:
    """The same in SQL (a rounded zero has no sign)."""
    x = f"round(CAST({expression} AS DOUBLE), {digits})"
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE {x} END" + (f" AS {name}" if name else f" AS {expression}" if expression.isidentifier() else "")


def Rs(names: list[str], digits: int = 6, prefix: str = "") -> str:
    return ", ".join(R(f"{prefix}{n}", digits, n) for n in names)


def D(expression: str, name: str | None = None) -> str:
    return f"strftime({expression}, '%Y-%m-%d') AS {name or expression}"
