"""Scalar helpers where the dialect and Spark differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """x, or an error where it is not finite."""
    return F.when(F.isnan(x) | (F.abs(x) == INF), F.raise_error(F.lit("NON_FINITE_RESULT")).cast("double")).otherwise(x)


def integer_divide(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def remainder(a: Column, b: Column) -> Column:
    low = -(1 << 63)
    return F.when((a == low) & (b == -1), F.raise_error(F.lit("ARITHMETIC_OVERFLOW")).cast("long")).otherwise(a % b)


def like(value: Column, pattern: Column | str, fold: bool) -> Column:
    """LIKE without an escape character, with folding of both sides for ILIKE."""
    if isinstance(pattern, str):
        pattern = F.lit(pattern.replace("\\", "\\\\"))
    else:
        pattern = F.replace(pattern, F.lit("\\"), F.lit("\\\\"))
    return F.call_function("like", F.lower(value), F.lower(pattern)) if fold else F.call_function("like", value, pattern)


def order_key(c: Column, descending: bool, nulls_first: bool | None) -> Column:
    """Sorting key: by default nulls are last ascending and first descending."""
    first = descending if nulls_first is None else nulls_first
    return (c.desc_nulls_first() if first else c.desc_nulls_last()) if descending else (c.asc_nulls_first() if first else c.asc_nulls_last())
