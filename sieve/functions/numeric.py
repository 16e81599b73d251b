"""Number expressions shared by models, metrics and displays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def two_class(p: Column) -> Column:
    """[1 - p, p]"""
    return F.array(F.lit(1.0) - p, p)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def ceil_share(total: Column, percent: int) -> Column:
    """ceil(total * percent / 100) in whole numbers."""
    return F.call_function("div", total * percent + 99, F.lit(100))


def as_double(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def fixed(x: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", x)


def percent_done(done: Column, total: Column) -> Column:
    return F.floor(done * 100 / total).cast("bigint")
