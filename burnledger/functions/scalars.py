"""Small column expressions used by several operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY_SUM = DecimalType(38, 6)


def zero(scale: int = 6) -> Column:
    return F.lit(Decimal(0)).cast(DecimalType(scale + 1, scale))


def or_zero(value: Column, scale: int = 6) -> Column:
    return F.coalesce(value, zero(scale))


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 unless ``whole`` is positive."""
    return (F.when(whole > 0, part.cast("double") / whole.cast("double"))
            .otherwise(F.lit(0.0)))


def percent_of(part: Column, whole: Column) -> Column:
    return safe_ratio(part, whole) * 100


def mean(total: Column, count: Column) -> Column:
    """Mean from a sum and a count, NULL for an empty group."""
    return F.when(count > 0, total.cast("double") / count.cast("double"))


def magnitude_if_negative(value: Column) -> Column:
    return F.when(value < 0, -value).otherwise(zero(2))
