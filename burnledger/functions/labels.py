"""Text labels of the reports, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def currency_label(value: Column, prefix: str = "$") -> Column:
    """Millions with one decimal and an M, thousands without decimals, else two decimals."""
    v = value.cast("double")
    text = (F.when(F.abs(v) >= 1_000_000, F.concat(F.format_number(v / 1_000_000, 1), F.lit("M")))
            .when(F.abs(v) >= 1_000, F.format_number(v, 0))
            .when(v.isNotNull(), F.format_number(v, 2))
            .otherwise(F.lit("0")))
    return F.concat(F.lit(prefix), text)


def percent_label(value: Column) -> Column:
    return (F.when(value.isNotNull(), F.format_string("%.1f%%", value.cast("double")))
            .otherwise(F.lit("0.0%")))


def date_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def days_label(days: Column) -> Column:
    """Days as text; the 'no forecast' value 999 and above reads N/A."""
    return F.when(days < 999, days.cast("string")).otherwise(F.lit("N/A"))


def expiry_class(expired: Column, days_left: Column) -> Column:
    return (F.when(expired, F.lit("EXPIRED"))
            .when(days_left == 0, F.lit("TODAY"))
            .when(days_left < 30, F.lit("SOON"))
            .when(days_left < 60, F.lit("APPROACHING"))
            .otherwise(F.lit("OK")))


def expiry_label(expired: Column, days_left: Column) -> Column:
    return (F.when(expired, F.lit("EXPIRED"))
            .when(days_left == 0, F.lit("TODAY"))
            .otherwise(F.concat(days_left.cast("string"), F.lit(" days"))))


def depletion_label(depleted: Column, days_left: Column, expired: Column, before_expiry: Column,
                    na_when_expired: bool = True) -> Column:
    """DEPLETED, a number of days, or N/A when there is no forecast.

    Funds that run out before the contract does show their days, however many.

    ``na_when_expired=False`` keeps the number of days of an expired contract
    even if it is the 'no forecast' value; the single-customer report does so.
    """
    days = F.concat(days_left.cast("string"), F.lit(" days"))
    has_forecast = (days_left < 999) | before_expiry
    if not na_when_expired:
        has_forecast = has_forecast | expired
    return (F.when(depleted, F.lit("DEPLETED"))
            .when(has_forecast, days)
            .otherwise(F.lit("N/A")))


def balance_band(remaining: Column, consumption_pct: Column) -> Column:
    return (F.when(remaining <= 0, F.lit("RED"))
            .when(consumption_pct > 80, F.lit("ORANGE"))
            .otherwise(F.lit("GREEN")))


def urgency_band(depleted: Column, days_left: Column) -> Column:
    return (F.when(depleted | (days_left < 60), F.lit("RED"))
            .when(days_left < 120, F.lit("ORANGE"))
            .otherwise(F.lit("GREEN")))
