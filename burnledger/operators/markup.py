"""Effective-dated markup: rate lookup, price increase, rate lists."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from burnledger.operators.joins import lookup_join
from burnledger.sources.schemas import CONSUMER, CUSTOMER, ORG, PERCENT

PCT = "__markup_pct"


def active(config: DataFrame) -> DataFrame:
    return config.filter("is_active")


def with_markup_pct(df: DataFrame, rates: DataFrame, date: Column | dt.date | str,
                    salt_by: list[str] | None = None) -> DataFrame:
    """Left interval join: the rate of the organisation that covers ``date``.

    ``date`` is the name of a date column (the rate of the row's own day) or a
    fixed date (the rate of that day for all rows). Rows without a rate keep a
    NULL percentage; overlapping rates yield one row per rate.
    """
    lookup = active(rates).select(
        F.col(ORG).alias("__rate_org"), F.col("effective_from").alias("__from"),
        F.col("effective_to").alias("__to"), F.col("markup_pct").alias(PCT))
    if isinstance(date, dt.date):
        day = F.lit(date)
        covering = lookup.filter((F.col("__from") <= day) & (F.col("__to").isNull() | (F.col("__to") >= day)))
        return lookup_join(df, covering.drop("__from", "__to"), {ORG: "__rate_org"}, "left",
                           salt_by=salt_by)

    def covers(fact: DataFrame, rate: DataFrame) -> Column:
        day = fact[date]
        return (day >= rate["__from"]) & (rate["__to"].isNull() | (day <= rate["__to"]))

    return (lookup_join(df, lookup, {ORG: "__rate_org"}, "left", covers, salt_by or [date])
            .drop("__from", "__to"))


def factor(pct: Column) -> Column:
    """``1 + pct`` with a missing percentage read as none."""
    return F.lit(Decimal(1)) + F.coalesce(pct, F.lit(Decimal(0)).cast(PERCENT))


def raise_prices(df: DataFrame, scales: dict[str, int]) -> DataFrame:
    """Multiply the columns by the row's markup factor, each rounded to its own scale."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        name: F.round(F.col(name) * factor(F.col(PCT)), scale).cast(types[name])
        for name, scale in scales.items()
    }).drop(PCT)


def apply_markup(df: DataFrame, rates: DataFrame, scales: dict[str, int],
                 date: Column | dt.date | str, salt_by: list[str] | None = None) -> DataFrame:
    """Rate lookup and price increase in one step (``scales``: column -> decimals)."""
    return raise_prices(with_markup_pct(df, rates, date, salt_by), scales)


def markup_list(rates: DataFrame, mapping: DataFrame, today: dt.date) -> DataFrame:
    """Active rates not yet expired, with each mapped consumer of the organisation.

    There is no check of the start date and none of the mapping's own flag, so
    a future rate and a deactivated consumer are listed too; an organisation
    with two consumers is listed twice.
    """
    current = active(rates).filter(
        F.col("effective_to").isNull() | (F.col("effective_to") >= F.lit(today)))
    consumers = mapping.select(F.col(ORG).alias("__org"), CUSTOMER, CONSUMER, "is_active")
    return (lookup_join(current.drop("is_active"), consumers, {ORG: "__org"})
            .select(ORG, CUSTOMER, "markup_pct", CONSUMER, "is_active", "effective_from", "effective_to"))


def first_markup_by_customer(listed: DataFrame) -> DataFrame:
    """One percentage per customer name: the earliest rate, then locator, then percentage."""
    first = F.min(F.struct("effective_from", CONSUMER, "markup_pct"))
    return listed.groupBy(CUSTOMER).agg(first.alias("__first")).select(
        CUSTOMER, F.col("__first.markup_pct").alias("markup_pct"))


def percent_points(pct: Column) -> Column:
    return (pct * 100).cast(DecimalType(9, 4))
