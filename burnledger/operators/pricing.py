"""Contract items, rate sheets and usage prices."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from burnledger.sources.schemas import (
    BALANCE_SOURCE, BILLING_TYPE, CAPACITY_ITEM, CONTRACT_ITEMS, FREE_ITEM, KEYS, RATE_SHEET,
    SERVICES, USAGE,
)
from burnledger.sources.tables import conform, date_spine

ACCOUNT_COLUMNS = ("account_name", "account_locator", "region", "service_level")

# Uplift on the list rate per service level.
UPLIFTS = {"Business Critical": Decimal("1.60"), "Enterprise": Decimal("1.20")}

# Price per unit by rating class and service level.
PRICES = {
    "compute": {"Business Critical": "4.80", "Enterprise": "3.60", "Standard": "3.00"},
    "storage": {"Business Critical": "36.80", "Enterprise": "27.60", "Standard": "23.00"},
    "other": {"Business Critical": "0.032", "Enterprise": "0.024", "Standard": "0.020"},
}

def _number(value: str | int, precision: int, scale: int) -> Column:
    return F.lit(Decimal(value)).cast(DecimalType(precision, scale))


def contract_items(contracts: DataFrame) -> DataFrame:
    """One row per contract (``capacity_amt``, ``free_amt``) -> one row per item."""
    items = contracts.withColumn(
        "contract_item", F.explode(F.array(F.lit(CAPACITY_ITEM), F.lit(FREE_ITEM))))
    amount = (F.when(F.col("contract_item") == CAPACITY_ITEM, F.col("capacity_amt"))
              .when(F.col("contract_item") == FREE_ITEM, F.col("free_amt")))
    return conform(items.withColumn("amount", amount), CONTRACT_ITEMS)


def with_services(accounts: DataFrame) -> DataFrame:
    """Each account once per metered service, from a constant array."""
    services = F.array(*[
        F.struct(F.lit(usage_type).alias("usage_type"), F.lit(rating).alias("rating_type"),
                 F.lit(service).alias("service_type"), _number(rate, 5, 2).alias("list_rate"))
        for _, usage_type, rating, service, rate in SERVICES])
    return (accounts.withColumn("__s", F.explode(services))
            .select(*accounts.columns, "__s.*")
            .withColumn("billing_type", F.lit(BILLING_TYPE)))


def rate_sheet(accounts: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Account x day x service with the list rate raised by service level, at 2 decimals."""
    return sheet_rows(date_spine(accounts, start, end, "date"))


def sheet_rows(account_days: DataFrame) -> DataFrame:
    """The sheet of given accounts and days (``date``): each once per metered service."""
    level = F.col("service_level")
    uplift = F.lit(Decimal("1.00"))
    for name, value in UPLIFTS.items():
        uplift = F.when(level == name, F.lit(value)).otherwise(uplift)
    rows = (with_services(account_days)
            .withColumn("effective_rate", F.col("list_rate") * uplift)
            .withColumns({"is_adjustment": F.lit(False), "currency": F.lit("USD")}))
    return conform(rows, RATE_SHEET)


def unit_price(rating_type: Column, service_level: Column) -> Column:
    """Price per unit; unknown classes and levels take the last entry of the table."""
    def by_level(levels: dict[str, str]) -> Column:
        return (F.when(service_level == "Business Critical", _number(levels["Business Critical"], 5, 3))
                .when(service_level == "Enterprise", _number(levels["Enterprise"], 5, 3))
                .otherwise(_number(levels["Standard"], 5, 3)))

    return (F.when(rating_type == "compute", by_level(PRICES["compute"]))
            .when(rating_type == "storage", by_level(PRICES["storage"]))
            .otherwise(by_level(PRICES["other"])))


def price_usage(quantities: DataFrame) -> DataFrame:
    """Usage rows from quantities: quantity and price are each rounded to 6 decimals."""
    credit = F.col("credit_usage")
    price = unit_price(F.col("rating_type"), F.col("service_level"))
    return conform(quantities.withColumns({
        "usage": F.round(credit, 6),
        "usage_in_currency": F.round(credit * price, 6),
        "currency": F.lit("USD"),
        "balance_source": F.lit(BALANCE_SOURCE),
        "is_adjustment": F.lit(False),
    }), USAGE)
