"""Consumer-isolated, marked-up views of the four billing tables.

``shared_*`` return what one consumer may see. ``published_*`` do the same for
all active consumers in one job, with the consumer's locator as first column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnledger.operators.joins import lookup_join
from burnledger.operators.markup import active, apply_markup
from burnledger.sources.schemas import (
    BALANCE_COLUMNS, CONSUMER, CONTRACT, CONTRACT_ITEMS, ORG, RATE_SHEET, REMAINING_BALANCE, USAGE,
)
from burnledger.sources.tables import Billing

# Decimals each amount is rounded to after the markup.
CONTRACT_SCALES = {"amount": 4}
RATE_SHEET_SCALES = {"effective_rate": 2}
USAGE_SCALES = {"usage_in_currency": 6}
BALANCE_SCALES = {name: 2 for name in BALANCE_COLUMNS}


def isolate(df: DataFrame, mapping: DataFrame, consumer: str) -> DataFrame:
    """Rows of the organisations actively mapped to ``consumer``."""
    own = (active(mapping).filter(F.col(CONSUMER) == F.lit(consumer))
           .select(F.col(ORG).alias("__map_org")))
    return lookup_join(df, own, {ORG: "__map_org"}, "left_semi")


def per_consumer(df: DataFrame, mapping: DataFrame, salt_by: list[str]) -> DataFrame:
    """Each row once per consumer that may see it; the locator is added in front.

    If the join was salted, the salt stays for the markup lookup that follows.
    """
    pairs = active(mapping).select(F.col(ORG).alias("__map_org"), CONSUMER).distinct()
    joined = lookup_join(df, pairs, {ORG: "__map_org"}, "inner", salt_by=salt_by, keep_salt=True)
    return joined.select(CONSUMER, *[c for c in joined.columns if c != CONSUMER])


Scope = Callable[[DataFrame, list[str]], DataFrame]


def _own(src: Billing, consumer: str) -> Scope:
    return lambda df, salt_by: isolate(df, src.mapping, consumer)


def _all(src: Billing) -> Scope:
    return lambda df, salt_by: per_consumer(df, src.mapping, salt_by)


def _contract_items(src: Billing, scope: Scope, as_of: dt.datetime) -> DataFrame:
    rows = scope(src.contract_items.select(*CONTRACT_ITEMS.names), [CONTRACT])
    return apply_markup(rows, src.rates, CONTRACT_SCALES, as_of.date(), [CONTRACT])


def _rate_sheet(src: Billing, scope: Scope) -> DataFrame:
    rows = scope(src.rate_sheet.select(*RATE_SHEET.names), ["date"])
    return apply_markup(rows, src.rates, RATE_SHEET_SCALES, "date")


def _usage(src: Billing, scope: Scope) -> DataFrame:
    rows = scope(src.usage.select(*USAGE.names), ["usage_date"])
    return apply_markup(rows, src.rates, USAGE_SCALES, "usage_date")


def _balance(src: Billing, scope: Scope) -> DataFrame:
    rows = scope(src.balances.select(*REMAINING_BALANCE.names), ["date"])
    return apply_markup(rows, src.rates, BALANCE_SCALES, "date")


def shared_contract_items(src: Billing, consumer: str, as_of: dt.datetime) -> DataFrame:
    """Contract items; amounts carry the rate valid at ``as_of``."""
    return _contract_items(src, _own(src, consumer), as_of)


def shared_rate_sheet(src: Billing, consumer: str) -> DataFrame:
    return _rate_sheet(src, _own(src, consumer))


def shared_usage(src: Billing, consumer: str) -> DataFrame:
    """Usage rows; the price is marked up, the quantity is not."""
    return _usage(src, _own(src, consumer))


def shared_balance(src: Billing, consumer: str) -> DataFrame:
    return _balance(src, _own(src, consumer))


def published_contract_items(src: Billing, as_of: dt.datetime) -> DataFrame:
    return _contract_items(src, _all(src), as_of)


def published_rate_sheet(src: Billing) -> DataFrame:
    return _rate_sheet(src, _all(src))


def published_usage(src: Billing) -> DataFrame:
    return _usage(src, _all(src))


def published_balance(src: Billing) -> DataFrame:
    return _balance(src, _all(src))


# The labels of the row-count check.
VIEW_LABELS = ("Contract Items", "Usage Daily", "Remaining Balance", "Rate Sheet")


def view_counts(contract_items: DataFrame, usage: DataFrame, balance: DataFrame,
                rate_sheet: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row count of each shared view, per consumer if ``by`` names the locator."""
    by = by or []
    counts = [df.groupBy(*by).agg(F.count("*").alias("rows"))
              .select(*by, F.lit(label).alias("view_name"), "rows")
              for label, df in zip(VIEW_LABELS, (contract_items, usage, balance, rate_sheet))]
    stacked = counts[0]
    for other in counts[1:]:
        stacked = stacked.unionByName(other)
    return stacked


def publish(src: Billing, out: str, as_of: dt.datetime) -> dict[str, str]:
    """Write all four views for all consumers, one directory per consumer.

    Rows are rebalanced by consumer before the write: small consumers share a
    task, a large one is split over several, so neither many small files nor
    one huge file results. Sorting inside the files keeps organisations and
    days together for row-group pruning.
    """
    views = {
        "partner_contract_items": (published_contract_items(src, as_of), "start_date"),
        "partner_rate_sheet_daily": (published_rate_sheet(src), "date"),
        "partner_usage_in_currency_daily": (published_usage(src), "usage_date"),
        "partner_remaining_balance_daily": (published_balance(src), "date"),
    }
    paths = {}
    for name, (df, date) in views.items():
        paths[name] = f"{out.rstrip('/')}/{name}"
        (df.hint("rebalance", CONSUMER)
         .sortWithinPartitions(CONSUMER, ORG, date)
         .write.mode("overwrite").partitionBy(CONSUMER).parquet(paths[name]))
    return paths
