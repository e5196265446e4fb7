"""Reports of the consumers, on their own marked-up data.

All functions take the published tables (one column holds the consumer) and
answer for every consumer in one pass. ``PublishedTables.of`` narrows them to
one consumer; the filter reaches the account mapping and the scans.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from burnledger.functions.clock import Clock, month_floor
from burnledger.functions.labels import date_label
from burnledger.functions.scalars import MONEY_SUM, or_zero
from burnledger.operators import shared
from burnledger.operators.usage import DAY, latest_per, running_total, spend_by
from burnledger.plans.common import LATEST, alerts, assess, usage_profile
from burnledger.sources.schemas import CAPACITY_ITEM, CONSUMER, CONTRACT, CUSTOMER, FREE_ITEM
from burnledger.sources.tables import Billing, project_existing

PROJECTION_DAYS = 60
KEY = [CONSUMER]

# Display names of the two exported tables.
CONTRACT_LABELS = {
    "contract_item": "Agreement Type", "amount": "Capacity/Purchase($)", "currency": "Currency",
    "start_date": "Start Date", "end_date": "End Date", "expiration_date": "Expiration",
    "total_consumption": "Consumption($)", "capacity_remaining": "Remaining($)",
}
SUBSCRIPTION_LABELS = {
    "account_name": "Account", "region": "Region", "service_level": "Edition",
    "currency": "Currency", "service_type": "Service", "effective_rate": "Rate ($)",
}


class PublishedTables:
    """The four published tables, each built when first used."""

    def __init__(self, src: Billing, as_of: dt.datetime, consumer: str | None = None):
        self.src, self.as_of, self.consumer = src, as_of, consumer

    def of(self, consumer: str) -> PublishedTables:
        return PublishedTables(self.src, self.as_of, consumer)

    def _narrow(self, df: DataFrame) -> DataFrame:
        return df if self.consumer is None else df.filter(F.col(CONSUMER) == F.lit(self.consumer))

    @cached_property
    def contract_items(self) -> DataFrame:
        return self._narrow(shared.published_contract_items(self.src, self.as_of))

    @cached_property
    def usage(self) -> DataFrame:
        return self._narrow(shared.published_usage(self.src))

    @cached_property
    def balances(self) -> DataFrame:
        return self._narrow(shared.published_balance(self.src))

    @cached_property
    def rate_sheet(self) -> DataFrame:
        return self._narrow(shared.published_rate_sheet(self.src))


def money(value: Column) -> Column:
    return value.cast(MONEY_SUM)


def _daily(tables: PublishedTables) -> DataFrame:
    return spend_by(tables.usage, CONSUMER, DAY)


def _header(tables: PublishedTables) -> DataFrame:
    """First contract row, and first capacity and free-usage amount, by contract and item."""
    col = F.col

    def first_amount(item: str) -> Column:
        return F.min(F.when(col("contract_item") == item, F.struct(CONTRACT, "amount")))

    grouped = tables.contract_items.groupBy(*KEY).agg(
        F.min(F.struct(CONTRACT, "contract_item", "start_date", "end_date", CUSTOMER)).alias("__row"),
        first_amount(CAPACITY_ITEM).alias("__capacity"), first_amount(FREE_ITEM).alias("__free"))
    return grouped.select(
        CONSUMER, col(f"__row.{CUSTOMER}").alias(CUSTOMER), col(f"__row.{CONTRACT}").alias(CONTRACT),
        or_zero(col("__capacity.amount"), 4).alias("capacity"),
        or_zero(col("__free.amount"), 4).alias("free_usage"),
        col("__row.start_date").alias("start_date"), col("__row.end_date").alias("end_date"),
    ).withColumn("entitlement", col("capacity") + col("free_usage"))


def _latest_balance(tables: PublishedTables) -> DataFrame:
    """The last balance row of the consumer; on equal dates the greatest contract number."""
    keep = ["date", *LATEST.values()]
    return latest_per(tables.balances.select(CONSUMER, CONTRACT, *keep), KEY, ["date", CONTRACT], keep).select(
        CONSUMER, F.col("date").alias("updated_on"),
        *[F.col(column).alias(name) for name, column in LATEST.items()])


def contract_header(tables: PublishedTables) -> DataFrame:
    return _header(tables).select(
        CONSUMER, CUSTOMER, CONTRACT, F.col("capacity").cast(DecimalType(38, 4)).alias("capacity"),
        F.col("free_usage").cast(DecimalType(38, 4)).alias("free_usage"),
        F.col("entitlement").cast(DecimalType(38, 4)).alias("entitlement"), "start_date", "end_date")


def _profile(tables: PublishedTables, clock: Clock) -> DataFrame:
    return usage_profile(_daily(tables), _header(tables), KEY, clock, fallback=True)


def _assessed(tables: PublishedTables, as_of: dt.datetime) -> DataFrame:
    clock = Clock(as_of)
    state = (_header(tables).drop("entitlement").join(_profile(tables, clock), CONSUMER, "full")
             .join(_latest_balance(tables), CONSUMER, "left"))
    return assess(state, clock, expired_keeps_days=True)


def overview(tables: PublishedTables, as_of: dt.datetime) -> DataFrame:
    """Consumption, funds, expiry and depletion forecast of each consumer."""
    col = F.col
    return _assessed(tables, as_of).select(
        CONSUMER, CUSTOMER, CONTRACT,
        money(col("consumed")).alias("consumed"),
        col("entitlement").cast(DecimalType(38, 4)).alias("entitlement"),
        "consumption_pct",
        money(col("credits")).alias("credits"), "usage_days",
        "credits_per_day",
        money(col("overage")).alias("overage"),
        col("remaining").cast(DecimalType(38, 2)).alias("remaining"),
        col("free_left").cast(DecimalType(38, 2)).alias("free_left"),
        col("rollover").cast(DecimalType(38, 2)).alias("rollover"),
        col("funds").cast(DecimalType(38, 2)).alias("funds"), "updated_on",
        "burn",
        "start_date", "end_date", "expired", "days_to_expiry", "days_past_end",
        "expiry_class", "expiry_label", "depleted", "days_to_depletion", "depletion_date",
        "depletion_label", "depletes_before_expiry", "urgency", "balance_band")


def consumer_alerts(tables: PublishedTables, as_of: dt.datetime) -> DataFrame:
    return alerts(_assessed(tables, as_of), KEY)


def summary_bar(tables: PublishedTables, as_of: dt.datetime) -> DataFrame:
    col = F.col
    names = ("entitlement", "capacity", "free_usage", "rollover", "consumed", "overage")
    return _assessed(tables, as_of).select(
        CONSUMER, *[money(col(name)).alias(name) for name in names], "burn")


def usage_vs_entitlement(tables: PublishedTables, as_of: dt.datetime, period: str = "All") -> DataFrame:
    """Daily and running spend in the period; the running sum starts before it."""
    series = running_total(_daily(tables), KEY).join(
        _header(tables).select(CONSUMER, "entitlement"), CONSUMER, "left")
    return series.filter(Clock(as_of).in_period(F.col(DAY), period)).select(
        CONSUMER, DAY, money(F.col("spend")).alias("daily"),
        money(F.col("cumulative")).alias("cumulative"),
        or_zero(F.col("entitlement"), 4).cast(DecimalType(38, 4)).alias("entitlement"))


def projection(tables: PublishedTables, as_of: dt.datetime) -> DataFrame:
    """Running spend extended by 60 days of the current burn."""
    col = F.col
    ahead = F.explode(F.sequence(F.lit(1), F.lit(PROJECTION_DAYS))).alias("day_ahead")
    last = _profile(tables, Clock(as_of))
    return last.select(CONSUMER, "last_usage_date", "last_cumulative", "burn", ahead).select(
        CONSUMER, "day_ahead", F.date_add("last_usage_date", col("day_ahead")).alias("date"),
        (col("last_cumulative").cast("double") + col("burn") * col("day_ahead")).alias("projected"))


def breakout(tables: PublishedTables, as_of: dt.datetime, period: str = "All") -> DataFrame:
    """Daily spend by service in the period; the period is a filter on the scan."""
    rows = tables.usage.filter(Clock(as_of).in_period(F.col(DAY), period))
    return (spend_by(rows, CONSUMER, DAY, "service_type")
            .select(CONSUMER, DAY, "service_type", money(F.col("spend")).alias("spend")))


def daily_by_service(tables: PublishedTables) -> DataFrame:
    """Daily spend by service over the whole history."""
    return breakout(tables, dt.datetime.max)


def active_contract(tables: PublishedTables) -> DataFrame:
    """The contract items with total spend and remaining capacity, under display names."""
    col = F.col
    spent = tables.usage.groupBy(*KEY).agg(F.sum("usage_in_currency").alias("total_consumption"))
    left = _latest_balance(tables).select(CONSUMER, col("remaining").alias("capacity_remaining"))
    rows = (tables.contract_items.join(spent, CONSUMER, "left").join(left, CONSUMER, "left")
            .withColumns({
                "total_consumption": money(or_zero(col("total_consumption"))),
                "capacity_remaining": or_zero(col("capacity_remaining"), 2).cast(DecimalType(38, 2)),
                **{name: date_label(col(name)) for name in ("start_date", "end_date", "expiration_date")}}))
    return project_existing(rows, [CONSUMER, *CONTRACT_LABELS]).withColumnsRenamed(CONTRACT_LABELS)


def active_subscription(tables: PublishedTables) -> DataFrame:
    """The latest rate per account and service, under display names."""
    keep = ["region", "service_level", "currency", "effective_rate"]
    latest = latest_per(tables.rate_sheet, [CONSUMER, "account_name", "service_type"], ["date"], keep)
    return project_existing(latest, [CONSUMER, *SUBSCRIPTION_LABELS]).withColumnsRenamed(SUBSCRIPTION_LABELS)


def consumption_mix(tables: PublishedTables) -> DataFrame:
    """Compute, cloud services, storage and the rest: spend, share, credits."""
    col = F.col
    # The usage types shown on their own.
    kinds = {"compute": "Compute", "cloud services": "Cloud Services", "storage": "Storage"}
    is_kind = {k: col("usage_type") == k for k in kinds}
    sums = tables.usage.groupBy(*KEY).agg(
        F.sum("usage_in_currency").alias("total"),
        *[or_zero(F.sum(F.when(is_kind[k], col("usage_in_currency")))).alias(f"spend {k}") for k in kinds],
        *[or_zero(F.sum(F.when(is_kind[k], col("usage")))).alias(f"credits {k}") for k in kinds])
    rest = col("total")
    for k in kinds:
        rest = rest - col(f"spend {k}")
    parts = [F.struct(F.lit(label).alias("category"), money(col(f"spend {k}")).alias("spend"),
                      money(col(f"credits {k}")).alias("credits")) for k, label in kinds.items()]
    parts.append(F.struct(F.lit("Other").alias("category"), money(rest).alias("spend"),
                          F.lit(None).cast(MONEY_SUM).alias("credits")))
    rows = sums.select(CONSUMER, "total", F.explode(F.array(*parts)).alias("__p"))
    share = (F.when(col("total") != 0, col("__p.spend").cast("double") / col("total").cast("double") * 100)
             .otherwise(F.lit(0.0)))
    return rows.select(CONSUMER, "__p.category", "__p.spend", share.alias("share_pct"),
                       "__p.credits")


def monthly_by_type(tables: PublishedTables) -> DataFrame:
    return (spend_by(tables.usage, CONSUMER, month_floor(F.col(DAY)).alias("month"), "usage_type")
            .select(CONSUMER, "month", "usage_type", money(F.col("spend")).alias("spend")))


def type_ranking(tables: PublishedTables) -> DataFrame:
    """Usage types by total spend, smallest first within a consumer."""
    return (spend_by(tables.usage, CONSUMER, "usage_type")
            .select(CONSUMER, "usage_type", money(F.col("spend")).alias("total"))
            .orderBy(CONSUMER, "total", "usage_type"))
