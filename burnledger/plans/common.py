"""Burn, overage, depletion and expiry: shared by the portfolio and customer reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnledger.functions.clock import Clock
from burnledger.functions.labels import (
    balance_band, date_label, depletion_label, expiry_class, expiry_label, urgency_band,
)
from burnledger.functions.scalars import magnitude_if_negative, mean, or_zero, percent_of
from burnledger.operators.usage import DAY, running_total
from burnledger.sources.schemas import CAPACITY_ITEM, FREE_ITEM

BURN_DAYS = 30
NO_FORECAST = 999
MOST_DAYS = 1e15  # keeps the days of a vanishing burn within a bigint
LATEST = {
    "remaining": "capacity_balance",
    "rollover": "rollover_balance",
    "free_left": "free_usage_balance",
    "on_demand": "on_demand_consumption_balance",
}


def item_total(item: str) -> Column:
    return F.sum(F.when(F.col("contract_item") == item, F.col("amount")))


def entitlements(items: DataFrame, keys: list[str]) -> DataFrame:
    """Capacity and free usage per key, with the outer dates of its contracts."""
    return items.groupBy(*keys).agg(
        or_zero(item_total(CAPACITY_ITEM), 4).alias("capacity"),
        or_zero(item_total(FREE_ITEM), 4).alias("free_usage"),
        F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))


def recent_mean(spend: Column, recent: Column) -> Column:
    """Mean over the recent rows of a group, NULL if there are none."""
    return mean(F.sum(F.when(recent, spend)), F.count(F.when(recent, spend)))


def burn_rate(spend: Column, recent: Column, fallback: bool) -> Column:
    """Mean of the recent daily sums. Without any: the all-time mean, or 0."""
    recent_burn = recent_mean(spend, recent)
    other = mean(F.sum(spend), F.count(spend)) if fallback else F.lit(0.0)
    return F.coalesce(recent_burn, other, F.lit(0.0))


def overage(on_demand: Column, consumed: Column, remaining: Column, limit: Column | None) -> Column:
    """On-demand spend; without any, what was consumed beyond ``limit`` once capacity is gone.

    The reports differ in the limit: capacity alone, capacity and free usage,
    or no such fallback.
    """
    booked = magnitude_if_negative(on_demand)
    return booked if limit is None else with_fallback(booked, consumed, remaining, limit)


def with_fallback(booked: Column, consumed: Column, remaining: Column, limit: Column) -> Column:
    return (F.when((booked == 0) & (consumed > limit) & (remaining <= 0), consumed - limit)
            .otherwise(booked))


def whole_days(funds: Column, burn: Column) -> Column:
    """Days the funds last, rounded down; only for positive funds and burn."""
    return F.floor(F.least(funds.cast("double") / burn, F.lit(MOST_DAYS))).cast("bigint")


def usage_profile(daily: DataFrame, limits: DataFrame, keys: list[str], clock: Clock,
                  fallback: bool) -> DataFrame:
    """One row per key: totals, active days, burn, first day the entitlement was reached.

    ``daily`` has one row per key and day, ``limits`` one per key with
    ``entitlement``. The running sum hashes the days by key; the join and the
    final aggregate reuse that, so the days are shuffled once.
    """
    series = running_total(daily, keys).join(limits.select(*keys, "entitlement"), keys, "left")
    reached = F.col("cumulative") >= or_zero(F.col("entitlement"), 4)
    return series.groupBy(*keys).agg(
        F.sum("spend").alias("consumed"),
        F.sum("credits").alias("credits"),
        F.count("*").alias("usage_days"),
        burn_rate(F.col("spend"), clock.within(F.col(DAY), BURN_DAYS), fallback).alias("burn"),
        F.min(F.when(reached, F.col(DAY))).alias("reached_on"),
        F.max(DAY).alias("last_usage_date"),
        F.max_by("cumulative", DAY).alias("last_cumulative"))


def assess(state: DataFrame, clock: Clock, expired_keeps_days: bool = False) -> DataFrame:
    """Overage, expiry and depletion forecast from one row per contract holder.

    Needs ``consumed credits usage_days burn reached_on capacity free_usage
    start_date end_date`` and the latest balances (see ``LATEST``).
    """
    col = F.col
    state = state.withColumns({
        **{name: or_zero(col(name)) for name in ("consumed", "credits")},
        **{name: or_zero(col(name), 4) for name in ("capacity", "free_usage")},
        **{name: or_zero(col(name), 2) for name in LATEST},
        "usage_days": F.coalesce(col("usage_days"), F.lit(0)),
        "burn": F.coalesce(col("burn"), F.lit(0.0)),
    })
    state = state.withColumns({
        "entitlement": col("capacity") + col("free_usage"),
        "funds": col("remaining") + col("rollover") + col("free_left"),
    })
    state = state.withColumns({
        "overage": overage(col("on_demand"), col("consumed"), col("remaining"), col("entitlement")),
        "consumption_pct": percent_of(col("consumed"), col("entitlement")),
        "credits_per_day": col("credits").cast("double") / F.greatest(col("usage_days"), F.lit(1)),
        "expired": F.coalesce(clock.expired(col("end_date")), F.lit(False)),
        "days_past_end": F.coalesce(-clock.days_until(col("end_date")), F.lit(0)),
        "days_to_expiry": F.coalesce(F.greatest(clock.days_until(col("end_date")), F.lit(0)), F.lit(0)),
    })
    state = state.withColumn("depleted", (col("remaining") <= 0) | (col("overage") > 0))
    lasting = (col("burn") > 0) & (col("funds") > 0)
    state = state.withColumn(
        "days_to_depletion",
        F.when(col("depleted"), F.lit(0).cast("bigint")).when(lasting, whole_days(col("funds"), col("burn")))
        .otherwise(F.lit(NO_FORECAST)))
    days = col("days_to_depletion")
    return state.withColumns({
        "depletion_date": F.when(col("depleted"), F.coalesce(date_label(col("reached_on")), F.lit("Depleted")))
        .when(lasting, F.coalesce(date_label(clock.date_after(days)), F.lit("N/A"))).otherwise(F.lit("N/A")),
        "depletes_before_expiry": ~col("expired") & ~col("depleted") & (days < col("days_to_expiry")),
        "urgency": urgency_band(col("depleted"), days),
        "balance_band": balance_band(col("remaining"), col("consumption_pct")),
        "expiry_class": expiry_class(col("expired"), col("days_to_expiry")),
        "expiry_label": expiry_label(col("expired"), col("days_to_expiry")),
    }).withColumn("depletion_label", depletion_label(
        col("depleted"), days, col("expired"), col("depletes_before_expiry"), not expired_keeps_days))


def alerts(assessed: DataFrame, keys: list[str]) -> DataFrame:
    """Zero to two rows per key: depleted or top-up advisory, and expired.

    ``amount`` is the capacity used up, or the funds left; ``days`` the days
    before the end of the contract, or since. A depleted holder also shows what
    was consumed, the overage, and the rollover that absorbs it.
    """
    col = F.col

    def alert(name: str, date: Column, amount: Column, days: Column, spent: bool = False) -> Column:
        details = [(col(c) if spent else none).cast(kind).alias(c) for c, kind in (
            ("consumed", "decimal(38,6)"), ("overage", "decimal(38,6)"), ("rollover", "decimal(38,2)"))]
        return F.struct(F.lit(name).alias("alert"), date.alias("on_date"),
                        amount.cast("decimal(38,4)").alias("amount"), days.cast("bigint").alias("days"), *details)

    none = F.lit(None)
    funds_alert = (
        F.when(col("depleted"), alert("CAPACITY_DEPLETED", col("depletion_date"), col("capacity"), none, True))
        .when(col("depletes_before_expiry"),
              alert("TOP_UP_ADVISORY", col("depletion_date"), col("funds"),
                    col("days_to_expiry") - col("days_to_depletion"))))
    end_alert = F.when(col("expired"), alert("CONTRACT_EXPIRED", date_label(col("end_date")), none,
                                             F.abs(col("days_past_end"))))
    found = F.array_compact(F.array(funds_alert, end_alert))
    return assessed.select(*keys, F.explode(found).alias("__a")).select(*keys, "__a.*")
