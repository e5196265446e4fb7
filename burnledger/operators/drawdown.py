"""Cumulative spend and the drawdown of contract funds."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from burnledger.functions.scalars import zero
from burnledger.operators.usage import DAY, running_total
from burnledger.sources.schemas import CONTRACT, REMAINING_BALANCE
from burnledger.sources.tables import conform, date_spine

_SUM = DecimalType(28, 6)


def cumulative_spend(contracts: DataFrame, daily: DataFrame, start: Column | dt.date,
                     end: Column | dt.date) -> DataFrame:
    """Gap-free running spend per contract and day of ``start .. end``.

    ``daily`` has spend per contract and day (further keys are summed over).
    The days of each contract enter as zero rows and are aggregated together
    with the spend, which fills the gaps without a join. Spend outside the
    days or of unknown contracts is dropped. The running sum sees at most one
    row per contract and day.
    """
    grid = (date_spine(contracts, start, end, DAY)
            .select(CONTRACT, DAY, zero().cast(_SUM).alias("spend"), F.lit(True).alias("__grid")))
    spend = daily.select(CONTRACT, DAY, F.col("spend").cast(_SUM).alias("spend"),
                         F.lit(False).alias("__grid"))
    filled = (grid.unionByName(spend).groupBy(CONTRACT, DAY)
              .agg(F.sum("spend").cast(_SUM).alias("daily_total"), F.max("__grid").alias("__grid"))
              .filter("__grid").drop("__grid"))
    return running_total(filled, [CONTRACT], "daily_total", DAY, "cum_spend").select(
        CONTRACT, F.col(DAY).alias("date"), "daily_total", F.col("cum_spend").cast(_SUM).alias("cum_spend"))


def waterfall(spend: Column, free: Column, capacity: Column, rollover: Column) -> dict[str, Column]:
    """Funds left after ``spend``: free usage first, then capacity, rollover, on demand (negative)."""
    none = zero(2)
    beyond_free = spend - free
    beyond_capacity = beyond_free - capacity
    beyond_all = beyond_capacity - rollover
    capacity_left = F.greatest(capacity - F.greatest(beyond_free, none), none)
    return {
        "free_usage_balance": F.greatest(free - F.least(spend, free), none),
        "capacity_balance": capacity_left,
        "on_demand_consumption_balance": F.when(beyond_all > 0, -beyond_all).otherwise(none),
        "rollover_balance": F.greatest(rollover - F.greatest(beyond_capacity, none), none),
        "marketplace_capacity_drawdown_balance": capacity_left * F.lit(Decimal("0.10")),
    }


def remaining_balances(contracts: DataFrame, cumulative: DataFrame) -> DataFrame:
    """Daily balances per contract at 2 decimals.

    ``contracts`` has one row per contract with ``capacity_amt``, ``free_amt``
    and ``rollover_amt``. The running sum already left the rows hashed by
    contract, so the join adds no shuffle of the daily rows.
    """
    funds = waterfall(F.col("cum_spend"), F.col("free_amt"), F.col("capacity_amt"), F.col("rollover_amt"))
    return conform(cumulative.join(contracts, CONTRACT).withColumns(funds), REMAINING_BALANCE)
