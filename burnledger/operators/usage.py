"""Aggregates of the usage table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnledger.sources.schemas import CONTRACT, CUSTOMER, ORG

DAY = "usage_date"
DAILY_KEYS = [ORG, CUSTOMER, CONTRACT, DAY]
ACCOUNT = "account_name"
MEASURES = ["spend", "credits", "n_rows"]


def spend_by(usage: DataFrame, *keys: str | Column) -> DataFrame:
    """Spend and credits per group. Spark sums per input partition before the shuffle."""
    return usage.groupBy(*keys).agg(F.sum("usage_in_currency").alias("spend"),
                                    F.sum("usage").alias("credits"))


def measures(usage: DataFrame) -> DataFrame:
    """Usage rows under the names of an aggregate, as its finest form: reports sum either in the same way."""
    return usage.select(*DAILY_KEYS, ACCOUNT, "service_type", "usage_type", F.col("usage_in_currency").alias("spend"),
                        F.col("usage").alias("credits"), F.col("usage_in_currency").isNotNull().cast("bigint").alias("n_rows"))


def summed(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Measures per group."""
    return rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MEASURES])


def _whole(cube: DataFrame) -> DataFrame:
    """The same rows, by a filter that refers to all measures and is true of every row.

    Parts of a report that use different measures thus still share one
    aggregate; otherwise each would be pruned to its own columns and the usage
    rows scanned again.
    """
    return cube.filter(F.coalesce("spend", "credits").isNotNull() | (F.col("n_rows") >= 0))


def daily_cube(rows: DataFrame) -> DataFrame:
    """Measures per contract and day: the one pass over the usage table.

    Totals, burn rates, cumulative curves and balances all start here, so that
    a report that needs several of them shuffles the usage table once. A group
    has one row per contract and day, however many usage rows a customer has.
    """
    return _whole(summed(rows, *DAILY_KEYS))


def grains(rows: DataFrame) -> DataFrame:
    """Measures per contract and day (grain 0) and per customer's account (grain 1), from one scan and one shuffle.

    Each row is summed once for either grain. The grain is given as an aggregate
    of itself: a filter on it stays above the sums, which all readers share.
    """
    tagged = rows.withColumn("__g", F.explode(F.array(F.lit(0), F.lit(1))))
    days, accounts = F.col("__g") == 0, F.col("__g") == 1
    keys = [F.when(days, F.col(k)).alias(k) if k != CUSTOMER else F.col(k) for k in DAILY_KEYS]
    return tagged.groupBy("__g", *keys, F.when(accounts, F.col(ACCOUNT)).alias(ACCOUNT)).agg(
        F.max("__g").alias("grain"), *[F.sum(m).alias(m) for m in MEASURES]).drop("__g")


def contract_days(by_grain: DataFrame) -> DataFrame:
    return _whole(by_grain.filter("grain = 0").select(*DAILY_KEYS, *MEASURES))


def account_totals(by_grain: DataFrame) -> DataFrame:
    return _whole(by_grain.filter("grain = 1").select(CUSTOMER, ACCOUNT, *MEASURES))


def daily_spend(usage: DataFrame, contract: str | None = None) -> DataFrame:
    """Spend per contract and day, optionally of one contract only."""
    rows = usage if contract is None else usage.filter(F.col(CONTRACT) == F.lit(contract))
    return rows.groupBy(CONTRACT, DAY).agg(F.sum("usage_in_currency").alias("spend"))


def daily_totals(cube: DataFrame, *keys: str) -> DataFrame:
    """The cube per key and day."""
    return cube.groupBy(*keys, DAY).agg(F.sum("spend").alias("spend"), F.sum("credits").alias("credits"))


def running_total(daily: DataFrame, keys: list[str], value: str = "spend",
                  date: str = DAY, name: str = "cumulative") -> DataFrame:
    """Running sum per key in date order. Input has one row per key and day."""
    frame = (Window.partitionBy(*keys).orderBy(date)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return daily.withColumn(name, F.sum(value).over(frame))


def latest_per(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as an aggregate.

    Each input partition keeps one candidate per key before the shuffle. Equal
    ``order`` values are decided by the kept values, so the result is stable.
    """
    columns = order + [c for c in keep if c not in order]
    best = F.max(F.struct(*columns)).alias("__best")
    grouped = df.groupBy(*keys).agg(best)
    return grouped.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in keep])
