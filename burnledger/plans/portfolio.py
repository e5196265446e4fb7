"""Reports of the seller over all customers, on raw (not marked-up) data.

Customer reports cover every customer in one pass; a single customer is a
filter on the result, which Catalyst pushes down to the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from burnledger.functions.clock import Clock, month_floor
from burnledger.functions.labels import days_label, percent_label
from burnledger.functions.scalars import MONEY_SUM, magnitude_if_negative, mean, or_zero, percent_of
from burnledger.operators.joins import fold_rows
from burnledger.operators.markup import first_markup_by_customer, markup_list, percent_points
from burnledger.operators.usage import DAY, daily_totals, latest_per, running_total, summed
from burnledger.plans.common import (
    BURN_DAYS, LATEST, NO_FORECAST, alerts, assess, burn_rate, entitlements, usage_profile,
    whole_days, with_fallback,
)
from burnledger.sources.schemas import BALANCE_COLUMNS, CONSUMER, CONTRACT, CUSTOMER, ORG
from burnledger.sources.tables import Billing

AT_RISK_DAYS = 60
TOP = 5
# The metrics the comparison can be ordered by.
METRICS = ("total_consumption", "total_credits", "burn_per_row")


def money(value: Column) -> Column:
    return value.cast(MONEY_SUM)


def _last_rows(src: Billing) -> DataFrame:
    """The last balance row of each customer's contracts; both readings of it share one pass over the balances."""
    return latest_per(src.balances.select(CUSTOMER, CONTRACT, "date", *BALANCE_COLUMNS), [CUSTOMER, CONTRACT], ["date"],
                      ["date", *BALANCE_COLUMNS])


def latest_balances(src: Billing) -> DataFrame:
    """The last balance row of each contract."""
    return latest_per(_last_rows(src), [CONTRACT], ["date"], [CUSTOMER, "date", *BALANCE_COLUMNS])


def customer_latest(src: Billing) -> DataFrame:
    """The last balance row of each customer; on equal dates the greatest contract number."""
    return latest_per(_last_rows(src), [CUSTOMER], ["date", CONTRACT], list(LATEST.values())).select(
        CUSTOMER, *[F.col(column).alias(name) for name, column in LATEST.items()])


def _markups(src: Billing, clock: Clock) -> DataFrame:
    return markup_list(src.rates, src.mapping, clock.today)


def _customer_daily(src: Billing) -> DataFrame:
    return daily_totals(src.cube, CUSTOMER)


# ------------------------------------------------------------- whole portfolio

def active_markups(src: Billing, as_of: dt.datetime) -> DataFrame:
    return _markups(src, Clock(as_of))


def portfolio_kpis(src: Billing, as_of: dt.datetime) -> DataFrame:
    """One row: counts, totals, remaining funds, overage, markup revenue, risk."""
    clock, col = Clock(as_of), F.col
    # One pass over usage: accounts, margins, burn and (for contracts sized by spend) balances share one aggregate.
    src = src.with_accounts()
    cube = src.cube
    sold = src.accounts.agg(F.count_distinct(CUSTOMER).alias("n_customers"),
                  F.count_distinct("account_name").alias("n_accounts"),
                  F.sum("spend").alias("consumption"), F.sum("credits").alias("credits"))
    granted = entitlements(src.contract_items, [CONTRACT]).agg(
        F.count("*").alias("n_contracts"),
        F.sum("capacity").alias("capacity"), F.sum("free_usage").alias("free_usage"))
    booked = magnitude_if_negative(col("on_demand_consumption_balance"))
    left = latest_balances(src).agg(
        F.sum("capacity_balance").alias("remaining"), F.sum(booked).alias("overage"),
        F.count_if(col("on_demand_consumption_balance") < 0).alias("n_in_overage"))
    earned = _spend_per_markup(cube, _markups(src, clock)).agg(
        F.sum("margin_revenue").alias("markup_revenue"),
        mean(F.sum("markup_pct"), F.count("markup_pct")).alias("avg_markup"))
    risk = _risk(src, daily_totals(cube, CUSTOMER), clock)
    row = fold_rows(sold, granted, left, earned, risk)
    raised = 1 + F.coalesce(col("avg_markup"), F.lit(0.0))
    revenue = or_zero(col("markup_revenue"))
    return row.select(
        "n_customers", "n_accounts", "n_contracts",
        money(col("consumption")).alias("consumption"), money(col("credits")).alias("credits"),
        money(revenue).alias("markup_revenue"),
        money(col("consumption") + revenue).alias("customer_sees"),
        col("capacity").cast(DecimalType(38, 4)).alias("capacity"),
        col("free_usage").cast(DecimalType(38, 4)).alias("free_usage"),
        col("remaining").cast(DecimalType(38, 2)).alias("remaining"),
        percent_of(col("remaining"), col("capacity")).alias("remaining_pct"),
        (col("remaining").cast("double") * raised).alias("remaining_marked_up"),
        col("overage").cast(DecimalType(38, 2)).alias("overage"),
        (col("overage").cast("double") * raised).alias("overage_marked_up"),
        "n_in_overage",
        (F.coalesce(col("avg_markup"), F.lit(0.0)) * 100).alias("avg_markup_pct"),
        "n_at_risk", "n_expired")


def _risk(src: Billing, daily: DataFrame, clock: Clock) -> DataFrame:
    """Counts of expired customers, and of others whose funds last less than 60 days."""
    col = F.col
    burn = daily.groupBy(CUSTOMER).agg(
        burn_rate(col("spend"), clock.within(col(DAY), BURN_DAYS), fallback=False).alias("burn"))
    ends = src.contract_items.groupBy(CUSTOMER).agg(F.max("end_date").alias("end_date"))
    state = burn.join(ends, CUSTOMER, "left").join(customer_latest(src), CUSTOMER, "left")
    expired = F.coalesce(clock.expired(col("end_date")), F.lit(False))
    funds = (col("remaining") + col("rollover") + col("free_left")).cast("double")
    short = F.when(col("burn") > 0, funds / col("burn") < AT_RISK_DAYS)
    return state.agg(F.count_if(expired).alias("n_expired"),
                     F.count_if(~expired & F.coalesce(short, F.lit(False))).alias("n_at_risk"))


def monthly_by_customer(src: Billing) -> DataFrame:
    return (src.measures.groupBy(month_floor(F.col(DAY)).alias("month"), CUSTOMER).agg(F.sum("spend").alias("spend"))
            .select("month", CUSTOMER, money(F.col("spend")).alias("spend")))


def customer_summary(src: Billing, as_of: dt.datetime) -> DataFrame:
    """Funds, burn, forecast, markup and status per customer, largest first."""
    clock, col = Clock(as_of), F.col
    used = _customer_daily(src).groupBy(CUSTOMER).agg(
        F.sum("spend").alias("consumed"),
        burn_rate(col("spend"), clock.within(col(DAY), BURN_DAYS), fallback=False).alias("burn"))
    booked = magnitude_if_negative(col("on_demand_consumption_balance"))
    left = latest_balances(src).groupBy(CUSTOMER).agg(
        F.sum("capacity_balance").alias("remaining"), F.sum("rollover_balance").alias("rollover"),
        F.sum("free_usage_balance").alias("free_left"), F.sum(booked).alias("booked"))
    granted = entitlements(src.contract_items, [CUSTOMER])
    pct = first_markup_by_customer(_markups(src, clock))
    row = (used.join(granted, CUSTOMER, "left").join(left, CUSTOMER, "left").join(pct, CUSTOMER, "left")
           .withColumns({**{n: or_zero(col(n), 2) for n in ("remaining", "rollover", "free_left", "booked")},
                         "capacity": or_zero(col("capacity"), 4),
                         "markup_pct": or_zero(col("markup_pct"), 4)}))
    funds = col("remaining") + col("rollover") + col("free_left")
    days = (F.when(funds <= 0, F.lit(0)).when(col("burn") > 0, whole_days(funds, col("burn")))
            .otherwise(F.lit(NO_FORECAST)))
    expired = F.coalesce(clock.expired(col("end_date")), F.lit(False))
    return row.withColumn("__days", days).select(
        CUSTOMER,
        col("capacity").cast(DecimalType(38, 4)).alias("capacity"),
        money(col("consumed")).alias("consumed"),
        col("remaining").cast(DecimalType(38, 2)).alias("remaining"),
        money(with_fallback(col("booked"), col("consumed"), col("remaining"), col("capacity"))).alias("overage"),
        F.bround(col("burn"), 2).alias("burn_rate"),
        days_label(col("__days")).alias("days_to_depletion"),
        percent_points(col("markup_pct")).alias("markup_percent"),
        F.when(expired, F.lit("Expired")).when(col("__days") < AT_RISK_DAYS, F.lit("At Risk"))
        .otherwise(F.lit("Active")).alias("status"),
    ).orderBy(F.desc("consumed"), CUSTOMER)


# ------------------------------------------------------------- per customer

def _assessed(src: Billing, clock: Clock) -> DataFrame:
    limits = entitlements(src.contract_items, [CUSTOMER]).withColumn(
        "entitlement", F.col("capacity") + F.col("free_usage"))
    used = usage_profile(_customer_daily(src), limits, [CUSTOMER], clock, fallback=False)
    state = (used.join(limits.drop("entitlement"), CUSTOMER, "left")
             .join(customer_latest(src), CUSTOMER, "left")
             .join(first_markup_by_customer(_markups(src, clock)), CUSTOMER, "left"))
    return assess(state, clock).withColumn("markup_pct", or_zero(F.col("markup_pct"), 4))


def deep_dive(src: Billing, as_of: dt.datetime) -> DataFrame:
    """All indicators of each customer, with what the customer sees after markup."""
    col = F.col
    margin = money(col("consumed") * col("markup_pct"))
    raised = 1 + col("markup_pct")
    return _assessed(src, Clock(as_of)).select(
        CUSTOMER,
        money(col("consumed")).alias("consumed"),
        col("entitlement").cast(DecimalType(38, 4)).alias("entitlement"),
        "consumption_pct",
        money(col("credits")).alias("credits"), "usage_days",
        "credits_per_day",
        money(col("overage")).alias("overage"),
        money(col("overage") * raised).alias("overage_marked_up"),
        col("remaining").cast(DecimalType(38, 2)).alias("remaining"),
        money(col("remaining") * raised).alias("remaining_marked_up"),
        col("free_left").cast(DecimalType(38, 2)).alias("free_left"),
        col("rollover").cast(DecimalType(38, 2)).alias("rollover"),
        col("funds").cast(DecimalType(38, 2)).alias("funds"),
        "burn",
        "start_date", "end_date", "expired", "days_to_expiry", "days_past_end",
        "expiry_class", "expiry_label",
        "depleted", "days_to_depletion", "depletion_date", "depletion_label",
        "depletes_before_expiry", "urgency", "balance_band",
        percent_points(col("markup_pct")).alias("markup_percent"),
        margin.alias("margin_revenue"),
        money(col("consumed") + margin).alias("customer_sees"))


def customer_alerts(src: Billing, as_of: dt.datetime) -> DataFrame:
    return alerts(_assessed(src, Clock(as_of)), [CUSTOMER])


def dual_view(src: Billing, as_of: dt.datetime) -> DataFrame:
    """Seven metrics per customer, raw and as the customer sees them."""
    col = F.col
    views = F.array(F.struct(F.lit("raw").alias("view"), F.lit(1).cast(DecimalType(6, 4)).alias("by")),
                    F.struct(F.lit("customer").alias("view"),
                             (1 + col("markup_pct")).cast(DecimalType(6, 4)).alias("by")))
    amounts = ["entitlement", "capacity", "free_usage", "rollover", "consumed", "overage"]
    rows = _assessed(src, Clock(as_of)).withColumn("__v", F.explode(views))
    by = col("__v.by")
    return rows.select(CUSTOMER, col("__v.view").alias("view"),
                       *[money(col(name) * by).alias(name) for name in amounts],
                       (col("burn") * by.cast("double")).alias("burn"))


def cumulative_series(src: Billing) -> DataFrame:
    """Daily and running spend of each customer next to the entitlement."""
    granted = entitlements(src.contract_items, [CUSTOMER]).select(
        CUSTOMER, (F.col("capacity") + F.col("free_usage")).alias("entitlement"))
    series = running_total(_customer_daily(src), [CUSTOMER]).join(granted, CUSTOMER, "left")
    return series.select(CUSTOMER, DAY, money(F.col("spend")).alias("daily"),
                         money(F.col("cumulative")).alias("cumulative"),
                         or_zero(F.col("entitlement"), 4).cast(DecimalType(38, 4)).alias("entitlement"))


def service_daily(src: Billing) -> DataFrame:
    return (summed(src.measures, CUSTOMER, DAY, "service_type")
            .select(CUSTOMER, DAY, "service_type", money(F.col("spend")).alias("spend")))


# ------------------------------------------------------------- comparison

def _monthly_metrics(src: Billing, clock: Clock) -> DataFrame:
    recent = clock.within(F.col(DAY), BURN_DAYS)
    return src.measures.groupBy(CUSTOMER, month_floor(F.col(DAY)).alias("month")).agg(
        F.sum("spend").alias("spend"), F.sum("credits").alias("credits"),
        F.sum(F.when(recent, F.col("spend"))).alias("recent_spend"),
        F.sum(F.when(recent, F.col("n_rows"))).alias("recent_rows"))


def _compared(monthly: DataFrame) -> DataFrame:
    """Per customer; the burn here is the mean of the raw usage rows, not of the days."""
    return monthly.groupBy(CUSTOMER).agg(
        F.sum("spend").cast(MONEY_SUM).alias("total_consumption"),
        F.sum("credits").cast(MONEY_SUM).alias("total_credits"),
        F.bround(F.coalesce(mean(F.sum("recent_spend"), F.sum("recent_rows")), F.lit(0.0)), 2)
        .alias("burn_per_row"))


def comparison(src: Billing, as_of: dt.datetime, metric: str = METRICS[0]) -> DataFrame:
    _known(metric)
    return _compared(_monthly_metrics(src, Clock(as_of))).orderBy(F.col(metric), CUSTOMER)


def top_trend(src: Billing, as_of: dt.datetime, metric: str = METRICS[0]) -> DataFrame:
    """Monthly spend of the five customers with the highest metric."""
    _known(metric)
    monthly = _monthly_metrics(src, Clock(as_of))
    leaders = _compared(monthly).orderBy(F.desc(metric), CUSTOMER).limit(TOP).select(CUSTOMER)
    return (monthly.join(leaders, CUSTOMER, "left_semi")
            .select("month", CUSTOMER, money(F.col("spend")).alias("spend")))


def _known(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")


# ------------------------------------------------------------- margins

def _spend_per_markup(spend: DataFrame, listed: DataFrame) -> DataFrame:
    """Each listed rate with the organisation's spend and the margin on it."""
    by_org = spend.groupBy(ORG).agg(F.sum("spend").alias("raw_spend"))
    return (listed.join(by_org, ORG, "left")
            .withColumn("raw_spend", money(or_zero(F.col("raw_spend"))))
            .withColumn("margin_revenue", money(F.col("raw_spend") * F.col("markup_pct"))))


def _margins(src: Billing, clock: Clock) -> DataFrame:
    return _spend_per_markup(summed(src.measures, ORG), _markups(src, clock))


def margin_report(src: Billing, as_of: dt.datetime, descending: bool = True) -> DataFrame:
    """Spend and margin per rate and consumer, by margin."""
    col = F.col
    order = F.desc("margin_revenue") if descending else F.asc("margin_revenue")
    return _margins(src, Clock(as_of)).select(
        CUSTOMER, percent_label(percent_points(col("markup_pct"))).alias("markup_label"),
        "raw_spend", "margin_revenue",
        money(col("raw_spend") + col("margin_revenue")).alias("customer_sees"),
        CONSUMER, "is_active", "effective_from").orderBy(order, CUSTOMER, CONSUMER, "effective_from")


def margin_kpis(src: Billing, as_of: dt.datetime) -> DataFrame:
    col = F.col
    pct = percent_points(col("markup_pct"))
    return _margins(src, Clock(as_of)).agg(
        money(or_zero(F.sum("margin_revenue"))).alias("total_margin"),
        money(or_zero(F.sum("raw_spend"))).alias("total_spend"),
        F.count("*").alias("n_rows"),
        (mean(F.sum("markup_pct"), F.count("markup_pct")) * 100).alias("avg_markup_pct"),
        F.min(pct).alias("min_markup_percent"), F.max(pct).alias("max_markup_percent"),
        F.count_if(col("markup_pct") == 0).alias("n_zero_markup"))
