"""All reports and operators as named queries over the test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal
from functools import lru_cache
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnledger.functions.labels import currency_label, percent_label
from burnledger.functions.scalars import percent_of
from burnledger.operators import audits, config, pricing, shared
from burnledger.operators.daily_store import DailyStore
from burnledger.operators.published_store import PublishedStore, touched_by_rows
from burnledger.operators.usage import DAY, daily_spend, running_total
from burnledger.plans import customer, portfolio
from burnledger.plans.common import entitlements
from burnledger.plans.customer import PublishedTables
from burnledger.sources.bridge import AS_OF, CONSUMER_EXAMPLE, BridgeSource
from burnledger.sources.schemas import BALANCE_COLUMNS, CONTRACT, CUSTOMER, ORG
from burnledger.sources.tables import normalise_dates
from burnledger.sources.versions import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

LOAD_DAY = dt.date(1998, 1, 1)  # the second load of the stored tables begins here
PREVIEW_ORDER = ("usage_date", "account_name", "service_type", "usage_in_currency")


def _on_source(build: Callable[[BridgeSource], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(BridgeSource(spark, sf_dir))


def _on_published(build: Callable[[PublishedTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(PublishedTables(BridgeSource(spark, sf_dir), AS_OF))


def _spend(src: BridgeSource, contract: str | None) -> DataFrame:
    return daily_spend(src.usage, contract).withColumn("spend", portfolio.money(F.col("spend")))


def _view_counts(p: PublishedTables) -> DataFrame:
    return shared.view_counts(p.contract_items, p.usage, p.balances, p.rate_sheet, customer.KEY)


def _usage_bounds(src: BridgeSource) -> DataFrame:
    return src.usage.groupBy(CUSTOMER, DAY).agg(F.count("*").alias("n")).groupBy(CUSTOMER).agg(
        F.min(DAY).alias("first_usage"), F.max(DAY).alias("last_usage"), F.count("*").alias("usage_days"))


def _currency_labels(src: BridgeSource) -> DataFrame:
    daily = src.usage.groupBy(CUSTOMER, DAY).agg(F.sum("usage_in_currency").alias("spend"))
    return daily.select(CUSTOMER, DAY, currency_label(F.col("spend")).alias("label"))


def _percent_labels(src: BridgeSource) -> DataFrame:
    granted = entitlements(src.contract_items, [CUSTOMER])
    daily = src.usage.groupBy(CUSTOMER, DAY).agg(F.sum("usage_in_currency").alias("spend"))
    share = percent_of(F.col("cumulative"), F.col("capacity") + F.col("free_usage"))
    return (running_total(daily, [CUSTOMER]).join(granted, CUSTOMER)
            .select(CUSTOMER, DAY, percent_label(share).alias("label")))


def _cumulative(src: BridgeSource) -> DataFrame:
    return src.cumulative.select(CONTRACT, "date", portfolio.money(F.col("daily_total")).alias("daily_total"),
                                 portfolio.money(F.col("cum_spend")).alias("cum_spend"))


def _changes(src: BridgeSource) -> DataFrame:
    """A new rate for every third organisation."""
    return src.rates.filter("effective_to IS NULL").filter(F.substring_index(ORG, "_", -1).cast("int") % 3 == 0).select(
        ORG, F.lit(Decimal("0.0450")).cast("decimal(5,4)").alias("markup_pct"),
        F.lit(dt.date(2001, 8, 1)).alias("effective_from"))


def _onboard(src: BridgeSource) -> tuple[DataFrame, DataFrame]:
    return config.onboard(src.mapping, src.rates, "ORG_NEW", "New Customer", "LOC_NEW",
                          Decimal("0.025"), AS_OF.date(), AS_OF)


@lru_cache(maxsize=1)
def _loaded(spark: SparkSession, sf_dir: str) -> BridgeSource:
    """A source whose reports start from a stored daily aggregate, made by two loads; the second has late rows.

    The store is written once for the queries that share it.
    """
    raw, store = BridgeSource(spark, sf_dir), DailyStore(spark, shared_folder(spark))
    late = (F.col(DAY) >= F.lit(LOAD_DAY)) | (F.crc32(F.col("account_name")) % 7 == 0) & (F.dayofmonth(DAY) == 1)
    store.add(raw.usage.filter(~late))
    store.add(raw.usage.filter(late))
    return BridgeSource(spark, sf_dir, stored_measures=store.read())


def _on_store(build: Callable[[BridgeSource], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(_loaded(spark, sf_dir))


def _republished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage that all consumers read after a second run, which publishes the months of later rows only."""
    src, store = BridgeSource(spark, sf_dir), PublishedStore(spark, shared_folder(spark))
    later = F.col(DAY) >= F.lit(LOAD_DAY)
    before = SimpleNamespace(mapping=src.mapping, rates=src.rates, contract_items=src.contract_items, rate_sheet=src.rate_sheet,
                             balances=src.balances, usage=src.usage.filter(~later))
    store.publish(before, AS_OF, views=["usage"])
    store.publish(src, AS_OF, touched_by_rows(src.usage.filter(later), DAY, src.mapping), views=["usage"])
    return store.tables().usage


QUERIES: dict[str, Query] = {
    # shared views
    "shared_contract_items": _on_source(lambda s: shared.shared_contract_items(s, CONSUMER_EXAMPLE, AS_OF)),
    "shared_rate_sheet": _on_source(lambda s: shared.shared_rate_sheet(s, CONSUMER_EXAMPLE)),
    "shared_usage": _on_source(lambda s: shared.shared_usage(s, CONSUMER_EXAMPLE)),
    "shared_balance": _on_source(lambda s: shared.shared_balance(s, CONSUMER_EXAMPLE)),
    "shared_usage_preview": _on_source(
        lambda s: shared.shared_usage(s, CONSUMER_EXAMPLE).orderBy(*PREVIEW_ORDER).limit(10)),
    "published_contract_items": _on_source(lambda s: shared.published_contract_items(s, AS_OF)),
    "published_rate_sheet": _on_source(shared.published_rate_sheet),
    "publish_all": _on_source(shared.published_usage),
    "published_balance": _on_source(shared.published_balance),
    "shared_view_counts": _on_published(_view_counts),
    # pricing and drawdown
    "date_spine": _on_source(lambda s: s.calendar),
    "contract_items": _on_source(lambda s: s.contract_items),
    "rate_sheet": _on_source(lambda s: s.rate_sheet),
    "priced_usage": _on_source(lambda s: pricing.price_usage(s.quantities)),
    "daily_spend": _on_source(lambda s: _spend(s, None)),
    "daily_spend_one_contract": _on_source(lambda s: _spend(s, "CNT-3")),
    "cumulative_spend": _on_source(_cumulative),
    "balances": _on_source(lambda s: s.balances),
    "latest_balances": _on_source(lambda s: portfolio.latest_balances(s).select(
        CONTRACT, CUSTOMER, "date", *BALANCE_COLUMNS)),
    # portfolio
    "markup_list": _on_source(lambda s: portfolio.active_markups(s, AS_OF)),
    "portfolio_kpis": _on_source(lambda s: portfolio.portfolio_kpis(s, AS_OF)),
    "monthly_by_customer": _on_source(portfolio.monthly_by_customer),
    "customer_summary": _on_source(lambda s: portfolio.customer_summary(s, AS_OF)),
    "deep_dive": _on_source(lambda s: portfolio.deep_dive(s, AS_OF)),
    "alerts": _on_source(lambda s: portfolio.customer_alerts(s, AS_OF)),
    "dual_view": _on_source(lambda s: portfolio.dual_view(s, AS_OF)),
    "cumulative_series": _on_source(portfolio.cumulative_series),
    "service_daily": _on_source(portfolio.service_daily),
    "comparison": _on_source(lambda s: portfolio.comparison(s, AS_OF)),
    "comparison_by_credits": _on_source(lambda s: portfolio.comparison(s, AS_OF, "total_credits")),
    "comparison_by_burn": _on_source(lambda s: portfolio.comparison(s, AS_OF, "burn_per_row")),
    "top5_trend": _on_source(lambda s: portfolio.top_trend(s, AS_OF)),
    "top5_trend_by_credits": _on_source(lambda s: portfolio.top_trend(s, AS_OF, "total_credits")),
    "top5_trend_by_burn": _on_source(lambda s: portfolio.top_trend(s, AS_OF, "burn_per_row")),
    "margin_report": _on_source(lambda s: portfolio.margin_report(s, AS_OF)),
    "margin_report_ascending": _on_source(lambda s: portfolio.margin_report(s, AS_OF, descending=False)),
    "margin_kpis": _on_source(lambda s: portfolio.margin_kpis(s, AS_OF)),
    # customer
    "contract_header": _on_published(customer.contract_header),
    "overview": _on_published(lambda p: customer.overview(p, AS_OF)),
    "customer_alerts": _on_published(lambda p: customer.consumer_alerts(p, AS_OF)),
    "summary_bar": _on_published(lambda p: customer.summary_bar(p, AS_OF)),
    "usage_vs_entitlement": _on_published(lambda p: customer.usage_vs_entitlement(p, AS_OF)),
    "usage_vs_entitlement_30d": _on_published(lambda p: customer.usage_vs_entitlement(p, AS_OF, "30 days")),
    "usage_vs_entitlement_60d": _on_published(lambda p: customer.usage_vs_entitlement(p, AS_OF, "60 days")),
    "usage_vs_entitlement_90d": _on_published(lambda p: customer.usage_vs_entitlement(p, AS_OF, "90 days")),
    "usage_vs_entitlement_180d": _on_published(lambda p: customer.usage_vs_entitlement(p, AS_OF, "180 days")),
    "projection": _on_published(lambda p: customer.projection(p, AS_OF)),
    "breakout_1m": _on_published(lambda p: customer.breakout(p, AS_OF, "1M")),
    "breakout_3m": _on_published(lambda p: customer.breakout(p, AS_OF, "3M")),
    "breakout_1y": _on_published(lambda p: customer.breakout(p, AS_OF, "1Y")),
    "breakout_qtd": _on_published(lambda p: customer.breakout(p, AS_OF, "QTD")),
    "breakout_ytd": _on_published(lambda p: customer.breakout(p, AS_OF, "YTD")),
    "breakout_all": _on_published(lambda p: customer.breakout(p, AS_OF)),
    "active_contract": _on_published(customer.active_contract),
    "active_subscription": _on_published(customer.active_subscription),
    "consumption_mix": _on_published(customer.consumption_mix),
    "monthly_by_type": _on_published(customer.monthly_by_type),
    "type_ranking": _on_published(customer.type_ranking),
    "daily_by_service": _on_published(customer.daily_by_service),
    # config and audits
    "onboard_mapping": _on_source(lambda s: _onboard(s)[0]),
    "onboard_rates": _on_source(lambda s: _onboard(s)[1]),
    "change_rate": _on_source(lambda s: config.change_rate(
        s.rates, "ORG_3", Decimal("0.05"), dt.date(2001, 7, 1), AS_OF)),
    "change_rates": _on_source(lambda s: config.change_rate_rows(s.rates, _changes(s), AS_OF)),
    "deactivate": _on_source(lambda s: config.deactivate(s.mapping, "ORG_5", AS_OF)),
    "rate_violations": _on_source(lambda s: audits.rate_violations(s.dirty_rates)),
    "mapping_violations": _on_source(lambda s: audits.mapping_violations(s.dirty_mapping)),
    "rate_overlaps": _on_source(lambda s: audits.rate_overlaps(s.dirty_rates)),
    "current_markups": _on_source(lambda s: audits.current_markups(s.rates, s.mapping, AS_OF.date())),
    "customers": _on_source(lambda s: audits.customers(s.contract_items)),
    "isolation_leaks": _on_source(lambda s: audits.isolation_leaks(shared.published_usage(s), s.swapped_mapping)),
    "reconcile": _on_source(lambda s: audits.reconcile_markup(s.usage, s.mapping, s.rates)),
    "config_gaps": _on_source(lambda s: audits.config_gaps(s.usage, s.mapping, s.dirty_rates)),
    # stored aggregates and views
    "stored_customer_summary": _on_store(lambda s: portfolio.customer_summary(s, AS_OF)),
    "stored_portfolio_kpis": _on_store(lambda s: portfolio.portfolio_kpis(s, AS_OF)),
    "stored_comparison": _on_store(lambda s: portfolio.comparison(s, AS_OF)),
    "republished_usage": _republished,
    # dates and labels
    "normalised_dates": _on_source(lambda s: normalise_dates(s.usage.select(
        CONTRACT, F.date_format("usage_date", "yyyy-MM-dd").alias("usage_date"), "service_type", "usage"))),
    "usage_bounds": _on_source(_usage_bounds),
    "currency_labels": _on_source(_currency_labels),
    "percent_labels": _on_source(_percent_labels),
}
