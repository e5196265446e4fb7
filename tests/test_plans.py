"""What Spark is asked to do: scans, shuffles, joins."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from burnledger.operators import shared
from burnledger.plans import customer, portfolio
from burnledger.plans.customer import PublishedTables
from burnledger.plans.oracle import ORACLES
from burnledger.plans.registry import QUERIES
from burnledger.sources import schemas, tables
from burnledger.sources.bridge import AS_OF, BridgeSource

SF = "/root/testdata/sf0.001"


def initial_plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")  # show all pushed filters
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan after it ran, with what was reused."""
    df.collect()
    return initial_plan(df).split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    src = BridgeSource(spark, SF)
    for name, df in {"partner_usage_in_currency_daily": src.usage, "partner_contract_items": src.contract_items,
                     "partner_rate_sheet_daily": src.rate_sheet, "partner_remaining_balance_daily": src.balances,
                     "account_mapping": src.mapping, "markup_rates": src.rates}.items():
        df.coalesce(1).write.parquet(f"{root}/{name}")
    return tables.TableSource(spark, root)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_of_tables(spark, name):
    plan = initial_plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan


def test_shared_usage_does_not_shuffle_the_usage_table(stored):
    plan = initial_plan(shared.shared_usage(stored, "LOC3"))
    assert "Exchange hash" not in plan and "SortMergeJoin" not in plan
    assert plan.count("BroadcastHashJoin") == 2


def test_published_usage_is_aggregated_before_its_shuffle(stored):
    plan = initial_plan(customer.monthly_by_type(PublishedTables(stored, AS_OF)))
    below = plan[plan.index("Exchange hashpartitioning(consumer"):]
    assert below.index("partial_sum") < below.index("BroadcastHashJoin")


def test_scans_read_only_the_columns_of_the_report(stored):
    plan = initial_plan(portfolio.monthly_by_customer(stored))
    scan = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
    assert sorted(re.sub(r"#\d+L?", "", c) for c in scan.split(",")) == [
        "sold_to_customer_name", "usage_date", "usage_in_currency"]


def test_periods_and_consumers_reach_the_scan(stored):
    plan = initial_plan(customer.breakout(PublishedTables(stored, AS_OF).of("LOC3"), AS_OF, "3M"))
    assert "GreaterThanOrEqual(usage_date,2001-03-18)" in plan
    assert "EqualTo(consumer_account_locator,LOC3)" in plan


def test_one_customer_reaches_the_scan(stored):
    name = F.col(schemas.CUSTOMER) == "NATION_3"
    plan = initial_plan(portfolio.service_daily(stored).filter(name))
    assert "EqualTo(sold_to_customer_name,NATION_3)" in plan
    plan = initial_plan(portfolio.cumulative_series(stored).filter(name))
    assert "EqualTo(sold_to_customer_name,NATION_3)" in plan


@pytest.mark.parametrize("name, passes", [("balances", 1), ("customer_summary", 1), ("usage_vs_entitlement", 1),
                                          ("top5_trend", 1), ("margin_kpis", 1)])
def test_order_lines_are_read_once_per_report(spark, name, passes):
    """Balances, contracts and totals of a report share the scan and shuffle of the lines."""
    plan = final_plan(QUERIES[name](spark, SF))
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == passes


def test_windows_see_days_and_never_one_partition_for_all(stored):
    for df in (portfolio.cumulative_series(stored), portfolio.deep_dive(stored, AS_OF)):
        plan = initial_plan(df)
        window = plan[plan.index("Window ["):]
        assert "HashAggregate" in window
        assert "hashpartitioning(sold_to_customer_name" in window[:window.index("HashAggregate")]


def test_latest_period_filter_uses_dates(stored):
    plan = initial_plan(stored.usage.filter(F.col("usage_date") >= F.lit(dt.date(2001, 5, 17))))
    assert "GreaterThanOrEqual(usage_date,2001-05-17)" in plan
