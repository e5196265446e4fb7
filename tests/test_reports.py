import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from burnledger.functions.clock import Clock
from burnledger.operators.usage import daily_cube
from burnledger.plans import common, customer, portfolio
from burnledger.plans.customer import PublishedTables
from burnledger.sources.schemas import CONSUMER, CUSTOMER
from billing_rows import balance_rows, billing, item_rows, mapping_rows, rate_rows, table, usage_rows
from burnledger.sources import schemas
from burnledger.sources.bridge import BridgeSource

DAY = dt.date
AS_OF = dt.datetime(2026, 3, 15, 12)
CLOCK = Clock(AS_OF)


def days(first, n, amount, org="A"):
    return [(org, first + dt.timedelta(days=i), amount) for i in range(n)]


def build(spark, usage, items, balances, rates=(), mapping=()):
    return billing(
        usage=usage_rows(spark, usage), contract_items=item_rows(spark, items),
        balances=balance_rows(spark, balances),
        rates=rate_rows(spark, list(rates) or [("none", "0.01", DAY(2020, 1, 1), None)]),
        mapping=mapping_rows(spark, list(mapping) or [("none", "none")]),
        rate_sheet=table(spark, schemas.RATE_SHEET, [{"date": DAY(2026, 1, 1), "effective_rate": D("1.00")}]))


def row_of(df, org="A"):
    return df.filter(F.col(CUSTOMER) == f"Customer {org}").first()


def test_worked_example(spark):
    # Consumed 199,647 of 204,000; 4,353 left plus 10,000 rollover at 583 a day last 24 days.
    usage = days(DAY(2026, 2, 14), 30, "583") + [("A", DAY(2025, 6, 1), "182157")]
    src = build(spark, usage, [("A", "capacity", "200000", DAY(2026, 4, 30)), ("A", "free usage", "4000", DAY(2026, 4, 30))],
                [("A", DAY(2026, 3, 15), "0", "4353", "0", "10000"), ("A", DAY(2026, 3, 14), "0", "9999", "0", "10000")],
                rates=[("A", "0.03", DAY(2025, 5, 1), None)], mapping=[("A", "L1")])
    row = row_of(portfolio.deep_dive(src, AS_OF))
    assert (row.consumed, row.remaining, row.burn) == (D("199647.000000"), D("4353.00"), 583.0)
    assert (row.days_to_depletion, row.depletion_date) == (24, "2026-04-08")
    assert (row.days_to_expiry, row.depletes_before_expiry, row.urgency) == (45, True, "RED")
    assert (row.expiry_class, row.depletion_label, row.depleted) == ("APPROACHING", "24 days", False)
    assert row.margin_revenue == D("5989.410000") and row.customer_sees == D("205636.410000")
    alert = portfolio.customer_alerts(src, AS_OF).collect()
    assert [(a.alert, a.on_date, a.days) for a in alert] == [("TOP_UP_ADVISORY", "2026-04-08", 21)]
    # A constant markup changes the amounts, not the days.
    seen = customer.overview(PublishedTables(src, AS_OF), AS_OF).first()
    assert (seen.days_to_depletion, seen.remaining, seen.burn) == (24, D("4483.59"), pytest.approx(600.49))
    summary = row_of(portfolio.customer_summary(src, AS_OF))
    assert (summary.days_to_depletion, summary.status, summary.burn_rate) == ("24", "At Risk", 583.0)
    kpis = portfolio.portfolio_kpis(src, AS_OF).first()
    assert (kpis.n_at_risk, kpis.n_expired, kpis.avg_markup_pct) == (1, 0, pytest.approx(3.0))
    views = {r.view: r for r in portfolio.dual_view(src, AS_OF).collect()}
    assert views["raw"].entitlement == D("204000.000000")
    assert views["customer"].consumed == D("205636.410000")


def test_overage_variants(spark):
    # 1120 consumed; 1000 capacity, 100 free; nothing booked on demand yet.
    src = build(spark, [("A", DAY(2026, 3, 10), "1120")],
                [("A", "capacity", "1000", DAY(2026, 12, 31)), ("A", "free usage", "100", DAY(2026, 12, 31))],
                [("A", DAY(2026, 3, 10), "0", "0", "0", "30")], mapping=[("A", "L1")])
    assert portfolio.portfolio_kpis(src, AS_OF).first().overage == D("0.00")
    assert row_of(portfolio.customer_summary(src, AS_OF)).overage == D("120.000000")
    assert row_of(portfolio.deep_dive(src, AS_OF)).overage == D("20.000000")
    seen = customer.overview(PublishedTables(src, AS_OF), AS_OF).first()
    assert seen.overage == D("20.000000") and seen.depleted and seen.depletion_date == "2026-03-10"


def test_booked_overage_wins(spark):
    src = build(spark, [("A", DAY(2026, 3, 10), "1180")], [("A", "capacity", "1000", DAY(2026, 12, 31))],
                [("A", DAY(2026, 3, 10), "0", "0", "-30", "0")])
    assert row_of(portfolio.customer_summary(src, AS_OF)).overage == D("30.000000")
    kpis = portfolio.portfolio_kpis(src, AS_OF).first()
    assert (kpis.overage, kpis.n_in_overage) == (D("30.00"), 1)


def test_burn_variants(spark):
    day = DAY(2026, 3, 10)
    rows = [("A", day, "10"), ("A", day, "20"), ("A", day + dt.timedelta(days=1), "30")]
    src = build(spark, rows, [("A", "capacity", "1000", DAY(2026, 12, 31))], [("A", day, "0", "900", "0", "0")],
                mapping=[("A", "L1")])
    assert row_of(portfolio.customer_summary(src, AS_OF)).burn_rate == 30.0
    assert row_of(portfolio.comparison(src, AS_OF)).burn_per_row == 20.0
    # No usage in the last 30 days: the seller's report has no burn, the consumer's the all-time mean.
    later = dt.datetime(2026, 6, 15, 12)
    summary = row_of(portfolio.customer_summary(src, later))
    assert (summary.burn_rate, summary.days_to_depletion, summary.status) == (0.0, "N/A", "Active")
    seen = customer.overview(PublishedTables(src, later), later).first()
    assert (seen.burn, seen.days_to_depletion) == (30.0, 30)
    assert row_of(portfolio.comparison(src, later)).burn_per_row == 0.0


@pytest.mark.parametrize("as_of, first", [(dt.datetime(2026, 3, 15, 12), DAY(2026, 2, 14)),
                                          (dt.datetime(2026, 3, 15), DAY(2026, 2, 13))])
def test_the_thirty_day_window(spark, as_of, first):
    usage = [("A", first, "10"), ("A", first - dt.timedelta(days=1), "1000")]
    src = build(spark, usage, [("A", "capacity", "5", DAY(2026, 12, 31))], [("A", first, "0", "900", "0", "0")])
    assert row_of(portfolio.customer_summary(src, as_of)).burn_rate == 10.0


def test_status_and_expiry(spark):
    recent = DAY(2026, 3, 10)
    src = build(spark, [(o, recent, "10") for o in "ABC"] + [("D", recent, "0")],
                [("A", "capacity", "5000", DAY(2026, 12, 31)), ("B", "capacity", "5000", DAY(2026, 3, 15)),
                 ("C", "capacity", "10", DAY(2026, 12, 31)), ("D", "capacity", "10", DAY(2026, 12, 31))],
                [("A", recent, "0", "4000", "0", "0"), ("B", recent, "0", "4000", "0", "0"),
                 ("C", recent, "0", "0", "0", "0"), ("D", recent, "0", "10", "0", "0")])
    got = {r[CUSTOMER][-1]: (r.status, r.days_to_depletion) for r in portfolio.customer_summary(src, AS_OF).collect()}
    assert got == {"A": ("Active", "400"), "B": ("Expired", "400"), "C": ("At Risk", "0"), "D": ("Active", "N/A")}
    dive = {r[CUSTOMER][-1]: r for r in portfolio.deep_dive(src, AS_OF).collect()}
    assert (dive["B"].expiry_label, dive["B"].days_past_end) == ("EXPIRED", 1)
    assert (dive["D"].days_to_depletion, dive["D"].depletion_date, dive["D"].depletion_label) == (999, "N/A", "N/A")
    assert dive["C"].depletion_label == "DEPLETED"
    alerts = {(r[CUSTOMER][-1], r.alert): r for r in portfolio.customer_alerts(src, AS_OF).collect()}
    assert set(alerts) == {("B", "CONTRACT_EXPIRED"), ("C", "CAPACITY_DEPLETED")}
    kpis = portfolio.portfolio_kpis(src, AS_OF).first()
    assert (kpis.n_expired, kpis.n_at_risk) == (1, 1)


def test_crossing_date_with_falling_spend(spark):
    # The running sum reaches 100 on the 2nd, drops, and reaches it again.
    rows = [("A", DAY(2026, 3, 1), "90"), ("A", DAY(2026, 3, 2), "20"), ("A", DAY(2026, 3, 3), "-50"),
            ("A", DAY(2026, 3, 4), "80")]
    src = build(spark, rows, [("A", "capacity", "100", DAY(2026, 12, 31))], [("A", DAY(2026, 3, 4), "0", "0", "-40", "0")])
    assert row_of(portfolio.deep_dive(src, AS_OF)).depletion_date == "2026-03-02"
    series = [r.cumulative for r in portfolio.cumulative_series(src).orderBy("usage_date").collect()]
    assert series == [D("90.000000"), D("110.000000"), D("60.000000"), D("140.000000")]


def test_depleted_without_a_crossing(spark):
    src = build(spark, [("A", DAY(2026, 3, 1), "1")], [("A", "capacity", "100", DAY(2026, 12, 31))],
                [("A", DAY(2026, 3, 4), "0", "0", "0", "0")])
    assert row_of(portfolio.deep_dive(src, AS_OF)).depletion_date == "Depleted"


def test_customer_without_contract_or_balance(spark):
    src = build(spark, [("A", DAY(2026, 3, 1), "7"), ("B", DAY(2026, 3, 1), "7")],
                [("A", "capacity", "100", DAY(2026, 12, 31))], [("A", DAY(2026, 3, 1), "0", "93", "0", "0")])
    row = row_of(portfolio.customer_summary(src, AS_OF), "B")
    assert (row.capacity, row.remaining, row.status) == (D("0.0000"), D("0.00"), "At Risk")
    assert portfolio.deep_dive(src, AS_OF).count() == 2


def test_margins_and_repeated_markups(spark):
    src = build(spark, [("A", DAY(2026, 3, 1), "100"), ("B", DAY(2026, 3, 1), "50")],
                [("A", "capacity", "100", DAY(2026, 12, 31))], [("A", DAY(2026, 3, 1), "0", "93", "0", "0")],
                rates=[("A", "0.02", DAY(2025, 1, 1), DAY(2026, 3, 14)), ("A", "0.03", DAY(2025, 1, 1), DAY(2026, 3, 15)),
                       ("A", "0.05", DAY(2027, 1, 1), None), ("B", "0", DAY(2025, 1, 1), None),
                       ("B", "0.04", DAY(2025, 1, 1), None, False), ("Q", "0.01", DAY(2025, 1, 1), None)],
                mapping=[("A", "L1"), ("B", "L2", False), ("Q", "L3")])
    # The rate that ended yesterday is gone, the future one counts, the inactive consumer is listed.
    listed = sorted((r[CONSUMER], r.markup_pct) for r in portfolio.active_markups(src, AS_OF).collect())
    assert listed == [("L1", D("0.0300")), ("L1", D("0.0500")), ("L2", D("0.0000")), ("L3", D("0.0100"))]
    report = [(r[CONSUMER], r.markup_label, r.margin_revenue) for r in portfolio.margin_report(src, AS_OF).collect()]
    assert report == [("L1", "5.0%", D("5.000000")), ("L1", "3.0%", D("3.000000")), ("L2", "0.0%", D("0.000000")),
                      ("L3", "1.0%", D("0.000000"))]
    kpis = portfolio.margin_kpis(src, AS_OF).first()
    assert (kpis.total_margin, kpis.total_spend, kpis.n_rows, kpis.n_zero_markup) == (
        D("8.000000"), D("250.000000"), 4, 1)
    # By customer name the earliest rate is taken.
    assert row_of(portfolio.customer_summary(src, AS_OF)).markup_percent == D("3.0000")


def test_comparison_and_top_five(spark):
    rows = [(chr(65 + i), DAY(2026, 3, 1), str(10 * (i + 1))) for i in range(7)] + [("A", DAY(2026, 2, 1), "1000")]
    src = build(spark, rows, [("A", "capacity", "1", DAY(2026, 12, 31))], [("A", DAY(2026, 3, 1), "0", "1", "0", "0")])
    order = [r[CUSTOMER][-1] for r in portfolio.comparison(src, AS_OF).collect()]
    assert order == list("BCDEFGA")
    assert {r[CUSTOMER][-1] for r in portfolio.top_trend(src, AS_OF).collect()} == set("ADEFG")
    assert {r[CUSTOMER][-1] for r in portfolio.top_trend(src, AS_OF, "burn_per_row").collect()} == set("CDEFG")
    with pytest.raises(ValueError):
        portfolio.comparison(src, AS_OF, "unknown")


def test_consumer_reports(spark):
    rows = [("A", DAY(2026, 1, 5), "10", "STORAGE", "storage"), ("A", DAY(2026, 3, 5), "30", "WAREHOUSE_METERING", "compute"),
            ("A", DAY(2026, 3, 6), "60", "SNOWPIPE", "snowpipe"), ("B", DAY(2026, 3, 6), "5", "STORAGE", "storage")]
    src = build(spark, rows, [("A", "capacity", "100", DAY(2026, 12, 31)), ("A", "free usage", "20", DAY(2026, 12, 31)),
                              ("B", "capacity", "9", DAY(2026, 12, 31))],
                [("A", DAY(2026, 3, 6), "0", "20", "0", "5"), ("B", DAY(2026, 3, 6), "0", "4", "0", "0")],
                mapping=[("A", "L1"), ("B", "L2")])
    one = PublishedTables(src, AS_OF).of("L1")
    mix = {r.category: (r.spend, r.share_pct) for r in customer.consumption_mix(one).collect()}
    assert mix == {"Compute": (D("30.000000"), pytest.approx(30.0)), "Cloud Services": (D("0.000000"), 0.0),
                   "Storage": (D("10.000000"), 10.0), "Other": (D("60.000000"), 60.0)}
    ahead = customer.projection(one, AS_OF).orderBy("day_ahead").collect()
    assert len(ahead) == 60 and (ahead[0].date, ahead[0].projected) == (DAY(2026, 3, 7), 145.0)
    assert (ahead[-1].date, ahead[-1].projected) == (DAY(2026, 5, 5), 2800.0)
    # The running sum goes back before the period.
    series = customer.usage_vs_entitlement(one, AS_OF, "30 days").orderBy("usage_date").collect()
    assert [(r.daily, r.cumulative) for r in series] == [(D("30"), D("40")), (D("60"), D("100"))]
    assert series[0].entitlement == D("120.0000")
    assert customer.breakout(one, AS_OF, "1M").count() == 2 and customer.breakout(one, AS_OF).count() == 3
    assert [r.usage_type for r in customer.type_ranking(one).collect()] == ["storage", "compute", "snowpipe"]
    contract = customer.active_contract(one).collect()
    assert contract[0]["Consumption($)"] == D("100.000000") and contract[0]["Remaining($)"] == D("20.00")
    assert contract[0]["End Date"] == "2026-12-31"
    header = customer.contract_header(one).first()
    assert (header.entitlement, header.capacity) == (D("120.0000"), D("100.0000"))
    everyone = customer.overview(PublishedTables(src, AS_OF), AS_OF)
    assert everyone.count() == 2
    assert everyone.filter(F.col(CONSUMER) == "L1").collect() == customer.overview(one, AS_OF).collect()


def test_latest_rate_per_account_and_service(spark):
    sheet = table(spark, schemas.RATE_SHEET, [
        {"date": DAY(2026, 1, d), "account_name": "A-1", "service_type": s, "effective_rate": D(r)}
        for d, s, r in ((1, "STORAGE", "1"), (3, "STORAGE", "2"), (2, "STORAGE", "9"), (1, "SNOWPIPE", "4"))])
    src = billing(rate_sheet=sheet, mapping=mapping_rows(spark, [("A", "L1")]),
                  rates=rate_rows(spark, [("A", "0", DAY(2020, 1, 1), None)]))
    got = {r["Service"]: r["Rate ($)"] for r in customer.active_subscription(PublishedTables(src, AS_OF)).collect()}
    assert got == {"STORAGE": D("2.00"), "SNOWPIPE": D("4.00")}


def test_daily_cube_has_one_row_per_contract_and_day(spark):
    rows = usage_rows(spark, days(DAY(2026, 1, 1), 3, "1") * 5)
    assert sorted(r.spend for r in daily_cube(rows).collect()) == [D("5.000000")] * 3


def test_whole_days_rounds_down(spark):
    row = spark.range(1).select(common.whole_days(F.lit(D("14353.00")), F.lit(583.0)).alias("d")).first()
    assert row.d == 24


def test_a_vanishing_burn_leaves_the_other_rows_alone(spark):
    state = spark.createDataFrame(
        [("A", D("100"), D("1"), 5, 0.0001, None, D("1000000"), D("0"), DAY(2025, 1, 1), DAY(2026, 1, 1), D("500000"), D("0"), D("0"), D("0")),
         ("B", D("100"), D("1"), 5, 1e-300, None, D("1000000"), D("0"), DAY(2025, 1, 1), DAY(2026, 1, 1), D("500000"), D("0"), D("0"), D("0")),
         ("C", D("100"), D("1"), 5, 10.0, None, D("1000"), D("0"), DAY(2025, 1, 1), DAY(2026, 1, 1), D("500"), D("0"), D("0"), D("0"))],
        "k string, consumed decimal(18,2), credits decimal(18,2), usage_days bigint, burn double, reached_on date, "
        "capacity decimal(18,2), free_usage decimal(18,2), start_date date, end_date date, capacity_balance decimal(18,2), "
        "rollover_balance decimal(18,2), free_usage_balance decimal(18,2), on_demand_consumption_balance decimal(18,2)"
    ).withColumnsRenamed({v: k for k, v in common.LATEST.items()})
    got = {r.k: r for r in common.assess(state, Clock(dt.datetime(2025, 6, 20, 12))).collect()}
    assert (got["A"].days_to_depletion, got["A"].depletion_date) == (5_000_000_000, "N/A")
    assert got["B"].depletion_date == "N/A" and got["B"].days_to_depletion > 10**14
    assert (got["C"].days_to_depletion, got["C"].depletion_date) == (50, "2025-08-09")


def test_alerts_show_what_was_spent(spark):
    rows = portfolio.customer_alerts(BridgeSource(spark, "/root/testdata/sf0.001"), dt.datetime(2001, 6, 15, 12)).collect()
    spent = [r for r in rows if r.alert == "CAPACITY_DEPLETED"]
    assert spent and all(r.consumed is not None and r.overage is not None and r.rollover is not None for r in spent)
    assert all(r.consumed is None for r in rows if r.alert != "CAPACITY_DEPLETED")
