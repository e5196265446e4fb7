import datetime as dt
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from burnledger.operators import audits, config, drawdown, joins, markup, pricing, shared, usage
from burnledger.sources import schemas
from burnledger.sources.schemas import CONSUMER, CONTRACT, ORG
from billing_rows import balance_rows, billing, item_rows, mapping_rows, rate_rows, table, usage_rows

DAY = dt.date
RATES = [("A", "0.03", DAY(2025, 5, 1), DAY(2025, 6, 30)), ("A", "0.04", DAY(2025, 7, 1), None)]


def contracts(spark, free="100", capacity="1000", rollover="50", org="A"):
    return spark.createDataFrame(
        [("SELLER", org, f"Customer {org}", f"PO-{org}", f"CNT-{org}", "USD", D(capacity), D(free), D(rollover))],
        "organization_name string, sold_to_organization_name string, sold_to_customer_name string, "
        "sold_to_po_number string, sold_to_contract_number string, currency string, "
        "capacity_amt decimal(18,2), free_amt decimal(18,2), rollover_amt decimal(18,2)")


# ---------------------------------------------------------------- drawdown

def test_waterfall(spark):
    rows = usage_rows(spark, [("A", DAY(2025, 1, 1), "60"), ("A", DAY(2025, 1, 2), "20"), ("A", DAY(2025, 1, 2), "40"),
                              ("A", DAY(2025, 1, 3), "900"), ("A", DAY(2025, 1, 5), "100"), ("A", DAY(2025, 1, 6), "60"),
                              ("A", DAY(2025, 1, 9), "7"), ("Z", DAY(2025, 1, 2), "5")])
    held = contracts(spark)
    cumulative = drawdown.cumulative_spend(held, usage.daily_cube(rows), DAY(2025, 1, 1), DAY(2025, 1, 6))
    got = [tuple(r) for r in drawdown.remaining_balances(held, cumulative).orderBy("date").select(
        F.dayofmonth("date"), *schemas.BALANCE_COLUMNS).collect()]
    assert got == [
        (1, D("40.00"), D("1000.00"), D("0.00"), D("50.00"), D("100.00")),
        (2, D("0.00"), D("980.00"), D("0.00"), D("50.00"), D("98.00")),
        (3, D("0.00"), D("80.00"), D("0.00"), D("50.00"), D("8.00")),
        (4, D("0.00"), D("80.00"), D("0.00"), D("50.00"), D("8.00")),
        (5, D("0.00"), D("0.00"), D("0.00"), D("30.00"), D("0.00")),
        (6, D("0.00"), D("0.00"), D("-30.00"), D("0.00"), D("0.00")),
    ]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.decimals("-500", "3000", places=2), min_size=1, max_size=8))
def test_funds_are_conserved(spark, spends):
    free, capacity, rollover = (F.lit(D(v)) for v in ("100.00", "1000.00", "50.00"))
    df = spark.createDataFrame([(s,) for s in spends], "s decimal(18,2)")
    w = drawdown.waterfall(F.col("s"), free, capacity, rollover)
    for row in df.select("s", *[c.alias(n) for n, c in w.items()]).collect():
        left = (row.free_usage_balance + row.capacity_balance + row.rollover_balance
                + row.on_demand_consumption_balance)
        assert left == D("1150.00") - row.s


def test_negative_spend_gives_more_free_usage(spark):
    rows = usage_rows(spark, [("A", DAY(2025, 1, 1), "-10")])
    cumulative = drawdown.cumulative_spend(contracts(spark), usage.daily_cube(rows), DAY(2025, 1, 1), DAY(2025, 1, 1))
    row = drawdown.remaining_balances(contracts(spark), cumulative).first()
    assert row.free_usage_balance == D("110.00") and row.capacity_balance == D("1000.00")


def test_daily_spend_of_one_contract(spark):
    rows = usage_rows(spark, [("A", DAY(2025, 1, 1), "1"), ("A", DAY(2025, 1, 1), "2"), ("B", DAY(2025, 1, 1), "5")])
    assert [(r.spend) for r in usage.daily_spend(rows, "CNT-A").collect()] == [D("3.000000")]
    assert usage.daily_spend(rows).count() == 2


# ---------------------------------------------------------------- markup and isolation

def marked(spark, day, amount="10", org="A", rates=RATES):
    rows = usage_rows(spark, [(org, day, amount)])
    out = markup.apply_markup(rows, rate_rows(spark, rates), {"usage_in_currency": 6}, "usage_date")
    return sorted(r.usage_in_currency for r in out.collect())


@pytest.mark.parametrize("day, price", [
    (DAY(2025, 4, 30), "10.000000"), (DAY(2025, 5, 1), "10.300000"), (DAY(2025, 6, 30), "10.300000"),
    (DAY(2025, 7, 1), "10.400000")])
def test_rate_of_the_day(spark, day, price):
    assert marked(spark, day) == [D(price)]


def test_overlapping_rates_fan_out_and_inactive_ones_do_not_count(spark):
    both = RATES + [("A", "0.05", DAY(2025, 6, 1), None), ("A", "0.01", DAY(2025, 1, 1), None, False)]
    assert marked(spark, DAY(2025, 6, 15), rates=both) == [D("10.300000"), D("10.500000")]
    assert marked(spark, DAY(2025, 6, 15), org="B", rates=both) == [D("10.000000")]


def test_rounding_per_column(spark):
    sheet = table(spark, schemas.RATE_SHEET, [{"date": DAY(2025, 5, 2), "effective_rate": D(v)} for v in ("3.60", "0.02")])
    out = markup.apply_markup(sheet, rate_rows(spark, RATES), {"effective_rate": 2}, "date")
    assert sorted(r.effective_rate for r in out.collect()) == [D("0.02"), D("3.71")]
    balance = balance_rows(spark, [("A", DAY(2025, 5, 2), "0", "0", "-30.00", "0")])
    out = markup.apply_markup(balance, rate_rows(spark, RATES), shared.BALANCE_SCALES, "date")
    assert out.first().on_demand_consumption_balance == D("-30.90")


def source(spark, **more):
    day = DAY(2025, 5, 2)
    return billing(
        usage=usage_rows(spark, [("A", day, "10"), ("B", day, "20"), ("C", day, "30")]),
        contract_items=item_rows(spark, [("A", "capacity", "200000", DAY(2026, 4, 30)),
                                         ("B", "capacity", "1", DAY(2026, 4, 30))]),
        balances=balance_rows(spark, [("A", day, "1", "2", "-3", "4"), ("B", day, "1", "2", "-3", "4")]),
        rate_sheet=table(spark, schemas.RATE_SHEET, [{"date": day, "effective_rate": D("3.60")}]),
        mapping=mapping_rows(spark, [("A", "L1"), ("B", "L2"), ("C", "L3", False), ("B", "L1B")]),
        rates=rate_rows(spark, RATES), **more)


def test_a_consumer_sees_only_its_own_rows(spark):
    src, as_of = source(spark), dt.datetime(2025, 6, 1, 9)
    assert [r.usage_in_currency for r in shared.shared_usage(src, "L1").collect()] == [D("10.300000")]
    assert shared.shared_usage(src, "L3").count() == 0  # mapping switched off
    assert shared.shared_usage(src, "nobody").count() == 0
    assert [r.amount for r in shared.shared_contract_items(src, "L1", as_of).collect()] == [D("206000.0000")]
    assert shared.shared_usage(src, "L1").columns == schemas.USAGE.names
    assert shared.shared_balance(src, "L1").columns == schemas.REMAINING_BALANCE.names
    assert shared.shared_rate_sheet(src, "L1").columns == schemas.RATE_SHEET.names


def test_contract_amounts_follow_the_clock(spark):
    src = source(spark)
    amounts = [shared.shared_contract_items(src, "L1", as_of).first().amount
               for as_of in (dt.datetime(2025, 4, 1), dt.datetime(2025, 6, 30, 23), dt.datetime(2025, 7, 1))]
    assert amounts == [D("200000.0000"), D("206000.0000"), D("208000.0000")]


def test_batch_form_equals_the_single_consumer_views(spark):
    src = source(spark)
    batch = shared.published_usage(src)
    for consumer in ("L1", "L2", "L1B", "L3"):
        one = batch.filter(F.col(CONSUMER) == consumer).drop(CONSUMER)
        assert sorted(map(tuple, one.collect()), key=str) == sorted(
            map(tuple, shared.shared_usage(src, consumer).collect()), key=str)


def stored(spark, df, path):
    """The same rows as a file, whose size Spark knows."""
    df.write.parquet(str(path))
    return spark.read.schema(df.schema).parquet(str(path))


def test_salted_lookup_equals_broadcast(spark, tmp_path):
    # One organisation holds most rows; two of its rates overlap.
    days = [DAY(2025, 5, 1) + dt.timedelta(days=i) for i in range(120)]
    rows = usage_rows(spark, [("A", d, str(i + 1)) for i, d in enumerate(days) for _ in range(3)]
                      + [("B", d, "1") for d in days[:10]])
    rates = stored(spark, rate_rows(spark, RATES + [("A", "0.01", DAY(2025, 6, 15), None)]), tmp_path / "rates")
    mapping = stored(spark, mapping_rows(spark, [("A", "L1"), ("A", "L2"), ("B", "L1")]), tmp_path / "mapping")
    results, salted = {}, {}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("-1", "100m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            assert joins.broadcast_limit(rows) == (-1 if limit == "-1" else 100 << 20)
            out = shared.published_usage(billing(usage=rows, rates=rates, mapping=mapping))
            salted[limit] = "__salt" in out._jdf.queryExecution().toString()
            results[limit] = sorted(map(str, out.collect()))
            results[limit] += sorted(map(str, audits.config_gaps(rows, mapping, rates).collect()))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert salted == {"-1": True, "100m": False}
    assert results["-1"] == results["100m"]
    # 75 of the 120 days are covered by two rates; A is seen by two consumers.
    assert len([x for x in results["-1"] if "usage_in_currency" in x]) == 2 * (360 + 75 * 3) + 10


def test_fold_rows(spark):
    a = spark.range(5).agg(F.sum("id").alias("a"))
    b = spark.range(3).agg(F.max("id").alias("b"), F.lit("x").alias("c"))
    assert tuple(joins.fold_rows(a, b).first()) == (10, 2, "x")


# ---------------------------------------------------------------- pricing

def accounts(spark, level="Enterprise"):
    return spark.createDataFrame(
        [("SELLER", "A", "Customer A", "PO-A", "CNT-A", "ACC", "LOC", "R", level)],
        "organization_name string, sold_to_organization_name string, sold_to_customer_name string, "
        "sold_to_po_number string, sold_to_contract_number string, account_name string, account_locator string, "
        "region string, service_level string")


@pytest.mark.parametrize("level, compute, storage, transfer", [
    ("Business Critical", "4.80", "36.80", "0.03"), ("Enterprise", "3.60", "27.60", "0.02"),
    ("Standard", "3.00", "23.00", "0.02")])
def test_rate_sheet(spark, level, compute, storage, transfer):
    sheet = pricing.rate_sheet(accounts(spark, level), DAY(2025, 5, 3), DAY(2026, 5, 3))
    assert sheet.count() == 366 * 7
    got = {r.usage_type: r.effective_rate for r in sheet.filter("date = '2025-05-03'").collect()}
    assert (got["compute"], got["storage"], got["data transfer"]) == (D(compute), D(storage), D(transfer))
    assert sheet.columns == schemas.RATE_SHEET.names


def test_usage_price_by_rating_type_and_level(spark):
    given = pricing.with_services(accounts(spark, "Business Critical")).withColumns({
        "usage_date": F.lit(DAY(2025, 5, 3)), "credit_usage": F.lit(D("2.5"))})
    priced = pricing.price_usage(given)
    assert priced.columns == schemas.USAGE.names
    got = {r.usage_type: (r.usage, r.usage_in_currency) for r in priced.collect()}
    assert len(got) == 7
    assert got["compute"] == (D("2.500000"), D("12.000000"))
    assert got["storage"] == (D("2.500000"), D("92.000000"))
    assert got["data transfer"] == (D("2.500000"), D("0.080000"))


def test_contract_items(spark):
    held = contracts(spark).withColumns({
        "start_date": F.lit(DAY(2025, 1, 1)), "end_date": F.lit(DAY(2025, 12, 31)),
        "expiration_date": F.lit(DAY(2026, 1, 30)), "contract_modified_date": F.lit(DAY(2024, 12, 1))})
    got = {r.contract_item: r.amount for r in pricing.contract_items(held).collect()}
    assert got == {"capacity": D("1000.0000"), "free usage": D("100.0000")}


# ---------------------------------------------------------------- config and audits

NOW = dt.datetime(2025, 6, 20, 8)


def test_onboard(spark):
    mapping, rates = config.onboard(mapping_rows(spark, [("A", "L1")]), rate_rows(spark, RATES), "NEW", "New Co",
                                    "L9", D("0.025"), DAY(2025, 6, 20), NOW)
    row = mapping.filter(F.col(ORG) == "NEW").first()
    assert (row[CONSUMER], row.is_active, row.created_at) == ("L9", True, NOW)
    rate = rates.filter(F.col(ORG) == "NEW").first()
    assert (rate.markup_pct, rate.effective_from, rate.effective_to) == (D("0.0250"), DAY(2025, 6, 20), None)
    assert rates.schema.simpleString() == schemas.MARKUP_RATES.simpleString()


def test_change_rate_closes_the_open_row_only(spark):
    before = rate_rows(spark, [("Q", "0.015", DAY(2024, 2, 1), None), ("Q", "0.01", DAY(2023, 3, 1), DAY(2024, 1, 31)),
                               ("Q", "0.02", DAY(2024, 1, 15), None, False), ("R", "0.02", DAY(2024, 2, 1), None)])
    after = config.change_rate(before, "Q", D("0.035"), DAY(2024, 11, 15), NOW)
    got = sorted((r[ORG], r.effective_from, r.effective_to, r.markup_pct, r.is_active) for r in after.collect())
    assert got == [
        ("Q", DAY(2023, 3, 1), DAY(2024, 1, 31), D("0.0100"), True),
        ("Q", DAY(2024, 1, 15), None, D("0.0200"), False),
        ("Q", DAY(2024, 2, 1), DAY(2024, 11, 14), D("0.0150"), True),
        ("Q", DAY(2024, 11, 15), None, D("0.0350"), True),
        ("R", DAY(2024, 2, 1), None, D("0.0200"), True)]
    changes = spark.createDataFrame([("Q", D("0.035"), DAY(2024, 11, 15))],
                                    "sold_to_organization_name string, markup_pct decimal(5,4), effective_from date")
    batch = config.change_rate_rows(before, changes, NOW)
    assert sorted(map(str, batch.collect())) == sorted(map(str, after.collect()))
    # Prices of earlier days do not move.
    rows = usage_rows(spark, [("Q", DAY(2024, 11, 14), "10"), ("Q", DAY(2024, 11, 15), "10")])
    out = markup.apply_markup(rows, after, {"usage_in_currency": 6}, "usage_date")
    assert sorted(r.usage_in_currency for r in out.collect()) == [D("10.150000"), D("10.350000")]


def test_rates_above_the_limit_are_rejected(spark):
    out = config.change_rate(rate_rows(spark, RATES), "A", D("0.06"), DAY(2025, 9, 1), NOW)
    with pytest.raises(Exception, match="out of range"):
        out.collect()
    config.change_rate(rate_rows(spark, RATES), "A", D("0.05"), DAY(2025, 9, 1), NOW).collect()


def test_deactivate(spark):
    mapping = config.deactivate(mapping_rows(spark, [("A", "L1"), ("A", "L2"), ("B", "L3")]), "A", NOW)
    assert sorted((r[CONSUMER], r.is_active) for r in mapping.collect()) == [("L1", False), ("L2", False), ("L3", True)]


def test_audits(spark):
    rates = rate_rows(spark, [("A", "0.06", DAY(2025, 1, 1), None), ("B", "0.05", DAY(2025, 1, 1), None),
                              ("B", "0.02", DAY(2025, 6, 1), None), ("C", "0.01", DAY(2025, 1, 1), DAY(2025, 2, 1)),
                              ("C", "0.01", DAY(2025, 2, 2), None), ("D", "0.01", DAY(2025, 1, 1), DAY(2025, 3, 1)),
                              ("D", "0.01", DAY(2025, 3, 1), None), ("E", "0.01", DAY(2025, 1, 1), None),
                              ("E", "0.02", DAY(2025, 1, 1), None)])
    assert [(r[ORG], r.violation) for r in audits.rate_violations(rates).collect()] == [("A", "OUT_OF_RANGE")]
    overlaps = sorted((r[ORG], r.effective_from, r.n_rates) for r in audits.rate_overlaps(rates).collect())
    assert overlaps == [("B", DAY(2025, 6, 1), 1), ("D", DAY(2025, 3, 1), 1), ("E", DAY(2025, 1, 1), 2)]
    mapping = mapping_rows(spark, [("A", "L1"), ("A", "L1"), ("A", "L2")])
    assert [(r[CONSUMER], r.n_rows, r.violation) for r in audits.mapping_violations(mapping).collect()] == [
        ("L1", 2, "DUPLICATE")]


def test_isolation_leaks_and_reconciliation(spark):
    src = source(spark)
    published = shared.published_usage(src)
    assert audits.isolation_leaks(published, src.mapping).count() == 0
    swapped = mapping_rows(spark, [("A", "L2"), ("B", "L1"), ("B", "L1B")])
    leaks = sorted((r[CONSUMER], r[ORG], r.n_rows) for r in audits.isolation_leaks(published, swapped).collect())
    assert leaks == [("L1", "A", 1), ("L2", "B", 1)]
    checked = {r[ORG]: r for r in audits.reconcile(src.usage, shared.shared_usage(src, "L1")).collect()}
    assert (checked["A"].raw_total, checked["A"].shared_total, checked["A"].implied_markup) == (
        D("10.00"), D("10.30"), 0.03)
    assert checked["B"].shared_total is None


def test_config_gaps(spark):
    rows = usage_rows(spark, [("A", DAY(2025, 4, 29), "1"), ("A", DAY(2025, 4, 30), "1"), ("A", DAY(2025, 5, 2), "1"),
                              ("Z", DAY(2025, 5, 2), "1")])
    got = sorted((r.issue, r[ORG], r.first_date, r.n_days) for r in audits.config_gaps(
        rows, mapping_rows(spark, [("A", "L1"), ("Y", "L2", False)]), rate_rows(spark, RATES)).collect())
    assert got == [("INACTIVE_MAPPING", "Y", None, None), ("NO_ACTIVE_MAPPING", "Z", DAY(2025, 5, 2), 1),
                   ("NO_RATE", "A", DAY(2025, 4, 29), 2), ("NO_RATE", "Z", DAY(2025, 5, 2), 1)]


def test_latest_rows(spark):
    rows = balance_rows(spark, [("A", DAY(2025, 1, 1), "1", "1", "0", "0"), ("A", DAY(2025, 1, 3), "2", "2", "0", "0"),
                                ("B", DAY(2025, 1, 2), "3", "3", "0", "0")])
    last = usage.latest_per(rows, [CONTRACT], ["date"], ["capacity_balance"])
    assert {r[CONTRACT]: r.capacity_balance for r in last.collect()} == {"CNT-A": D("2.00"), "CNT-B": D("3.00")}
