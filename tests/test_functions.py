import datetime as dt

import pytest
from pyspark.sql import functions as F

from burnledger.functions import labels, scalars
from burnledger.functions.clock import Clock, month_floor

END = dt.date(2026, 4, 30)


@pytest.mark.parametrize("as_of, expired, days, label, kind", [
    (dt.datetime(2026, 5, 2, 12), True, -3, "EXPIRED", "EXPIRED"),
    (dt.datetime(2026, 4, 30, 12), True, -1, "EXPIRED", "EXPIRED"),
    (dt.datetime(2026, 4, 30), False, 0, "TODAY", "TODAY"),
    (dt.datetime(2026, 4, 29, 12), False, 0, "TODAY", "TODAY"),
    (dt.datetime(2026, 4, 10, 12), False, 19, "19 days", "SOON"),
    (dt.datetime(2026, 3, 15, 12), False, 45, "45 days", "APPROACHING"),
    (dt.datetime(2026, 1, 1, 12), False, 118, "118 days", "OK"),
])
def test_expiry(spark, as_of, expired, days, label, kind):
    clock, end = Clock(as_of), F.lit(END)
    left = F.greatest(clock.days_until(end), F.lit(0))
    row = spark.range(1).select(
        clock.expired(end).alias("e"), clock.days_until(end).alias("d"),
        labels.expiry_label(clock.expired(end), left).alias("l"),
        labels.expiry_class(clock.expired(end), left).alias("k")).first()
    assert tuple(row) == (expired, days, label, kind)


def test_periods():
    clock = Clock(dt.datetime(2026, 5, 15, 13))
    assert clock.cutoff("1M") == dt.date(2026, 4, 16)
    assert clock.cutoff("3M") == dt.date(2026, 2, 15)
    assert clock.cutoff("1Y") == dt.date(2025, 5, 16)
    assert clock.cutoff("QTD") == dt.date(2026, 4, 1)
    assert clock.cutoff("YTD") == dt.date(2026, 1, 1)
    assert clock.cutoff("All") is None
    assert clock.cutoff("180 days") == clock.since(180)
    with pytest.raises(ValueError):
        clock.cutoff("2W")


def test_thirty_days_hold_thirty_dates_or_thirty_one_at_midnight():
    noon, midnight = Clock(dt.datetime(2026, 5, 15, 12)), Clock(dt.datetime(2026, 5, 15))
    assert (noon.today - noon.since(30)).days + 1 == 30
    assert (midnight.today - midnight.since(30)).days + 1 == 31


def test_edge_agrees_with_comparing_timestamps(spark):
    for as_of in (dt.datetime(2026, 5, 15), dt.datetime(2026, 5, 15, 0, 0, 1), dt.datetime(2026, 5, 15, 23, 59)):
        clock = Clock(as_of)
        for offset in range(-33, 3):
            day = clock.today + dt.timedelta(days=offset)
            at = dt.datetime.combine(day, dt.time())
            assert (day >= clock.since(30)) == (at >= as_of - dt.timedelta(days=30))
            assert (day < clock.edge) == (as_of > at)
            assert (day - clock.edge).days == (at - as_of).days


@pytest.mark.parametrize("value, text", [
    (1234567.0, "$1.2M"), (12345.6, "$12,346"), (12344.5, "$12,344"), (999999.6, "$1,000,000"),
    (999.5, "$999.50"), (None, "$0"), (-2500000.0, "$-2.5M"), (0.0, "$0.00"), (-12.345, "$-12.35"),
])
def test_currency_label(spark, value, text):
    row = spark.range(1).select(labels.currency_label(F.lit(value).cast("double")).alias("t")).first()
    assert row.t == text


def test_percent_and_days_labels(spark):
    row = spark.range(1).select(
        labels.percent_label(F.lit(3.0)).alias("a"), labels.percent_label(F.lit(None).cast("double")).alias("b"),
        labels.days_label(F.lit(24)).alias("c"), labels.days_label(F.lit(999)).alias("d"),
        labels.depletion_label(F.lit(False), F.lit(999), F.lit(True), F.lit(False)).alias("e"),
        labels.depletion_label(F.lit(False), F.lit(999), F.lit(True), F.lit(False), False).alias("f"),
        labels.urgency_band(F.lit(False), F.lit(119)).alias("g"),
        labels.depletion_label(F.lit(False), F.lit(1200), F.lit(False), F.lit(True)).alias("h"),
        labels.balance_band(F.lit(1), F.lit(80.5)).alias("i"), labels.balance_band(F.lit(0), F.lit(1.0)).alias("j"),
        labels.balance_band(F.lit(1), F.lit(80.0)).alias("k")).first()
    assert tuple(row) == ("3.0%", "0.0%", "24", "N/A", "N/A", "999 days", "ORANGE", "1200 days", "ORANGE", "RED", "GREEN")


def test_calendar_functions(spark):
    row = spark.range(1).select(
        month_floor(F.lit(dt.date(2026, 5, 17))).alias("floor")).first()
    assert tuple(row) == (dt.date(2026, 5, 1),)


def test_guarded_ratio(spark):
    row = spark.range(1).select(scalars.percent_of(F.lit(1), F.lit(4)).alias("a"),
                                scalars.percent_of(F.lit(1), F.lit(0)).alias("b"),
                                scalars.mean(F.lit(5), F.lit(0)).alias("c")).first()
    assert tuple(row) == (25.0, 0.0, None)
