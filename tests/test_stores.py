"""Stored aggregates and views: only touched partitions change, readers see one version, writers do not overwrite each other."""

import datetime as dt
import re
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from billing_rows import D, mapping_rows, rate_rows, usage_rows
from burnledger.operators import audits, shared
from burnledger.operators.daily_store import STORED, STORED_KEYS, DailyStore
from burnledger.operators.published_store import MONTH, PublishedStore, touched_by_config, touched_by_rows
from burnledger.operators.usage import DAY, measures, summed
from burnledger.plans import portfolio
from burnledger.sources.bridge import AS_OF, BridgeSource
from burnledger.sources.schemas import CONSUMER, ORG
from burnledger.sources.tables import conform
from burnledger.sources.versions import Conflict

SF = "/root/testdata/sf0.001"
DAYS = [dt.date(2025, 1, d) for d in range(1, 9)]


def _rows(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def _full(usage):
    return conform(summed(measures(usage), *STORED_KEYS), STORED)


def _folders(df):
    return {re.search(r"__part=([^/]*)", f).group(1) for f in df.inputFiles()}


@pytest.fixture
def loads(spark):
    first = usage_rows(spark, [(org, day, f"{i}.25", "S", "t") for i, day in enumerate(DAYS[:6]) for org in "ABC"])
    # New days, one late row of an old day, one without a day.
    second = usage_rows(spark, [("A", DAYS[6], "4"), ("B", DAYS[7], "5"), ("A", DAYS[2], "0.5", "S", "t"), ("C", None, "7")])
    return first, second


def test_loads_equal_one_pass(spark, loads, tmp_path):
    store = DailyStore(spark, str(tmp_path / "cube"))
    assert store.read().count() == 0 and store.table.version() == 0
    assert store.add(loads[0]) == 1
    early = store.read()
    assert store.add(loads[1]) == 2
    assert _rows(store.read()) == _rows(_full(loads[0].union(loads[1])))
    assert _rows(early) == _rows(_full(loads[0])) == _rows(store.read(version=1))  # an earlier reader keeps its version


def test_a_load_reads_and_writes_the_days_it_touches(spark, loads, tmp_path):
    store = DailyStore(spark, str(tmp_path / "cube"))
    store.add(loads[0])
    read = []
    whole, store.table.read = store.table.read, lambda *a, **k: read.append(whole(*a, **k)) or read[-1]
    store.add(loads[1])
    assert _folders(read[0]) == {"2025-01-03"}
    commits = {r[DAY]: int(r["commit"].split("-")[0]) for r in store.table.manifest().collect()}
    assert {d for d, n in commits.items() if n == 2} == {DAYS[2], DAYS[6], DAYS[7], None}
    assert {d for d, n in commits.items() if n == 1} == set(DAYS[:6]) - {DAYS[2]}


def test_a_load_evaluates_the_arrived_rows_once(spark, loads, tmp_path):
    store, seen = DailyStore(spark, str(tmp_path / "cube")), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    for load in loads:
        store.add(load.mapInArrow(counted, load.schema))
    assert seen.value == loads[0].count() + loads[1].count()
    assert _rows(store.read()) == _rows(_full(loads[0].union(loads[1])))
    assert not list((tmp_path / "cube" / "arrived").iterdir())  # what was set aside is gone


def test_lines_are_shuffled_with_day_and_amount_only(spark):
    """The sources of the amount (extended price, discount) stay on the scan's side of the shuffle."""
    plan = BridgeSource(spark, SF).usage._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line and "l_orderkey" in line)
    below = plan.splitlines()[plan.splitlines().index(join) + 1]
    assert "Project" in below and "AS usage_in_currency" in below and "AS usage_date" in below


def test_a_repeated_load_fails_and_changes_nothing(spark, loads, tmp_path):
    store = DailyStore(spark, str(tmp_path / "cube"))
    base = store.table.version()
    store.add(loads[0], base)
    with pytest.raises(Conflict):
        store.add(loads[0], base)
    assert _rows(store.read()) == _rows(_full(loads[0])) and store.table.version() == 1


def test_restated_days(spark, loads, tmp_path):
    store = DailyStore(spark, str(tmp_path / "cube"))
    store.add(loads[0])
    days = spark.createDataFrame([(DAYS[0],), (DAYS[1],)], f"{DAY} date")
    fixed = loads[0].filter(F.col(DAY) != F.lit(DAYS[1])).withColumn("usage", F.col("usage") * 2).transform(
        lambda df: conform(df, loads[0].schema))
    store.restate(fixed, days)  # the second day has no rows any more
    got = {r[DAY]: r["c"] for r in store.read().groupBy(DAY).agg(F.sum("credits").alias("c")).collect()}
    plain = {r[DAY]: r["c"] for r in loads[0].groupBy(DAY).agg(F.sum("usage").alias("c")).collect()}
    assert DAYS[1] not in got and got[DAYS[0]] == 2 * plain[DAYS[0]] and got[DAYS[2]] == plain[DAYS[2]]


def test_an_unfinished_commit_is_not_seen(spark, loads, tmp_path):
    store = DailyStore(spark, str(tmp_path / "cube"))
    store.add(loads[0])
    open(tmp_path / "cube" / "head" / "2", "w").close()  # created, not yet written
    assert store.table.version() == 1 and _rows(store.read()) == _rows(_full(loads[0]))


def test_reports_from_the_store_read_no_usage_rows(spark, tmp_path):
    raw, store = BridgeSource(spark, SF), DailyStore(spark, str(tmp_path / "cube"))
    store.add(raw.usage)
    src = BridgeSource(spark, SF, stored_measures=store.read())
    reports = {
        "kpis": lambda s: portfolio.portfolio_kpis(s, AS_OF), "service": portfolio.service_daily,
        "comparison": lambda s: portfolio.comparison(s, AS_OF), "margins": lambda s: portfolio.margin_kpis(s, AS_OF),
    }
    for name, report in reports.items():
        got = report(src)
        assert _rows(got) == _rows(report(raw)), name
        assert not any("lineitem" in f for f in got.inputFiles()), name


@pytest.mark.parametrize("name", ["portfolio_kpis", "deep_dive"])
def test_one_scan_of_the_order_lines(spark, name):
    report = getattr(portfolio, name)(BridgeSource(spark, SF), AS_OF)
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1


def test_reconcile_in_one_pass(spark):
    usage = usage_rows(spark, [(org, day, f"{i}.333333") for i, day in enumerate(DAYS) for org in "ABCD"] + [("A", DAYS[0], "9")])
    mapping = mapping_rows(spark, [("A", "L1"), ("A", "L2"), ("A", "L2"), ("B", "L3"), ("C", "L4", False)])
    # A: overlapping rates, one given twice; B: none before the fifth day; D: no consumer.
    rates = rate_rows(spark, [("A", "0.0100", DAYS[0], None), ("A", "0.0300", DAYS[2], DAYS[4]), ("A", "0.0300", DAYS[2], DAYS[4]),
                              ("B", "0.0500", DAYS[4], None), ("D", "0.0200", DAYS[0], None)])
    src = SimpleNamespace(usage=usage, mapping=mapping, rates=rates)
    got = audits.reconcile_markup(usage, mapping, rates)
    assert _rows(got) == _rows(audits.reconcile(usage, shared.published_usage(src)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("usage_in_currency") and len(re.findall(r"LogicalRDD|LocalRelation", plan)) <= 3


# ---------------------------------------------------------------- published views

@pytest.fixture
def facts(spark):
    days = [dt.date(2025, m, d) for m in (1, 2, 3) for d in (1, 15)]
    usage = usage_rows(spark, [(org, day, f"{i}.5") for i, day in enumerate(days) for org in "ABC"])
    mapping = mapping_rows(spark, [("A", "L/1"), ("B", "L/1"), ("B", "L 2"), ("C", "Lö3")])
    rates = rate_rows(spark, [("A", "0.0100", days[0], None), ("B", "0.0200", days[2], None)])
    return SimpleNamespace(usage=usage, mapping=mapping, rates=rates, contract_items=None, rate_sheet=None, balances=None)


def _parts(store, number):
    return {(r[CONSUMER], r[MONTH].month) for r in store.table("usage").manifest().collect() if r["commit"].startswith(f"{number}-")}


def test_publishing_changes_touched_partitions_only(spark, facts, tmp_path):
    store = PublishedStore(spark, str(tmp_path / "out"))
    assert store.publish(facts, AS_OF, views=["usage"]) == 1
    assert _rows(store.tables().usage) == _rows(shared.published_usage(facts))
    reader = store.tables("L/1")
    arrived = usage_rows(spark, [("B", dt.date(2025, 2, 3), "100"), ("A", dt.date(2025, 4, 1), "7")])
    later = SimpleNamespace(**{**vars(facts), "usage": facts.usage.union(arrived)})
    assert store.publish(later, AS_OF, touched_by_rows(arrived, DAY, facts.mapping), views=["usage"]) == 2
    assert _parts(store, 2) == {("L/1", 2), ("L 2", 2), ("L/1", 4)}
    assert _rows(store.tables().usage) == _rows(shared.published_usage(later))
    # A reader from before the run goes on to see the first release, a new one the second.
    own = F.col(CONSUMER) == "L/1"
    assert _rows(reader.usage) == _rows(shared.published_usage(facts).filter(own))
    assert _rows(store.tables("L/1").usage) == _rows(shared.published_usage(later).filter(own))


def test_one_consumer_reads_only_their_folders(spark, facts, tmp_path):
    store = PublishedStore(spark, str(tmp_path / "out"))
    store.publish(facts, AS_OF, views=["usage"])
    whole, own = store.tables().usage, store.tables().of("Lö3").usage
    assert len(_folders(whole)) == 9 and len(_folders(own)) == 3
    assert {r[CONSUMER] for r in own.collect()} == {"Lö3"} and store.tables("nobody").usage.count() == 0


def test_config_changes_touch_whole_consumers(spark, facts, tmp_path):
    store = PublishedStore(spark, str(tmp_path / "out"))
    store.publish(facts, AS_OF, views=["usage"])
    after = SimpleNamespace(**{**vars(facts), "mapping": mapping_rows(spark, [("A", "L/1"), ("B", "L 2"), ("C", "L4")]),
                               "rates": rate_rows(spark, [("A", "0.0100", dt.date(2025, 1, 1), None), ("B", "0.0300", dt.date(2025, 2, 1), None)])})
    changed = touched_by_config(facts, after)
    assert {r[0] for r in changed.collect()} == {"L/1", "L 2", "Lö3", "L4"}
    store.publish(after, AS_OF, consumers=changed, views=["usage"])
    assert _rows(store.tables().usage) == _rows(shared.published_usage(after))
    assert touched_by_config(after, after).count() == 0


def test_of_two_publishers_one_fails(spark, facts, tmp_path):
    store, other = (PublishedStore(spark, str(tmp_path / "out")) for _ in range(2))
    store.publish(facts, AS_OF, views=["usage"])
    seen = other.releases.version()
    doubled = SimpleNamespace(**{**vars(facts), "usage": facts.usage.union(facts.usage)})
    store.publish(doubled, AS_OF, views=["usage"])
    other.releases.version = lambda: seen  # as if it had begun before
    with pytest.raises(Conflict):
        other.publish(facts, AS_OF, views=["usage"])
    assert _rows(store.tables().usage) == _rows(shared.published_usage(doubled))
    assert store.publish(facts, AS_OF, views=["usage"]) == 3  # goes on past the version that was never released
    assert _rows(store.tables().usage) == _rows(shared.published_usage(facts))
    assert D("1") and ORG in store.tables().usage.columns
