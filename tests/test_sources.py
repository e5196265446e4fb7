import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from burnledger.operators import config, shared
from burnledger.plans import customer, portfolio
from burnledger.plans.customer import PublishedTables
from burnledger.sources import schemas, tables
from burnledger.sources.bridge import AS_OF, BridgeSource
from burnledger.sources.schemas import CONSUMER, CONTRACT, CUSTOMER, ORG
from billing_rows import mapping_rows, rate_rows, usage_rows

DAY = dt.date
SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2025, 6, 20, 8)


def test_append_is_positional_and_casts(spark, tmp_path):
    path = str(tmp_path / "rates")
    tables.create_table(spark, path, schemas.MARKUP_RATES)
    assert spark.read.parquet(path).count() == 0
    rows = spark.createDataFrame([("A", 0.03126, "2025-01-01", None, True, NOW, NOW)],
                                 "x string, y double, z string, a date, b boolean, c timestamp, d timestamp")
    tables.append_rows(rows, path, schemas.MARKUP_RATES)
    tables.append_rows(rows, path, schemas.MARKUP_RATES)
    got = spark.read.schema(schemas.MARKUP_RATES).parquet(path).collect()
    assert len(got) == 2 and got[0].markup_pct == D("0.0313") and got[0].effective_from == DAY(2025, 1, 1)
    with pytest.raises(ValueError):
        tables.append_rows(rows.drop("d"), path, schemas.MARKUP_RATES)


def test_defaults(spark):
    given = spark.createDataFrame([("A", "Customer A", "L1")], [ORG, CUSTOMER, CONSUMER])
    row = tables.with_defaults(given, schemas.ACCOUNT_MAPPING, NOW).first()
    assert (row.is_active, row.created_at, row.updated_at) == (True, NOW, NOW)
    rate = tables.with_defaults(spark.createDataFrame([("A",)], [ORG]), schemas.MARKUP_RATES, NOW).first()
    assert (rate.markup_pct, rate.effective_from, rate.effective_to) == (D("0.0000"), DAY(2025, 6, 20), None)
    with pytest.raises(ValueError):
        tables.with_defaults(given.drop(CONSUMER), schemas.ACCOUNT_MAPPING, NOW)


def test_snapshots_leave_the_files_being_read_alone(spark, tmp_path):
    root = str(tmp_path / "mapping")
    tables.save_snapshot(mapping_rows(spark, [("A", "L1"), ("B", "L2")]), root, 1)
    current = tables.latest_snapshot(spark, root, schemas.ACCOUNT_MAPPING)
    tables.save_snapshot(config.deactivate(current, "A", NOW), root, 2)
    now = {r[CONSUMER]: r.is_active for r in
           tables.latest_snapshot(spark, root, schemas.ACCOUNT_MAPPING).collect()}
    assert now == {"L1": False, "L2": True}
    with pytest.raises(Exception, match="exist"):
        tables.save_snapshot(current, root, 2)


def test_dates_are_normalised_by_name(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 2, 3), "2025-01-05", "x")], "usage_date timestamp, Date string, note string")
    out = tables.normalise_dates(df)
    assert dict(out.dtypes) == {"usage_date": "date", "Date": "date", "note": "string"}
    assert tuple(out.first())[:2] == (DAY(2025, 1, 2), DAY(2025, 1, 5))


def test_projection_keeps_existing_columns(spark):
    assert tables.project_existing(spark.range(1).withColumn("b", F.lit(1)), ["b", "c", "id"]).columns == ["b", "id"]


def test_date_spine(spark):
    one = tables.literal_rows(spark, [("A",)], "k string")
    assert tables.date_spine(one, DAY(2025, 5, 3), DAY(2026, 5, 3)).count() == 366
    assert tables.date_spine(one, DAY(2025, 5, 3), DAY(2025, 5, 2)).count() == 0
    bounds = spark.createDataFrame([("A", DAY(2025, 1, 1), DAY(2025, 1, 2)), ("B", DAY(2025, 1, 1), DAY(2025, 1, 1))],
                                   "k string, a date, b date")
    assert tables.date_spine(bounds, F.col("a"), F.col("b")).count() == 3


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    """The bridge written as a model root, and read back."""
    root = str(tmp_path_factory.mktemp("model"))
    src = BridgeSource(spark, SF)
    tables.save_fact(src.usage.withColumn("usage_month", F.trunc("usage_date", "MM")),
                     f"{root}/partner_usage_in_currency_daily", ["usage_month"], "usage_date")
    for name, df in {"partner_contract_items": src.contract_items, "partner_rate_sheet_daily": src.rate_sheet,
                     "partner_remaining_balance_daily": src.balances, "account_mapping": src.mapping,
                     "markup_rates": src.rates}.items():
        df.write.parquet(f"{root}/{name}")
    return src, tables.TableSource(spark, root)


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_reports_do_not_depend_on_the_source(model):
    bridge, stored = model
    same(portfolio.customer_summary(bridge, AS_OF), portfolio.customer_summary(stored, AS_OF))
    same(shared.shared_usage(bridge, "LOC3"), shared.shared_usage(stored, "LOC3"))


def test_catalog_source(spark, model):
    _, stored = model
    names = {}
    for name, schema in schemas.TABLES.items():
        stored.read(name).createOrReplaceTempView(name)
        names[name] = schema

    class Views(tables.TableSource):
        def read(self, name, root=None):
            return tables.conform(self.spark.table(name), schemas.TABLES[name])

    same(portfolio.margin_report(Views(spark, "any", catalog=True), AS_OF), portfolio.margin_report(stored, AS_OF))


def test_publish_and_read_back(spark, model, tmp_path):
    _, stored = model
    paths = shared.publish(stored, str(tmp_path / "out"), AS_OF)
    usage = spark.read.parquet(paths["partner_usage_in_currency_daily"])
    assert usage.select(CONSUMER).distinct().count() == 23
    own = usage.filter(F.col(CONSUMER) == "LOC3").select(*schemas.USAGE.names)
    same(own, shared.shared_usage(stored, "LOC3"))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(consumer_account_locator" in plan
    balance = spark.read.parquet(paths["partner_remaining_balance_daily"])
    same(balance.filter(F.col(CONSUMER) == "LOC7").select(*schemas.REMAINING_BALANCE.names),
         shared.shared_balance(stored, "LOC7"))


def test_csv_exports(spark, model, tmp_path):
    _, stored = model
    published = PublishedTables(stored, AS_OF).of("LOC3")
    for name, df in {"summary": portfolio.customer_summary(stored, AS_OF), "margin": portfolio.margin_report(stored, AS_OF),
                     "contract": customer.active_contract(published),
                     "subscription": customer.active_subscription(published)}.items():
        path = str(tmp_path / name)
        tables.export_csv(df, path, single_file=True)
        back = spark.read.option("header", True).csv(path)
        assert back.columns == df.columns and back.count() == df.count()


def test_bridge_sizes(spark):
    src = BridgeSource(spark, SF)
    assert src.usage.count() == 6000 and src.organisations.count() == 25
    assert src.usage.schema.simpleString() == schemas.USAGE.simpleString()
    assert src.contract_items.schema.simpleString() == schemas.CONTRACT_ITEMS.simpleString()
    assert src.balances.schema.simpleString() == schemas.REMAINING_BALANCE.simpleString()


def test_usage_fixture_types(spark):
    assert usage_rows(spark, [("A", DAY(2025, 1, 1), "1")]).schema.simpleString() == schemas.USAGE.simpleString()
    assert rate_rows(spark, [("A", "0.01", DAY(2025, 1, 1), None)]).schema.names == schemas.MARKUP_RATES.names


def test_usage_is_every_order_line_and_the_sheet_covers_its_days(spark):
    src = BridgeSource(spark, SF)
    assert src.usage.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    late = src.usage.filter(F.col("usage_date") > AS_OF.date())
    assert late.count() > 0
    days = src.usage.select("account_name", F.col("usage_date").alias("date")).distinct()
    assert days.join(src.rate_sheet, ["account_name", "date"], "left_anti").count() == 0
    last = src.balances.groupBy(CONTRACT).agg(F.max("date").alias("last"))
    used = src.usage.groupBy(CONTRACT).agg(F.max("usage_date").alias("used"))
    assert last.join(used, CONTRACT).filter(F.col("last") < F.col("used")).count() == 0
    # Rows after the clock count in the totals, the latest 30 days and the latest balance.
    summary = {r[CUSTOMER]: r for r in portfolio.deep_dive(src, AS_OF).collect()}
    total = {r[CUSTOMER]: r.t for r in src.usage.groupBy(CUSTOMER).agg(F.sum("usage_in_currency").alias("t")).collect()}
    assert {c: r.consumed for c, r in summary.items()} == total
    assert any(r.depletes_before_expiry and r.days_to_depletion >= 999 and r.depletion_label == f"{r.days_to_depletion} days"
               for r in summary.values())


def test_declared_widths_are_read_by_path_and_catalog(spark, tmp_path):
    src, root = BridgeSource(spark, SF), str(tmp_path / "wide")
    tables_of = {"partner_contract_items": src.contract_items, "partner_rate_sheet_daily": src.rate_sheet.limit(50),
                 "partner_usage_in_currency_daily": src.usage, "partner_remaining_balance_daily": src.balances,
                 "account_mapping": src.mapping, "markup_rates": src.rates}
    spark.sql("CREATE DATABASE IF NOT EXISTS wide_widths")
    for name, df in tables_of.items():
        wide = df.withColumns({f.name: F.col(f.name).cast(f"decimal(38,{6 if f.dataType.scale > 2 else 2})")
                               for f in df.schema.fields
                               if f.dataType.typeName() == "decimal" and name not in ("account_mapping", "markup_rates")})
        wide.write.parquet(f"{root}/{name}")
        spark.sql(f"DROP TABLE IF EXISTS wide_widths.{name}")
        spark.sql(f"CREATE TABLE wide_widths.{name} USING parquet LOCATION '{root}/{name}'")
    by_path = portfolio.deep_dive(tables.TableSource(spark, root), AS_OF).orderBy(CUSTOMER).collect()
    by_name = portfolio.deep_dive(tables.TableSource(spark, "wide_widths", catalog=True), AS_OF).orderBy(CUSTOMER).collect()
    assert by_path == by_name and len(by_path) == 25
    spark.sql("DROP DATABASE wide_widths CASCADE")
