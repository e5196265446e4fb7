"""Reading, typing and writing the billing tables."""

from __future__ import annotations

import datetime as dt
from functools import cached_property
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from burnledger.operators.usage import account_totals, contract_days, daily_cube, grains, measures
from burnledger.sources.schemas import ORG, TABLES


class Billing(Protocol):
    """The six tables every report starts from, and aggregates of usage (operators.usage.measures and daily_cube)."""

    contract_items: DataFrame
    rate_sheet: DataFrame
    usage: DataFrame
    measures: DataFrame
    cube: DataFrame
    accounts: DataFrame

    balances: DataFrame
    mapping: DataFrame
    rates: DataFrame

    def with_accounts(self) -> Billing: ...


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema`` by name, cast to the declared types."""
    return df.selectExpr(*[f"cast(`{f.name}` as {f.dataType.simpleString()}) as `{f.name}`"
                           for f in schema.fields])


def normalise_dates(df: DataFrame) -> DataFrame:
    """Every column with DATE in its name becomes a date."""
    names = [c for c in df.columns if "DATE" in c.upper()]
    return df.withColumns({c: F.to_date(F.col(c)) for c in names}) if names else df


def project_existing(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that exist, in the given order."""
    present = set(df.columns)
    return df.select(*[c for c in names if c in present])


class TableSource:
    """The model tables below one root: a directory of Parquet or a catalog schema.

    Only the root differs between a demo and a production set of tables. Reports
    start from ``stored_measures`` (a DailyStore's rows), where given, instead of
    from the usage rows.
    """

    def __init__(self, spark: SparkSession, root: str, catalog: bool = False,
                 config_root: str | None = None, stored_measures: DataFrame | None = None,
                 by_grain: bool = False):
        self._stored, self._by_grain = stored_measures, by_grain
        self.spark, self.root, self.catalog = spark, root.rstrip("/"), catalog
        self.config_root = (config_root or root).rstrip("/")

    def read(self, name: str, root: str | None = None) -> DataFrame:
        root = root or self.root
        if self.catalog:
            return conform(self.spark.table(f"{root}.{name}"), TABLES[name])
        # Files may hold wider decimals than the model; they are read as written, then cast.
        return conform(self.spark.read.parquet(f"{root}/{name}"), TABLES[name])

    @cached_property
    def contract_items(self) -> DataFrame:
        return self.read("partner_contract_items")

    @cached_property
    def rate_sheet(self) -> DataFrame:
        return self.read("partner_rate_sheet_daily")

    @cached_property
    def usage(self) -> DataFrame:
        return self.read("partner_usage_in_currency_daily")

    @cached_property
    def measures(self) -> DataFrame:
        return measures(self.usage) if self._stored is None else self._stored

    @cached_property
    def grains(self) -> DataFrame:
        return grains(self.measures)

    @cached_property
    def cube(self) -> DataFrame:
        return contract_days(self.grains) if self._by_grain else daily_cube(self.measures)

    @property
    def accounts(self) -> DataFrame:
        return account_totals(self.grains)

    def with_accounts(self) -> TableSource:
        """The same tables for a report that needs totals by account too: cube and accounts then come from one scan."""
        return TableSource(self.spark, self.root, self.catalog, self.config_root, self._stored, by_grain=True)

    @cached_property
    def balances(self) -> DataFrame:
        return self.read("partner_remaining_balance_daily")

    @cached_property
    def mapping(self) -> DataFrame:
        return self.read("account_mapping", self.config_root)

    @cached_property
    def rates(self) -> DataFrame:
        return self.read("markup_rates", self.config_root)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """An inline table."""
    return spark.createDataFrame(rows, schema)


def date_spine(bounds: DataFrame, start: Column | dt.date, end: Column | dt.date,
               name: str = "dt") -> DataFrame:
    """Each row of ``bounds`` once per day of ``start .. end`` (both included).

    The days are generated on the executors from the row itself, so there is
    no second table and no product of two tables.
    """
    first = F.lit(start) if isinstance(start, dt.date) else start
    last = F.lit(end) if isinstance(end, dt.date) else end
    days = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 day")))
    return bounds.withColumn(name, F.explode(days))


# ---------------------------------------------------------------- writing

def create_table(spark: SparkSession, path: str, schema: StructType) -> None:
    """Create or replace an empty typed table."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def positional(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns matched by position, not by name, and cast to the declared types."""
    if len(df.columns) != len(schema.fields):
        raise ValueError(f"{len(df.columns)} columns given, {len(schema.fields)} declared")
    return conform(df.toDF(*schema.names), schema)


def append_rows(df: DataFrame, path: str, schema: StructType) -> None:
    """Append by position with the implicit cast to the declared scale."""
    positional(df, schema).write.mode("append").parquet(path)


def with_defaults(df: DataFrame, schema: StructType, now: dt.datetime) -> DataFrame:
    """Fill the columns a config insert leaves out; keep those it gives."""
    stamp = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    defaults = {"is_active": F.lit(True), "created_at": stamp, "updated_at": stamp,
                "effective_from": F.lit(now.date()), "effective_to": F.lit(None),
                "markup_pct": F.lit(0)}
    given = set(df.columns)
    missing = [n for n in schema.names if n not in given]
    unknown = [n for n in missing if n not in defaults]
    if unknown:
        raise ValueError(f"no value and no default for {unknown}")
    return conform(df.withColumns({n: defaults[n] for n in missing}) if missing else df, schema)


def save_fact(df: DataFrame, path: str, partition_by: list[str], date: str) -> None:
    """Write a fact table partitioned, with files sorted by organisation and day."""
    (df.hint("rebalance", *partition_by)
     .sortWithinPartitions(*partition_by, ORG, date)
     .write.mode("overwrite").partitionBy(*partition_by).parquet(path))


def save_snapshot(df: DataFrame, root: str, version: int) -> None:
    """Write a new version of a config table next to the ones still being read."""
    df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/version={version}")


def latest_snapshot(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The newest version. The version is a partition column: older files are not read."""
    typed = StructType([*schema.fields, StructField("version", IntegerType())])
    versions = spark.read.schema(typed).parquet(root)
    newest = versions.agg(F.max("version").alias("v"))
    return versions.filter(F.col("version") == newest.scalar()).select(*schema.names)


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. One file only for reports of a few rows per customer."""
    out = df.repartition(1) if single_file else df  # only the write is single; sort again where order matters
    out.write.mode("overwrite").option("header", True).csv(path)
