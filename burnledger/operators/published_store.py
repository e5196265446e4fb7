"""The four shared views as stored tables: one partition per consumer and month, all views switched at once."""

from __future__ import annotations

import datetime as dt
from functools import cached_property
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from burnledger.functions.clock import month_floor
from burnledger.operators import shared
from burnledger.operators.joins import lookup_join
from burnledger.operators.markup import active
from burnledger.sources.schemas import CONSUMER, CONTRACT_ITEMS, ORG, RATE_SHEET, REMAINING_BALANCE, USAGE
from burnledger.sources.tables import Billing
from burnledger.sources.versions import PartitionedTable

MONTH = "__month"
# View -> schema and date of its rows.
VIEWS = {"contract_items": (CONTRACT_ITEMS, "start_date"), "rate_sheet": (RATE_SHEET, "date"),
         "usage": (USAGE, "usage_date"), "balances": (REMAINING_BALANCE, "date")}
RELEASE = StructType([StructField("view", StringType()), StructField("version", LongType())])


def _month(date: str) -> Column:
    return month_floor(F.col(date)).cast("date")


def touched_by_rows(arrived: DataFrame, date: str, mapping: DataFrame) -> DataFrame:
    """Consumer and month of the partitions that new rows of a fact belong to."""
    months = arrived.select(ORG, _month(date).alias(MONTH)).distinct()
    pairs = active(mapping).select(F.col(ORG).alias("__org"), CONSUMER).distinct()
    return lookup_join(months, pairs, {ORG: "__org"}).select(CONSUMER, MONTH).distinct()


def touched_by_config(before: Billing, after: Billing) -> DataFrame:
    """Consumers of organisations whose mapping or rates differ, as they were and as they are: all their months change."""
    def rows(src: Billing) -> DataFrame:
        rates = active(src.rates).select(ORG, F.concat_ws("|", F.lit("rate"), "markup_pct", "effective_from", "effective_to").alias("fact"))
        pairs = active(src.mapping).select(ORG, F.concat_ws("|", F.lit("to"), CONSUMER).alias("fact"))
        return rates.unionByName(pairs).groupBy(ORG, "fact").agg(F.count("*").alias("n"))

    old, new = rows(before), rows(after)
    differing = old.exceptAll(new).unionByName(new.exceptAll(old)).select(F.col(ORG).alias("__org")).distinct()
    pairs = active(before.mapping).select(ORG, CONSUMER).unionByName(active(after.mapping).select(ORG, CONSUMER))
    return lookup_join(pairs, differing, {ORG: "__org"}, "left_semi").select(CONSUMER).distinct()


class PublishedStore:
    """What consumers read. Every view keeps its versions; a release names the version of each, and is committed last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.releases = PartitionedTable(spark, f"{self.root}/release", RELEASE, ["view"])

    def table(self, view: str) -> PartitionedTable:
        schema, date = VIEWS[view]
        typed = StructType([StructField(CONSUMER, StringType()), StructField(MONTH, DateType()), *schema.fields])
        return PartitionedTable(self.spark, f"{self.root}/{view}", typed, [CONSUMER, MONTH], [ORG, date])

    def release(self, number: int | None = None) -> dict[str, int]:
        """The version of each view in a release, the newest by default."""
        return {r["view"]: r["version"] for r in self.releases.read(version=number).collect()}

    def publish(self, src: Billing, as_of: dt.datetime, touched: DataFrame | None = None, consumers: DataFrame | None = None,
                views: list[str] | None = None) -> int:
        """Write the partitions named by ``touched`` (consumer and month) and all those of ``consumers``, or everything if
        neither is given, and release them together. Contract items, priced as of today, are always written.

        ``views`` limits a run to some of them. The raw facts are reduced to the organisations and months in question before they are priced. Readers keep the
        release they began with. Of two publishers that began with the same release one fails. Returns the release.
        """
        base = self.releases.version()
        before, whole = self.release(base) if base else {}, touched is None and consumers is None
        versions = []
        for view in views or VIEWS:
            schema, date = VIEWS[view]
            table, at = self.table(view), before.get(view, 0)
            if whole or view == "contract_items":
                scope, stale = None, table.manifest(at).select(CONSUMER, MONTH)
            else:
                stale = scope = self._stale(getattr(src, view), src.mapping, table, at, date, touched, consumers)
            rows = self._rows(src, view, date, as_of, scope).select(CONSUMER, _month(date).alias(MONTH), *schema.names)
            if scope is not None:
                rows = lookup_join(rows, scope.select(F.col(CONSUMER).alias("__c"), F.col(MONTH).alias("__m")),
                                   {CONSUMER: "__c", MONTH: "__m"}, "left_semi")
            # Another publisher may have left a version that was never released: go on from the newest, with the released rows.
            versions.append((view, self._write(table, rows, stale, at)))
        return self.releases.replace(self.spark.createDataFrame(versions, RELEASE), base=base)

    @staticmethod
    def _write(table: PartitionedTable, rows: DataFrame, stale: DataFrame, at: int) -> int:
        newest = table.version()
        if newest != at:
            table.revert(at, newest)
            at = newest + 1
        return table.replace(rows, touched=stale, base=at)

    @staticmethod
    def _stale(fact: DataFrame, mapping: DataFrame, table: PartitionedTable, at: int, date: str, touched: DataFrame | None,
               consumers: DataFrame | None) -> DataFrame:
        """Consumer and month of all partitions to be written, those that there are and those that there will be."""
        parts = [] if touched is None else [touched.select(CONSUMER, MONTH)]
        if consumers is not None:
            names = consumers.select(F.col(CONSUMER).alias("__c")).distinct()
            there = lookup_join(table.manifest(at).select(CONSUMER, MONTH), names, {CONSUMER: "__c"}, "left_semi")
            coming = lookup_join(touched_by_rows(fact, date, mapping), names, {CONSUMER: "__c"}, "left_semi")
            parts += [there, coming]
        stale = parts[0]
        for other in parts[1:]:
            stale = stale.unionByName(other)
        return stale.distinct()

    @staticmethod
    def _rows(src: Billing, view: str, date: str, as_of: dt.datetime, scope: DataFrame | None) -> DataFrame:
        def narrowed(fact: DataFrame) -> DataFrame:
            if scope is None:
                return fact
            pairs = active(src.mapping).select(ORG, F.col(CONSUMER).alias("__c")).distinct()
            wanted = lookup_join(pairs, scope, {"__c": CONSUMER}).select(
                F.col(ORG).alias("__org"), F.col(MONTH).alias("__m")).distinct()
            fact = fact.withColumn(MONTH, _month(date))
            return lookup_join(fact, wanted, {ORG: "__org", MONTH: "__m"}, "left_semi").drop(MONTH)

        lazy = SimpleNamespace(mapping=src.mapping, rates=src.rates)
        setattr(lazy, view, narrowed(getattr(src, view)))
        return {"contract_items": lambda: shared.published_contract_items(lazy, as_of), "rate_sheet": lambda: shared.published_rate_sheet(lazy),
                "usage": lambda: shared.published_usage(lazy), "balances": lambda: shared.published_balance(lazy)}[view]()

    def tables(self, consumer: str | None = None, release: int | None = None) -> StoredTables:
        """The views of one consumer, or of all, as of one release."""
        return StoredTables(self, self.releases.version() if release is None else release, consumer)


class StoredTables:
    """The four views of one release. One consumer's rows are read from that consumer's folders only."""

    def __init__(self, store: PublishedStore, release: int, consumer: str | None = None):
        self.store, self.number, self.consumer = store, release, consumer
        self.versions = store.release(release)

    def of(self, consumer: str) -> StoredTables:
        return StoredTables(self.store, self.number, consumer)

    def _read(self, view: str) -> DataFrame:
        own = None if self.consumer is None else F.col(CONSUMER) == F.lit(self.consumer)
        return self.store.table(view).read(own, self.versions[view]).drop(MONTH)

    @cached_property
    def contract_items(self) -> DataFrame:
        return self._read("contract_items")

    @cached_property
    def usage(self) -> DataFrame:
        return self._read("usage")

    @cached_property
    def balances(self) -> DataFrame:
        return self._read("balances")

    @cached_property
    def rate_sheet(self) -> DataFrame:
        return self._read("rate_sheet")
