"""The test tables read as a billing model.

Every order line is a usage row: a nation is a sold-to organisation, a market
segment of a nation an account, the line number the metered service, the ship
date the usage day. Contracts follow from the organisation's total spend, so
that depleted and healthy contracts both occur. All tables are lazy; a report
only evaluates those it uses.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from burnledger.operators import drawdown, pricing
from burnledger.operators.usage import DAY, account_totals, contract_days, daily_cube, grains, measures
from burnledger.sources.schemas import (
    ACCOUNT_MAPPING, BALANCE_SOURCE, BILLING_TYPE, CONSUMER, CONTRACT, CUSTOMER, KEYS, MARKUP_RATES, ORG,
    QUANTITY, SERVICES, USAGE,
)
from burnledger.sources.tables import conform, date_spine

AS_OF = dt.datetime(2001, 6, 15, 12, 0, 0)
CONSUMER_EXAMPLE = "LOC3"
SELLER = "CHANNEL_PARTNER"
FIRST_DAY = dt.date(1995, 1, 1)
RATE_CHANGE = dt.date(1998, 7, 1)
CREATED = dt.datetime(1995, 1, 1)
LONG_LASTING = 19  # the organisation whose funds last for years, yet not to the end of its contract

# Declared, so that opening a table starts no job to read its footers.
TEST_TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
}


def _number(value: str, precision: int, scale: int) -> Column:
    return F.lit(Decimal(value)).cast(DecimalType(precision, scale))


def _required(value: Column) -> Column:
    """A column that cannot be NULL.

    Without this, each join adds its own not-NULL filter below the usage
    aggregate and the otherwise equal aggregates of a report are not shared.
    """
    return F.coalesce(value, F.lit(""))


def _tagged(prefix: str, key: str = "n_nationkey") -> Column:
    return _required(F.concat(F.lit(prefix), F.col(key).cast("string")))


class BridgeSource:
    """``Billing`` tables derived from the Parquet files of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: dt.datetime = AS_OF, stored_measures: DataFrame | None = None,
                 by_grain: bool = False):
        self._stored, self._by_grain = stored_measures, by_grain
        self.spark, self.sf_dir, self.as_of = spark, sf_dir.rstrip("/"), as_of
        self.last_day = as_of.date()

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TEST_TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def organisations(self) -> DataFrame:
        """One row per nation with the key columns and the region.

        A new DataFrame for each use: a join of two tables that share columns
        makes Spark rename those of one side, and a renamed aggregate is not
        recognised as the one already computed.
        """
        return self._table("nation").select(
            "n_nationkey", _tagged("REGION_", "n_regionkey").alias("region"),
            F.lit(SELLER).alias("organization_name"), _tagged("ORG_").alias(ORG),
            _required(F.col("n_name")).alias(CUSTOMER), _tagged("PO-").alias("sold_to_po_number"),
            _tagged("CNT-").alias(CONTRACT))

    @staticmethod
    def _account_columns(nation: str, segment: str) -> dict[str, Column]:
        account = F.concat(F.col(nation).cast("string"), F.lit("-"), F.col(segment))
        seg = F.col(segment)
        return {
            "account_name": account,
            "account_locator": F.concat(F.lit("ACC-"), account),
            "service_level": F.when(seg.isin("AUTOMOBILE", "BUILDING"), "Business Critical")
            .when(seg.isin("FURNITURE", "HOUSEHOLD"), "Enterprise").otherwise("Standard"),
        }

    @cached_property
    def usage(self) -> DataFrame:
        """One usage row per order line, also those dated after the clock.

        Orders meet customers first, on three narrow columns; the lines are
        then shuffled once, on the order key, with their day and their amount
        instead of what these are made of. Names are attached last, from
        the organisations, so they do not travel through a shuffle.
        """
        price = (F.col("l_extendedprice").cast(DecimalType(12, 2))
                 * (F.lit(Decimal(1)) - F.col("l_discount").cast(DecimalType(4, 2))))
        lines = self._table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                               price.cast(QUANTITY).alias("usage_in_currency"),
                                               F.col("l_shipdate").cast("date").alias("usage_date"))
        buyers = self._table("customer").select(F.col("c_custkey").alias("o_custkey"),
                                                F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
        orders = (self._table("orders").select("o_orderkey", "o_custkey").join(buyers, "o_custkey")
                  .select(F.col("o_orderkey").alias("l_orderkey"), "n_nationkey", "c_mktsegment"))
        # Both sides grow with the data, whatever their compressed size suggests.
        rows = lines.join(orders.hint("merge"), "l_orderkey").join(self.organisations, "n_nationkey")
        services = F.array(*[F.struct(F.lit(u).alias("usage_type"), F.lit(r).alias("rating_type"),
                                      F.lit(s).alias("service_type")) for _, u, r, s, _ in SERVICES])
        service = F.element_at(services, F.col("l_linenumber"))
        return conform(rows.withColumns({
            **self._account_columns("n_nationkey", "c_mktsegment"),
            "usage_type": service["usage_type"],
            "rating_type": service["rating_type"],
            "service_type": service["service_type"],
            "usage": F.col("l_quantity"),
            "currency": F.lit("USD"),
            "balance_source": F.lit(BALANCE_SOURCE),
            "billing_type": F.lit(BILLING_TYPE),
            "is_adjustment": F.lit(False),
        }), USAGE)

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

    def with_accounts(self) -> BridgeSource:
        """The same tables for a report that needs totals by account too: cube and accounts then come from one scan."""
        return BridgeSource(self.spark, self.sf_dir, self.as_of, self._stored, by_grain=True)

    @cached_property
    def contracts(self) -> DataFrame:
        """One contract per organisation, sized by its total spend."""
        totals = self.cube.groupBy(CONTRACT).agg(F.sum("spend").alias("__total"))
        key = F.col("n_nationkey")
        total = F.coalesce(F.col("__total"), F.lit(Decimal(0))).cast(DecimalType(28, 6))
        share = F.when(key == LONG_LASTING, _number("9.00", 4, 2)).otherwise(
            ((F.lit(60) + F.lit(5) * (key % 10)) * _number("0.01", 3, 2)).cast(DecimalType(4, 2)))
        end = (F.when(key == LONG_LASTING, F.lit(dt.date(2090, 12, 31)))
               .when(key % 3 == 0, F.lit(dt.date(2001, 3, 31)))
               .when(key % 3 == 1, F.lit(dt.date(2001, 8, 1))).otherwise(F.lit(dt.date(2001, 12, 31))))
        money = DecimalType(18, 2)
        return self.organisations.join(totals, CONTRACT, "left").select(
            *KEYS,
            F.lit(FIRST_DAY).alias("start_date"), end.alias("end_date"),
            F.date_add(end, 30).alias("expiration_date"), F.lit("USD").alias("currency"),
            F.lit(dt.date(1994, 12, 15)).alias("contract_modified_date"),
            (total * share).cast(money).alias("capacity_amt"),
            (total * _number("0.02", 3, 2)).cast(money).alias("free_amt"),
            (total * _number("0.05", 3, 2)).cast(money).alias("rollover_amt"))

    @cached_property
    def contract_items(self) -> DataFrame:
        return pricing.contract_items(self.contracts)

    def _spans(self) -> DataFrame:
        """Each contract with its calendar's last day: the clock's, or that of later usage."""
        spent = F.when(F.col("spend").isNotNull(), F.col(DAY))  # the same columns as totals need: one shared aggregate
        last = self.cube.groupBy(CONTRACT).agg(F.max(spent).alias("__last"))
        return self.organisations.join(last, CONTRACT, "left").select(
            CONTRACT, F.greatest(F.lit(self.last_day), F.col("__last")).alias("last_day"))

    @cached_property
    def calendar(self) -> DataFrame:
        return date_spine(self._spans(), FIRST_DAY, F.col("last_day"), "date").select(CONTRACT, "date")

    @cached_property
    def cumulative(self) -> DataFrame:
        return drawdown.cumulative_spend(self._spans(), self.cube, FIRST_DAY, F.col("last_day"))

    @cached_property
    def balances(self) -> DataFrame:
        return drawdown.remaining_balances(self.contracts, self.cumulative)

    @cached_property
    def rate_sheet(self) -> DataFrame:
        """The sheet of every day on which an account has usage."""
        days = self.usage.select(*KEYS, *pricing.ACCOUNT_COLUMNS, F.col("usage_date").alias("date")).distinct()
        return pricing.sheet_rows(days)

    @cached_property
    def quantities(self) -> DataFrame:
        return self.usage.withColumn("credit_usage", F.col("usage"))

    @cached_property
    def mapping(self) -> DataFrame:
        stamp = F.lit(CREATED.isoformat(sep=" ")).cast("timestamp_ntz")
        return conform(self._table("nation").select(
            _tagged("ORG_").alias(ORG), F.col("n_name").alias(CUSTOMER), _tagged("LOC").alias(CONSUMER),
            (F.col("n_nationkey") % 12 != 11).alias("is_active"),
            stamp.alias("created_at"), stamp.alias("updated_at")), ACCOUNT_MAPPING)

    @cached_property
    def rates(self) -> DataFrame:
        stamp = F.lit(CREATED.isoformat(sep=" ")).cast("timestamp_ntz")
        nations = self._table("nation").filter("n_nationkey <> 24")

        def interval(shift: int, first: dt.date, last: dt.date | None) -> DataFrame:
            step = ((F.col("n_nationkey") + shift) % 6).cast(DecimalType(2, 0))
            return conform(nations.select(
                _tagged("ORG_").alias(ORG), (step * _number("0.01", 3, 2)).alias("markup_pct"),
                F.lit(first).alias("effective_from"), F.lit(last).alias("effective_to"),
                F.lit(True).alias("is_active"), stamp.alias("created_at"), stamp.alias("updated_at")),
                MARKUP_RATES)

        return interval(0, FIRST_DAY, RATE_CHANGE - dt.timedelta(days=1)).unionByName(
            interval(1, RATE_CHANGE, None))

    # Config tables with faults, so that the audits have something to report.

    @cached_property
    def dirty_mapping(self) -> DataFrame:
        """One pair repeated."""
        again = self.mapping.filter(F.col(CONSUMER) == "LOC1")
        return self.mapping.unionByName(again)

    @cached_property
    def dirty_rates(self) -> DataFrame:
        """One rate above the limit, one overlapping open rate, one switched off."""
        open_rates = self.rates.filter("effective_to IS NULL")
        too_high = open_rates.filter(F.col(ORG) == "ORG_0").withColumn(
            "markup_pct", _number("0.06", 5, 4))
        overlap = open_rates.filter(F.col(ORG) == "ORG_2").withColumn(
            "effective_from", F.lit(dt.date(2000, 1, 1)))
        off = open_rates.filter(F.col(ORG) == "ORG_4").withColumn("is_active", F.lit(False))
        return self.rates.unionByName(too_high).unionByName(overlap).unionByName(off)

    @cached_property
    def swapped_mapping(self) -> DataFrame:
        """The locators of organisations 3 and 4 exchanged."""
        swapped = (F.when(F.col(CONSUMER) == "LOC3", "LOC4").when(F.col(CONSUMER) == "LOC4", "LOC3")
                   .otherwise(F.col(CONSUMER)))
        return self.mapping.withColumn(CONSUMER, swapped)
