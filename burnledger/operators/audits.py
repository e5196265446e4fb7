"""Checks of the config tables and of the shared views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from burnledger.functions.scalars import MONEY_SUM, safe_ratio
from burnledger.operators.config import MAX_MARKUP
from burnledger.operators.joins import lookup_join
from burnledger.operators.markup import active, factor, markup_list, percent_points
from burnledger.operators.shared import USAGE_SCALES
from burnledger.operators.usage import DAY
from burnledger.sources.schemas import CONSUMER, CUSTOMER, ORG, QUANTITY

OPEN_END = dt.date(9999, 12, 31)


def rate_violations(rates: DataFrame) -> DataFrame:
    """Rates outside 0 .. 5 % or without a required value."""
    pct = F.col("markup_pct")
    missing = F.col(ORG).isNull() | pct.isNull() | F.col("effective_from").isNull()
    reason = (F.when(missing, F.lit("MISSING_VALUE"))
              .when((pct < 0) | (pct > F.lit(MAX_MARKUP)), F.lit("OUT_OF_RANGE")))
    return (rates.withColumn("violation", reason).filter("violation IS NOT NULL")
            .select(ORG, "markup_pct", "effective_from", "violation"))


def mapping_violations(mapping: DataFrame) -> DataFrame:
    """Repeated (organisation, consumer) pairs and rows without a required value."""
    absent = (F.col(ORG).isNull() | F.col(CUSTOMER).isNull() | F.col(CONSUMER).isNull())
    return (mapping.groupBy(ORG, CONSUMER)
            .agg(F.count("*").alias("n_rows"), F.max(absent).alias("__absent"))
            .withColumn("violation", F.when(F.col("__absent"), F.lit("MISSING_VALUE"))
                        .when(F.col("n_rows") > 1, F.lit("DUPLICATE")))
            .filter("violation IS NOT NULL")
            .select(ORG, CONSUMER, "n_rows", "violation"))


def rate_overlaps(rates: DataFrame) -> DataFrame:
    """Start days of active rates that fall into an earlier rate, or are used twice.

    Rates are first folded to one row per organisation and start day; the
    window then compares each start with the latest end so far, so no pairs
    of rates are formed.
    """
    until = F.coalesce(F.col("effective_to"), F.lit(OPEN_END))
    starts = (active(rates).groupBy(ORG, "effective_from")
              .agg(F.count("*").alias("n_rates"), F.max(until).alias("__until")))
    before = (Window.partitionBy(ORG).orderBy("effective_from")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (starts.withColumn("earlier_until", F.max("__until").over(before))
            .filter((F.col("n_rates") > 1) | (F.col("earlier_until") >= F.col("effective_from")))
            .select(ORG, "effective_from", "n_rates", "earlier_until"))


def current_markups(rates: DataFrame, mapping: DataFrame, today: dt.date) -> DataFrame:
    """Markups in percent, highest first."""
    return (markup_list(rates, mapping, today)
            .select(ORG, CUSTOMER, percent_points(F.col("markup_pct")).alias("markup_percent"),
                    "effective_from", "effective_to")
            .orderBy(F.desc("markup_percent"), CUSTOMER, "effective_from"))


def customers(contract_items: DataFrame) -> DataFrame:
    """Organisations and customer names found in the contracts."""
    return contract_items.select(ORG, CUSTOMER).distinct().orderBy(CUSTOMER, ORG)


def isolation_leaks(published: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows a consumer was given without an active mapping, per consumer and organisation.

    The rows are counted per (consumer, organisation) first; only these counts
    are compared with the mapping.
    """
    allowed = active(mapping).select(F.col(ORG).alias("__org"), F.col(CONSUMER).alias("__consumer"))
    seen = published.groupBy(CONSUMER, ORG).agg(F.count("*").alias("n_rows"))
    return lookup_join(seen, allowed, {ORG: "__org", CONSUMER: "__consumer"}, "left_anti")


def reconcile(raw_usage: DataFrame, shared_usage: DataFrame) -> DataFrame:
    """Raw and marked-up totals per organisation, and the markup they imply.

    ``shared_usage`` must show each row once. Organisations without shared
    rows keep an empty shared total.
    """
    def total(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(ORG).agg(F.sum("usage_in_currency").alias(name))

    raw, shared = total(raw_usage, "raw_total"), total(shared_usage, "shared_total")
    gap = F.col("shared_total") - F.col("raw_total")
    return raw.join(shared, ORG, "left").select(
        ORG,
        F.round("raw_total", 2).cast(DecimalType(38, 2)).alias("raw_total"),
        F.round("shared_total", 2).cast(DecimalType(38, 2)).alias("shared_total"),
        gap.cast(MONEY_SUM).alias("difference"),
        F.when(gap.isNotNull(), safe_ratio(gap, F.col("raw_total"))).alias("implied_markup"))


def reconcile_markup(usage: DataFrame, mapping: DataFrame, rates: DataFrame) -> DataFrame:
    """Raw and marked-up totals per organisation, and the markup they imply, from one pass over the usage rows.

    Each row meets the rates of its day and carries both amounts. Where rates
    overlap it comes once for each: sums are kept apart by rate, so that the raw
    one counts once a day and the marked-up ones count all, times the
    consumers that are shown the rows. Organisations without a consumer keep
    an empty shared total.
    """
    named = rates.withColumn("__rate", F.struct("effective_from", "effective_to", "markup_pct"))
    lookup = (active(named).groupBy(ORG, "__rate").agg(F.count("*").alias("__times"))
              .select(F.col(ORG).alias("__org"), "__rate", "__times"))
    rows = lookup_join(usage.select(ORG, DAY, "usage_in_currency"), lookup, {ORG: "__org"}, "left",
                       lambda u, r: (u[DAY] >= r["__rate.effective_from"])
                       & (r["__rate.effective_to"].isNull() | (u[DAY] <= r["__rate.effective_to"])), [DAY])
    marked = F.round(F.col("usage_in_currency") * factor(F.col("__rate.markup_pct")), USAGE_SCALES["usage_in_currency"])
    by_rate = rows.groupBy(ORG, DAY, "__rate", "__times").agg(
        F.sum("usage_in_currency").alias("raw"), F.sum(marked.cast(QUANTITY)).alias("shown"))
    by_day = by_rate.groupBy(ORG, DAY).agg(
        F.max("raw").alias("raw"), F.sum(F.col("shown") * F.coalesce("__times", F.lit(1))).alias("shown"))
    totals = by_day.groupBy(ORG).agg(F.sum("raw").alias("raw_total"), F.sum("shown").alias("shown"))
    consumers = active(mapping).groupBy(F.col(ORG).alias("__org")).agg(F.count_distinct(CONSUMER).alias("consumers"))
    both = lookup_join(totals, consumers, {ORG: "__org"}, "left").withColumn(
        "shared_total", (F.col("shown") * F.col("consumers")).cast(MONEY_SUM))
    gap = F.col("shared_total") - F.col("raw_total")
    return both.select(
        ORG,
        F.round("raw_total", 2).cast(DecimalType(38, 2)).alias("raw_total"),
        F.round("shared_total", 2).cast(DecimalType(38, 2)).alias("shared_total"),
        gap.cast(MONEY_SUM).alias("difference"),
        F.when(gap.isNotNull(), safe_ratio(gap, F.col("raw_total"))).alias("implied_markup"))


def config_gaps(usage: DataFrame, mapping: DataFrame, rates: DataFrame) -> DataFrame:
    """Where consumers would see nothing, or raw prices.

    NO_ACTIVE_MAPPING: usage nobody can see. NO_RATE: usage days without a
    rate, which are shown at raw prices. INACTIVE_MAPPING and INACTIVE_RATE:
    rows switched off. Usage is folded to organisation and day first.
    """
    days = usage.groupBy(ORG, DAY).agg(F.count("*").alias("__n"))

    def span(df: DataFrame, issue: str) -> DataFrame:
        return (df.groupBy(ORG)
                .agg(F.min(DAY).alias("first_date"), F.max(DAY).alias("last_date"),
                     F.count("*").alias("n_days"))
                .select(F.lit(issue).alias("issue"), ORG, "first_date", "last_date", "n_days"))

    def flagged(df: DataFrame, issue: str) -> DataFrame:
        return (df.filter(~F.col("is_active")).groupBy(ORG).agg(F.count("*").alias("__n"))
                .select(F.lit(issue).alias("issue"), ORG,
                        F.lit(None).cast("date").alias("first_date"),
                        F.lit(None).cast("date").alias("last_date"),
                        F.lit(None).cast("bigint").alias("n_days")))

    mapped = active(mapping).select(F.col(ORG).alias("__org"))
    rated = active(rates).select(F.col(ORG).alias("__org"), F.col("effective_from").alias("__from"),
                                 F.col("effective_to").alias("__to"))
    unmapped = lookup_join(span(days, "NO_ACTIVE_MAPPING"), mapped, {ORG: "__org"}, "left_anti")
    unrated = lookup_join(
        days, rated, {ORG: "__org"}, "left_anti",
        lambda d, r: (d[DAY] >= r["__from"]) & (r["__to"].isNull() | (d[DAY] <= r["__to"])),
        salt_by=[DAY])
    return (unmapped.unionByName(span(unrated, "NO_RATE"))
            .unionByName(flagged(mapping, "INACTIVE_MAPPING"))
            .unionByName(flagged(rates, "INACTIVE_RATE")))
