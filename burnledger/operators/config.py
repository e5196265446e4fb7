"""Edits of the mapping and rate tables; each returns the new content.

The edits are batch operations: the ``*_rows`` form takes a table of changes,
the plain form one change. Files are immutable, so the result is written as a
new snapshot (``sources.tables.save_snapshot``), never over the input.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnledger.operators.joins import lookup_join
from burnledger.sources.schemas import ACCOUNT_MAPPING, CONSUMER, CUSTOMER, MARKUP_RATES, ORG, PERCENT
from burnledger.sources.tables import with_defaults

MAX_MARKUP = Decimal("0.05")


def one_row(df: DataFrame, **values) -> DataFrame:
    """A single literal row, on the session of ``df``."""
    return df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def _stamp(now: dt.datetime) -> Column:
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def add_consumers(mapping: DataFrame, rows: DataFrame, now: dt.datetime) -> DataFrame:
    return mapping.select(*ACCOUNT_MAPPING.names).unionByName(with_defaults(rows, ACCOUNT_MAPPING, now))


def add_rates(rates: DataFrame, rows: DataFrame, now: dt.datetime) -> DataFrame:
    """Append rates; a rate outside the allowed range fails the job that reads it."""
    return rates.select(*MARKUP_RATES.names).unionByName(
        enforce_range(with_defaults(rows, MARKUP_RATES, now)))


def onboard(mapping: DataFrame, rates: DataFrame, org: str, name: str, consumer: str,
            pct: Decimal, effective_from: dt.date, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """New customer: one mapping row and one open rate; the other columns take defaults."""
    who = one_row(mapping, **{ORG: org, CUSTOMER: name, CONSUMER: consumer})
    rate = one_row(rates, **{ORG: org, "markup_pct": pct, "effective_from": effective_from})
    return add_consumers(mapping, who, now), add_rates(rates, rate, now)


def _close(rates: DataFrame, start: Column, now: dt.datetime) -> DataFrame:
    """End the open active rates on the day before ``start``; a NULL start leaves a row alone."""
    closes = start.isNotNull() & F.col("is_active") & F.col("effective_to").isNull()
    return rates.withColumns({
        "effective_to": F.when(closes, F.date_sub(start, 1)).otherwise(F.col("effective_to")),
        "updated_at": F.when(closes, _stamp(now)).otherwise(F.col("updated_at")),
    })


def change_rate_rows(rates: DataFrame, changes: DataFrame, now: dt.datetime) -> DataFrame:
    """Close the open active rates on the day before each change and append the new ones.

    ``changes``: organisation, ``markup_pct``, ``effective_from``, one row per
    organisation. Older intervals and inactive rows are left alone.
    """
    starts = changes.select(F.col(ORG).alias("__change_org"), F.col("effective_from").alias("__start"))
    joined = lookup_join(rates.select(*MARKUP_RATES.names), starts, {ORG: "__change_org"}, "left",
                         salt_by=["effective_from"])
    return add_rates(_close(joined, F.col("__start"), now).drop("__start"), changes, now)


def change_rate(rates: DataFrame, org: str, pct: Decimal, effective_from: dt.date,
                now: dt.datetime) -> DataFrame:
    """The same for one organisation, without a join."""
    start = F.when(F.col(ORG) == F.lit(org), F.lit(effective_from))
    change = one_row(rates, **{ORG: org, "markup_pct": pct, "effective_from": effective_from})
    return add_rates(_close(rates.select(*MARKUP_RATES.names), start, now), change, now)


def deactivate(mapping: DataFrame, org: str, now: dt.datetime) -> DataFrame:
    """Switch off every consumer of an organisation."""
    hit = F.col(ORG) == F.lit(org)
    return mapping.select(*ACCOUNT_MAPPING.names).withColumns({
        "is_active": F.when(hit, F.lit(False)).otherwise(F.col("is_active")),
        "updated_at": F.when(hit, _stamp(now)).otherwise(F.col("updated_at")),
    })


def enforce_range(rates: DataFrame) -> DataFrame:
    """Reject rates outside 0 .. 5 % when the rows are read or written."""
    pct = F.col("markup_pct")
    allowed = (pct >= 0) & (pct <= F.lit(MAX_MARKUP))
    message = F.concat(F.lit("markup out of range for "), F.col(ORG), F.lit(": "), pct.cast("string"))
    return rates.withColumn(
        "markup_pct", F.when(allowed, pct).otherwise(F.raise_error(message).cast(PERCENT)))
