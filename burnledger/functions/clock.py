"""Calendar arithmetic around an explicit point in time.

The reports compare midnight dates with a wall-clock time. Every such
comparison can be turned into one between dates by rounding the clock *up* to
the next midnight (``edge``): for a date ``d``, ``d >= clock`` holds exactly if
``d >= edge``. Date literals, unlike casts of the column, are pushed down to
the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The look-back choices of the reports, in days.
OVERVIEW_PERIODS = {"30 days": 30, "60 days": 60, "90 days": 90, "180 days": 180}
BREAKOUT_PERIODS = {"1M": 30, "3M": 90, "1Y": 365}

HORIZON_DAYS = 36_525  # a forecast further ahead, 100 years, gets no date


@dataclass(frozen=True)
class Clock:
    as_of: dt.datetime

    @property
    def today(self) -> dt.date:
        return self.as_of.date()

    @property
    def edge(self) -> dt.date:
        """The first midnight at or after the clock."""
        at_midnight = self.as_of.time() == dt.time.min
        return self.today if at_midnight else self.today + dt.timedelta(days=1)

    def since(self, days: int) -> dt.date:
        """Earliest date whose midnight is not before ``as_of - days``."""
        return self.edge - dt.timedelta(days=days)

    def within(self, date: Column, days: int) -> Column:
        """True for dates of the trailing ``days``; later dates count too."""
        return date >= F.lit(self.since(days))

    def expired(self, end: Column) -> Column:
        """A contract has ended once the clock is past midnight of its end date."""
        return end < F.lit(self.edge)

    def days_until(self, end: Column) -> Column:
        """Whole days from the clock to the end date, rounded down (may be negative)."""
        return F.datediff(end, F.lit(self.edge))

    def date_after(self, days: Column) -> Column:
        """Calendar date reached ``days`` days from the clock; NULL beyond HORIZON_DAYS."""
        near = F.least(days, F.lit(HORIZON_DAYS)).cast("int")
        return F.when(days <= HORIZON_DAYS, F.date_add(F.lit(self.today), near))

    def cutoff(self, period: str) -> dt.date | None:
        """First date of a named look-back period; None for the whole history."""
        if period == "All":
            return None
        if period == "QTD":
            return dt.date(self.today.year, (self.today.month - 1) // 3 * 3 + 1, 1)
        if period == "YTD":
            return dt.date(self.today.year, 1, 1)
        days = {**OVERVIEW_PERIODS, **BREAKOUT_PERIODS}.get(period)
        if days is None:
            raise ValueError(f"unknown period {period!r}")
        return self.since(days)

    def in_period(self, date: Column, period: str) -> Column:
        first = self.cutoff(period)
        return F.lit(True) if first is None else date >= F.lit(first)


def month_floor(date: Column) -> Column:
    return F.trunc(date, "MM")
