"""The daily aggregate as a stored table that each load changes for the days it touches only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from burnledger.functions.scalars import MONEY_SUM
from burnledger.operators.usage import ACCOUNT, DAILY_KEYS, DAY, measures, summed
from burnledger.sources.schemas import CUSTOMER, ORG
from burnledger.sources.tables import conform
from burnledger.sources.versions import PartitionedTable

STORED_KEYS = [*DAILY_KEYS, ACCOUNT, "service_type", "usage_type"]
STORED = StructType([*[StructField(k, DateType() if k == DAY else StringType()) for k in STORED_KEYS],
                     StructField("spend", MONEY_SUM), StructField("credits", MONEY_SUM), StructField("n_rows", LongType())])


class DailyStore:
    """Measures per account, service and day, one partition a day. What ``operators.usage.measures`` makes of the raw rows,
    reports can take from here instead: a report over years then reads days, not usage rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = PartitionedTable(spark, root, STORED, [DAY], [ORG, CUSTOMER])

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version=version)

    def add(self, arrived: DataFrame, base: int | None = None) -> int:
        """Usage rows that are not in the store yet, of whatever days. Only the days they are of are read and written.

        The rows are read once: their aggregate is set aside in files, which also say what days are touched.
        Give the version that was the newest when the rows were chosen as ``base``: if the load has been committed before,
        a second attempt fails instead of adding the rows twice.
        """
        base = self.table.version() if base is None else base
        with self.table.set_aside(conform(summed(measures(arrived), *STORED_KEYS), STORED)) as fresh:
            days = fresh.select(DAY).distinct()
            before = self.table.read(lambda m: m.join(days, m[DAY].eqNullSafe(days[DAY]), "left_semi"), base)
            merged = conform(summed(before.unionByName(fresh), *STORED_KEYS), STORED)
            return self.table.replace(merged, base=base)

    def restate(self, usage: DataFrame, days: DataFrame, base: int | None = None) -> int:
        """All usage rows of the given days (a column ``usage_date``), instead of what the store holds of them."""
        rows = usage.join(days.select(F.col(DAY).alias("__day")).distinct(), F.col(DAY).eqNullSafe(F.col("__day")), "left_semi")
        return self.table.replace(conform(summed(measures(rows), *STORED_KEYS), STORED), touched=days.select(DAY), base=base)
