"""Spark session settings the package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE does the size-dependent work: it merges small shuffle partitions, splits
# skewed ones in joins and in rebalanced writes, and turns a sort-merge join
# into a broadcast once the measured side is below the threshold.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Python call sites of every column expression; costs most of the plan building time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "burnledger",
                  memory: str = "8g") -> SparkSession:
    """Session for tests and for ``bench.py``; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
