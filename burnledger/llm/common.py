"""Helpers that several operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5
WORD_BREAKS = " \t-\r"  # inside a character class: space and the five ASCII white space characters
WORD = f"[^{WORD_BREAKS}]+"
SLICE_ROWS = 256  # rows that a task turns into Python objects at a time
BATCH_ROWS = 1000  # rows of an Arrow batch within small_batches()


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    context = spark.sparkContext
    home = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if home is None:
        home = "/tmp/checkpoints"
    return f"{home.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts the lineage and survives lost executors.

    Afterwards the shuffle files behind them are of no use; collecting garbage lets Spark's cleaner drop them.
    """
    path, schema = scratch(spark), df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within it hands at most BATCH_ROWS rows at a time to Python; the executor and the worker hold batches whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and that nothing reads any more, because what came of them is stored too."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def connected(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """Smallest node reachable from each node of undirected edges (two long columns): columns node, root.

    Large-star and small-star rounds until the edges form stars around their smallest node. Every round aggregates
    before it joins, so a hub meets its neighbours' smallest label only; rounds grow with the logarithm of the longest
    path.
    """
    now = stored(edges.toDF("a", "b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("u <> v").distinct(), spark)
    previous = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = stored(small.union(least.select("u", F.col("m").alias("v"))).select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), spark)
        discard(now)
        now = after
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == previous:
            break
        previous = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (long) and the text, under fixed names."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out. A null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def per_slice(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None],
              schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow over small slices, so that a task holds few texts as Python objects."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = work(batch.slice(start, rows))
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
    return df.mapInArrow(run, schema)


def bounded_sample(labelled: DataFrame, id_col: str, label_col: str, per_label: int, max_labels: int = 1000) -> DataFrame:
    """At most per_label ids of each label (those with the smallest hash), independent of row order.

    Rows beyond a hash threshold derived from the label's count leave before the shuffle, so that no label's rows meet
    in one task. Null ids and labels are left out; an id that is given twice counts once.
    """
    rows = labelled.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label")) \
        .where("id IS NOT NULL AND label IS NOT NULL")
    counts = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_labels).collect()
    if not counts:
        return rows.limit(0)
    order = F.shiftrightunsigned(F.xxhash64("id"), 1)
    share = reduce(lambda c, r: c.when(F.col("label") == r["label"], min(1.0, 2.0 * per_label / r["count"] + 0.001)),
                   counts, F)
    picked = rows.where(order < share * F.lit(float(2**63))).dropDuplicates(["id"]).withColumn("o", order)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label").orderBy("o", "id"))
    return picked.withColumn("r", rank).where(F.col("r") <= per_label).select("id", "label")
