"""Tables whose partitions are replaced one by one and that are always read as of one version.

Below the root, ``data`` holds the files of each commit, which has only the partitions it changed; ``manifest`` holds, for
each commit, the partitions in force with the commit that wrote them; ``head`` holds one small file for each commit, created
last and only if there is none of that number; ``arrived`` holds rows while a commit is made of them. So a reader sees a
version as a whole or not at all, of two writers that start from the same version one fails, and nothing that is being read
is ever overwritten.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

PART = "__part"


class Conflict(RuntimeError):
    """Someone else has committed since the version that was read."""


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's checkpoint folder; below a temporary one in a local session without any."""
    home = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if home is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        home = tempfile.mkdtemp(prefix="burnledger-")
    return f"{home.rstrip('/')}/{uuid.uuid4().hex}"


class PartitionedTable:
    """Rows of ``schema``, partitioned by columns of it (dates or text)."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str], order: list[str] | None = None):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        self.order = [k for k in order or [] if k not in keys]
        self._manifest = StructType([StructField(PART, StringType()), *[schema[k] for k in keys],
                                     StructField("commit", StringType()), StructField("n_rows", LongType())])

    # ------------------------------------------------------------ versions

    def _path(self, name: str) -> tuple[object, object]:
        """The file system of the root, and a path below it."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _head(self, version: int) -> str:
        """The commit of a version; empty while it is being written."""
        row = self.spark.read.text(f"{self.root}/head/{version}").head()
        return row[0] if row else ""

    def version(self) -> int:
        """The newest complete version, 0 for a table without any."""
        files, folder = self._path("head")
        numbers = [] if not files.exists(folder) else [
            int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()]
        return next((n for n in sorted(numbers, reverse=True) if self._head(n)), 0)

    def _advance(self, version: int, commit: str) -> None:
        files, path = self._path(f"head/{version}")
        try:
            out = files.create(path, False)
        except Exception as error:
            if files.exists(path):
                raise Conflict(f"version {version} of {self.root} exists already") from error
            raise
        out.write(bytearray(commit.encode()))
        out.close()

    # ------------------------------------------------------------ reading

    def manifest(self, version: int | None = None) -> DataFrame:
        """The partitions in force: their keys, the commit that wrote them and their number of rows."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self._manifest)
        return self.spark.read.schema(self._manifest).parquet(f"{self.root}/manifest/{self._head(version)}")

    def read(self, which: Column | Callable[[DataFrame], DataFrame] | None = None, version: int | None = None) -> DataFrame:
        """The rows of the partitions chosen, all by default: by a condition on the keys or a function of the manifest.

        Only the folders of these partitions are listed and read. What the driver collects is one path for each.
        """
        chosen = self.manifest(version)
        if which is not None:
            chosen = which(chosen) if callable(which) and not isinstance(which, Column) else chosen.filter(which)
        paths = [f"{self.root}/data/{r.commit}/{PART}={r[PART]}" for r in chosen.select(PART, "commit").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    # ------------------------------------------------------------ writing

    @contextmanager
    def set_aside(self, rows: DataFrame) -> Iterator[DataFrame]:
        """Rows kept in files below the root while a commit is made of them, so that what they come from is read once."""
        name = f"arrived/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.root}/{name}")
            yield self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}")
        finally:
            files, path = self._path(name)
            files.delete(path, True)

    def part(self) -> Column:
        """Name of a row's partition, safe as a folder's name."""
        names = [F.hex(F.col(k).cast("binary")) if isinstance(self.schema[k].dataType, StringType) else F.col(k).cast("string")
                 for k in self.keys]
        return F.concat_ws("_", *[F.coalesce(n, F.lit("null")) for n in names])

    def replace(self, rows: DataFrame, touched: DataFrame | None = None, base: int | None = None) -> int:
        """Commit ``rows`` as the whole content of the partitions they belong to; all others stay as they are.

        ``touched`` (rows with the key columns) names further partitions that are replaced, and so vanish if they have no
        rows any more. ``base`` is the version the rows were made from; if it is not the newest one, nothing changes and
        ``Conflict`` is raised, so that a repeated load does not count twice. Returns the new version.
        """
        base = self.version() if base is None else base
        commit = f"{base + 1}-{uuid.uuid4().hex}"
        where = f"{self.root}/data/{commit}"
        tagged = rows.select(*self.schema.names).withColumn(PART, self.part())
        (tagged.hint("rebalance", PART).sortWithinPartitions(PART, *self.order)
         .write.partitionBy(PART).parquet(where))
        typed = StructType([*self.schema.fields, StructField(PART, StringType())])
        try:
            written = self.spark.read.schema(typed).parquet(where)
        except PySparkException:  # no rows, no files
            written = self.spark.createDataFrame([], typed)
        now = written.groupBy(PART, *self.keys).agg(F.count("*").alias("n_rows")).select(
            PART, *self.keys, F.lit(commit).alias("commit"), "n_rows")
        gone = now.select(PART) if touched is None else now.select(PART).union(touched.select(self.part()))
        kept = self.manifest(base).join(gone.distinct(), PART, "left_anti")
        kept.unionByName(now).coalesce(1).write.parquet(f"{self.root}/manifest/{commit}")
        self._advance(base + 1, commit)
        return base + 1

    def revert(self, to: int, base: int) -> int:
        """Commit the state of an earlier version as the newest one."""
        commit = f"{base + 1}-{uuid.uuid4().hex}"
        self.manifest(to).coalesce(1).write.parquet(f"{self.root}/manifest/{commit}")
        self._advance(base + 1, commit)
        return base + 1
