"""The shared folder and lineage cuts.

Intermediate results are Parquet tables below ``spark.checkpoint.dir``, so a lost executor costs a
re-read and not a recomputation; no operator keeps state on a machine-local disk.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PARTITIONS = "spark.sql.shuffle.partitions"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where it is unset (tests on one machine) a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            where = current.get()
        else:
            where = tempfile.mkdtemp(prefix="winsyn-")
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """A folder of intermediate tables inside the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/winsyn-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again: the plan above starts from files."""
        path = self.path(name)
        with self._tidy():
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._winsyn_path = path
        return out

    def bucketed(self, df: DataFrame, by: str, buckets: int, name: str, grouped: bool = False) -> DataFrame:
        """The same as a bucketed table: plans that group by the column need no shuffle of it. ``grouped``: ``df`` is
        a grouping by the column alone, whose own shuffle deals the rows to the buckets."""
        path, table_name = self.path(name), f"winsyn_{uuid.uuid4().hex}"
        with self._tidy(), self._set(_PARTITIONS, buckets if grouped else None):
            dealt = df if grouped else df.repartition(buckets, by)
            dealt.sortWithinPartitions(by).write.option("compression", "zstd").option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(table_name)
        out = self.spark.table(table_name)
        self.spark.sql(f"DROP TABLE {table_name}")  # of an external table only the name goes
        out._winsyn_path = path
        return out

    def _tidy(self):
        """Within, the shuffle files of a plan are deleted as soon as it has run."""
        return self._set(_CLEANUP, "true")

    @contextmanager
    def _set(self, key: str, value):
        """Within, a setting has another value, unless that is None."""
        old = self.spark.conf.get(key, None)
        if value is not None:
            self.spark.conf.set(key, value)
        try:
            yield
        finally:
            if value is not None:
                self.spark.conf.unset(key) if old is None else self.spark.conf.set(key, old)

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of ``cut`` that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._winsyn_path)
            path.getFileSystem(conf).delete(path, True)
