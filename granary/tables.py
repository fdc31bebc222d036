"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a task where Spark's own sizes mislead.
ROWS = 100_000
_SETTING = "spark.checkpoint.dir"


def scratch(spark: SparkSession) -> str:
    """A fresh path under ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder; a cluster must set it."""
    base = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set(_SETTING, base)
    return f"{base.rstrip('/')}/granary-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` and read it back: cuts lineage, survives lost executors, and lets Spark see the size."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as its number of rows asks for.

    Spark merges partitions by their compressed size, which tells little of the memory that a sort takes where texts repeat.
    """
    return df.repartition(1 + df.count() // ROWS, *keys)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Add ``name``: 1 for the first row by ``order``, and so on. Rows are sorted by ranges, and no task sees all of them.

    The sorted rows are written, because the ranges of another run of the same plan may differ.
    """
    by_range = df.repartitionByRange(1 + df.count() // ROWS, *order).sortWithinPartitions(*order)
    rows = stored(by_range.withColumn("_id", F.monotonically_increasing_id()), scratch(df.sparkSession), "numbered").withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_id", "_start")


class Stages:
    """Tables of a run in one folder. A stage that is there whole is read; any other is computed and written."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def _file(self, name: str):  # noqa: ANN202
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}")
        return path.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()), path

    def whole(self, name: str) -> bool:
        files, path = self._file(f"{name}/_SUCCESS")
        return files.exists(path)

    def __call__(self, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self._folder}/{name}"
        if not self.whole(name):
            compute().write.mode("overwrite").parquet(path)
        return self._spark.read.parquet(path)

    def claim(self, name: str) -> bool:
        """Make an empty file that nobody has made before; False if somebody has."""
        files, path = self._file(name)
        files.mkdirs(path.getParent())
        return not files.exists(path) and files.createNewFile(path)

    def note(self, name: str, text: str) -> None:
        """Write a short text whole: under another name first."""
        files, path = self._file(name)
        _, draft = self._file(f"{name}.draft")
        out = files.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        files.rename(draft, path)

    def noted(self, name: str) -> str | None:
        files, path = self._file(name)
        if not files.exists(path):
            return None
        source = files.open(path)
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def names(self, pattern: str) -> list[str]:
        """Paths under the folder that a pattern matches, without the folder."""
        files, path = self._file(pattern)
        root = files.makeQualified(self._spark._jvm.org.apache.hadoop.fs.Path(self._folder)).toString().rstrip("/")
        return [str(s.getPath().toString()).removeprefix(root + "/") for s in files.globStatus(path) or []]

    def drop(self, name: str) -> None:
        files, path = self._file(name)
        files.delete(path, True)
