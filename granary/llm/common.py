"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the one named in ``spark.checkpoint.dir``. Where that is unset and the master is local (tests on one
    machine) a temporary folder is made once and kept in the session's settings; on a cluster it must be set.
    """
    base = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set(_SETTING, base)
    return f"{base.rstrip('/')}/granary-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` under ``folder`` and read it back: cuts lineage, survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
