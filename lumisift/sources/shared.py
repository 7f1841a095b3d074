"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where that is unset and the session is local, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lumisift-"))
        found = _own[0]
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  at exit the session may be gone
        return


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared one; removed when the driver ends."""
    path = f"{shared_dir(spark)}/lumisift/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and where: for tables that are removed before the driver ends."""
    spark = df.sparkSession
    path = shared_folder(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends, and lost executors lose nothing."""
    return cut_at(df)[0]
