"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder, else one in the warehouse; a temporary folder under a local master only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder and not sc.master.startswith("local"):
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_written"
    if not folder:
        folder = getattr(spark, "_sparkfacts_written", None) or "file://" + tempfile.mkdtemp(prefix="sparkfacts-written-")
        spark._sparkfacts_written = folder
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what later reads see doesn't depend on plans, retries or lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._sparkfacts_paths = [*getattr(spark, "_sparkfacts_paths", []), path]
    return spark.read.schema(df.schema).parquet(path)


def paths(spark: SparkSession) -> list[str]:
    """Folders of the session's written tables, oldest first."""
    return list(getattr(spark, "_sparkfacts_paths", []))


def forget(spark: SparkSession, path: str) -> None:
    """Deletes one written table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    spark._sparkfacts_paths = [p for p in paths(spark) if p != path]


def discard(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables written after the first ``since``; a session calls it when no frame reads them any more."""
    for path in paths(spark)[since:]:
        forget(spark, path)
