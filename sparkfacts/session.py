"""Session settings that every plan assumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    """UTC, ANSI and AQE on; partition counts stay with the caller or the cluster."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
