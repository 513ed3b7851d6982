"""Delimited sources: header CSV, lines with bare commas in a name, piped rows inside a ZIP."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ein, is_discovery_name


def registry_csv(spark: SparkSession, path: str, watched: DataFrame | None = None) -> DataFrame:
    """A header CSV of registrations, all strings: rows with a valid EIN that are watched or have a telling name."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", escape='"')
    raw = raw.toDF(*(c.removeprefix("﻿") for c in raw.columns)).withColumn("EIN", ein(F.col("EIN"))).filter("EIN is not null")
    if watched is None:
        return raw.filter(is_discovery_name(F.col("NAME")))
    mark = watched.select(F.col("ein").alias("EIN")).distinct().withColumn("_w", F.lit(True))
    return raw.join(mark, "EIN", "left").filter(F.col("_w") | is_discovery_name(F.col("NAME"))).drop("_w")


def ragged(df: DataFrame, fields: str, leading: list[str], middle: str, trailing: list[str]) -> DataFrame:
    """Names the fields of rows whose middle field may hold the separator itself."""
    n, f = len(leading), F.col(fields)
    out = df.filter(F.size(f) > n + len(trailing))
    cols = {c: f[i] for i, c in enumerate(leading)}
    cols[middle] = F.array_join(F.slice(f, n + 1, F.size(f) - n - len(trailing)), ",")
    cols |= {c: F.element_at(f, i - len(trailing)) for i, c in enumerate(trailing)}
    return out.withColumns(cols)


# Columns of a filing index around the taxpayer's name.
INDEX_LEADING = ["return_id", "filing_type", "ein", "tax_period", "sub_date"]
INDEX_TRAILING = ["return_type", "dln", "object_id"]


def filing_index(spark: SparkSession, path: str, batches: bool = False) -> DataFrame:
    """Index rows of annual returns with an object id; a trailing batch column is dropped."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("RETURN_ID")).select(F.split("value", ",").alias("f"))
    rows = ragged(lines, "f", INDEX_LEADING, "name", [*INDEX_TRAILING, "batch"] if batches else INDEX_TRAILING)
    kept = rows.filter(F.col("return_type").isin("990", "990EZ") & (F.trim("object_id") != ""))
    return kept.select(*INDEX_LEADING, "name", *INDEX_TRAILING).withColumn("ein", ein(F.col("ein"), pad=True))


def zipped_rows(spark: SparkSession, path: str, names: list[str], sep: str = "|") -> DataFrame:
    """Rows of headerless text files inside ZIP archives, by position; further fields go to ``extra``.

    Lines stream out of each archive in batches; an archive is one task's work.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            held = []
                            for line in io.TextIOWrapper(f, encoding="utf-8", errors="replace"):
                                if line.strip():
                                    held.append(line.rstrip("\r\n"))
                                if len(held) >= 10_000:
                                    yield pa.RecordBatch.from_arrays([pa.array(held)], ["line"])
                                    held = []
                            if held:
                                yield pa.RecordBatch.from_arrays([pa.array(held)], ["line"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line string")
    f = F.split("line", "\\" + sep)
    extra = F.when(F.size(f) > len(names), F.slice(f, len(names) + 1, F.greatest(F.size(f) - len(names), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return lines.select(*(F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)), extra.alias("extra"))


def curated_csv(spark: SparkSession, path: str, required: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
    """A small curated CSV: # comments, required columns, fields with several values."""
    df = spark.read.csv(path, header=True, comment="#", escape='"')
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    return df.withColumns({c: F.filter(F.transform(F.split(c, "\\|"), lambda x: F.trim(x)), lambda x: x != "") for c in lists})


def not_fetched(index: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Index keys without a stored record, in order."""
    return index.join(records, key, "left_anti").select(key).distinct().orderBy(key)


def raw_conflicts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose key is stored with other content; (key, content) on both sides."""
    a = new.select("key", F.sha2("content", 256).alias("checksum"))
    b = stored.select("key", F.sha2("content", 256).alias("stored"))
    return a.join(b, "key").filter("checksum <> stored")
