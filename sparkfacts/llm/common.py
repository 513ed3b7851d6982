"""What the corpus operators share: the cluster's shared folder, staged tables, inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    spark.checkpoint.dir of the session, else the context's own checkpoint folder, else one
    beside the tables of the warehouse. Only a local master, whose executors share the
    driver's disk, takes a temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root and not sc.master.startswith("local"):
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    if not root:
        root = getattr(spark, "_sparkfacts_root", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="sparkfacts-")
            spark._sparkfacts_root = root
    return root.rstrip("/")


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and keeps costly Python
    stages from being computed again by later jobs of the same query. ``discard`` takes
    the tables away when nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    held(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def held(spark: SparkSession) -> list[str]:
    """Paths of the session's staged tables, oldest first."""
    if not hasattr(spark, "_sparkfacts_staged"):
        spark._sparkfacts_staged = []
    return spark._sparkfacts_staged


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the tables staged after the first ``since``, but for the last ``keep``."""
    paths = held(spark)
    gone = paths[since : len(paths) - keep]
    del paths[since : len(paths) - keep]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, as_bytes: bool = True) -> DataFrame:
    """(doc_id, text) with null texts read as empty; bytes are the UTF-8 form."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (text.cast("binary") if as_bytes else text).alias("text"))


def held_out(doc_id: str = "doc_id"):
    """True for the third of documents that no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


NULL_ID = -(1 << 63)


def no_null_ids(docs: DataFrame) -> DataFrame:
    """Null doc_ids become NULL_ID, for joins inside an operator; ``null_ids_back`` undoes it."""
    return docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))


def null_ids_back(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.expr(f"nullif(doc_id, {NULL_ID + 1}L - 1L)"))


def text_key(text: str = "text"):
    """A row's identity in joins beside its doc_id: a 64-bit hash of its text, null read as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def as_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, k, doc): rows by identity, with all their columns in one struct, so that no name clashes.

    Null doc_ids are NULL_ID.
    """
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_key().alias("k"), doc.alias("doc"))
