"""Corpus pipeline: five stages from raw documents to token shards.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its
result is written as Parquet and read again. All but the last return the columns of
``documents``.

Defined cases: rows are judged each for itself: a doc_id may be null or stand for several
texts. Null and empty texts pass every filter, and as near copies they are one group, of
which one row stays; of rows repeated whole one stays. Ties go to the smaller doc_id, then
to a hash of the text. Tables may be empty; a further column goes along with its row,
whatever its name, and never meets a column of an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfacts.llm import decontamination, mixing, simhash, token_output, toxicity
from sparkfacts.llm.common import discard, held, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at the threshold or above go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (distinct five-word shingles, Jaccard index 0.8 or more) one row stays, of the smallest doc_id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item's template go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns what they hold of each document, read back."""
    return token_output.read_documents(token_output.write_shards(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: No stage but the anti-joins can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage staged goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = len(held(spark))
        docs = staged(stage(spark, docs, sf_dir), name)
        discard(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
