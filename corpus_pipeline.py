"""A corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again for the next.  All but the last return the columns of
documents, and rows as they came in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnmap.llm.common import documents, stored
from cairnmap.llm.decontamination import clean
from cairnmap.llm.language_id import accepted, train
from cairnmap.llm.mixing import mix
from cairnmap.llm.ngram_join import keep_one
from cairnmap.llm.packing import packed


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of a language that is a toss-up, go."""
    return accepted(docs, train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link, directly or not, the one of least id stays."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go until the sources are near their targets."""
    return mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Trained models, similarity joins and tokenisers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
