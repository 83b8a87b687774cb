"""A corpus pipeline of five stages: toxic documents go, one of each group of near copies stays, documents that hold
benchmark text go, sources are mixed to their target weights (a document taken twice is two rows), and rows are dealt to shards.

Defined results, stage by stage those of the operators: null and empty texts have no score above that of texts without hits, no
links and no benchmark words; the mixture takes no documents without words; repeated rows are copies, so one stays; rows that
share an id, or have none, are documents each; ties go by id and by hashes; very long texts are taken whole; columns that clash
stay; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fjordline.llm import decontam, mixing, ngram_join, sharding, toxicity
from fjordline.llm.spark import Table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_row(docs, n=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.interleave(docs, 16)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark),
    ("mixing", mixture),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written as Parquet in the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        table = Table(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = table.df, table
    return docs


#: No SQL expresses a learnt score or the cube method; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None
