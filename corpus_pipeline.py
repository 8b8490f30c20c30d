"""A corpus pipeline of five stages over the ``documents`` table.

Quality rules drop documents, near duplicates leave one document of each
group, documents that hold benchmark passages go, sources are mixed to target
weights, and what is left is written as token-id blocks and read back. Each
stage gets what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, ngram_join, quality_rules, source_mix, token_blocks
from granary.llm.common import scratch, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the newest policy keeps."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row per epoch of a document, cut where a budget ends."""
    return source_mix.materialize(docs, source_mix.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(spark, "corpus")
    token_blocks.write(docs, path)
    return token_blocks.read(spark, path)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near duplicates by hashed sets, aligned masks and a tokenizer are beyond SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
