"""A training corpus from ``documents``: rules, dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
reread as the next stage's documents. All columns stay up to the last stage, whatever
their names. An empty table gives an empty corpus.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from structlake.llm import bpe, exact_dedup, minhash, mixing, quality
from structlake.llm.common import shared_dir, temporary_tables
from structlake.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity band.

    Null and short texts fail. A null language is a language. Rows that repeat an id
    are judged each by its own text.
    """
    return quality.quality_filter(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space.

    Rows alike in id and text stay or go together.
    """
    return exact_dedup.exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the least id.

    Rows with a null id stay. Rows that repeat an id are told apart by their texts; of
    rows alike in both, all stay or go.
    """
    return minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null is a source like any other."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, a row for each copy."""
    return bpe.bpe_digests(docs, *tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
#: Perplexity bands have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with temporary_tables(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
