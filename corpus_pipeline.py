"""Training data from the table documents, in five stages.

Toxic documents go; of each group of near duplicates one document stays; secrets
are masked; sources are mixed to their target weights; what is left is encoded.
Each stage's rows are written as Parquet and read again as the next one's docs.

Defined results, beside those of each operator: null and empty texts aren't toxic,
are no near duplicates of anything, hold no secret and encode to no tokens; rows
with a null id stay in the first three stages and are drawn one by one; rows that
repeat an id are judged each by their own text for toxicity, stay together among
near duplicates if one of them is to stay, and share a draw; ties between equal
texts go to the smallest id; very long texts are read whole; other columns, whatever
their names, stay up to the last stage, which returns doc_id, lang, source,
n_tokens and token_ids; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foldspark import tables
from foldspark.llm import bpe, mixing, ngram_join, secret_scan, toxicity
from foldspark.llm.common import kept, prepare, shared_dir


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, chain)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.one_of_each(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Its ledger starts empty; give secret_scan.Ledger a lasting folder to scan only what is new."""
    return secret_scan.redacted(docs, secret_scan.Ledger(spark, shared_dir(spark)))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, number_col=None)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, ("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", clean_language),
    ("near duplicates", one_of_near_duplicates),
    ("secrets", masked_secrets),
    ("mixing", mixed_sources),
    ("encoding", token_ids),
]

#: No SQL: the first stage is a fitted model. tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves behind is deleted once the next one's docs are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = tables.made()
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
        tables.release(spark, since, but=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
