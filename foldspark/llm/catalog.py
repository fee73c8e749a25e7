"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, mixing, ngram_join, pii, quality_rules, quality_score, secret_scan, token_count, topk, toxicity
from .common import in_fold, prepare, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger starts empty, in a folder of its own; one that is kept between runs gives the same rows."""
    docs = documents(spark, sf_dir)
    ledger = secret_scan.Ledger(spark, shared_dir(spark))
    ledger.update(docs)
    return secret_scan.digest(secret_scan.findings(docs, ledger.read()))


ORACLE["op7_secret_scan"] = secret_scan.duckdb_sql()


@query
def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


ORACLE["op9_poisson_mix"] = mixing.duckdb_sql()


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = toxicity.train(docs, labels(spark, sf_dir))
    scored = toxicity.score(docs, chain)
    held_out = in_fold(F.col("doc_id"), toxicity.FOLDS, toxicity.HELD_OUT).alias("held_out")
    offsets = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scored.select("doc_id", held_out, "score", "predicted", F.size("spans").cast("long").alias("n_spans"), offsets.alias("spans"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op5_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_score.score(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


ORACLE["op3_exact_top_k"] = topk.duckdb_sql()


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


ORACLE["op6_ngram_jaccard_join"] = ngram_join.duckdb_sql()
