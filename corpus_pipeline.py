"""From raw documents to token shards: language, near duplicates, benchmark leaks, mixture, tokens.

STAGES are applied in order; each reads what the one before it kept and wrote. run() does so for a folder of tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statspark.llm import decontaminate, langid, mixing, queries, simhash, tokens
from statspark.llm.common import store, table
from statspark.session import scratch_dir

SHINGLE, RADIUS = 3, 2
#: Pieces that the tokenizer's workers remember: they share the executor with what the stages before have left.
PIECES = 400_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the classifier rejects go."""
    found = langid.identify_language(docs, queries.language_model(docs))
    return found.where(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return simhash.keep_one(docs, shingle=SHINGLE, radius=RADIUS).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    weighed = queries.with_domain(docs)
    mixed = mixing.mix(weighed, ("domain", "lang", "source"), queries.MIX_WEIGHTS, budget_share=1.0, max_epochs=queries.MIX_EPOCHS, seed=queries.MIX_SEED)
    return mixed.select(*docs.columns)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mixture, read back as one row per document."""
    path = scratch_dir(spark, "tokens")
    tokens.write_tokens(docs, path, queries.tokenizer_path(), pieces=PIECES)
    return tokens.read_tokens(spark, path)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
    ("token_shards", token_shards),
]

#: SQL can't express trained classifiers, fingerprints, tiling or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
