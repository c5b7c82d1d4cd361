"""A training corpus from ``documents``: quality, near copies, repeated passages, benchmark leaks, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bpe, decontaminate, ngram_join, quality, substrings
from lodestar.llm.queries import vocabulary
from lodestar.llm.shared import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.good_only(docs, table(spark, sf_dir, "labels"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies."""
    return ngram_join.first_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents that lose all words go."""
    return substrings.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    return bpe.encode(docs, vocabulary()).select("doc_id", "n_tokens", "ids")


STAGES = [("quality", keep_good), ("near copies", keep_first_copies), ("repeated passages", cut_repeats), ("benchmark leaks", drop_leaks), ("tokens", to_tokens)]

#: Training and graph search are no SQL; the pipeline's tests check columns and row counts only, not its texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
