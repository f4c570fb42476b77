"""A corpus through language ID, exact and near de-duplication, decontamination and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrazzo.llm import bpe, decontaminate, exact_dedup, jaccard_join, language
from terrazzo.llm.common import read, stage
from terrazzo.llm.queries import tokenizer_path

#: Languages to keep (None: all that the documents are labelled with), and the least probability of the one predicted.
LANGUAGES, LEAST_SCORE = None, 0.4


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language isn't one of LANGUAGES, or is hardly likelier than another, go; so do those without a letter.

    Where no document has a language to learn from, only the letters decide.
    """
    return language.keep_known(docs, LANGUAGES, LEAST_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays (null: the smallest; null text: empty). Of repeated rows one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays, and each without words."""
    return jaccard_join.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; those without text stay."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of what is left, with digests of the ids and of the text they decode to. No text: no ids."""
    return bpe.encode_digests(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language", keep_known_languages),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("benchmark", drop_benchmark_leaks),
    ("encode", encode),
]
#: The network, the shingle graph and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each is written to the shared folder before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
