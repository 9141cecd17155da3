"""A training corpus from documents, in stages that are each written and read again.

All stages but the last return the columns they get, whatever their names; the last returns doc_id, start, n_tokens and ids_crc32. Null and empty texts have
no language and go in the first stage; a null doc_id, lang or source is a value like any other. Equal rows and equal texts are copies, of which near_duplicates keeps one;
ties go to the smallest doc_id, then to any one. An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import curriculum, decontaminate, langid, similar, tokens
from wayfold.llm.common import landed, read_table, under_own_names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; those without text or letters go."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id: components of SimHash links and of shingle sets of similarity 0.8 or more."""
    return under_own_names(docs, lambda d, c: similar.keep_one(d, doc_id=c["doc_id"], text=c["text"], bits=True))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    benchmark = read_table(spark, sf_dir, "benchmark")
    return under_own_names(docs, lambda d, c: decontaminate.remove_contamination(d, benchmark, text=c["text"]))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, a row for each copy, in training order."""
    return under_own_names(docs, lambda d, c: curriculum.mix(d, doc_id=c["doc_id"], text=c["text"], source=c["source"]))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards; a row for each document in them."""
    return tokens.write_and_read(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: SQL has neither the models nor the hashes of these stages; tests/llm holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name)
    return docs
