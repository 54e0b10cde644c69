"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, benchmark leaks go, the rest is encoded.

Null and empty texts pass all stages and are encoded as no ids. A null doc_id passes too, but leaves with any leak that has
none. Repeated rows are judged alike; near-duplicates keep one row of an id. A table without rows gives none; columns of
any names stay as they were until encoding, which returns its own. Texts are read whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import saved, table
from corpusloom.llm.decontaminate import drop_leaks
from corpusloom.llm.near_dup import drop_near_duplicates
from corpusloom.llm.pieces import encode_documents
from corpusloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier chain, fitted on the labels table, finds toxic; without labels, all stay."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the smallest id of each component of near-duplicates; texts without words are linked with nothing."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a passage of the benchmark; null and empty items are in no document."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of each document; of a null or empty text, no ids."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
