"""Corpus preparation from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on every row the stage before it kept, and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.llm import common, mixing, near_dups, packing, quality, secret_scan


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject.

    Null and empty texts get the score of the model's bias; repeated rows are scored row by row; without labels none are rejected.
    """
    model = quality.train(docs, common.read(spark, sf_dir, "labels"))
    score = max(docs.columns, key=len) + "_score"
    return quality.scored(docs, model, score).where(F.col(score) >= quality.ACCEPT).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id. Rows without a doc_id stay.

    Texts without words are no one's copies and stay; repeated rows of a kept doc_id all stay.
    """
    kept = near_dups.near_duplicates(docs).where("kept").select("doc_id")
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; null texts stay null."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight has it taken.

    Null sources are a source of their own; documents of a source without words are not taken; equal rows are drawn row by row.
    """
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, with their ids; null and empty texts have their end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, hashes and tokenizers are not SQL's; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way, and the stage before it, is deleted once the stage itself is written."""
    docs, before = common.read(spark, sf_dir, "documents"), common.tables_written()
    for name, stage in STAGES:
        docs = common.written_alone(stage(spark, docs, sf_dir), f"stage-{name}", before)
    return docs
