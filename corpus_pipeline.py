"""A training corpus from raw documents, stage by stage; each stage is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import byte_bpe, common, dart_minhash, exact_dedup, importance, mixing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling takes; the others go.

    A null, empty or blank text has no n-grams and goes; rows that repeat key and text stay or go together, as do ties. A null key is drawn like
    any other. No documents give none; columns of any name pass unchanged.
    """
    return importance.resample(docs, common.read_table(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest doc_id, null being the largest; of rows that repeat both, one.

    Null and empty texts are equal to each other, and blank ones among themselves. No documents give none; columns of any name pass unchanged.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Texts without words and rows without a doc_id are in no group and stay. Long texts are compared whole. No documents give none;
    columns of any name pass unchanged.
    """
    return dart_minhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, which may be never.

    Null is a source like any other; a text without words counts nothing and follows its source's rate. Rows that repeat a doc_id share its
    fate. No documents give none; columns of any name pass unchanged.
    """
    return mixing.emit_mixture(mixing.plan_mixture(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of each document, and of the bytes that they decode to; a row per row.

    A null text is encoded as an empty one, of no tokens; texts of any length are encoded whole. No documents give no rows.
    """
    return byte_bpe.token_digests(docs).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality_importance", quality), ("exact_dedup_bloom", exact), ("near_dedup_dart_minhash", near), ("mix_sources", mixture), ("byte_bpe", encode)]

#: The first stage draws by trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows lie in the session's shared folder."""
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
