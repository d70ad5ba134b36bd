"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corelog.llm import bpe, line_templates, mixing, near_dups, quality_ranker
from corelog.llm.common import discard, scratch, shared_dir
from corelog.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the pairwise ranker rejects go."""
    return quality_ranker.filter_ranked(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score=None)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: lines of recurring templates go; n_chars follows the text. A document may become ''."""
    return line_templates.drop_lines(docs, n_chars="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of near duplicates stays, that of the least doc_id."""
    return near_dups.drop_near_dups(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents are selected, and repeated, until each source has its share of tokens.

    A document that is used several times is several rows. Documents without words, which no quota can use, go.
    """
    return mixing.mix_documents(docs, copies=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: byte-level BPE ids of each text, and whether decoding them gives it back."""
    return bpe.encode(docs, bpe.Vocabulary.load(VOCABULARY), same="round_trip", keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Training, similarity joins and flows aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what each returns is a table in the shared folder for the next.

    What a stage wrote besides is deleted when its result is written, and that when the next one's is.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            before, path = path, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
