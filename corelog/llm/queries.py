"""Queries over the training-data operators, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelog.llm import bpe, language_id, line_templates, mixing, near_dups, neighbours, pii, quality_ranker, quality_rules, substrings
from corelog.llm.common import row_key

#: Where the public vocabulary is; set CORELOG_VOCABULARY to use another one.
VOCABULARY = os.environ.get("CORELOG_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's byte-level BPE token ids, and whether decoding them gives the text back."""
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode(docs, bpe.Vocabulary.load(VOCABULARY), same="round_trip", keep=["doc_id"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents within their (language, source) group's adaptive bounds."""
    return quality_rules.filter_quality(_table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others, among all vectors, of every vector whose id is divisible by 20."""
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"), asking=F.col("id") % 20 == 0)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data hidden."""
    return pii.redact(_table(spark, sf_dir, "documents"), pii.train(), where="spans", keep=["doc_id", "text"])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; the model learns from a bounded sample of the lang column."""
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs), keep=["doc_id", "lang"])


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates (its least doc_id) and the number of documents it is near to."""
    return near_dups.jaccard_classes(_table(spark, sf_dir, "documents"))


def op7_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the pairwise ranker keeps, with their scores."""
    return quality_ranker.filter_ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the mix uses, the source whose quota it fills, and how often."""
    docs = _table(spark, sf_dir, "documents")
    chosen = mixing.mix(docs)
    keyed = docs.select("doc_id", row_key().alias("doc_key"))
    return chosen.join(keyed, "doc_key").groupBy("doc_key", "source", "copies").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source", "copies")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    return line_templates.drop_lines(_table(spark, sf_dir, "documents"), dropped="n_dropped", n_chars="n_chars")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of WINDOW words or more that stand in two documents or more."""
    return substrings.find_repeats(_table(spark, sf_dir, "documents")).drop("doc_key")


QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_quality_rules, op3_neighbours, op4_pii, op5_language_id, op6_jaccard_join, op7_quality_ranker, op8_mixing, op9_line_templates, op10_substrings)
}
ORACLES = {"op2_quality_rules": quality_rules.FILTER_SQL, "op6_jaccard_join": near_dups.CLASSES_SQL, "op10_substrings": substrings.FIND_SQL}
