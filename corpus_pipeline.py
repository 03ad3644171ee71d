"""From raw documents to training tokens: five stages, each on all documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixmill.llm import bpe, decontaminate
from helixmill.llm.near_dedup import NearDedup
from helixmill.llm.quality import ImportanceResampling
from helixmill.llm.stage import read, written
from helixmill.llm.toxicity import OrdinalToxicity
from helixmill.llm.vocabulary import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the texts labelled as good keeps."""
    return ImportanceResampling().fit(docs, read(spark, sf_dir, "labels")).keep(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the cut."""
    return OrdinalToxicity().fit(docs, read(spark, sf_dir, "labels")).clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by near duplicates: five-word shingles, similarity 0.8."""
    return NearDedup(k=5, percent=80).keep(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item: less than 0.8 of each item's five-word shingles."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the SHA-256 of the ids and of the bytes that they decode to."""
    ranks, pattern = vocabulary()
    return bpe.round_trip(docs, ranks, pattern, with_ids=True)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", benchmark), ("bpe", tokens)]

#: The first two stages fit models, which SQL cannot; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of each document that all stages keep.

    Null and empty texts have no words: they are kept or dropped as the quality model's cut says for a log weight of 0, link
    with nothing, contain no item and have no ids. Repeated rows get the same verdicts, and near dedup keeps one of them;
    null ids are ids like others. Other columns, whatever their names, pass through all stages but the last. Empty tables
    give no rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
