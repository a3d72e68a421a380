"""From documents to token ids: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written as Parquet and read again before the next.

Defined results: a null or empty text, or one below the base rules, goes in the first
stage, so that later stages see none from `run`, though each takes them; rows that are
equal count as copies and one of them stays; an empty table gives an empty result; of
columns of any name all are kept up to the last stage, whose result has its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seriesmill.llm import mixing, pii, quality, sentencepiece_bpe, simhash
from seriesmill.llm.common import remove, remove_at_exit, shared_folder, table
from seriesmill.llm.queries import piece_model

#: Entropy of the source weights as a share of its maximum, and how often a source is repeated at most.
ENTROPY, REPEATS = 0.97, 2.0


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on the labelled documents of the table; what it rejects goes.

    Rows are judged one by one, so equal rows go or stay together; a null text goes.
    """
    return quality.keep_good(docs, quality.trained_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest doc_id, then as `simhash.deduplicate` says for ties.

    Texts without words are one group; a null doc_id stays only where its group has no other.
    """
    return simhash.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become their kind in brackets; no row goes, a null text stays null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least budget that takes every source whole: no document goes, those of small sources come up to REPEATS times.

    A null source is a source of its own; texts without words cost nothing and come once or more.
    """
    return mixing.mix(docs, ENTROPY, REPEATS, "cover")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of counts and digests for each row; a null text is an empty one."""
    return sentencepiece_bpe.encode_texts(docs, piece_model())


STAGES = [
    ("quality rules", keep_good_documents),
    ("SimHash near-dedup", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: No stage but the base counts can be said in SQL; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each result in the shared folder until the next is written there; the last goes when the driver ends."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, base)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
