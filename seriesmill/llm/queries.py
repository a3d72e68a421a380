"""The queries of this subpackage, by name, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import chat, licenses, mixing, pii, quality, sentencepiece_bpe, sharding, simhash, suffix_dedup, syncmers
from seriesmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.annotate(docs, keep_text=False)
    base = F.filter("pii_spans", lambda s: s["base"])

    def of(k: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")

    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.said(base), 256).alias("base_sha256"), pii.said(F.col("pii_spans")).alias("spans"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_texts(table(spark, sf_dir, "documents"), piece_model())


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and pass of the mixture, with its place."""
    plan = mixing.schedule(mixing.units_of(table(spark, sf_dir, "documents")))
    return plan.select("doc_id", "source", "tokens", F.col("pass").cast("long").alias("pass"), "start", F.round("at", 9).alias("at"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_summary(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.trained_model(docs, table(spark, sf_dir, "labels")))


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_with_neighbours(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"op1_pii": op1_pii, "op2_sharding": op2_sharding, "op3_sentencepiece": op3_sentencepiece, "op4_licenses": op4_licenses, "op5_mixing": op5_mixing, "op6_repeats": op6_repeats, "op7_simhash": op7_simhash, "op8_quality": op8_quality, "op9_chat": op9_chat, "op10_syncmers": op10_syncmers}
ORACLE: dict[str, str] = {"op4_licenses": licenses.oracle(), "op9_chat": chat.ORACLE}
