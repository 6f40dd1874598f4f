"""Whole-table queries of language, archives, repeated bytes and text quality."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm.bytenet import detect_language, learn_languages
from talkmill.llm.fluency import judge_fluency
from talkmill.llm.queries_corpus import documents, segments_of
from talkmill.llm.registry import query
from talkmill.llm.repeats import drop_repeated_bytes
from talkmill.llm.warc import read_archive, write_archive
from talkmill.session import shared_folder


def held_out(doc_id: str = "doc_id"):
    """Every fifth document by checksum of its id; a null id counts as held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = learn_languages(segments_of(docs.where(~held_out())))
    return detect_language(segments_of(docs), net).select(
        F.col("sequence_id").alias("doc_id"), held_out("sequence_id").alias("held_out"),
        F.col("detected").alias("lang_pred"), "score")


@query("op5_warc_archive", r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d
  FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
""")
def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archive(spark, folder).select(
        F.col("page_id").cast("bigint"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint"))


@query("op9_suffix_array_dedup")
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/repeats/{uuid.uuid4().hex}"
    return drop_repeated_bytes(segments_of(documents(spark, sf_dir)), folder).select(
        F.col("sequence_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_quality_perplexity")
def op3_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted text: documents labelled as of quality and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select(
        F.col("doc_id").alias("sequence_id"))
    return judge_fluency(segments_of(documents(spark, sf_dir)), trusted).select(
        F.col("sequence_id").alias("doc_id"), F.nullif("language", F.lit("")).alias("lang"),
        "perplexity", "threshold", "surprise", "surprise_threshold", "kept")
