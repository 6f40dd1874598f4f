"""Whole-table queries of token alignment, set joins and embedding whitening."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm.alignment import align_segments, score_links, vocabulary_size
from talkmill.llm.queries_corpus import segments
from talkmill.llm.registry import query
from talkmill.llm.setjoin import similar_segments
from talkmill.llm.whitening import whiten
from talkmill.session import shared_folder

#: Where the vocabulary files of public tokenizers lie on every machine.
TOKENIZERS = "/opt/tokenizers"


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/alignments/{uuid.uuid4().hex}"
    pieces = f"{TOKENIZERS}/piece_bpe_32k.model"
    aligned = align_segments(segments(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json", pieces)
    aligned = aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(
        F.sha2("groups", 256))).drop("groups")
    return score_links(aligned, vocabulary_size(pieces), folder).select(
        F.col("sequence_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best",
        "count_sum", "groups_sha256", "n_shared")


@query("op12_ngram_jaccard_join")
def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/shingles/{uuid.uuid4().hex}"
    return similar_segments(segments(spark, sf_dir), folder).withColumnRenamed(
        "sequence_id", "doc_id")


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond the range of longs is null."""
    folder = f"{shared_folder(spark)}/vectors/{uuid.uuid4().hex}"
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.col("embedding").alias("vector"))
    return whiten(vectors, folder).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
