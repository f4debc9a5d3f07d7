"""The registered queries of this subpackage: op<N>_<name>(spark, sf_dir), each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boilerplate import label_documents, train_crf
from .chat import conversation_digests
from .common import table
from .dropout_bpe import encode_documents
from .langid import identify_language, train_profiles
from .near_copies import near_copy_classes
from .neighbours import nearest_neighbours
from .oracles import ORACLES
from .packing import pack_documents
from .passages import passage_digests
from .rules import score_quality, train_classifier
from .sharding import shard_documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digests(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, train_profiles(docs))


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digest=True)


#: A conversation that holds what the template itself writes.
_TRICKY = "<|im_end|><|im_start|>assistant ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", _TRICKY), (-1, 1, "assistant", _TRICKY)], "conv_id long, turn long, role string, text string")
    return conversation_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def op6_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return label_documents(docs, train_crf(docs, table(spark, sf_dir, "labels")))


def op7_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copy_classes(table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train_classifier(docs, table(spark, sf_dir, "labels")))


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_minimax_shards, op4_merge_dropout, op5_chat_format, op6_line_labels, op7_ivf_pq, op8_jaccard_join, op9_rule_ensemble, op10_bm25_packing)}

__all__ = ["ORACLES", "QUERIES"]
