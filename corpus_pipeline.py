"""The corpus pipeline: classify, judge lines, drop near copies, cut repeated passages, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet to the
shared folder and the next stage reads it.  All stages but the last return the columns of ``documents``.

A null or empty text has too few words for the quality rules and goes there, if the classifier kept it.  A null doc_id is no copy of
anything and loses no passage.  Repeated rows are one document: the Jaccard join keeps one of them.  Very long texts are read whole by every
stage.  Ties of scores and of texts are broken as the operators say.  An empty table gives no rows.  Columns beyond those of
``documents``, whatever their names, are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgraph.llm.boilerplate import label_documents, train_crf
from docgraph.llm.common import materialize, small_batches, table
from docgraph.llm.near_copies import near_copy_classes
from docgraph.llm.packing import pack_documents
from docgraph.llm.passages import remove_passages
from docgraph.llm.rules import score_quality, train_classifier

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = COLUMNS[1:]

#: Bytes of the shortest repeated passage that is cut: any of more than 50 words is longer.
PASSAGE_BYTES = 100


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored below 0.5 go."""
    docs = docs.select(*COLUMNS)
    model = train_classifier(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=OTHERS).filter("predicted = 1").select(*COLUMNS)


def keep_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the line labels or the base rules reject go."""
    docs = docs.select(*COLUMNS)
    model = train_crf(docs, table(spark, sf_dir, "labels"))
    return label_documents(docs, model, keep=OTHERS).filter("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component the document with the least doc_id stays, of its rows, if it has several, the one with the first text.

    Rows without a doc_id are documents of their own and stay.  What goes or has to be chosen from is told by doc_id in one table, so texts
    move once.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    classes = near_copy_classes(docs, words=5, percent=80).filter("doc_id is not null")
    told = classes.groupBy("doc_id").agg(F.min(F.when(F.col("component_id") < F.col("doc_id"), "copy").otherwise("several")).alias("why"), F.count("*").alias("n"))
    told = materialize(told.filter("why = 'copy' or n > 1").select("doc_id", "why"), "told")
    known = docs.join(told, "doc_id", "left")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))
    chosen = known.filter("why = 'several'").withColumn("place", first).filter("place = 1")
    return known.filter("why is null").select(*COLUMNS).unionByName(chosen.select(*COLUMNS))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages that an earlier document holds are cut out; n_chars follows the text."""
    small_batches(spark)
    cut = remove_passages(docs.select(*COLUMNS), PASSAGE_BYTES, keep=("lang", "source", "n_chars"))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every token of what is left, in sequences of related documents."""
    small_batches(spark)
    return pack_documents(docs)


STAGES = [("quality classifier", keep_good), ("quality rules", keep_content), ("n-gram jaccard join", drop_near_copies), ("suffix-array dedup", cut_passages), ("packing", pack)]

#: Trained models, sorting and retrieval: SQL can't express it.  tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
