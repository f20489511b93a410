"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), with docs the table that the stage before it wrote, and
returns a DataFrame; all but the last return the columns of documents. `sf_dir` is read for labels
only. Null and empty texts fail the quality rules; rows with a null doc_id stay through every
stage but belong to no near-duplicate group with an id; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm import packing, quality_rules, simhash_covering, suffix_dedup, toxicity_kn
from tidemark.llm.common import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without the lines that fail."""
    return quality_rules.keep_clean(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; the models learn from this stage's labelled rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity_kn.fit(toxicity_kn.train_rows(docs), toxicity_kn.train_rows(labels))
    own = "_".join(["score", *docs.columns])  # no column has this name
    scored = toxicity_kn.score(docs, model, columns=docs.columns, score_col=own)
    return scored.where(F.col(own) < toxicity_kn.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies by SimHash: the one with the smallest doc_id.

    Rows that repeat a doc_id are documents of their own: they stay if their texts are no near-copies,
    else the one whose text has the smallest digest does. Rows with a null doc_id can't be told apart
    by id; they all stay.
    """
    groups = simhash_covering.near_duplicates(docs, keys=True)
    kept = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias("id"), "group_key").agg(F.min("text_key").alias("key")).select("id", "key")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64("text").alias("key")).join(kept, ["id", "key"], "left_semi")
    first = Window.partitionBy("id", "key").orderBy("id")  # of rows with one id and text any will do
    one = own.withColumn("rank", F.row_number().over(first)).where("rank = 1").select(*(F.col("row")[c].alias(c) for c in docs.columns))
    return one.unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeat 50 bytes of a document with a smaller doc_id."""
    return suffix_dedup.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 1024 tokens."""
    return packing.pack(docs)


#: Training a model, fingerprints and tokenizers have no SQL form; each stage is tested by itself.
ORACLE_SQL = None
STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of sf_dir, each stage's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
