"""Cleaning pipeline over the documents table: toxic documents go, then exact copies, near copies and
documents with benchmark passages; what is left is tokenised.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes every
stage's result to the shared folder and reads it back as the next one's ``docs``, so a lost executor
never costs more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.exact_dedup import deduplicate
from tidemark.llm.jaccard import keep_one
from tidemark.llm.pieces import encode
from tidemark.llm.textcnn import fit_toxicity, score_toxicity
from tidemark.llm.tiling import clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold; a null text is empty and stays."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    scored = score_toxicity(own, model, at["doc_id"], at["text"], at["lang"], extra=tuple(n for n in names if n != at["doc_id"]))
    return scored.filter(~F.col("rejected")).select(*[F.col(n).alias(c) for c, n in at.items()])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest id."""
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group tied by similarities of 0.8 or more, the document with the smallest id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every document left."""
    return encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: The first stage is a trained model, so SQL cannot give the rows of ``run``.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
