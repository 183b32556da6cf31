"""A training corpus from ``documents``: toxic documents out, repeated lines out, one of each group of near copies, benchmark leaks out, packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last return the columns of
``documents``, whatever further columns there are; ``n_chars`` follows the text.

Defined cases: null and empty texts are clean, are one empty line each (so line dedup makes a null text empty), are near copies of nothing, hold no benchmark item and are packed as their end
alone; texts that line dedup empties stay as empty documents; rows without ``doc_id`` are scored, checked and packed like others, lose no line and are near copies of nothing,
but are kept by decontamination whatever they hold; rows that share a ``doc_id`` go together; empty tables of documents, labels or benchmark give empty or unfiltered results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.llm import decontamination, line_dedup, minhash, packing, toxicity
from cueframe.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.where(~toxicity.held_out()), labels.where(~toxicity.held_out()))
    return toxicity.without_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the document of the largest id."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return minhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Trained models and tokenizers: tests compare each stage with brute force on its own input instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
