"""Corpus preparation: quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.  ``run`` writes what a stage returns and gives it to the next.

Edge cases: a null or empty text is judged as such and packs as its end mark; rows without an id, or with a repeated
one, are judged by row; equal rows are copies, of which one stays; texts are read whole; other columns pass unchanged
under any name; an empty table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.shared import scratch_table
from marketloom.llm import near_duplicates, packing, quality, substring

#: Documents with a lower score are rejected.
THRESHOLD = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the labels of ``sf_dir``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model, THRESHOLD)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard index of at least 0.8."""
    return near_duplicates.distinct(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier text has; others stay as they are.

    A text that repeats as a whole stays as an empty text, so no document is lost.
    """
    return substring.cleaned(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts with their places in sequences of at most 1024 tokens."""
    # a worker keeps its table while other stages run in it
    parts = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), chunks=400_000)
    return packing.pack(parts, packing.Capacity(tokens=1024)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


STAGES = [("quality", good_documents), ("near_duplicates", distinct_documents), ("repeated_passages", without_repeats), ("packing", packed)]

#: A fitted model and MinHash bands have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
