"""From raw documents to token ids: toxicity, line dedup, near-duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but
the last return the columns of ``documents``. A null text passes every stage as an empty one, and
rows with a null id are kept like others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keelson.llm.bpe import bpe_round_trip, public_vocabulary
from keelson.llm.common import stored
from keelson.llm.contamination import contamination
from keelson.llm.line_chunks import line_dedup
from keelson.llm.shingle_copies import similar_representatives
from keelson.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels).where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that occur earlier in the corpus."""
    shorter = line_dedup(docs).select(*docs.columns)
    return shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else shorter


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    The trie join of fingerprints proposes, the sets of shingles decide, and what fingerprints miss is added."""
    return similar_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).where("not contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and the digests of ids and decoded bytes."""
    ranks, pattern = public_vocabulary()
    return bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), ranks, pattern).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

ORACLE_SQL = None  # trained weights, 64-bit XXH64 fingerprints and merges are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if number == 0 else stored(docs), sf_dir)
    return docs
