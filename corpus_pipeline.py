"""A corpus, from raw documents to packed sequences.

Each stage takes the session, the documents that the one before it kept, and the folder of the tables, and
returns a DataFrame; all but the last return the columns of ``documents``. Stages are written as Parquet to
the shared folder and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bin_packing, simhash_dedup, source_mixing, substring_dedup, toxicity
from tidewater.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the text decides, so rows of one id may differ."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_ordinary(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more of five-word shingles, the row of smallest id, once."""
    return simhash_dedup.without_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of a smaller id has too."""
    return substring_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or stretches of them, that make up the mix of sources."""
    return source_mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces stand in the packed sequences."""
    return bin_packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mix_sources", mix),
    ("pack", pack),
]

#: Compression lengths, the hashes of fingerprints and the tokenizer's ids have no SQL; the tests hold a small run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
