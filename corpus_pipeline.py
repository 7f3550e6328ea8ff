"""From raw documents to packed training sequences: five stages, each one of the operators.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last
return the columns of documents: the quality classifier drops documents, exact and near
deduplication leave one of each group, and mixing repeats, cuts or leaves out documents as its
schedule says. The last returns a row per piece of a document with its place in a sequence.

Defined results: null and empty texts are scored like others, the exact and the near deduplication
leave one of them (the latter links them with nothing), and mixing takes none, so none is packed.
Null languages, sources and ids are values of their own; of rows that repeat an id or a text one
stays. Columns beside those of documents pass through up to the packing, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from gridloom.llm.common import staged_alone, table, unstage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, the near-duplicates and the packing are beyond SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; what a stage has written goes once the next is written."""
    docs, written = table(spark, sf_dir, "documents"), []
    for k, (_, apply) in enumerate(STAGES):
        given = docs
        docs = staged_alone(lambda apply=apply, given=given: apply(spark, given, sf_dir), f"pipeline-{k}")
        unstage(*written)
        written = [docs]
    return docs
