"""The corpus pipeline: from raw documents to encoded training data, each stage on all that its predecessor kept.

Quality rules drop documents and lines; SimHash near-dedup keeps the document of each group with the smallest id; PII is masked; sources are
mixed to their target weights (whole epochs, and one document cut where the budget ends); the mix is encoded by byte-level BPE. All stages but the
last return the columns of documents. A document that the mix repeats is encoded as often.

Cases: null texts and short ones fail the base rules; a null id is an id of its own, which every stage keeps; a null source is a source; repeated rows are near
copies of each other; an empty table gives no rows; further columns pass through all stages but the last, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkspan.llm import mixing, pii, quality, simhash
from inkspan.llm.common import stage
from inkspan.llm.queries import bpe_digests


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted go; lines over their host's limit go from the rest."""
    return quality.clean(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id (null ids last); of rows that repeat its id and text, one."""
    return simhash.one_of_each(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("mask_pii", mask_pii), ("mix_sources", mix_sources), ("encode_bpe", encode_bpe)]

#: XXH64 fingerprints, groups by reachability and BPE have no DuckDB SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs)
    return docs
