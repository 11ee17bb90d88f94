"""The ten operators' queries over the driver's tables, with production parameters, and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> tuple[bytes, str]:
    """A rank file's bytes, read on the driver (some 1 MB) and sent with the tasks; and its split pattern."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.urls import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.quality import COUNTS, assess

    return assess(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    from inkspan.llm.bpe import decode, encode

    ranks, pattern = vocabulary()
    encoded = encode(docs, ranks, pattern)
    return decode(encoded, ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(doc_id: Column) -> Column:
    """A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.langid import predict, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out(F.col("doc_id")))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.neighbors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.windows import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm import pii

    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(F.col("base"), k.name).alias(f"n_{k.name}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_url_filter, op2_quality_rules, op3_byte_bpe, op4_language_id, op5_simhash, op6_html_text, op7_embedding_dedup, op8_substring_dedup, op9_source_mix, op10_pii]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from inkspan.llm import oracles

    return {"op2_quality_rules": oracles.OP2, "op7_embedding_dedup": oracles.OP7, "op8_substring_dedup": oracles.OP8, "op9_source_mix": oracles.OP9, "op10_pii": oracles.OP10}
