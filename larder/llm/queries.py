"""Registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on the driver, from which it is shipped."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    """The pattern that cuts texts for the public byte-level BPE files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.katz import score

    return score(_table(spark, sf_dir, "documents"), order=3)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents"))


def op3_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.interleave import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), 40)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.lattice import encode

    return encode(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.pack import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 1024, 0)


def op7_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.near_text import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85, size=3)


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), 0.95)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.main_text import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.codebooks import compress

    return compress(_table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.bpe_tree import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), tokenizer_pattern())


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_katz, op2_quality, op3_interleave, op4_pieces, op5_licenses, op6_packing, op7_near_text, op8_near_vectors, op9_language, op10_main_text, op11_codes, op12_byte_bpe, op13_filter_audit, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others cannot be said in SQL that ends on whole tables; tests use brute force."""
    from larder.llm import audit, codebooks

    return {"op11_codes": codebooks.SQL, "op13_filter_audit": audit.SQL}
