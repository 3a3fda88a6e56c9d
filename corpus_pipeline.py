"""Corpus pipeline: quality rules, language ID, near-dedup, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read back as the next one's docs. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import staged
from larder.llm.langid import identify
from larder.llm.near_text import near_duplicates
from larder.llm.pack import pack
from larder.llm.quality import judge
from larder.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if no language holds this share of it, or if its languages explain it no
#: better than this (nats a trigram over even bins), as with text of no learned language.
LEAST_SHARE, LEAST_GAIN = 0.5, 0.0
#: Near-duplicates: five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are no outliers of their language and source.

    Each row has its own verdict, whatever its id; a null text fails.
    """
    return judge(docs.select(*COLUMNS), keep=COLUMNS).filter("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language that holds LEAST_SHARE of them and explains them; ``lang`` stays the given one."""
    found = identify(docs, keep=COLUMNS)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE) & (F.col("gain") > LEAST_GAIN)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, an id before none.

    Rows are told apart by their places in the files of docs, which are written before this
    stage reads them, so rows without an id, and rows that share one, go only where their
    texts are near. Wordless texts stay.
    """
    rows = docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id())
    found = near_duplicates(rows.select("_row", "text"), percent=PERCENT, size=SHINGLE, row_id="_row")
    groups = found.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    return rows.join(first.select("first._row"), "_row", "left_semi").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 1024 tokens."""
    return pack(docs, tokenizer("byte_bpe_50k.json"), 1024, 0)


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("packing", packing)]

#: Neither robust estimates nor sketches can be said in SQL; tests/llm holds run() against
#: a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
