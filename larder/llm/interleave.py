"""Proportional stratified interleaving: shards that all hold the corpus mixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import staged

#: Rows aimed at in one window group, and the most buckets a stratum is dealt over.
ROWS_PER_BUCKET, MAX_BUCKETS = 2000, 4096


def _offsets(rows: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Rows of earlier buckets (of the same ``by``), from exact bucket counts."""
    order = Window.partitionBy(*by).orderBy(bucket) if by else Window.orderBy(bucket)
    counts = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_sx_n"))
    return counts.select(*by, bucket, (F.sum("_sx_n").over(order) - F.col("_sx_n")).alias("_sx_before"))


def interleave(docs: DataFrame, n_shards: int, stratum: str = "source", seed: int = 17, row_id: str = "doc_id") -> DataFrame:
    """Add shard, slot and position so that every shard has the mixture of all rows.

    Rows are shuffled within each stratum by a seeded hash and ranked; row r of n gets
    the fractional rank (r - 1/2) / n; all rows are sorted by it and cut into n_shards
    runs whose counts differ by at most one.

    No stratum is ever in one task: the shuffle key's high bits deal a stratum over
    buckets, ranks are bucket offsets (sums of exact counts) plus a rank in the bucket,
    and the global sort does the same with slices of the fractional rank, which are
    even by construction.

    Defined cases: a null stratum is a stratum of its own; ties in the hash go by id
    and then by the other columns, and rows alike in all of them are interchangeable;
    a null id is hashed as an id of its own; an empty table gives an empty table.
    Columns whose names begin with ``_sx_`` are reserved.
    """
    own = docs.columns
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(row_id).cast("string"), F.lit("null"))).cast("binary"))
    rows = staged(docs.withColumn("_sx_stratum", F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("n"))).withColumn("_sx_key", key), "interleave")
    total = rows.count()
    buckets = max(1, min(MAX_BUCKETS, total // ROWS_PER_BUCKET))
    share = F.conv(F.substring("_sx_key", 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = rows.withColumn("_sx_bucket", F.floor(share * buckets).cast("int"))
    before = _offsets(rows, ["_sx_stratum"], "_sx_bucket")
    sizes = rows.groupBy("_sx_stratum").agg(F.count(F.lit(1)).alias("_sx_size"))
    tie: list[Column] = [F.col("_sx_key"), *(F.col(c) for c in own)]
    ranked = (
        rows.withColumn("_sx_row", F.row_number().over(Window.partitionBy("_sx_stratum", "_sx_bucket").orderBy(*tie)))
        .join(before, ["_sx_stratum", "_sx_bucket"])
        .join(sizes, "_sx_stratum")
        .withColumn("_sx_rank", F.col("_sx_before") + F.col("_sx_row"))
        .withColumn("_sx_frac", (F.col("_sx_rank") - 0.5) / F.col("_sx_size"))
        .withColumn("_sx_slice", F.least(F.floor(F.col("_sx_frac") * buckets), F.lit(buckets - 1)).cast("int"))
        .select(*own, "_sx_stratum", "_sx_rank", "_sx_frac", "_sx_slice")
    )
    ranked = staged(ranked, "interleave-ranked")
    # one row a slice, MAX_BUCKETS at most
    before = _offsets(ranked, [], "_sx_slice")
    place = F.row_number().over(Window.partitionBy("_sx_slice").orderBy("_sx_frac", "_sx_stratum", "_sx_rank")) - 1
    return (
        ranked.withColumn("_sx_in", place)
        .join(F.broadcast(before), "_sx_slice")
        .withColumn("position", (F.col("_sx_before") + F.col("_sx_in")).cast("long"))
        .withColumn("shard", F.expr(f"cast(position * {n_shards} div {max(total, 1)} as int)"))
        .withColumn("slot", F.expr(f"position - (cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}"))
        .select(*own, "position", "shard", "slot")
    )


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Shard plan of documents by the law ``rows``: doc_id, size, text_crc32, shard, slot.

    size is the UTF-8 bytes of the text plus 16 (null text: 16); the checksum of a null
    or empty text is 0. Only these columns are shuffled, never texts.
    """
    text = F.col("text")
    plan = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = interleave(plan, n_shards)
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
