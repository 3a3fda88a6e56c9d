"""Row-wise operators over streams.

All scalar operators and page extraction keep no state, so a stream takes the same
function as a table; ranking and deduplication across rows belong to each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run(spark: SparkSession, path: str, schema: str, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a stateless operator to new Parquet files of a folder, exactly once."""
    return operator(spark.readStream.schema(schema).parquet(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
