"""Input tables: content that was fetched before, as Parquet, and inline rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows(spark: SparkSession, values: str, columns: str) -> DataFrame:
    """Inline rows from SQL VALUES, the same text that a SQL oracle takes."""
    return spark.sql(f"SELECT * FROM (VALUES {values}) AS t({columns})")


def write(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Result rows as Parquet, partitioned by columns if given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the folder that driver and executors share, and read back.

    That cuts the lineage and settles row numbers. The folder is that of
    ``spark.checkpoint.dir``; a local session without one gets a folder of its own, a
    cluster is refused.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
