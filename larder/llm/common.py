"""Shared helpers of the training-data operators.

Nothing here keeps data on the driver or in a machine-local folder of a cluster:
intermediate tables go to the folder named by ``spark.checkpoint.dir``, which the
driver and all executors share, so a job survives the loss of any executor.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in most contracts: space, tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``. Where that is unset, a local session (as in
    tests) gets a temporary folder of its own, set for the session; a cluster, whose
    machines would not share one, is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str = "snappy") -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts the lineage.

    Task output is committed atomically, so what a lost or repeated task had chosen
    (partition numbers, batch borders) is settled by the committed files. Tables of
    compressed blobs go without a codec, whose buffers would be as large as the blobs.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """staged, but as an external table in buckets of key: grouping by key reads it in place.

    As many buckets as the session has shuffle partitions; rows are large blobs, so no
    codec and at most a file a row. The table leaves the catalog once it is resolved; its
    files stay.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = "larder_" + path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "none").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    back = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    back.staged_at = path
    return back


def remove(table: DataFrame, part: str = "") -> None:
    """Delete a written table, or one partition folder of it, that nothing reads any more."""
    jvm = table.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{table.staged_at}/{part}".rstrip("/"))
    path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of stages whose results are written.

    The query that ran last stays referenced until another one runs, so a small one does.
    """
    gc.collect()
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Words between white space of SPACE_CLASS; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id gives 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def bound(value: Column, body) -> Column:
    """Evaluate value once and hand it to body, as ``let`` would.

    A lambda that refers to an outer expression may evaluate it again for every
    element; a variable bound by a one-element transform is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
