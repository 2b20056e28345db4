"""Tables between steps, in the folder that driver and executors share, and bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


#: Bytes of rows that go to a Python worker at once (a longer row goes alone).
BATCH_BYTES = 4 << 20
#: Bytes of a bounded table that come to the driver at once.
PART_BYTES = 16 << 20
#: Rows of texts that a scan decodes at once.
SCAN_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow() in batches that are bounded by bytes, so that neither long texts nor many rows fill a worker's memory.

    Scans read fewer rows at once, too: thousands of texts in one column vector make very large objects, which
    a heap has to grow for. Both are settings of the session.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    conf.set("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it, a folder that driver and executors share; where it is unset, a temporary one if all of them are this process, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that written() made."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def brought(rows: DataFrame, most_bytes: int):
    """An iterator over the rows of a bounded table, which come to the driver by about PART_BYTES at once.

    toLocalIterator() alone runs a job for each partition, one after the other: thousands for a few rows on a large cluster.
    """
    return rows.repartition(max(1, most_bytes // PART_BYTES)).toLocalIterator()


def fold_of(column: str, of: int):
    """crc32 of the id as text, modulo the number of folds; a null id is in fold 0."""
    return F.coalesce(F.expr(f"crc32(cast(cast(`{column}` as string) as binary)) % {of}"), F.lit(0))


def by_hash(df: DataFrame, columns: list[str], seed: int, n: int) -> DataFrame:
    """n rows at most, those with the least seeded hash of some columns: the same on every run.

    A cut at the hash below which about n rows lie comes first, so that tasks hand on few rows more than are wanted.
    """
    rows = df.count()
    h = F.xxhash64(F.lit(seed), *columns)
    if rows > n:
        share = min(1.0, (n + 4 * n**0.5 + 10) / rows)
        df = df.where(h <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    return df.orderBy(h, *columns).limit(n)


def within(rows: DataFrame, keys: list[str], order: Column, size: Column, most: int, most_bytes: int) -> DataFrame:
    """Of each key's rows the first `most` in an order, and no more than `most_bytes` of their sizes, but one row at least."""
    by = Window.partitionBy(*keys).orderBy(order, size)
    rows = rows.withColumn("place__", F.row_number().over(by)).withColumn("bytes__", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("place__") <= most) & ((F.col("bytes__") <= most_bytes) | (F.col("place__") == 1))).drop("place__", "bytes__")
