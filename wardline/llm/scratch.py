"""Intermediate tables in the folder that the driver and all executors share.

A written Parquet table cuts the lineage like ``checkpoint()`` and survives
lost executors; it is smaller than a checkpoint of rows and can be dropped as
soon as a later table has been derived from it.
"""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import ensure_checkpoint_dir


class Scratch:
    """A folder of its own below ``spark.checkpoint.dir`` for one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def number(self, docs: DataFrame, *columns: str) -> DataFrame:
        """(row, doc): the rows of ``docs``, or the named columns of them, with a number of their own, written once.

        The number is the row's place in the partitions of this one scan; those of another scan may differ
        (Spark cuts files by the cores it has at that time), so every later step reads the written numbers.
        """
        rows = docs.select(F.monotonically_increasing_id().alias("row"),
                           F.struct(*[docs[c] for c in columns or docs.columns]).alias("doc"))
        return self.write(rows, "rows")

    def release(self) -> None:
        """Let Spark delete the exchange files of steps whose results are written.

        Its cleaner does so once the driver has collected the garbage of their
        plans, which on a quiet driver may otherwise take half an hour.  What
        the first collection sets free is referenced by what the second one
        sets free, hence two with a pause for the cleaner.
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep_only(self, *names: str) -> None:
        """Delete all tables but the named ones, once what was derived from them is written."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self.drop(*[n for n in (f.getPath().getName() for f in fs.listStatus(root)) if n not in names])


def clean_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns cannot clash with an operator's own."""
    return df.select(*[df[n] for n in names])
