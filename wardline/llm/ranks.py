"""Positions in a total order without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.scratch import Scratch


def with_index(scratch: Scratch, df: DataFrame, name: str, index: str, *order: Column) -> DataFrame:
    """Add ``index`` (0, 1, ...) in the order of ``order``.

    Range partitions are sorted by their own tasks; one row per partition
    gives the offsets.  Ties get some order of their own.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = scratch.write(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most n rows, one for each partition
    offsets = scratch.write(parts.groupBy("_part").agg(F.count("*").alias("_n"))
                            .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")),
                            f"{name}-offsets")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long") - 1
    return (parts.join(offsets, "_part").withColumn(index, F.col("_before") + inside)
            .drop("_part", "_before"))
