"""Table maintenance operators (§2.1 S4-S9, S12).

The reference changes tables in place (ALTER, INSERT ... ON DUPLICATE KEY
UPDATE, INSERT ... WHERE NOT EXISTS, UPDATE, DELETE).  On Spark a table
version is a DataFrame: each operator returns the next version, and writes
replace whole ``queue_date`` partitions (dynamic partition overwrite), so a
rerun of a day is idempotent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def harmonize(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Project ``df`` onto ``schema``: missing columns become the default
    (or NULL), present ones are cast; extra columns are dropped."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        else:
            c = F.lit(defaults.get(f.name)).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], update_cols: Sequence[str],
           order_col: str) -> DataFrame:
    """``INSERT ... ON DUPLICATE KEY UPDATE`` for a batch of rows.

    Listed columns take the last update row per key (by ``order_col``);
    other columns keep the base value, or the first update row's value for
    a new key.  One aggregation of the updates and one full outer join.
    """
    keys, update_cols = list(keys), list(update_cols)
    other = [c for c in base.columns if c not in keys and c not in update_cols]
    agg = updates.groupBy(*keys).agg(
        F.max_by(F.struct(*update_cols), order_col).alias("_last"),
        F.min_by(F.struct(*[c for c in other if c in updates.columns]), order_col).alias("_first"))
    b = base.withColumn("_in_base", F.lit(True))
    j = b.join(agg.withColumn("_in_upd", F.lit(True)), keys, "full")
    out = [F.col(k) for k in keys]
    for c in base.columns:
        if c in keys:
            continue
        if c in update_cols:
            out.append(F.when(F.col("_in_upd"), F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c))
        elif c in updates.columns:
            out.append(F.when(F.col("_in_base"), F.col(c)).otherwise(F.col(f"_first.{c}")).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def insert_absent(base: DataFrame, new: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """``INSERT ... SELECT ... WHERE NOT EXISTS``: rows of ``new`` whose key
    is absent from ``base`` (first row per key), appended with a source tag."""
    keys = list(keys)
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in new.columns if c not in keys]),
                                            order_col).alias("_r")).select(*keys, "_r.*")
    add = first.join(base.select(*keys), keys, "left_anti")
    cols = base.columns
    return base.withColumn("source", F.lit("base")).unionByName(
        add.select(*[c for c in cols if c in add.columns]).withColumn("source", F.lit("inserted")),
        allowMissingColumns=True)


def backfill(base: DataFrame, values: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``UPDATE t SET c = v WHERE key = k`` for a table of (key, values)."""
    v = values.select(*keys, *[F.col(c).alias(f"_v_{c}") for c in cols])
    j = base.join(v, list(keys), "left")
    return j.select(*[F.coalesce(F.col(f"_v_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in base.columns])


def reset_bookings(bookings: DataFrame, day) -> DataFrame:
    """Every booking of ``day`` back to 'booked' (the manual re-test reset)."""
    return bookings.withColumn("status", F.when(F.col("appointment_date") == F.lit(day).cast("date"),
                                                F.lit("booked")).otherwise(F.col("status")))


def replace_days(df: DataFrame, path: str, day_col: str = "queue_date", days: Sequence = ()) -> None:
    """Write ``df`` replacing the ``day_col`` partitions it holds, and
    remove those of ``days`` for which it has no row."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
      .partitionBy(day_col).parquet(path)
    if days:
        held = {r[0] for r in df.select(day_col).distinct().collect()}  # at most the days written
        delete_days(df.sparkSession, path, [d for d in days if d not in held], day_col)


def delete_days(spark: SparkSession, path: str, days: Sequence, day_col: str = "queue_date") -> None:
    """Remove the partitions of ``days`` (``DELETE ... WHERE day IN (...)``); missing ones are fine."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for day in days:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"{day_col}={day}"), True)


def to_response(df: DataFrame, cols=None, name: str = "response") -> DataFrame:
    """One JSON document per row (``json_encode`` of the endpoint)."""
    cols = cols or df.columns
    return df.select(F.to_json(F.struct(*cols)).alias(name))


def grouped_response(df: DataFrame, keys: Sequence[str], order_col: str, cols: Sequence[str],
                     name: str = "queue") -> DataFrame:
    """S11 for bounded groups (e.g. the five-row neighbourhood): the rows of a
    group as an ordered JSON array.  Only for groups with a size bound --
    ``collect_list`` puts a whole group in one row."""
    item = F.struct(F.col(order_col).alias("_o"), F.struct(*cols).alias("_v"))
    agg = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return agg.select(*keys, F.to_json(F.transform("_items", lambda x: x["_v"])).alias(name))
