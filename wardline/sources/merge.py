"""Copy-on-write tables: an upsert or backfill rewrites only the files it touches (§2.1 S5, S7).

The table is a list of Parquet files in a manifest.  A change finds the files
that hold one of its keys (``_metadata.file_path`` of a semi join on the key
columns alone), rewrites those into new files together with the rows of new
keys, and publishes a manifest with the untouched files and the new ones.  The
manifest is the last thing written, under a name that only one writer can
create, so readers see a change whole or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators import tables
from wardline.sources.snapshots import Manifests


class MergeTable:
    """A table of files below ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.manifests = Manifests(spark, self.root, {"files": []})

    def files(self) -> list[str]:
        """Paths of the table's files, below ``root``."""
        return self.manifests.read()[1]["files"]

    def _scan(self, files: Sequence[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in files])

    def read(self) -> DataFrame:
        return self._scan(self.files())

    def _write(self, rows: DataFrame) -> list[str]:
        tag = uuid.uuid4().hex
        rows.select(*self.schema.names).write.parquet(f"{self.root}/data/{tag}")
        return [f"data/{tag}/{n}" for n in self.manifests.list("data", tag) if n.endswith(".parquet")]

    def _publish(self, version: int, files: Sequence[str]) -> None:
        self.manifests.publish(version + 1, {"files": sorted(files)})

    def create(self, rows: DataFrame) -> None:
        """The table's first rows (or all of them anew)."""
        version, _ = self.manifests.read()
        self._publish(version, self._write(rows))

    def touched(self, changes: DataFrame, keys: Sequence[str]) -> list[str]:
        """Files that hold a key of ``changes``; at most the table's files."""
        files = self.files()
        if not files:
            return []
        held = self._scan(files).select(*keys, F.col("_metadata.file_path").alias("_file"))
        hit = held.join(changes.select(*keys).distinct(), list(keys), "left_semi").select("_file").distinct().collect()
        names = {r[0].rsplit("/data/", 1)[1] for r in hit}
        return [f for f in files if f.split("data/", 1)[1] in names]

    def _replace(self, touched: Sequence[str], rows: DataFrame) -> None:
        version, content = self.manifests.read()
        kept = [f for f in content["files"] if f not in set(touched)]
        self._publish(version, kept + self._write(rows))

    def upsert(self, updates: DataFrame, keys: Sequence[str], update_cols: Sequence[str], order_col: str) -> list[str]:
        """``tables.upsert`` on the touched files; returns those files."""
        touched = self.touched(updates, keys)
        self._replace(touched, tables.upsert(self._scan(touched), updates, keys, update_cols, order_col))
        return touched

    def backfill(self, values: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> list[str]:
        """``tables.backfill`` on the touched files; returns those files."""
        touched = self.touched(values, keys)
        if touched:
            self._replace(touched, tables.backfill(self._scan(touched), values, keys, cols))
        return touched
