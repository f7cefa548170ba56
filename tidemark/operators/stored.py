"""Tables in partition folders whose writes are staged and then swapped in.

A write touches some partitions. Their new content is staged beside the table as a Spark job; a
file that lists the touched folders says that it is whole; then the folders are swapped in by
renames. A job that fails while it stages leaves the old table, and recover(), which each write and
open() begin with, finishes a swap that was broken off and deletes what was staged in part. There is one
writer at a time; partitions that a write doesn't touch are neither read nor written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import upsert

READY = "_touched.json"


class StoredTable:
    """A Parquet table below path, in a folder for each value of column by, with unique keys."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str, keys: Sequence[str]):
        self.spark, self.path, self.by, self.keys = spark, path.rstrip("/"), by, list(keys)
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.recover()

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def _folders(self, path: str, prefix: str) -> list[str]:
        if not self._fs.exists(self._at(path)):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(path)) if x.isDirectory() and x.getPath().getName().startswith(prefix))

    def read(self) -> DataFrame:
        """The table as it is now."""
        if not self._folders(self.path, f"{self.by}="):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    # writes

    def replace(self, new: DataFrame, order: Sequence[Column] | None = None) -> None:
        """new's rows, and the table's of other keys."""
        self._merge(new, lambda old: upsert.replace(old, new.select(*old.columns), self.keys, order))

    def insert_ignore(self, new: DataFrame, order: Sequence[Column]) -> None:
        """The table's rows, and new's of other keys."""
        self._merge(new, lambda old: upsert.insert_ignore(old, new.select(*old.columns), self.keys, order))

    def update(self, delta: DataFrame) -> None:
        """Columns of delta, where they have a value, in the rows of its keys; by is one of the keys."""
        self._merge(delta, lambda old: upsert.coalesce_update(old, delta, self.keys))

    def append(self, rows: DataFrame) -> None:
        """rows as they are, whatever keys they have: for logs."""
        self._merge(rows, lambda old: old.unionByName(rows.select(*old.columns)))

    def overwrite(self, value: str, rows: DataFrame) -> None:
        """rows in place of the partition with that value of by, a text; it goes where there are none."""
        self.recover()
        self._write(rows.where(F.col(self.by) == value), [f"{self.by}={value}"])

    def delete(self, *conditions: Column) -> None:
        """The table without the rows that meet any condition; an unknown one deletes nothing."""
        gone = F.lit(False)
        for c in conditions:
            gone = gone | F.coalesce(c, F.lit(False))
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder")
        if not self._folders(self.path, f"{self.by}="):
            return
        touched = [r.folder for r in self.read().where(gone).select(folder).distinct().collect()]  # partition names
        values = self.read().where(gone).select(self.by).distinct()
        self._write(upsert.delete_where(self._within(values), *conditions), touched)

    def _within(self, values: DataFrame) -> DataFrame:
        """The rows of the partitions named in values."""
        old, wanted = self.read(), values.select(F.col(self.by).alias("touched value")).distinct()
        return old.join(wanted, old[self.by].eqNullSafe(wanted["touched value"]), "left_semi")

    def _merge(self, new: DataFrame, made: Callable[[DataFrame], DataFrame]) -> None:
        self.recover()
        self._write(made(self._within(new)), [])

    # staging

    def _write(self, content: DataFrame, touched: Iterable[str]) -> None:
        stage = self._stage(content, touched)
        self._swap(stage)

    def _stage(self, content: DataFrame, touched: Iterable[str]) -> str:
        stage = f"{self.path}.stage-{uuid.uuid4().hex}"
        content.select(*self.schema.names).write.partitionBy(self.by).parquet(stage)
        folders = sorted({*touched, *self._folders(stage, f"{self.by}=")})
        out = self._fs.create(self._at(stage, READY + ".part"))
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        self._fs.rename(self._at(stage, READY + ".part"), self._at(stage, READY))
        return stage

    def _swap(self, stage: str) -> None:
        """Each touched folder is replaced by the staged one, or goes; may be done again from any point."""
        stream = self._fs.open(self._at(stage, READY))
        folders = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        self._fs.mkdirs(self._at(self.path))
        for folder in folders:
            new, old, aside = self._at(stage, folder), self._at(self.path, folder), self._at(stage, f".old-{folder}")
            # a folder that was put aside is dealt with but for the staged one's move
            if self._fs.exists(old) and not self._fs.exists(aside):
                self._rename(old, aside)
            if self._fs.exists(new):
                self._rename(new, old)
            self._fs.mkdirs(aside)  # a folder that wasn't there before counts as put aside too
        self._fs.delete(self._at(stage), True)

    def _rename(self, old, new) -> None:
        if not self._fs.rename(old, new):
            raise OSError(f"{old} could not be renamed to {new}")

    def recover(self) -> None:
        """Finish the swaps that were broken off; delete what was staged in part."""
        parent, _, name = self.path.rpartition("/")
        for folder in self._folders(parent, f"{name}.stage-"):
            stage = f"{parent}/{folder}"
            if self._fs.exists(self._at(stage, READY)):
                self._swap(stage)
            else:
                self._fs.delete(self._at(stage), True)
