"""What the operators share: shipping code, cutting lineage, walking sorted groups."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PACKAGE = "tidemark"
#: Bytes of a batch that an operator's Python code gets at once, about.
BATCH_BYTES = 4 << 20
_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python
    workers can import it wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="ship-")
    with_code = os.path.join(folder, "code")
    shutil.copytree(os.path.join(root, PACKAGE), os.path.join(with_code, PACKAGE), ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(os.path.join(folder, PACKAGE), "zip", with_code)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED[app] = archive


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with the package shipped to the executors.  Batches of long texts are
    handed on in slices, and freed memory goes back when a task is done."""
    ship(df.sparkSession)
    names = df.columns
    if any(x in c for c in names for x in ".`"):  # Spark looks the columns up by name, where these have a meaning
        df = df.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(_slices(b.rename_columns(names) for b in batches))
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Memory that a task has freed goes back to the system, where its C library can do that: workers
    stay, and several operators use them in turn."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_BYTES at most; a longer row is a batch of its own."""
    for batch in batches:
        parts = min(-(-batch.nbytes // BATCH_BYTES), batch.num_rows)
        step = -(-batch.num_rows // max(parts, 1))
        if parts <= 1:
            yield batch
            continue
        for first in range(0, batch.num_rows, step):
            yield batch.slice(first, step)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that
    is unset and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Spark's setting that shuffle files go when the query that wrote them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind.  Only for a DataFrame that
    is run once: a second run would look for the files of the first."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; what is written there goes when the application ends."""
    path = f"{checkpoint_root(spark)}/{PACKAGE}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where)  # only what is there can be marked
    system.deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table below spark.checkpoint.dir and read it back: the
    lineage ends there, so a lost executor costs a re-read, not a re-run, and the shuffle
    files go.  The table goes when it is discarded or the application ends."""
    spark = df.sparkSession
    path = scratch(spark)
    with shuffles_end(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once all that is made of them has been written."""
    for df in tables:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def is_empty(df: DataFrame) -> bool:
    with shuffles_end(df.sparkSession):
        return not df.limit(1).collect()


def named(column: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(name: str, columns: list[str]) -> str:
    """name, or a longer one where columns has it (upper and lower case alike)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """k1 and k2: 128 bits that tell rows apart by id and text; a null is a value."""
    own, text = named(id_col), named(text_col)
    return [F.xxhash64(F.lit(k), own.isNull(), own, text.isNull(), text).alias(f"k{k}") for k in (1, 2)]


#: A key is hot from this share of the rows on; there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 1000


def join_of_keys(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, hint: str | None = None) -> DataFrame:
    """Inner join of rows with a table of one row for each key, whose column weight says how
    many rows the key has.  Rows of hot keys stay where they are and get theirs by broadcast
    (of under 1 / HOT_SHARE rows); all others meet by key, by the join that hint asks for, if any.  Both must be cut tables."""
    with shuffles_end(table.sparkSession):
        total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where(F.col(weight) > total * HOT_SHARE)
    if is_empty(hot):
        return rows.join(table.hint(hint) if hint else table, keys)
    by_share = rows.join(F.broadcast(hot), keys)
    rest = table.where(F.col(weight) <= total * HOT_SHARE)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest.hint(hint) if hint else rest, keys)
    return by_share.unionByName(others)


def boundaries(columns: list[np.ndarray]) -> np.ndarray:
    """Index of the first row of each run of equal keys."""
    n = len(columns[0])
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole runs of equal keys from key-sorted batches.

    A run of more than limit rows comes in parts of its own, each marked True: what a
    task holds stays bounded by limit and a batch, whatever one key's share is.
    """
    held: pa.Table | None = None
    over_key: list | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table, held = pa.concat_tables([held, table]), None
        starts = np.append(boundaries([table.column(k).to_numpy() for k in keys]), table.num_rows)
        first = 0
        if over_key is not None:
            if [table.column(k)[0].as_py() for k in keys] == over_key:
                yield table.slice(0, starts[1]), True
                first = 1
                if len(starts) == 2:
                    continue
            over_key = None
        ends = [int(k) for k in np.flatnonzero(np.diff(starts) > limit) if k >= first]
        last = len(starts) - 2
        for k in ends:
            if k > first:
                yield table.slice(starts[first], starts[k] - starts[first]), False
            yield table.slice(starts[k], starts[k + 1] - starts[k]), True
            first = k + 1
        if first > last:  # the open run is over the limit
            over_key = [table.column(k)[table.num_rows - 1].as_py() for k in keys]
            continue
        if last > first:
            yield table.slice(starts[first], starts[last] - starts[first]), False
        held = table.slice(starts[last])
    if held is not None:
        yield held, False
