"""What the operators share: reading a table, cutting lineage, shared folders, batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are held as Python objects at once.
SLICE_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where unset, in local mode alone, a new local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stormledger-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, as a URI; made by who writes to it."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends, not when the driver happens to collect its garbage. Meant for queries that are cut: what is built here must not be run twice."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: unlike a checkpoint's, its size is known to Spark, which then broadcasts it only below its own bound."""
    out = fresh_dir(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.parquet(out)


def numbered(docs: DataFrame, **extra: Column) -> DataFrame:
    """``docs`` with an identity for each row, written to the shared folder and read again: ``row`` (long) and ``doc`` (all of its columns), and ``extra`` columns.

    Ids may repeat or be null, so what has to be said of a row is said of its ``row``. Nested, no column's name clashes.
    """
    more = [c.alias(n) for n, c in extra.items()]
    return table(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), *more), "numbered")


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by sorting (numpy's own way is by hashing, and slower)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of few rows: bounds the Python objects that a task holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(column: pa.Array) -> list[str]:
    """A string column as Python strings; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]
