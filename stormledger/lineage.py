"""Cutting long plans: an intermediate table of known use is written once to the shared folder and continued from there."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only local sessions may leave that unset; they get one of their own."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="stormledger-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed and kept in the shared folder, so that neither planning nor a lost executor goes back behind it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Shuffle files of a table that is settled go when that is done: what is built under it must not be run twice unless it is settled.
SHUFFLES_REMOVED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Joins by several keys take tables as they are dealt out by one of them.
DEALT_BY_ONE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def settings(spark: SparkSession, of: dict[str, str]) -> Iterator[None]:
    """Settings that hold within, for what is settled there."""
    before = {k: spark.conf.get(k, None) for k in of}
    for k, v in of.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
