"""Catalogues built block by block: a run that was cut off goes on where it stopped, and a block is replaced as a whole.

A block's rows are one partition of the table. A line in the manifest says that a block is finished; readers take finished
blocks alone, so a half-written one is never seen, and asking for some blocks reads those alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import tracks

ROWS, MANIFEST = "rows", "manifest"


def finished(spark: SparkSession, path: str, block: str) -> DataFrame:
    """``block`` and its number of rows, for each finished block; the last entry of a block holds."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{block} string, n long")
    entries = spark.read.schema(f"{block} string, n long, at timestamp").json(f"{path}/{MANIFEST}")
    return entries.groupBy(block).agg(F.max_by("n", "at").alias("n"))


def build_blocks(source: DataFrame, path: str, block: str, build: Callable[[DataFrame], DataFrame], blocks: Iterable | None = None, at_once: int = 1, again: bool = False) -> list:
    """Builds the blocks of ``source`` that aren't finished (with ``again``: all) and tells which those were.

    ``build`` turns the rows of ``at_once`` blocks into a table that still has the column ``block``. Each such group is written on its own and
    noted, so what runs at a time is bounded and what is done stays done. ``blocks`` names them; else they're read from the source.
    """
    spark = source.sparkSession
    names = [r[0] for r in source.select(block).where(F.col(block).isNotNull()).distinct().orderBy(block).collect()] if blocks is None else list(blocks)
    done = set() if again else {r[0] for r in finished(spark, path, block).collect()}
    todo = [b for b in names if str(b) not in done]
    for k in range(0, len(todo), at_once):
        group = todo[k : k + at_once]
        built = build(source.where(F.col(block).isin(*group)))
        built.write.partitionBy(block).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{ROWS}")
        schema = T.StructType([f for f in built.schema if f.name != block] + [built.schema[block]])
        counts = spark.read.schema(schema).parquet(f"{path}/{ROWS}").where(F.col(block).isin(*group)).groupBy(block).agg(F.count("*").alias("n"))
        every = spark.createDataFrame([(b,) for b in group], T.StructType([source.schema[block]])).join(counts, block, "left")
        every.select(F.col(block).cast("string").alias(block), F.coalesce("n", F.lit(0)).alias("n"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(f"{path}/{MANIFEST}")
    return todo


def read_blocks(spark: SparkSession, path: str, block: str, blocks: Iterable | None = None) -> DataFrame:
    """All finished blocks as one table, or the given ones; the others aren't read."""
    done = [r[0] for r in finished(spark, path, block).where("n > 0").collect()]
    wanted = done if blocks is None else [b for b in map(str, blocks) if b in set(done)]
    rows = spark.read.parquet(f"{path}/{ROWS}")
    return rows.where(F.col(block).cast("string").isin(*wanted)) if wanted else rows.where("false")


def build_tracks(points: DataFrame, path: str, block: str = "dataset_id", basin_id: int | None = None, at_once: int = 1) -> list:
    """A catalogue of tracks by block: points of one basin, one for each step, with lagged step lengths and elapsed time. Blocks may number their tracks alike."""
    if basin_id is not None:
        points = points.where(F.col("basin_id") == basin_id)

    def build(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("track_id", F.struct(F.col(block).alias("block"), F.col("track_id").alias("track")))
        return tracks.timed(tracks.first_per_step(rows, "event_id")).withColumn("track_id", F.col("track_id.track"))

    return build_blocks(points, path, block, build, at_once=at_once)
