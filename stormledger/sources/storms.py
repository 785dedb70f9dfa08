"""Storm catalogues: headerless text blocks and Parquet, as track points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

#: The text files' columns, in order.
COLUMNS = ("year", "month", "tc_number", "time_step", "basin_id", "lat", "lon", "p_c", "wind", "rmax", "category", "landfall", "distance")
REQUIRED = ("year", "track_id", "time_step", "lat", "lon", "p_c", "wind_max", "rmax")


def block_index(path: Column) -> Column:
    """The block that a file name tells (``..._1000_YEARS_<n>``); 0 where it tells none."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"_1000_YEARS_(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def read_storm_text(spark: SparkSession, paths: str | Sequence[str], basin_id: int | None = None, wind_unit: str = "m/s") -> DataFrame:
    """All blocks as one table: years run on through the blocks, tracks are numbered by block, year and number."""
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in COLUMNS])
    rows = spark.read.csv(list(paths) if not isinstance(paths, str) else paths, schema=schema, header=False, mode="PERMISSIVE").withColumn("block", block_index(F.input_file_name()))
    if basin_id is not None:
        rows = rows.where(F.col("basin_id") == basin_id)
    year = (F.col("year") + 1000 * F.col("block")).cast("long")
    track = F.concat_ws("-", "block", F.col("year").cast("long"), F.col("tc_number").cast("long"))
    return rows.select(
        year.alias("year"), track.alias("track_id"), F.col("time_step").cast("int").alias("time_step"), "lat", S.wrap_longitude(F.col("lon")).alias("lon"), "p_c", S.wind_mps(S.finite(F.col("wind")), wind_unit).alias("wind"), "rmax", F.col("category").cast("int").alias("category"), F.col("basin_id").cast("int").alias("basin_id")
    )


def read_storm_parquet(spark: SparkSession, path: str, basin_ids: Sequence[int] = ()) -> DataFrame:
    """Track points from Parquet; the basin filter reaches the scan. Missing columns are an error."""
    rows = spark.read.parquet(path)
    names = {c.strip().lower().replace(" ", "_"): c for c in rows.columns}
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    if basin_ids and "basin_id" in names:
        rows = rows.where(F.col(f"`{names['basin_id']}`").isin(*basin_ids))
    return rows.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])
