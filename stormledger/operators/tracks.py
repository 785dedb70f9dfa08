"""Storm tracks: windows around exposure, selection, time steps, attributes, basins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

HOURS_PER_STEP, LEAST_PRESSURE = 3, 1010.0


def spatial_window(points: DataFrame, padding: float = 4.0) -> DataFrame:
    """One row: the points' box widened by ``padding`` degrees, within the globe; all longitudes where it's over 180 wide."""
    box = points.agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")])
    wide = F.col("max_lon") - F.col("min_lon") + 2 * padding > 180
    return box.select(
        F.greatest(F.lit(-90.0), F.col("min_lat") - padding).alias("lat_min"),
        F.least(F.lit(90.0), F.col("max_lat") + padding).alias("lat_max"),
        F.when(wide, -180.0).otherwise(F.greatest(F.lit(-180.0), F.col("min_lon") - padding)).alias("lon_min"),
        F.when(wide, 180.0).otherwise(F.least(F.lit(180.0), F.col("max_lon") + padding)).alias("lon_max"),
    )


def within_window(tracks: DataFrame, window: DataFrame) -> DataFrame:
    """Track points inside a one-row window."""
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & S.longitude_within(S.wrap_longitude(F.col("lon")), F.col("lon_min"), F.col("lon_max"))
    return tracks.join(F.broadcast(window), inside).select(*tracks.columns)


def _squared_distance(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    gap = F.abs(lon - lon0)
    gap = F.least(gap, F.lit(360.0) - gap)
    return (lat - lat0) * (lat - lat0) + gap * gap


def nearest_tracks(tracks: DataFrame, lat0: float, lon0: float, most: int) -> DataFrame:
    """All points of the ``most`` tracks that come closest to a place, in squared degrees; ties go to the smaller id."""
    distance = F.min(_squared_distance(F.col("lat"), F.col("lon"), F.lit(lat0), F.lit(lon0))).alias("d2")
    kept = tracks.groupBy("track_id").agg(distance).orderBy("d2", "track_id").limit(most)
    return tracks.join(F.broadcast(kept.select("track_id", "d2")), "track_id")  # ``most`` rows


def first_per_step(tracks: DataFrame, tie: str) -> DataFrame:
    """One point for each (track, step): the one with the smallest ``tie``."""
    over = Window.partitionBy("track_id", "time_step").orderBy(tie)
    return tracks.withColumn("__n", F.row_number().over(over)).where("__n = 1").drop("__n")


def timed(tracks: DataFrame, hours: int = HOURS_PER_STEP) -> DataFrame:
    """Hours since the point before (``step_h``) and since 2000-01-01 (``elapsed_h``, ``at``).

    Steps that don't advance count as one; the first takes the second's length.
    """
    order = Window.partitionBy("track_id").orderBy("time_step")
    step = F.col("time_step").cast("double") - F.lag("time_step").over(order)
    length = lambda c: F.when(c.isNull() | F.isnan(c) | (c <= 0), 1.0).otherwise(c)
    rows = tracks.withColumn("__s", step).withColumn("__first", F.col("__s").isNull())
    rows = rows.withColumn("__next", F.lead("__s").over(order))
    rows = rows.withColumn("step_h", F.when(F.col("__first"), length(F.col("__next"))).otherwise(length(F.col("__s"))) * hours)
    running = F.sum(F.when(F.col("__first"), 0.0).otherwise(F.col("step_h"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("elapsed_h", running)
    return rows.withColumn("at", F.timestamp_seconds(F.lit(946684800) + F.col("elapsed_h") * 3600)).drop("__s", "__first", "__next")


def attributes(tracks: DataFrame) -> DataFrame:
    """Of each track: first year, highest category, points, largest wind, lowest ambient pressure."""
    ambient = F.greatest(F.col("p_c") + 5.0, F.lit(LEAST_PRESSURE))
    return tracks.groupBy("track_id").agg(F.min_by("year", "time_step").alias("year"), F.max("category").alias("category"), F.count("*").alias("n_points"), F.max("wind").alias("max_wind"), F.min(ambient).alias("ambient_pressure"))


def basins_of(points: DataFrame, basins: DataFrame) -> DataFrame:
    """Ids of basins that hold any of the points; all basins where none does; the first where there are no points.

    ``basins`` is a small dimension: a box for each.
    """
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & S.longitude_within(S.wrap_longitude(F.col("lon")), F.col("lon_min"), F.col("lon_max"))
    hits = points.select("lat", "lon").join(F.broadcast(basins), inside).select("basin_id").distinct()
    counts = points.select(F.lit(1).alias("x")).limit(1).agg(F.count("*").alias("points"))
    n = hits.agg(F.count("*").alias("hits"))
    flags = basins.join(hits.withColumn("hit", F.lit(True)), "basin_id", "left").crossJoin(counts).crossJoin(n)
    first = F.col("basin_id") == F.min("basin_id").over(Window.partitionBy())
    keep = F.when(F.col("points") == 0, first).when(F.col("hits") == 0, True).otherwise(F.coalesce("hit", F.lit(False)))
    return flags.withColumn("keep", keep).where("keep").select("basin_id")


def outside_coverage(features: DataFrame, zones: DataFrame) -> DataFrame:
    """Features whose box meets no zone; without zones none is outside. ``zones`` is a small dimension."""
    apart = (F.col("lon_max") < F.col("z_lon_min")) | (F.col("lon_min") > F.col("z_lon_max")) | (F.col("lat_max") < F.col("z_lat_min")) | (F.col("lat_min") > F.col("z_lat_max"))
    zone = zones.select(*[F.col(c).alias(f"z_{c}") for c in ("lat_min", "lat_max", "lon_min", "lon_max")])
    any_zone = zones.agg((F.count("*") > 0).alias("__any"))
    out = features.join(F.broadcast(zone), ~apart, "left_anti")
    return out.crossJoin(F.broadcast(any_zone)).where("__any").drop("__any")


def overlap_share(current: DataFrame, previous: DataFrame, key: str = "track_id") -> DataFrame:
    """Percent of the current distinct ids that the previous have too, to two decimals; null where either is empty."""
    a, b = current.select(key).where(F.col(key).isNotNull()).distinct(), previous.select(key).where(F.col(key).isNotNull()).distinct()
    both = a.join(b.withColumn("there", F.lit(1)), key, "left").agg(F.count("*").alias("n"), F.count("there").alias("common"))
    size = b.agg(F.count("*").alias("n_previous"))
    share = F.when((F.col("n") > 0) & (F.col("n_previous") > 0), F.round(F.col("common") / F.col("n") * 100, 2))
    return both.crossJoin(size).select("n", "n_previous", "common", share.alias("overlap_pct"))
