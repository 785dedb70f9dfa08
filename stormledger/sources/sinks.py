"""Results as files: CSV, JSON, GeoJSON rows; all written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

PREVIEW = 5000


def ranked_events(events: DataFrame) -> DataFrame:
    """Top events of all hazards with their rank, as the event summary lists them."""
    rank = F.row_number().over(Window.partitionBy("hazard").orderBy(F.desc("loss"), "event_id"))
    return events.select("hazard", rank.alias("rank"), "event_id", F.round("loss", 2).alias("loss_eur"), "frequency")


def feature(point: str = "Point", **properties: Column) -> Column:
    """A GeoJSON point feature as text, from columns lon and lat."""
    shape = F.struct(F.lit(point).alias("type"), F.array("lon", "lat").alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")))


def preview(exposure: DataFrame, most: int = PREVIEW, observed: Observation | None = None) -> DataFrame:
    """The first features that have a place, by id, as GeoJSON; a preview is a bounded listing.

    ``observed`` tells, once the preview has been read, the ``total`` of such features, how many were left out for want of a place
    (``placeless``) and whether the listing was ``truncated``: all from the same run.
    """
    rows = exposure.withColumn("__there", F.col("lon").isNotNull() & F.col("lat").isNotNull())
    if observed is not None:
        total = F.count_if("__there")
        rows = rows.observe(observed, total.alias("total"), F.count_if(~F.col("__there")).alias("placeless"), (total > most).alias("truncated"))
    rows = rows.where("__there").orderBy("asset_id").limit(most)
    return rows.select("asset_id", feature(asset_id=F.col("asset_id"), value_eur=F.col("value_eur")).alias("feature"))


def result_json(territories: DataFrame, portfolio: DataFrame) -> DataFrame:
    """The result document's tables as JSON text, one row for each territory or portfolio row."""
    a = territories.select(F.lit("territory_results").alias("part"), F.to_json(F.struct("*")).alias("json"))
    return a.unionAll(portfolio.select(F.lit("portfolio_results").alias("part"), F.to_json(F.struct("*")).alias("json")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_split(df: DataFrame, path: str, by: str) -> None:
    """A folder of Parquet for each value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def append_journal(df: DataFrame, path: str) -> None:
    """Run entries, appended as JSON lines."""
    df.write.mode("append").json(path)
