"""From an exposure to the result document in one call: sample points, find centroids and curves, run all components, tell the results."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curves as C
from ..functions import scalars as S
from ..lineage import settled
from . import geometry, impact, metrics, multihazard, production, sampling
from . import interdependency as dep

#: Metres between sample points, the most of them for a feature, degrees to a centroid, events listed for a hazard.
SPACING, MOST, REACH, TOP_EVENTS = 100.0, 300, 0.4, 20


@dataclass(frozen=True)
class Source:
    """A component's tables: ``hazard``, ``centroids`` (``centroid_id``, ``lat``, ``lon``), ``curves`` (``impf_id``, ``x``, ``y``), and a bin of the curves' axis."""

    hazard: DataFrame
    centroids: DataFrame
    curves: DataFrame
    width: float


@dataclass(frozen=True)
class Job:
    points: DataFrame
    run: production.Run
    components: DataFrame
    document: DataFrame


def _metric(positions: Column) -> Column:
    """Positions (lon, lat, ...) as (x, y) in metres."""

    def point(p: Column) -> Column:
        x, y = S.mercator(F.get(p, 0), F.get(p, 1))
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(positions, point)


def sampled(exposure: DataFrame, spacing: float = SPACING, most: int = MOST) -> DataFrame:
    """Sample points of features: ``point_id``, ``value`` and place beside the features' columns; a feature's value is split evenly.

    ``exposure`` has ``asset_id``, ``value_eur``, ``lat``, ``lon`` and perhaps ``geometry`` (GeoJSON text). Lines and areas are sampled in
    metres; what has no such geometry (or a degenerate one) is one point at its place. Without a place there's no point.
    """
    if "geometry" not in exposure.columns:
        exposure = exposure.withColumn("geometry", F.lit(None).cast("string"))
    rows = settled(exposure)
    kind, at = F.get_json_object("geometry", "$.type"), F.get_json_object("geometry", "$.coordinates")
    read = lambda depth: F.from_json(at, "array<" * depth + "double" + ">" * depth)
    rings = lambda polygon: F.transform(polygon, _metric)
    lines = rows.where(kind.isin("LineString", "MultiLineString")).select(F.col("asset_id").alias("feature_id"), F.when(kind == "LineString", F.array(_metric(read(2)))).otherwise(F.transform(read(3), _metric)).alias("paths"))
    lines = lines.withColumn("paths", F.filter("paths", lambda p: F.size(p) >= 2)).where("size(paths) > 0")
    areas = rows.where(kind.isin("Polygon", "MultiPolygon")).select(F.col("asset_id").alias("feature_id"), F.when(kind == "Polygon", F.array(rings(read(3)))).otherwise(F.transform(read(4), rings)).alias("polygons"))
    metric = settled(sampling.sample_multilines(lines, spacing, most).unionByName(geometry.sample_polygons(areas, spacing, most)))
    lon, lat = S.from_mercator(F.col("x"), F.col("y"))
    found = metric.select("feature_id", "k", lon.alias("lon"), lat.alias("lat"))
    others = rows.join(metric.select(F.col("feature_id").alias("asset_id")).distinct(), "asset_id", "left_anti").where("lat is not null and lon is not null")
    found = found.unionByName(others.select(F.col("asset_id").alias("feature_id"), F.lit(0).alias("k"), "lon", "lat"))
    features = rows.drop("lat", "lon", "geometry").withColumn("feature_id", F.col("asset_id")).withColumnRenamed("value_eur", "value")
    return sampling.explode_points(features, found)


def placed(points: DataFrame, sources: Mapping[str, Source], flood: DataFrame, reach: float = REACH) -> DataFrame:
    """Points with territory, class, and for each component the curve's id and the nearest centroid within reach."""
    points = C.assign_curves(points, flood)
    for name, source in sources.items():
        near = impact.assign_centroids(points.select("point_id", "lat", "lon"), source.centroids, reach, reach)
        points = points.join(near.select("point_id", F.col("centroid_id").alias(f"{name}_at")), "point_id")
    shape = F.col("geometry_type") if "geometry_type" in points.columns else F.lit("Point")
    return points.withColumn("territory", S.territory_cell(F.col("lat"), F.col("lon"))).withColumn("infra_class", S.infra_class(F.col("exposure_category"), F.col("asset_type"), shape))


def document(run: production.Run, components: DataFrame, points: DataFrame, run_id: str, label: str, notes: list[str]) -> DataFrame:
    """The result document: rows of ``part``, ``at`` and ``json``, all written by Spark.

    Beside the run's own parts: a summary of the exposure, results by asset, risk by component, health by class, what depends on
    electricity, the largest events of each hazard, and notes.
    """
    out = production.document(run, run_id, label)
    summary = points.agg(F.countDistinct("asset_id").alias("asset_count_original"), F.count("*").alias("asset_count_points"), F.coalesce(F.round(impact.money_sum(F.greatest(F.lit(0.0), F.col("value"))), 2), F.lit(0.0)).alias("total_exposure_eur"))
    events = metrics.top_events(run.events, TOP_EVENTS, ("hazard",)).withColumn("at", F.concat_ws("|", "hazard", F.lpad(F.col("rank").cast("string"), 4, "0")))
    assets = dep.asset_results(run.points).withColumn("at", F.concat_ws("|", "hazard", "asset_id"))
    health = dep.component_health(run.points).withColumn("at", F.concat_ws("|", "hazard", "infra_class"))
    parts = {"exposure_summary": summary.withColumn("at", F.lit("")), "asset_results": assets, "components": components.withColumn("at", F.concat_ws("|", "hazard", "component")), "component_health": health, "interdependency": dep.dependent_assets(run.points).withColumn("at", F.col("hazard")), "event_summary": events}
    for name, df in parts.items():
        own = [c for c in df.columns if c != "at"]
        out = out.unionAll(df.select(F.lit(name).alias("part"), "at", F.to_json(F.struct(*own)).alias("json")))
    told = points.sparkSession.createDataFrame([("notes", f"{i:04d}", n) for i, n in enumerate(notes)], "part string, at string, json string")
    return out.unionAll(told.withColumn("json", F.to_json(F.struct(F.col("json").alias("note")))))


def run_job(exposure: DataFrame, sources: Mapping[str, Source], flood: DataFrame, run_id: str, label: str, spacing: float = SPACING, most: int = MOST, reach: float = REACH, capped: bool = False) -> Job:
    """The whole job over an accepted exposure. ``flood`` are numbered flood curves; ``sources`` have any of the components wind, rain and surge."""
    points = settled(placed(sampled(exposure, spacing, most), sources, flood, reach))
    parts = {n: multihazard.Component(s.hazard, s.curves, f"{n}_at", f"{n}_id", s.width) for n, s in sources.items()}
    run, components = production.run_components(points, parts, capped)
    notes = [f"components: {', '.join(c for c in multihazard.COMPONENTS if c in sources)}", "water depends on electricity: its own territory's, else the nearest, else all", "annual impacts stay within the exposure"]
    return Job(points, run, components, document(run, components, points, run_id, label, notes))
