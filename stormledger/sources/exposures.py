"""Exposure ingest: CSV, GeoJSON, drawn features, by suffix; rows are checked and errors are reported together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..lineage import settled
from . import geojson

MOST_ERRORS = 16
DRAWN_VALUE = 1_000_000.0
SUFFIXES = (".csv", ".geojson", ".json", ".xlsx", ".gpkg")


class InputError(ValueError):
    """The input doesn't hold what was asked for."""


def _header(columns: list[str], wanted: str | None, *aliases: str) -> str | None:
    """The column of that name, whatever its case, else the first alias there is."""
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[a] for a in (wanted, *aliases) if a and a.lower() in by_name), None)


def wkt_centre(wkt: Column) -> tuple[Column, Column]:
    """The middle of a WKT geometry's box: longitude, latitude; null where the text has no coordinates."""
    pairs = F.regexp_extract_all(F.coalesce(wkt, F.lit("")), F.lit(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s+(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), F.lit(0))
    part = lambda i: F.transform(pairs, lambda p: F.split(p, r"\s+")[i].try_cast("double"))
    mid = lambda a: (F.array_min(a) + F.array_max(a)) / 2
    return mid(part(0)), mid(part(1))


def checked(rows: DataFrame) -> DataFrame:
    """Rows with their first ``error`` (null if there is none): value, coordinates, asset type, category."""
    lon, lat = wkt_centre(F.col("geometry_wkt"))
    out = rows.withColumn("value_eur", S.checked_number(F.col("raw_value"))).withColumn("lat", F.coalesce(S.checked_number(F.col("raw_lat")), lat)).withColumn("lon", F.coalesce(S.checked_number(F.col("raw_lon")), lon))
    kind, group = S.asset_type(F.col("raw_asset_type"), strict=True), S.alias(F.col("raw_category"), S.CATEGORY_ALIASES)
    blank = S.token(F.col("raw_category")) == ""
    out = out.withColumn("asset_type", kind).withColumn("exposure_category", F.when(blank, "habitation").otherwise(group))
    error = (
        F.when(F.col("value_eur").isNull(), F.concat(F.lit("row "), F.col("row"), F.lit(": value isn't a finite number")))
        .when(F.col("lat").isNull() | F.col("lon").isNull(), F.concat(F.lit("row "), F.col("row"), F.lit(": no coordinates")))
        .when(F.col("asset_type").isNull(), F.concat(F.lit("row "), F.col("row"), F.lit(": unknown asset type")))
        .when(F.col("exposure_category").isNull(), F.concat(F.lit("row "), F.col("row"), F.lit(": unknown category")))
    )
    return out.withColumn("error", error)


def accept(rows: DataFrame) -> DataFrame:
    """The checked rows; if any has an error, the first ones are raised together and none is taken."""
    rows = settled(rows)  # read once for the check and once for what follows
    errors = [r.error for r in rows.where("error is not null").orderBy("row").select("error").limit(MOST_ERRORS).collect()]
    if errors:
        raise InputError("; ".join(errors))
    return rows.drop("row", "error", *[c for c in rows.columns if c.startswith("raw_")])


def read_csv(spark: SparkSession, path: str, fields: Mapping[str, str] | None = None) -> DataFrame:
    """A CSV with headers in any case: value_eur, asset_type, and lat/lon or geometry_wkt; ids and labels default to rows.

    Rows are numbered in the order of the file, which is read as one text: such uploads are small.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, encoding="UTF-8")
    names = {c: c.lstrip("﻿") for c in raw.columns}
    raw = raw.toDF(*names.values())
    asked = dict(fields or {})
    find = lambda k, *more: _header(raw.columns, asked.get(k), k, *more)
    value, asset = find("value_eur", "value"), find("asset_type")
    if not value or not asset:
        raise InputError("value_eur and asset_type are required columns")
    col = lambda name: F.col(f"`{name}`") if name else F.lit(None).cast("string")
    rows = raw.withColumn("row", F.monotonically_increasing_id() + 1)
    number = F.col("row").cast("string")
    return rows.select(
        "row",
        F.coalesce(col(find("asset_id", "id")), number).alias("asset_id"),
        F.coalesce(col(find("label", "name")), F.concat(F.lit("Row "), number)).alias("label"),
        col(asset).alias("raw_asset_type"),
        col(find("exposure_category", "category")).alias("raw_category"),
        col(value).alias("raw_value"),
        col(find("lat", "latitude")).alias("raw_lat"),
        col(find("lon", "lng", "longitude")).alias("raw_lon"),
        col(find("geometry_wkt", "wkt")).alias("geometry_wkt"),
    )


def read_geojson(spark: SparkSession, path: str, value_field: str = "value_eur", default_value: float | None = None) -> DataFrame:
    """A FeatureCollection: one row a feature with its properties as text and its box's middle as place.

    Features without the value take ``default_value``; without that they're an error, as is an empty collection.
    """
    text = spark.read.text(path, wholetext=True)
    kind = text.select(F.get_json_object("value", "$.type").alias("t")).first()
    if kind is None or kind.t != "FeatureCollection":
        raise InputError("a FeatureCollection is asked for")
    features = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("k", "f"))
    return accept(features_table(features, value_field, default_value))


def read_geojson_lines(spark: SparkSession, path: str, value_field: str = "value_eur", default_value: float | None = None) -> DataFrame:
    """A feature to a line, for collections that are too large for one text: files are split and read by many tasks.

    Errors name features by their line's place in the reading, which is the file's order for one file.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("k"), F.col("value").alias("f"))
    return accept(features_table(lines, value_field, default_value))


def features_table(features: DataFrame, value_field: str = "value_eur", default_value: float | None = None) -> DataFrame:
    """Rows of GeoJSON features (``k``, ``f``: JSON text) as exposure, with their ``row`` and first ``error``: no geometry, no finite value."""
    prop = lambda name: F.get_json_object("f", f"$.properties.{name}")
    features = features.withColumn("__box", geojson.box(F.get_json_object("f", "$.geometry")))
    out = features.select(
        (F.col("k") + 1).alias("row"),
        F.coalesce(prop("asset_id"), prop("id"), (F.col("k") + 1).cast("string")).alias("asset_id"),
        F.coalesce(prop("label"), prop("name"), F.concat(F.lit("Feature "), F.col("k") + 1)).alias("label"),
        F.get_json_object("f", "$.geometry.type").alias("geometry_type"),
        F.get_json_object("f", "$.geometry").alias("geometry"),
        S.asset_type(prop("asset_type")).alias("asset_type"),
        S.category(prop("exposure_category")).alias("exposure_category"),
        F.coalesce(S.checked_number(prop(value_field)), F.lit(default_value).cast("double")).alias("value_eur"),
        "__box.*",
    )
    out = out.withColumn("lon", (F.col("lon_min") + F.col("lon_max")) / 2).withColumn("lat", (F.col("lat_min") + F.col("lat_max")) / 2)
    number = F.concat(F.lit("feature "), F.col("row"))
    return out.withColumn("error", F.when(F.col("lon").isNull(), F.concat(number, F.lit(": no geometry with coordinates"))).when(F.col("value_eur").isNull(), F.concat(number, F.lit(": value isn't a finite number"))))


def read_drawn(spark: SparkSession, text: str) -> DataFrame:
    """Drawn features, as a FeatureCollection's text; without a value they're worth DRAWN_VALUE."""
    one = spark.createDataFrame([(text,)], "value string")
    return accept(features_table(one.select(F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("k", "f")), default_value=DRAWN_VALUE))


def read_exposure(spark: SparkSession, path: str, **options) -> DataFrame:
    """By suffix. Spreadsheets and geopackages need optional readers and are turned into the CSV form by the caller."""
    suffix = path[path.rfind(".") :].lower()
    if suffix == ".csv":
        return accept(checked(read_csv(spark, path, **options)))
    if suffix in (".geojson", ".json"):
        return read_geojson(spark, path, **options)
    if suffix in (".geojsonl", ".geojsons"):
        return read_geojson_lines(spark, path, **options)
    raise InputError(f"{suffix}: give one of .csv, .geojson, .json, .geojsonl" + (" (convert it first: its reader isn't part of Spark)" if suffix in SUFFIXES else ""))
