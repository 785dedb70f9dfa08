"""GeoJSON geometries of any nesting, read as variants: positions and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps down from a geometry: a multipolygon takes four, each collection around it one more.
DEPTH = 16
_NUMBERS = "^ARRAY<(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def _parts(value: Column) -> Column:
    """What a value is made of: a geometry of its geometries or coordinates, an array of its elements, a position of itself."""
    kind = F.schema_of_variant(value)
    inner = F.coalesce(F.try_variant_get(value, "$.geometries", "array<variant>"), F.array(F.try_variant_get(value, "$.coordinates", "variant")))
    return F.when(kind.rlike(_NUMBERS), F.array(value)).when(kind.startswith("OBJECT"), inner).when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def positions(geometry: Column) -> Column:
    """The positions of a geometry (JSON text), those of nested collections too: an array of (x, y), elevations left out.

    Null, malformed and empty geometries have none. Collections nested deeper than DEPTH allows are an error.
    """
    found = F.array(F.try_parse_json(geometry))
    for _ in range(DEPTH):
        found = F.flatten(F.transform(found, _parts))
    number = lambda v, k: F.try_variant_get(v, f"$[{k}]", "double")
    point = lambda v: F.when(F.schema_of_variant(v).rlike(_NUMBERS), F.struct(number(v, 0).alias("x"), number(v, 1).alias("y"))).otherwise(F.raise_error(F.lit("a geometry is nested too deeply")).cast("struct<x:double,y:double>"))
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<variant>")), point), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def box(geometry: Column) -> Column:
    """``lon_min``, ``lat_min``, ``lon_max``, ``lat_max`` of a geometry; null where it has no position."""
    at = positions(geometry)
    lon, lat = F.transform(at, lambda p: p["x"]), F.transform(at, lambda p: p["y"])
    return F.struct(F.array_min(lon).alias("lon_min"), F.array_min(lat).alias("lat_min"), F.array_max(lon).alias("lon_max"), F.array_max(lat).alias("lat_max"))
