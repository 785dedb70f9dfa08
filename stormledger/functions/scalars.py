"""Row functions: names, units, coordinates, damage states. All are Column expressions inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, weights, units, and the names that uploads may use.
STATE_THRESHOLDS = (0.05, 0.15, 0.35)
DEPENDENCY_THRESHOLDS = (0.35, 0.55, 0.75)
UPLIFT = {"S0": 0.0, "S1": 0.10, "S2": 0.25, "S3": 0.45}
HEALTH_WEIGHTS = {"S1": 0.3, "S2": 0.7, "S3": 1.0}
EARTH_RADIUS_KM = 6371.0088
WIND_UNITS = {"m/s": 1.0, "kn": 0.514444, "km/h": 1 / 3.6}
WIND_ALIASES = {"ms": "m/s", "mps": "m/s", "m/s": "m/s", "kt": "kn", "kts": "kn", "kn": "kn", "knots": "kn", "kmh": "km/h", "kph": "km/h", "km/h": "km/h"}
CATEGORY_ALIASES = {
    "habitation": "habitation",
    "residential": "habitation",
    "house": "habitation",
    "housing": "habitation",
    "water": "ouvrage_eau",
    "water_network": "ouvrage_eau",
    "water_infra": "ouvrage_eau",
    "ouvrage_eau": "ouvrage_eau",
    "ouvrageeau": "ouvrage_eau",
    "electric": "ouvrage_electrique",
    "electricity": "ouvrage_electrique",
    "power": "ouvrage_electrique",
    "ouvrage_electrique": "ouvrage_electrique",
    "ouvrageelectrique": "ouvrage_electrique",
}
ASSET_ALIASES = {
    "habitation": "habitation",
    "house": "habitation",
    "housing": "habitation",
    "eau_aep": "eau_aep_cana",
    "eau_aep_cana": "eau_aep_cana",
    "eau_eu": "eau_eu_cana",
    "eau_eu_cana": "eau_eu_cana",
    "elec_bt_aerien": "elec_bt_aerien",
    "elec_bt_souterrain": "elec_bt_souterrain",
    "elec_hta_aerien": "elec_hta_aerien",
    "elec_hta_souterrain": "elec_hta_souterrain",
    "eau_eu_pr": "eau_eu_pr",
    "eau_eu_step": "eau_eu_step",
    "aep_ouvrage_trait": "eau_aep_ouvrage_trait",
    "eau_aep_ouvrage_trait": "eau_aep_ouvrage_trait",
    "aep_ouvrage_stpmp": "eau_aep_ouvrage_stpmp",
    "eau_aep_ouvrage_stpmp": "eau_aep_ouvrage_stpmp",
    "aep_ouvrage_cap": "eau_aep_ouvrage_cap",
    "eau_aep_ouvrage_cap": "eau_aep_ouvrage_cap",
    "aep_ouvrage_cuv": "eau_aep_ouvrage_cuv",
    "eau_aep_ouvrage_cuv": "eau_aep_ouvrage_cuv",
    "aep_ouvrage_autres": "eau_aep_ouvrage_na",
    "eau_aep_ouvrage_na": "eau_aep_ouvrage_na",
}
DISTANCE_ALIASES = {
    "km": "km",
    "kilometer": "km",
    "kilometers": "km",
    "kilometre": "km",
    "kilometres": "km",
    "nm": "nm",
    "nmi": "nm",
    "nautical_mile": "nm",
    "nautical_miles": "nm",
    "m": "m",
    "meter": "m",
    "meters": "m",
    "metre": "m",
    "metres": "m",
}


def token(value: Column) -> Column:
    """Trimmed of white space of any kind, lower case, blanks and hyphens as underscores; null is the empty token."""
    return F.translate(F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", "")), " -", "__")


def alias(value: Column, aliases: dict[str, str], default: Column | None = None) -> Column:
    """The canonical name of a token; ``default`` (null if not given) where no alias matches."""
    pairs = [F.lit(x) for entry in aliases.items() for x in entry]
    return F.coalesce(F.element_at(F.create_map(*pairs), token(value)), F.lit(None).cast("string") if default is None else default)


def category(value: Column, default: str = "habitation") -> Column:
    return alias(value, CATEGORY_ALIASES, F.lit(default))


def asset_type(value: Column, strict: bool = False) -> Column:
    """The canonical asset type; an unknown one stays as its token, or is null when strict."""
    return alias(value, ASSET_ALIASES, None if strict else token(value))


def infra_class(category_: Column, asset: Column, geometry_type: Column) -> Column:
    """Of five classes, by category, words in the asset type and whether the geometry is a point."""
    kind, shape = F.lower(F.trim(F.coalesce(asset, F.lit("")))), F.lower(F.coalesce(geometry_type, F.lit("")))
    works = kind.contains("step") | kind.contains("station") | kind.contains("stpmp") | kind.startswith("pr") | kind.contains("ouvrage") | shape.contains("point")
    buried = kind.contains("souterrain") | kind.contains("underground")
    return (
        F.when(category_ == "ouvrage_electrique", F.when(buried, "elec_souterrain").otherwise("elec_aerien"))
        .when(category_ == "ouvrage_eau", F.when(works, "eau_ouvrage").otherwise("eau_reseau"))
        .otherwise("habitation")
    )


def finite(value: Column) -> Column:
    """The number, or null where it's NaN or infinite."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def checked_number(value: Column) -> Column:
    """Text as a finite double, else null."""
    return finite(value.try_cast("double"))


def _unit(name: str | None, aliases: dict[str, str], default: str) -> str:
    known = aliases.get((name or default).strip().lower())
    if known is None:
        raise ValueError(f"{name}: give one of {', '.join(sorted(set(aliases.values())))}")
    return known


def wind_mps(value: Column, unit: str) -> Column:
    """Wind speed in m/s from m/s, knots or km/h (or their aliases)."""
    name = _unit(unit, WIND_ALIASES, "m/s")
    return value / 3.6 if name == "km/h" else value * WIND_UNITS[name]


def radius_nm(value: Column, unit: str) -> Column:
    """A distance in nautical miles from km, nm or m (or their aliases)."""
    return {"km": value / 1.852, "nm": value * 1.0, "m": value / 1852.0}[_unit(unit, DISTANCE_ALIASES, "km")]


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180]; 180 itself stays."""
    wrapped = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return F.when(lon.between(-180.0, 180.0), lon).otherwise(F.when((wrapped == -180.0) & (lon > 0), 180.0).otherwise(wrapped))


def longitude_within(lon: Column, low: Column, high: Column) -> Column:
    """Between the bounds; across the date line where low exceeds high."""
    return F.when(low <= high, lon.between(low, high)).otherwise((lon >= low) | (lon <= high))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bin_centre(value: Column, size: float) -> Column:
    """The nearest multiple of ``size``, halves to even; never negative zero."""
    return (F.rint(value / size) + 0.0) * size


def territory_cell(lat: Column, lon: Column, size: float = 0.2) -> Column:
    """``cell-<lat>_<lon>`` of the territory grid; uploads without coordinates form one aggregate."""
    name = F.format_string("cell-%+05.2f_%+06.2f", bin_centre(lat, size), bin_centre(lon, size))
    return F.when(lat.isNull() | lon.isNull(), "uploaded-aggregate").otherwise(name)


def cell_index(value: Column, degrees: float, origin: float = 0.0) -> Column:
    return F.floor((value - origin) / degrees)


def cell_centre(index: Column, degrees: float) -> Column:
    return F.round((index + 0.5) * degrees, 6)


def coordinate_key(value: Column) -> Column:
    """A coordinate to five decimals as a whole number: safe to join on."""
    return F.rint(value * 1e5).cast("long")


def damage_state(ratio: Column) -> Column:
    a, b, c = STATE_THRESHOLDS
    return F.when(ratio >= c, "S3").when(ratio >= b, "S2").when(ratio >= a, "S1").otherwise("S0")


def dependency_state(health: Column) -> Column:
    a, b, c = DEPENDENCY_THRESHOLDS
    return F.when(health < a, "S3").when(health < b, "S2").when(health < c, "S1").otherwise("S0")


def uplift(state: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in UPLIFT.items() for x in kv]), state)


def health(total: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """1 less the weighted share in the states, within 0 and 1; 1 where there is no value."""
    lost = (HEALTH_WEIGHTS["S1"] * s1 + HEALTH_WEIGHTS["S2"] * s2 + HEALTH_WEIGHTS["S3"] * s3) / total
    return F.when(total <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - lost)))


def risk_index(eai: Column, exposure: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), eai / F.greatest(exposure, F.lit(1.0)) * 1000.0))


def percent_of(value: Column, whole: Column) -> Column:
    return F.when(whole > 0, value / whole * 100.0)


def distinct_strings(values: Column) -> Column:
    """Trimmed, without blanks and repeats, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def ratio_map(*parts: Column) -> list[Column]:
    """Non-negative parts as shares of their sum; all to the first where the sum isn't positive."""
    clipped = [F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(0.0)) for p in parts]
    total = sum(clipped[1:], clipped[0])
    return [F.when(total > 0, c / total).otherwise(1.0 if i == 0 else 0.0) for i, c in enumerate(clipped)]


def cents(total: Column, ratios: list[Column]) -> list[Column]:
    """A total in whole cents split by ratios: each rounds half to even, the last takes what remains."""
    whole = F.rint(total * 100).cast("long")
    parts = [F.rint(whole * r).cast("long") for r in ratios[:-1]]
    rest = whole
    for p in parts:
        rest = rest - p
    return [*parts, rest]


def line_points(length: Column, spacing: float, most: int) -> Column:
    """Points on a line: both ends and one for each spacing between, at most ``most``."""
    return F.least(F.lit(most), F.greatest(F.lit(2), (F.ceil(length / spacing) + 1).cast("int"))).cast("int")


def estimated_points(kind: Column, length: Column, area: Column, spacing: float) -> Column:
    """Points that a feature is expected to give, by kind of geometry."""
    line = F.greatest(F.lit(1), F.ceil(length / spacing))
    polygon = F.least(F.lit(10_000), F.greatest(F.lit(1), F.ceil(area / (spacing * spacing))))
    return F.when(kind == "point", 1).when(kind == "line", line).when(kind == "polygon", polygon).otherwise(3).cast("long")


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857 metres of degrees."""
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of EPSG:3857 metres."""
    r = 6378137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2)
