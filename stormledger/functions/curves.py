"""Vulnerability curves: the analytic sigmoid, curve tables, the choice of a curve by asset type, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
V_THRESHOLD, V_HALF = 25.7, 59.6
DEFAULT_WIND_ID = 2
WIND_IDS = {"W3.10": 310, "W3.14": 314, "W16.1": 316, "W19.1": 319, "W21.2": 212, "W21.4": 214, "W21.5": 215, "W21.10": 2110}
WIND_CURVE_OF = {
    "elec_bt_aerien": "W3.10",
    "elec_hta_aerien": "W3.14",
    "elec_bt_souterrain": "W16.1",
    "elec_hta_souterrain": "W16.1",
    "eau_aep_cana": "W16.1",
    "eau_eu_cana": "W19.1",
    "eau_eu_step": "W21.2",
    "eau_aep_ouvrage_trait": "W21.2",
    "eau_aep_ouvrage_stpmp": "W21.4",
    "eau_aep_ouvrage_cap": "W21.10",
    "eau_aep_ouvrage_cuv": "W21.5",
    "eau_aep_ouvrage_ouveb": "W21.5",
    "eau_aep_ouvrage_na": "W21.5",
}
SURGE_BASE, RAIN_BASE, DEFAULT_FLOOD, RUNOFF = 4100, 5100, "F17.5", 0.25
FLOOD_CURVE_OF = {
    "elec_bt_aerien": "F6.2",
    "elec_hta_aerien": "F6.2",
    "elec_bt_souterrain": "F6.1",
    "elec_hta_souterrain": "F6.1",
    "eau_aep_cana": "F19.3",
    "eau_eu_cana": "F19.3",
    "eau_eu_pr": "F20.3",
    "eau_eu_step": "F18.4",
    "eau_aep_ouvrage_trait": "F14.4",
    "eau_aep_ouvrage_stpmp": "F17.4",
    "eau_aep_ouvrage_cap": "F15.1",
    "eau_aep_ouvrage_cuv": "F13.1",
    "eau_aep_ouvrage_ouveb": "F13.1",
    "eau_aep_ouvrage_na": "F14.4",
}


def sigmoid(v: Column, threshold: float = V_THRESHOLD, half: float = V_HALF) -> Column:
    """Mean damage ratio at wind speed ``v`` (m/s): 0 up to the threshold, one half at ``half``."""
    n = (v - threshold) / (half - threshold)
    cube = n * n * n
    return F.when(v <= threshold, 0.0).otherwise(cube / (1.0 + cube))


def tabulate(spark: SparkSession, top: int = 300) -> DataFrame:
    """The analytic curve at each whole m/s: ``intensity``, ``mdd``, ``paa``."""
    v = F.col("id").cast("double")
    return spark.range(0, top + 1).select(v.alias("intensity"), sigmoid(v).alias("mdd"), F.lit(1.0).alias("paa"))


def _choice(value: Column, table: dict[str, object], default: object) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.trim(value))), F.lit(default))


def wind_curve_id(asset: Column) -> Column:
    """The wind curve of an asset type; the analytic one's id for any other."""
    return _choice(asset, {a: WIND_IDS[c] for a, c in WIND_CURVE_OF.items()}, DEFAULT_WIND_ID)


def flood_curve_code(asset: Column) -> Column:
    return _choice(asset, FLOOD_CURVE_OF, DEFAULT_FLOOD)


def number_curves(curves: DataFrame) -> DataFrame:
    """Flood curves (``code``, ``depth_m``, ``mdd``) with ``surge_id`` and ``rain_id`` in order of code, and the rain axis in mm.

    Damage is clipped to 0..1, repeated depths count once, codes with under two depths are dropped.
    """
    points = curves.where("depth_m is not null and mdd is not null").groupBy("code", "depth_m").agg(F.min("mdd").alias("mdd"))
    codes = points.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code", (F.row_number().over(Window.orderBy("code")) - 1).alias("at"))
    return points.join(F.broadcast(codes), "code").select(
        "code",
        (F.lit(SURGE_BASE) + F.col("at")).cast("int").alias("surge_id"),
        (F.lit(RAIN_BASE) + F.col("at")).cast("int").alias("rain_id"),
        "depth_m",
        (F.col("depth_m") * 1000.0 / RUNOFF).alias("rain_mm"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), "mdd")).alias("mdd"),
    )


def assign_curves(points: DataFrame, numbered: DataFrame, asset: str = "asset_type") -> DataFrame:
    """``points`` with ``wind_id``, ``surge_id`` and ``rain_id`` by asset type; where its flood curve isn't among ``numbered``, the default one's ids, else the first ones."""
    ids = numbered.select("code", "surge_id", "rain_id").distinct()
    default = ids.agg(*[F.coalesce(F.max(F.when(F.col("code") == DEFAULT_FLOOD, F.col(c))), F.min(c)).alias(f"__{c}") for c in ("surge_id", "rain_id")])
    rows = points.withColumn("code", flood_curve_code(F.col(asset))).join(ids, "code", "left").crossJoin(F.broadcast(default))  # a single row
    return rows.withColumn("wind_id", wind_curve_id(F.col(asset))).withColumn("surge_id", F.coalesce("surge_id", "__surge_id")).withColumn("rain_id", F.coalesce("rain_id", "__rain_id")).drop("__surge_id", "__rain_id", "code")


def payload(numbered: DataFrame) -> DataFrame:
    """Each flood curve as the catalogue shows it: ids, both axes, damage, and the asset types that use it. A curve's points are few."""
    kinds = numbered.sparkSession.createDataFrame([(c, a) for a, c in FLOOD_CURVE_OF.items()], "code string, asset string").groupBy("code").agg(F.array_sort(F.collect_list("asset")).alias("assets"))
    axes = F.array_sort(F.collect_list(F.struct("depth_m", "rain_mm", "mdd"))).alias("points")
    return numbered.groupBy("code", "surge_id", "rain_id").agg(axes).join(kinds, "code", "left").select("code", "surge_id", "rain_id", "points.depth_m", "points.rain_mm", "points.mdd", F.coalesce("assets", F.array().cast("array<string>")).alias("assets"))


def as_arrays(curves: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row per curve: ``key`` and ``curve``, an array of (x, y) in order of x. A dimension: bounded by the number of curves."""
    return curves.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("curve"))


def interpolate(curve: Column, x: Column, left: float = 0.0) -> Column:
    """Piecewise-linear value of an ordered array of (x, y) at ``x``: ``left`` before the first point, the last value after the last."""
    low = F.filter(curve, lambda p: p["x"] <= x)
    high = F.filter(curve, lambda p: p["x"] > x)
    a, b = F.try_element_at(low, F.lit(-1)), F.try_element_at(high, F.lit(1))
    between = a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"])
    return F.when(x.isNull(), None).when(F.size(low) == 0, left).when(F.size(high) == 0, a["y"]).otherwise(between)
