"""Points on lines, values split over points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def line_length(path: Column) -> Column:
    """The length of an array of (x, y)."""
    step = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    pairs = F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), step)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def sample_lines(features: DataFrame, spacing: float, most: int = 300, number: Column | None = None) -> DataFrame:
    """Equally spaced points on each line (``feature_id``, ``path``: array of (x, y)), both ends included: ``k``, ``x``, ``y``.

    ``number`` gives their number where the spacing doesn't. Lines of fewer than two vertices or without length give their first vertex. Each vertex knows its distance from the
    start, so a point's segment is the last one that starts before it.
    """
    zero = F.struct(F.array().cast("array<struct<d:double,x:double,y:double>>").alias("out"), F.lit(0.0).alias("d"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def add(acc: Column, p: Column) -> Column:
        d = acc["d"] + F.coalesce(F.sqrt((p["x"] - acc["x"]) * (p["x"] - acc["x"]) + (p["y"] - acc["y"]) * (p["y"] - acc["y"])), F.lit(0.0))
        return F.struct(F.concat(acc["out"], F.array(F.struct(d.alias("d"), p["x"].alias("x"), p["y"].alias("y")))).alias("out"), d.alias("d"), p["x"].alias("x"), p["y"].alias("y"))

    measured = features.withColumn("__m", F.aggregate("path", zero, add)).withColumn("__len", F.col("__m.d"))
    n = F.when(F.col("__len") > 0, S.line_points(F.col("__len"), spacing, most) if number is None else number).otherwise(1)
    rows = measured.withColumn("__n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    rows = rows.withColumn("__at", F.when(F.col("__n") > 1, F.col("__len") * F.col("k") / (F.col("__n") - 1)).otherwise(0.0))
    before = F.filter(F.col("__m.out"), lambda v: v["d"] <= F.col("__at"))
    rows = rows.withColumn("__a", F.try_element_at(before, F.lit(-1))).withColumn("__b", F.try_element_at(F.filter(F.col("__m.out"), lambda v: v["d"] > F.col("__at")), F.lit(1)))
    share = (F.col("__at") - F.col("__a.d")) / (F.col("__b.d") - F.col("__a.d"))
    at = lambda c: F.when(F.col("__b").isNull(), F.col(f"__a.{c}")).otherwise(F.col(f"__a.{c}") + (F.col(f"__b.{c}") - F.col(f"__a.{c}")) * share)
    return rows.where(F.col("__a").isNotNull()).withColumn("x", at("x")).withColumn("y", at("y")).drop("path", "n", "__m", "__len", "__n", "__at", "__a", "__b")


def explode_points(features: DataFrame, samples: DataFrame) -> DataFrame:
    """Exposure points: ``point_id`` is ``<feature>::p<k>``, the feature's value is split evenly over its points."""
    n = samples.groupBy("feature_id").agg(F.count("*").alias("n"))
    rows = samples.join(n, "feature_id").join(features, "feature_id")
    return rows.withColumn("point_id", F.concat_ws("::p", F.col("feature_id").cast("string"), F.col("k").cast("string"))).withColumn("value", F.greatest(F.lit(0.0), "value") / F.col("n"))


def line_parts(coordinates: Column) -> Column:
    """The parts of two points or more of a line's or several lines' GeoJSON coordinates: arrays of (x, y)."""
    several = F.from_json(coordinates, "array<array<array<double>>>", {"mode": "PERMISSIVE"})
    single = F.from_json(coordinates, "array<array<double>>", {"mode": "PERMISSIVE"})
    depth = F.length(F.regexp_extract(coordinates, r"^[\s\[]*", 0)) - F.length(F.replace(F.regexp_extract(coordinates, r"^[\s\[]*", 0), F.lit("["), F.lit("")))
    parts = F.when(depth >= 3, several).otherwise(F.array(single))
    good = F.filter(parts, lambda p: F.size(p) >= 2)
    return F.transform(good, lambda p: F.transform(p, lambda c: F.struct(F.get(c, 0).alias("x"), F.get(c, 1).alias("y"))))


def parts_km(parts: Column) -> Column:
    """The length of line parts (lon, lat) on the sphere."""
    step = lambda a, b: S.haversine_km(a["x"], a["y"], b["x"], b["y"])
    own = lambda p: F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), step), F.lit(0.0), lambda acc, x: acc + x)
    return F.aggregate(F.transform(parts, own), F.lit(0.0), lambda acc, x: acc + x)


def feature_weight(kind: Column, km: Column) -> Column:
    """A feature's weight: a line's kilometres (1 if it has none), 3 for polygons, 1 for all else."""
    return F.when(F.lower(kind).contains("line"), F.when(km > 0, km).otherwise(1.0)).when(F.lower(kind).contains("polygon"), 3.0).otherwise(1.0)


def sample_multilines(features: DataFrame, spacing: float, most: int = 300) -> DataFrame:
    """Points on features of several lines (``feature_id``, ``paths``): ``k``, ``x``, ``y``; a feature's number is shared out by length.

    Each part gets its rounded share (one at least) until the feature's number is used up; a part with one point gives its
    start. Running sums by feature do that: it has few parts.
    """
    parts = features.select("feature_id", F.posexplode("paths").alias("part", "path")).withColumn("len", line_length(F.col("path")))
    whole = Window.partitionBy("feature_id")
    total = F.sum("len").over(whole)
    count = F.when(total > 0, S.line_points(total, spacing, most)).otherwise(1)
    share = F.greatest(F.lit(1), F.when(total > 0, F.rint(count * F.col("len") / total)).otherwise(1).cast("int"))
    used = F.coalesce(F.sum("share").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alloted = parts.withColumn("total", count).withColumn("share", share).withColumn("n", F.greatest(F.lit(0), F.least(F.col("share"), F.col("total") - used)).cast("int"))
    one = alloted.where("n > 0").select(F.struct("feature_id", "part").alias("feature_id"), "path", "n")
    rows = sample_lines(one, spacing, most, number=F.col("n")).select("feature_id.feature_id", "feature_id.part", F.col("k").alias("at"), "x", "y")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("feature_id").orderBy("part", "at")) - 1).select("feature_id", "k", "x", "y")
