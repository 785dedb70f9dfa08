"""Grid statistics: cells, annual maxima and quantiles, merging of components, gap filling, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .impact import steady_mean
from .metrics import quantiles


def with_cells(rows: DataFrame, degrees: float) -> DataFrame:
    return rows.withColumn("i", S.cell_index(F.col("lat"), degrees)).withColumn("j", S.cell_index(F.col("lon"), degrees))


def cell_statistics(rows: DataFrame, degrees: float, years: int | None = None, value: str = "wind") -> DataFrame:
    """Mean, 50- and 100-year levels and the largest value of each cell; quantiles are exact, over annual maxima.

    By default years without a passage don't count; with ``years`` they count as 0. The annual maxima are the partial
    aggregate: two grouped steps, no window.
    """
    cells = with_cells(rows.where(F.col(value).isNotNull()), degrees)
    yearly = cells.groupBy("i", "j", "year").agg(F.max(value).alias("m"), F.sum(F.col(value).cast("decimal(24,9)")).alias("s"), F.count("*").alias("n"))
    out = yearly.groupBy("i", "j").agg(F.sum("n").alias("sample_count"), (F.sum("s").cast("double") / F.sum("n")).alias("mean_wind"), F.count("*").alias("n_years"), F.collect_list("m").alias("ms"), F.max("m").alias("event_max"))
    series = F.col("ms") if years is None else F.concat("ms", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(years) - F.col("n_years")).cast("int")))
    out = out.withColumn("ms", F.array_sort(series))
    out = out.withColumn("rp50", array_quantile(F.col("ms"), 0.98)).withColumn("rp100", array_quantile(F.col("ms"), 0.99))
    return out.select("i", "j", S.cell_centre(F.col("i"), degrees).alias("lat"), S.cell_centre(F.col("j"), degrees).alias("lon"), "sample_count", "n_years", "mean_wind", "rp50", "rp100", "event_max")


def array_quantile(ordered: Column, q: float) -> Column:
    """The linear-interpolated quantile of an ordered array."""
    at = (F.size(ordered) - 1) * q
    low = F.floor(at)
    a = F.element_at(ordered, (low + 1).cast("int"))
    b = F.element_at(ordered, F.least(F.size(ordered), (low + 2).cast("int")))
    return a + (b - a) * (at - low)


def maxima_summary(rows: DataFrame, unit: str, value: str = "wind") -> DataFrame:
    """Count, mean, high quantiles and maximum of the largest values by ``unit`` (a year or a track)."""
    most = rows.groupBy(unit).agg(F.max(value).alias("m"))
    sums = most.agg(F.count("*").alias("n"), steady_mean(F.col("m")).alias("mean_max"), F.max("m").alias("top"))
    return sums.crossJoin(quantiles(most, "m", {"q99": 0.99, "q999": 0.999})).select("n", "mean_max", "q99", "q999", "top")  # two single rows


def merge_components(cells: DataFrame, *components: DataFrame, on: Sequence[str] = ("i", "j")) -> DataFrame:
    """Cells with the metrics of each component; 0 where a component has none."""
    out = cells
    for c in components:
        names = [x for x in c.columns if x not in on]
        out = out.join(c, list(on), "left").fillna(0.0, subset=names)
    return out


def coarsen(cells: DataFrame, factor: int, metrics: Sequence[str]) -> DataFrame:
    """The largest metrics of each block of ``factor`` x ``factor`` cells."""
    up = lambda c: F.floor(F.col(c) / factor).cast("long").alias(c)
    return cells.select(up("i"), up("j"), *metrics).groupBy("i", "j").agg(*[F.max(m).alias(m) for m in metrics])


def bounds(cells: DataFrame, degrees: float) -> DataFrame:
    """The box of cell centres, half a cell wider, and its rows and columns."""
    h = degrees / 2
    box = cells.agg((F.min("lat") - h).alias("south"), (F.max("lat") + h).alias("north"), (F.min("lon") - h).alias("west"), (F.max("lon") + h).alias("east"))
    size = lambda a, b: F.rint((F.col(a) - F.col(b)) / degrees).cast("long")
    return box.withColumn("n_rows", size("north", "south")).withColumn("n_cols", size("east", "west"))


def regular_grid(spark: SparkSession, lat_min: float, lat_max: float, lon_min: float, lon_max: float, degrees: float) -> DataFrame:
    """Cells of a box, from its south-west corner: the last row and column are cut off at the box. ``cell_id`` goes by rows."""
    n = -int(-(lat_max - lat_min) / degrees // 1) if (lat_max - lat_min) / degrees % 1 > 1e-9 else round((lat_max - lat_min) / degrees)
    m = -int(-(lon_max - lon_min) / degrees // 1) if (lon_max - lon_min) / degrees % 1 > 1e-9 else round((lon_max - lon_min) / degrees)
    n, m = max(1, n), max(1, m)
    i, j = F.floor(F.col("id") / m), F.col("id") % m
    edge = lambda k, low, high: ((low + k * degrees) + F.least(low + (k + 1) * degrees, F.lit(high))) / 2
    return spark.range(n * m).select(F.col("id").alias("cell_id"), i.alias("i"), j.alias("j"), F.round(edge(i, lat_min, lat_max), 6).alias("lat"), F.round(edge(j, lon_min, lon_max), 6).alias("lon"))


def densify(points: DataFrame, step: float = 0.01, few: int = 50) -> DataFrame:
    """Distinct coordinates to five decimals; where there are at most ``few``, with their eight neighbours at ``step``."""
    base = points.select(F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon")).distinct()
    size = base.agg(F.count("*").alias("__n"))
    around = F.array(*[F.struct(F.lit(a * step).alias("a"), F.lit(b * step).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    here = F.array(F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")))
    rows = base.crossJoin(F.broadcast(size)).withColumn("d", F.explode(F.when(F.col("__n") <= few, around).otherwise(here)))
    return rows.select(F.round(F.col("lat") + F.col("d.a"), 5).alias("lat"), F.round(F.col("lon") + F.col("d.b"), 5).alias("lon")).distinct()


def fill_gaps(cells: DataFrame, value: str, reach: int) -> DataFrame:
    """Cells without a value take that of the nearest cell within ``reach``; ties go to the smaller (i, j).

    A gap meets its neighbours by equal keys: one row for each offset within reach.
    """
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(a * a + b * b).alias("d2")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if 0 < a * a + b * b <= reach * reach])
    known = cells.where(F.col(value).isNotNull()).select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col(value).alias("v"))
    gaps = cells.where(F.col(value).isNull()).select("i", "j", F.explode(near).alias("d")).select("i", "j", (F.col("i") + F.col("d.a")).alias("ni"), (F.col("j") + F.col("d.b")).alias("nj"), F.col("d.d2").alias("d2"))
    best = gaps.join(known, ["ni", "nj"]).groupBy("i", "j").agg(F.min_by("v", F.struct("d2", "ni", "nj")).alias("v"))
    return cells.join(best, ["i", "j"], "left").withColumn(value, F.coalesce(value, "v")).drop("v")


def smooth(cells: DataFrame, value: str, radius: int = 5, least: int = 3, nearest: int = 6) -> DataFrame:
    """``smoothed``: the mean of the nearest ``nearest`` neighbours within ``radius``, where there are ``least``; else the value."""
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(a * a + b * b).alias("d2")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if 0 < a * a + b * b <= radius * radius])
    known = cells.where(F.col(value).isNotNull()).select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col(value).alias("v"))
    met = cells.select("i", "j", F.explode(near).alias("d")).select("i", "j", (F.col("i") + F.col("d.a")).alias("ni"), (F.col("j") + F.col("d.b")).alias("nj"), F.col("d.d2").alias("d2")).join(known, ["ni", "nj"])
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("i", "j").orderBy("d2", "ni", "nj"))).where(F.col("r") <= nearest)
    means = ranked.groupBy("i", "j").agg(F.count("*").alias("n"), steady_mean(F.col("v")).alias("m")).where(F.col("n") >= least)
    return cells.join(means, ["i", "j"], "left").withColumn("smoothed", F.coalesce("m", value)).drop("m", "n")


def histogram(rows: DataFrame, value: str, keys: Sequence[str] = (), step: float = 1.0) -> DataFrame:
    """Percent of values by bins of ``step`` between the whole numbers around all values; the last bin is closed.

    The edges are shared by all keys; empty bins aren't listed.
    """
    kept = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    edges = kept.agg(F.floor(F.min(value)).cast("double").alias("low"), F.ceil(F.max(value)).cast("double").alias("high"))
    bins = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / step))
    at = kept.crossJoin(F.broadcast(edges)).withColumn("bin", F.least(F.floor((F.col(value) - F.col("low")) / step), bins - 1).cast("long"))
    counts = at.groupBy(*keys, "bin", "low").agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    out = counts.join(total, list(keys)) if keys else counts.crossJoin(F.broadcast(total))
    return out.select(*keys, "bin", (F.col("low") + (F.col("bin") + 0.5) * step).alias("centre"), "n", F.round(F.col("n") / F.col("total") * 100, 6).alias("pct"))


def equal_bins(rows: DataFrame, value: str, bins: int = 7) -> DataFrame:
    """Percent of values in ``bins`` equal bins, by their right edges; values that are all equal fall in the first."""
    span = rows.where(F.col(value).isNotNull()).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("total"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(width <= 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("low")) / width)))
    counted = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).withColumn("bin", at.cast("int")).groupBy("bin", "low", "high", "total").agg(F.count("*").alias("n"))
    return counted.select("bin", F.round(F.col("low") + (F.col("bin") + 1) * width, 6).alias("edge"), "n", F.round(F.col("n") / F.col("total") * 100, 6).alias("pct"))
