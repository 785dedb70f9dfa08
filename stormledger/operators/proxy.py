"""Case-study proxies: points on map cells through their own curves, multipliers and ratios by scenario, stratified picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .impact import money_sum

SCENARIOS = ("annual", "rp50", "rp100", "event_max", "top10", "top5")
#: The most of a stratum's quota that goes to points with a score.
PRIORITY_SHARE = 0.4


def on_cells(points: DataFrame, cells: DataFrame, lat_min: float, lon_min: float, degrees: float, how: str = "inner") -> DataFrame:
    """Points (``lat``, ``lon``) with the columns of the cell (``i``, ``j`` from a corner) that they lie in."""
    at = points.withColumn("i", F.floor((F.col("lat") - lat_min) / degrees).cast("long")).withColumn("j", F.floor((F.col("lon") - lon_min) / degrees).cast("long"))
    return at.join(cells, ["i", "j"], how)


def priority_scores(points: DataFrame, cells: DataFrame, metrics: Sequence[str], lat_min: float, lon_min: float, degrees: float) -> DataFrame:
    """``score`` of each point: the largest of the metrics of its cell over all hazards; points without a positive one are left out."""
    most = cells.groupBy("i", "j").agg(*[F.max(m).alias(m) for m in metrics])
    score = F.greatest(*[F.coalesce(m, F.lit(0.0)) for m in metrics], F.lit(0.0))
    return on_cells(points, most, lat_min, lon_min, degrees).withColumn("score", score).where("score > 0").select("point_id", "score")


def curve_segments(curves: DataFrame, key: str, x: str, y: str, width: float) -> DataFrame:
    """Segments of piecewise-linear curves by bins of ``width``: ``key``, ``bin``, ``x0``, ``x1``, ``y0``, ``slope``; the last one goes on level.

    The first bin of all is that of what lies before the curve (``x1`` its first point, ``y0`` 0).
    """
    order = Window.partitionBy(key).orderBy(x)  # a curve's points: few
    rows = curves.select(key, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(order).alias("x1"), F.lead(y).over(order).alias("y1"))
    rows = rows.withColumn("slope", F.coalesce((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")), F.lit(0.0)))
    bins = F.sequence(F.floor(F.col("x0") / width).cast("long"), F.floor(F.coalesce("x1", "x0") / width).cast("long"))
    return rows.select(key, "x0", "x1", "y0", "slope", F.explode(bins).alias("bin"))


def through_curves(rows: DataFrame, curves: DataFrame, key: str, value: str, x: str = "x", y: str = "y", width: float = 0.5) -> DataFrame:
    """``rows`` with ``damage``: each row's value on its own curve, 0 before the first point, the last value after the last.

    Rows meet segments by curve and bin, which are few and broadcast; a row beyond the curve is moved to its last point first.
    """
    ends = curves.groupBy(key).agg(F.min(x).alias("__first"), F.max(x).alias("__last"))
    asked = rows.join(F.broadcast(ends), key, "left").withColumn("__x", F.least(value, "__last"))
    segments = curve_segments(curves, key, x, y, width).withColumnRenamed("bin", "__bin")
    met = asked.withColumn("__bin", F.floor(F.col("__x") / width).cast("long")).join(F.broadcast(segments), [key, "__bin"], "left")
    inside = (F.col("__x") >= F.col("x0")) & (F.col("x1").isNull() | (F.col("__x") < F.col("x1")))
    met = met.where(inside | (F.col("__x") < F.col("__first")) & (F.col("x0").isNull() | (F.col("x0") == F.col("__first"))) | F.col("__x").isNull() | F.col("__first").isNull())
    damage = F.when(F.col("__x").isNull(), None).when(F.col("__x") < F.col("__first"), 0.0).otherwise(F.col("y0") + F.col("slope") * (F.col("__x") - F.col("x0")))
    return met.withColumn("damage", damage).drop("__x", "__bin", "__first", "__last", "x0", "x1", "y0", "slope")


def proxy_losses(points: DataFrame, cells: DataFrame, curves: DataFrame, lat_min: float, lon_min: float, degrees: float) -> DataFrame:
    """Losses by (hazard, scenario) of points (``value``, ``code``) whose cell has a ``depth`` for it, through each point's own curve."""
    rows = through_curves(on_cells(points, cells, lat_min, lon_min, degrees), curves, "code", "depth", "depth_m", "mdd")
    return rows.groupBy("hazard", "scenario").agg(money_sum(F.col("value") * F.coalesce("damage", F.lit(0.0))).alias("loss"), F.count("*").alias("n"))


#: Scenarios whose missing surge may be taken from a map.
FROM_MAP = ("rp50", "rp100", "event_max")


def scenario_ratios(rows: DataFrame, map_surge: DataFrame | None = None) -> DataFrame:
    """Wind, rain and surge shares and the multiplier of each (hazard, scenario) from ``component`` (``combined`` among them) and ``loss``.

    The multiplier is the combined loss, capped as it is, to wind's: 0 at least, 1 without wind. Where surge has no share in a scenario of
    FROM_MAP, ``map_surge`` (``hazard``, ``scenario``, ``loss``) stands for it if it's positive. All is wind where nothing is lost.
    """
    loss = F.greatest(F.lit(0.0), "loss")
    sums = rows.groupBy("hazard", "scenario").agg(*[money_sum(F.when(F.col("component") == c, loss).otherwise(0.0)).alias(c) for c in ("wind", "rain", "surge")], money_sum(F.when(F.col("component") == "combined", F.col("loss")).otherwise(0.0)).alias("combined"))
    if map_surge is not None:
        sums = sums.join(map_surge.select("hazard", "scenario", F.col("loss").alias("__map")), ["hazard", "scenario"], "left")
        sums = sums.withColumn("surge", F.when((F.col("surge") <= 0) & F.col("scenario").isin(*FROM_MAP) & (F.col("__map") > 0), F.col("__map")).otherwise(F.col("surge")))
    total = F.col("wind") + F.col("rain") + F.col("surge")
    ratio = lambda c: F.when(total > 0, F.col(c) / total).otherwise(1.0 if c == "wind" else 0.0)
    multiplier = F.when(F.col("wind") > 0, F.greatest(F.lit(0.0), F.col("combined") / F.col("wind"))).otherwise(1.0)
    return sums.select("hazard", "scenario", *[F.round(ratio(c), 6).alias(f"{c}_ratio") for c in ("wind", "rain", "surge")], F.round(multiplier, 6).alias("multiplier"))


def block_rank(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, name: str) -> DataFrame:
    """``name``: each row's place (from 0) in its key by ``order``; ``block`` must grow with it. Blocks are counted first, so no task sorts a key."""
    rows = rows.withColumn("__b", block)
    counts = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)) - 1
    return rows.join(counts.withColumn("__o", before).drop("__c"), [*keys, "__b"]).withColumn(name, place + F.col("__o")).drop("__b", "__o")


def repaired_quotas(sizes: DataFrame, strata: Sequence[str], total: int) -> DataFrame:
    """``quota`` of each stratum (``n`` rows): one and a rounded share of the rest, within ``n``; then made to add up to ``total``.

    What is too much comes off the largest quotas first (down to one), what is missing goes to the largest strata first (up to
    ``n``): running sums over a table of one row for each stratum.
    """
    everything, every = Window.partitionBy(), F.count("*").over(Window.partitionBy())
    rest = F.greatest(F.lit(0), F.lit(total) - every)
    out = sizes.withColumn("quota", F.least("n", 1 + F.rint(F.col("n") / F.sum("n").over(everything) * rest).cast("long")))
    out = out.withColumn("__more", F.lit(total) - F.sum("quota").over(everything))
    names = [F.col(s) for s in strata]
    ahead = lambda room, order: F.coalesce(F.sum(room).over(Window.orderBy(F.desc(order), *names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("__less", ahead(F.col("quota") - 1, "quota")).withColumn("__room", ahead(F.col("n") - F.col("quota"), "n"))
    cut = F.least(F.col("quota") - 1, F.greatest(F.lit(0), -F.col("__more") - F.col("__less")))
    add = F.least(F.col("n") - F.col("quota"), F.greatest(F.lit(0), F.col("__more") - F.col("__room")))
    return out.withColumn("quota", F.when(F.col("__more") < 0, F.col("quota") - cut).otherwise(F.col("quota") + add)).drop("__more", "__less", "__room")


def stratified_pick(rows: DataFrame, strata: Sequence[str], order: str, score: str, total: int, block: int = 100_000) -> DataFrame:
    """``total`` rows over strata: up to PRIORITY_SHARE of a quota by ``score`` (null or not positive: none), the rest evenly spaced by ``order``."""
    rows = rows.withColumn("__p", F.coalesce(F.col(score) > 0, F.lit(False)))
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("n"), F.count_if("__p").alias("__np"))
    quota = repaired_quotas(sizes, strata, total)
    first = F.when(F.col("quota") <= 2, F.col("quota")).otherwise(F.greatest(F.lit(1), F.ceil(F.col("quota") * PRIORITY_SHARE)))
    quota = quota.withColumn("__first", F.least("__np", first)).withColumn("__plain", F.least(F.col("quota") - F.col("__first"), F.col("n") - F.col("__np")))
    quota = quota.withColumn("__chosen", F.least(F.col("__np"), F.col("quota") - F.col("__plain")))
    scored = block_rank(rows.where("__p"), strata, [F.desc(score), F.col(order)], -F.floor(F.log2(1 + F.col(score)) * 32), "__at")
    plain = block_rank(rows.where("not __p"), strata, [F.col(order)], F.floor(F.col(order) / block), "__at")
    spots = quota.where("__plain > 0").select(*strata, "__plain", (F.col("n") - F.col("__np")).alias("__m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__plain") - 1)).alias("__k"))
    spots = spots.select(*strata, F.when(F.col("__plain") == 1, 0).otherwise(F.rint(F.col("__k") * (F.col("__m") - 1) / (F.col("__plain") - 1))).cast("long").alias("__at"))
    top = scored.join(quota.select(*strata, "__chosen"), list(strata)).where("__at < __chosen").drop("__chosen")
    return top.unionByName(plain.join(spots, [*strata, "__at"])).drop("__p", "__at")
