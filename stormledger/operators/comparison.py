"""Tables that set hazards and scenarios side by side, and summaries of an exposure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes as K
from ..functions import scalars as S
from . import metrics
from .casestudy import class_scenarios
from .impact import money_sum, steady_mean


def finite_mean(value: Column) -> Column:
    """The mean of a cell metric's finite values; null if there are none."""
    return steady_mean(F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value))


def hazard_means(cells: DataFrame, names: Sequence[str], hazards: Sequence[str] = ("storm", "storm_cmcc")) -> DataFrame:
    """One row a metric: its mean over the cells of either hazard, their difference, and the largest value of either."""
    long = cells.unpivot(["hazard"], list(names), "metric", "value")
    sums = long.groupBy("metric").agg(*[finite_mean(F.when(F.col("hazard") == h, F.col("value"))).alias(f"mean_{h}") for h in hazards], *[F.max(F.when(F.col("hazard") == h, F.col("value"))).alias(f"top_{h}") for h in hazards])
    return sums.withColumn("delta", F.col(f"mean_{hazards[1]}") - F.col(f"mean_{hazards[0]}"))


def metric_ranges(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row a metric: the least and the largest value over all hazards."""
    return cells.unpivot(["hazard"], list(names), "metric", "value").groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def side_by_side(rows: DataFrame, key: str, value: str, hazards: Sequence[str] = ("storm", "storm_cmcc")) -> DataFrame:
    """A full outer join of two hazards' rows by ``key``: 0 where one has none."""
    one, two = (rows.where(F.col("hazard") == h).select(key, F.col(value).alias(h)) for h in hazards)
    return one.join(two, key, "full_outer").fillna(0.0, subset=list(hazards))


def by_class(rows: DataFrame, labels: DataFrame, value: str) -> DataFrame:
    """All classes of ``labels`` (``class``) with the rows' values; a class without any has 0."""
    return labels.join(rows, "class", "left").fillna(0.0, subset=[value])


def prefix_totals(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sums by the first part of a class' name."""
    return rows.groupBy(F.split(key, "_")[0].alias("network")).agg(money_sum(F.col(value)).alias("total"))


def shared_bins(rows: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 14) -> DataFrame:
    """Percent of finite values by ``bins`` (6 to 28) equal bins over the range of all keys: ``bin``, ``centre``, ``pct``."""
    n = max(6, min(28, int(bins)))
    kept = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    span = kept.agg(F.min(value).alias("low"), F.greatest(F.lit(1e-9), F.max(value) - F.min(value)).alias("span"))
    at = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(value) - F.col("low")) / F.col("span") * n)))
    counts = kept.crossJoin(F.broadcast(span)).groupBy(*keys, at.cast("int").alias("bin"), (F.col("low") + (at + 0.5) * F.col("span") / n).alias("centre")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    out = counts.join(totals, list(keys)) if keys else counts.crossJoin(F.broadcast(totals))
    return out.select(*keys, "bin", "centre", (F.col("n") / F.col("total") * 100).alias("pct"))


def exposure_metrics(assets: DataFrame) -> DataFrame:
    """Kilometres, number and value by breakdown class, and of all together (``class`` null)."""
    rows = assets.withColumn("class", K.breakdown_class(F.col("asset_type"))).where("class is not null")
    return rows.rollup("class").agg(money_sum(F.col("km")).alias("km"), F.count("*").alias("n"), money_sum(F.greatest(F.lit(0.0), "value")).alias("value"))


def works_by_type(assets: DataFrame, code: str) -> DataFrame:
    """The number of works by type code in upper case; NA where there is none."""
    return assets.groupBy(F.upper(F.coalesce(F.nullif(F.trim(F.col(code)), F.lit("")), F.lit("NA"))).alias("type")).agg(F.count("*").alias("n"))


def six_scenarios(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Losses of each class in all six scenarios, within the class' value: those of ``class_scenarios``, and means of top tenths and twentieths."""
    events = rows.groupBy("class", "event_id").agg(money_sum(F.col("loss")).alias("loss"))
    out = class_scenarios(rows, values)
    for name, fraction in (("top10", 0.10), ("top5", 0.05)):
        part = metrics.mean_top_fraction(events, ("class",), fraction).join(values, "class")
        out = out.unionByName(part.select("class", F.lit(name).alias("scenario"), F.least("mean_loss", F.greatest("value", F.lit(0.0))).alias("loss")))
    return out


def scenario_factors(scenarios: DataFrame) -> DataFrame:
    """Each scenario's total loss over the annual one: ``scenario``, ``loss``, ``factor``."""
    totals = scenarios.groupBy("scenario").agg(money_sum(F.col("loss")).alias("loss"))
    annual = totals.where("scenario = 'annual'").select(F.greatest(F.col("loss"), F.lit(1e-9)).alias("annual"))
    return totals.crossJoin(F.broadcast(annual)).select("scenario", "loss", (F.col("loss") / F.col("annual")).alias("factor"))  # a single row


def top_event(events: DataFrame) -> DataFrame:
    """The event that loses most; the one with the smallest id of several."""
    return events.agg(F.min_by("event_id", F.struct(-F.col("loss"), F.col("event_id"))).alias("event_id"), F.max("loss").alias("loss"))


def state_table(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """By class: percent of ``weight`` in each final state, health, and direct, indirect and total damage."""
    w = F.greatest(F.lit(0.0), F.col(weight))
    sums = [money_sum(F.when(F.col("final_state") == s, w).otherwise(0.0)).alias(s.lower()) for s in ("S0", "S1", "S2", "S3")]
    money = [money_sum(F.col(c), 2).alias(f"{c}_eur") for c in ("direct", "indirect", "total")]
    out = rows.groupBy("hazard", key).agg(money_sum(w).alias("w"), *sums, *money)
    pct = [F.round(F.when(F.col("w") > 0, F.col(s) / F.col("w") * 100).otherwise(0.0), 3).alias(f"pct_{s}") for s in ("s0", "s1", "s2", "s3")]
    return out.select("hazard", key, *pct, F.round(S.health(F.col("w"), F.col("s1"), F.col("s2"), F.col("s3")), 6).alias("health"), "direct_eur", "indirect_eur", "total_eur")


def out_of_service(rows: DataFrame, weight: str) -> DataFrame:
    """By hazard and scenario: percent of network weight out of service, directly and by dependency alone, and the total loss."""
    w = F.col(weight)
    total = money_sum(w)
    pct = lambda hit: F.round(money_sum(F.when(hit, w).otherwise(0.0)) / F.greatest(total, F.lit(1e-9)) * 100, 3)
    return rows.groupBy("hazard", "scenario").agg(pct(F.col("state") == "S3").alias("direct_pct"), pct((F.col("state") != "S3") & (F.col("final_state") == "S3")).alias("indirect_pct"), money_sum(F.col("total"), 2).alias("total_eur"))


def catalogue_mass(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct tracks, points and summed track frequency of each block of a catalogue; a block at a time needs no more memory than its own."""
    tracks = rows.groupBy(*by, "track_id").agg(F.count("*").alias("points"), F.max("frequency").alias("frequency"))
    return tracks.groupBy(*by).agg(F.count("*").alias("tracks"), F.sum("points").alias("points"), F.sum(F.col("frequency").cast(metrics.FREQUENCY)).cast("double").alias("frequency"))
