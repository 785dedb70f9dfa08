"""Shares and allocation: breakdowns by class, component ratios, proxy reallocation, cents, stratified samples, fallback factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.codecs import stable_factor
from .impact import money_sum
from .proxy import block_rank

# Fixed values of the fallback engine.
CLASS_FACTORS = {"elec_aerien": 1.2, "elec_souterrain": 0.75, "eau_reseau": 0.95, "eau_ouvrage": 1.08, "habitation": 0.82}
SECOND_HAZARD_FACTOR = 1.24
SPREAD = (0.82, 1.18)
FLOORS = {"S0": 0.0, "S1": 0.07, "S2": 0.20, "S3": 0.45}
CURVE_PERIODS = (2, 5, 10, 20, 50, 100, 200, 250, 500, 750, 1000)


def shares(rows: DataFrame, keys: Sequence[str], by: str, amount: str) -> DataFrame:
    """Each class' share of the key's sum; 0 where the sum isn't positive. Classes are summed first, so windows see few rows."""
    sums = rows.groupBy(*keys, by).agg(money_sum(F.greatest(F.lit(0.0), amount)).alias("amount"))
    total = F.sum(F.col("amount").cast("decimal(24,6)")).over(Window.partitionBy(*keys)).cast("double")
    return sums.withColumn("share", F.when(total > 0, F.col("amount") / total).otherwise(0.0))


def reallocate(rows: DataFrame, proxy: DataFrame, multiplier: float, wind_ratio: float) -> DataFrame:
    """Losses (``point_id``, ``class``, ``value``, ``loss``) scaled to a multi-hazard total and blended towards the proxy's class shares.

    Each class' target is total * multiplier * (wind_ratio * own share + (1 - wind_ratio) * proxy share). Classes with loss are
    rescaled; classes without are spread by value; each point's loss stays within its value.
    """
    clipped = rows.withColumn("loss", F.least(F.greatest(F.lit(0.0), "value"), F.greatest(F.lit(0.0), "loss")))
    sums = clipped.groupBy("class").agg(money_sum(F.col("loss")).alias("own"), money_sum(F.col("value")).alias("capacity"))
    every = sums.join(proxy.select("class", F.col("share").alias("proxy_share")), "class", "left")
    total = F.sum(F.col("own").cast("decimal(24,6)")).over(Window.partitionBy()).cast("double")  # one row for each class
    own_share = F.when(total > 0, F.col("own") / total).otherwise(0.0)
    target = total * multiplier * (wind_ratio * own_share + (1 - wind_ratio) * F.coalesce("proxy_share", F.lit(0.0)))
    plan = every.select("class", "own", "capacity", target.alias("target"))
    joined = clipped.join(F.broadcast(plan), "class")
    scaled = F.when(F.col("own") > 0, F.col("loss") * F.col("target") / F.col("own")).otherwise(F.when(F.col("capacity") > 0, F.col("value") * F.col("target") / F.col("capacity")).otherwise(0.0))
    return joined.select("point_id", "class", "value", F.least(F.greatest(F.lit(0.0), "value"), scaled).alias("loss"))


def stratified_quotas(rows: DataFrame, strata: Sequence[str], total: int) -> DataFrame:
    """How many rows each stratum gives of ``total``: one at least, the rest in proportion (rounded down), never more than it has."""
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    everything = F.sum("n").over(Window.partitionBy())  # one row for each stratum
    return sizes.withColumn("quota", F.least("n", F.greatest(F.lit(1), F.floor(F.lit(total) * F.col("n") / everything))).cast("long"))


def evenly_spaced(rows: DataFrame, strata: Sequence[str], quotas: DataFrame, order: str, block: int = 100_000) -> DataFrame:
    """The quota of each stratum, evenly spaced in its order (a number) from first to last; positions round half to even.

    Ranks go by blocks of the order, counted first, so that no task sorts a stratum. Within a quota no two positions are the same.
    """
    ranked = block_rank(rows, strata, [F.col(order)], F.floor(F.col(order) / block), "__at")
    spots = quotas.select(*strata, F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("k"), "n", "quota")
    place = F.when(F.col("quota") <= 1, 0).otherwise(F.rint(F.col("k") * (F.col("n") - 1) / (F.col("quota") - 1))).cast("long")
    return ranked.join(spots.select(*strata, place.alias("__at")), [*strata, "__at"]).drop("__at")


def fallback_base(n_points: Column, n_features: Column) -> Column:
    """The fallback engine's base damage, from how complex the exposure is."""
    complexity = F.greatest(F.lit(1.0), F.least(F.lit(200.0), n_points / n_features))
    return F.greatest(F.lit(0.045), F.least(F.lit(0.22), 0.055 + 0.008 * F.log10(complexity + 1)))


def fallback_damage(base: Column, infra_class: Column, hazard: Column, seed: Column) -> Column:
    """Base damage times the factors of class, hazard and a stable one of the seed (``feature|hazard|class``), within 0 and 0.95."""
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_FACTORS.items() for x in kv]), infra_class), F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.95), base * factor * F.when(hazard == "storm_cmcc", SECOND_HAZARD_FACTOR).otherwise(1.0) * stable_factor(seed, *SPREAD)))


def water_damage(direct: Column, dependency: Column, health: Column) -> Column:
    """Damage of a water asset, at least its dependency's floor, more where electricity fails."""
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv]), dependency)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.greatest(direct, floor) + (1 - health) * 0.12))


def frequency_curve(total: Column, ratio: Column, lifetime: Column, periods: Sequence[int] = CURVE_PERIODS) -> Column:
    """A synthetic exceedance curve: an array of (return_period, loss)."""
    loss = lambda rp: F.round(total * ratio / F.sqrt(rp.cast("double")) * (1 + lifetime / 100 * 0.35), 2)
    return F.transform(F.array(*[F.lit(p) for p in periods]), lambda rp: F.struct(rp.alias("return_period"), loss(rp).alias("loss")))


def component_ratios(rows: DataFrame, keys: Sequence[str] = ("hazard",)) -> DataFrame:
    """Wind, rain and surge shares of the summed impact by key."""
    parts = [money_sum(F.when(F.col("component") == c, F.col("eai")).otherwise(0.0)).alias(f"__{c}") for c in ("wind", "rain", "surge")]
    out = rows.groupBy(*keys).agg(*parts)
    ratios = S.ratio_map(F.col("__wind"), F.col("__rain"), F.col("__surge"))
    return out.select(*keys, *[r.alias(c) for r, c in zip(ratios, ("wind", "rain", "surge"), strict=True)])
