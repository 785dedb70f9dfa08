"""Electricity to water: damage states, health by territory and overall, propagation, results by territory, asset, portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..lineage import settled
from .impact import money_sum, steady_mean
from .nearest import nearest_on_earth

WATER = ("eau_reseau", "eau_ouvrage")
ELECTRIC = ("elec_aerien", "elec_souterrain")


def with_direct(points: DataFrame) -> DataFrame:
    """``direct`` (impact within the value) and ``state`` for points with ``value``, ``eai`` and ``max_loss``."""
    value = F.greatest(F.lit(0.0), "value")
    rows = points.withColumn("value", value).withColumn("direct", F.least("value", F.greatest(F.lit(0.0), "eai")))
    return rows.withColumn("state", S.damage_state(F.greatest(F.lit(0.0), "max_loss") / F.greatest("value", F.lit(1.0))))


def electric_health(points: DataFrame) -> DataFrame:
    """Health of electric points by (hazard, territory) and by hazard (territory null), in one pass over grouping sets."""
    name = "state"
    rows = points.where(F.col("infra_class").isin(*ELECTRIC))
    sums = [money_sum(F.when(F.col(name) == s, F.col("value")).otherwise(0.0)).alias(s.lower()) for s in ("S1", "S2", "S3")]
    grouped = rows.groupingSets([["hazard", "territory"], ["hazard"]], "hazard", "territory").agg(money_sum(F.col("value")).alias("total"), *sums, F.count("*").alias("n"), steady_mean(F.col("lat")).alias("lat"), steady_mean(F.col("lon")).alias("lon"), F.grouping("territory").alias("overall"))
    return grouped.withColumn("health", S.health(F.col("total"), F.col("s1"), F.col("s2"), F.col("s3")))


def nearest_health(lost: DataFrame, known: DataFrame) -> DataFrame:
    """For each (hazard, territory, lat, lon) of ``lost`` the ``near`` health of the nearest of ``known`` (hazard, other, olat, olon, other_health), however far.

    Ties within a millionth of a kilometre go to the smaller territory.
    """
    asked = lost.select(F.struct("hazard", "territory", "lat", "lon").alias("ask"), "hazard", "lat", "lon")
    there = known.select(F.struct("other", "other_health").alias("other"), "hazard", F.col("olat").alias("lat"), F.col("olon").alias("lon"))
    found = nearest_on_earth(asked, there, ["hazard"])
    return found.select("ask.hazard", "ask.territory", "ask.lat", "ask.lon", F.col("other.other_health").alias("near"))


def resolve_health(territories: DataFrame, health: DataFrame) -> DataFrame:
    """Health for each (hazard, territory, lat, lon): the territory's own, else the nearest electric territory's, else the overall one, else 1.

    Works on distinct places (not on points): the nearest one is looked for only where a territory has no electric points.
    Both tables are settled, as each step of the search reads them.
    """
    health = settled(health)
    own = health.where("overall = 0").select("hazard", "territory", F.col("health").alias("own"))
    overall = health.where("overall = 1").select("hazard", F.col("health").alias("overall_health"))
    asked = settled(territories.join(own, ["hazard", "territory"], "left"))
    known = health.where("overall = 0 and lat is not null and lon is not null").select("hazard", F.col("territory").alias("other"), F.col("lat").alias("olat"), F.col("lon").alias("olon"), F.col("health").alias("other_health"))
    lost = asked.where("own is null and lat is not null and lon is not null")
    asked = asked.withColumn("near", F.lit(None).cast("double")) if lost.isEmpty() else asked.join(nearest_health(lost, known), ["hazard", "territory", "lat", "lon"], "left")
    out = asked.join(overall, "hazard", "left")
    tier = F.when(F.col("own").isNotNull(), "local").when(F.col("near").isNotNull(), "nearest").otherwise("global")
    return out.select(*territories.columns, F.coalesce("own", "near", "overall_health", F.lit(1.0)).alias("health"), tier.alias("tier"))


def propagate(points: DataFrame, resolved: DataFrame) -> DataFrame:
    """Points with ``dependency``, ``final_state``, ``indirect`` and ``total``: water depends on electric health, nothing else does."""
    rows = points.join(resolved.select("hazard", "territory", "health"), ["hazard", "territory"], "left")
    water = F.col("infra_class").isin(*WATER)
    rows = rows.withColumn("dependency", F.when(water, S.dependency_state(F.coalesce("health", F.lit(1.0)))).otherwise("S0"))
    rows = rows.withColumn("final_state", F.greatest("state", "dependency"))  # the names sort by severity
    rows = rows.withColumn("total", F.least("value", F.col("direct") + F.col("direct") * S.uplift(F.col("dependency"))))
    return rows.withColumn("indirect", F.col("total") - F.col("direct"))


def territory_results(rows: DataFrame) -> DataFrame:
    """Exposure, impacts by hazard rounded to cents, and risk index of each (territory, hazard)."""
    out = rows.groupBy("hazard", "territory").agg(*[money_sum(F.col(c), 2).alias(n) for c, n in (("value", "exposure"), ("direct", "direct_eai"), ("indirect", "indirect_eai"), ("total", "total_eai"))])
    return out.withColumn("risk_index", F.round(S.risk_index(F.col("total_eai"), F.col("exposure")), 2))


def asset_results(rows: DataFrame) -> DataFrame:
    """Impacts of each asset (of its points together) with its worst state."""
    return rows.groupBy("hazard", "asset_id").agg(
        money_sum(F.col("value"), 2).alias("exposure"), money_sum(F.col("direct"), 2).alias("direct_eai"), money_sum(F.col("total"), 2).alias("total_eai"), F.max("final_state").alias("state"), F.min_by("infra_class", "point_id").alias("infra_class")
    )


def portfolio_results(territories: DataFrame) -> DataFrame:
    """Sums of the rounded territory rows by hazard, and the scaler from direct to total."""
    sums = {c: F.round(F.sum(F.col(c).cast("decimal(24,2)")).cast("double"), 2).alias(c) for c in ("exposure", "direct_eai", "indirect_eai", "total_eai")}
    out = territories.groupBy("hazard").agg(*sums.values())
    return out.withColumn("scaler", F.round(F.col("total_eai") / F.greatest("direct_eai", F.lit(1.0)), 6))


def component_health(rows: DataFrame) -> DataFrame:
    """Health by class of infrastructure, from the final states."""
    sums = [money_sum(F.when(F.col("final_state") == s, F.col("value")).otherwise(0.0)).alias(s.lower()) for s in ("S1", "S2", "S3")]
    out = rows.groupBy("hazard", "infra_class").agg(money_sum(F.col("value")).alias("total"), *sums)
    return out.select("hazard", "infra_class", F.round(S.health(F.col("total"), F.col("s1"), F.col("s2"), F.col("s3")), 4).alias("health"))


def dependent_assets(rows: DataFrame) -> DataFrame:
    """Distinct assets by hazard that a dependency reaches."""
    return rows.where("dependency <> 'S0' and indirect > 0").groupBy("hazard").agg(F.countDistinct("asset_id").alias("n_assets"))


def state_shares(rows: DataFrame, key: str = "infra_class") -> DataFrame:
    """Percent of value in each final state, by class."""
    total = money_sum(F.col("value"))
    return rows.groupBy("hazard", key).agg(*[F.round(F.when(total > 0, money_sum(F.when(F.col("final_state") == s, F.col("value")).otherwise(0.0)) / total * 100).otherwise(0.0), 3).alias(f"pct_{s.lower()}") for s in ("S0", "S1", "S2", "S3")])


def states_wide(rows: DataFrame, hazards: list[str]) -> DataFrame:
    """The worst state of each asset, one column for each hazard; S0 where there is none."""
    return rows.groupBy("asset_id").pivot("hazard", hazards).agg(F.max("final_state")).fillna("S0")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
