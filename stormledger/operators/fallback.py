"""The engine without hazards: each feature's damage follows from its class, the hazard and a stable factor of its own.

Electricity's health by territory comes of the features' weights; water features take the damage floor of their electricity's
state. Annual impacts are fixed shares of the final damage, and event losses fixed multiples of the annual impact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..lineage import settled
from . import interdependency as dep
from . import shares
from .impact import money_sum, steady_mean

# Hazards, their annual share of damage and largest event; multiples of the annual impact; periods of the chart's curve;
# the name of features without a place.
HAZARDS = ("storm", "storm_cmcc")
ANNUAL = {"storm": 0.22, "storm_cmcc": 0.25}
LARGEST = {"storm": 4.5, "storm_cmcc": 4.9}
MULTIPLES = {"pml_10": 2.3, "pml_20": 2.0, "pml_50": 1.7, "pml_100": 1.45, "pml_200": 1.25, "pml_1000": 1.9, "tvar95": 1.8}
CHART_PERIODS = (1, 2, 5, 10, 20, 30, 50, 75, 100, 150, 200)
LIFETIMES = {"annual": 0, "lifetime_30": 30, "lifetime_50": 50}
AGGREGATE = "uploaded-aggregate"
AMOUNTS = {"value": "exposure", "direct": "direct_eai", "indirect": "indirect_eai", "total": "total_eai"}


@dataclass(frozen=True)
class Fallback:
    """A run's tables: features by hazard, results by territory, asset and portfolio, health by class, and what dependency did."""

    features: DataFrame
    territories: DataFrame
    assets: DataFrame
    portfolio: DataFrame
    delta: DataFrame
    component_health: DataFrame
    interdependency: DataFrame
    resolution: DataFrame
    curves: DataFrame


def _of_hazard(table: dict[str, float]) -> Column:
    return F.when(F.col("hazard") == HAZARDS[1], table[HAZARDS[1]]).otherwise(table[HAZARDS[0]])


def damaged(features: DataFrame) -> DataFrame:
    """Each feature in each hazard with ``damage`` and ``state``. How complex the exposure is, is the number of sample points to a feature."""
    size = features.agg((F.sum(F.coalesce("n_points", F.lit(0))) / F.greatest(F.count("*"), F.lit(1))).alias("__size"))
    rows = features.crossJoin(F.broadcast(size)).withColumn("hazard", F.explode(F.array(*[F.lit(h) for h in HAZARDS])))  # a single row
    seed = F.concat_ws("|", F.col("feature_id").cast("string"), "hazard", "infra_class")
    rows = rows.withColumn("damage", shares.fallback_damage(shares.fallback_base(F.col("__size"), F.lit(1.0)), F.col("infra_class"), F.col("hazard"), seed)).drop("__size")
    return rows.withColumn("value", F.greatest(F.lit(0.0), "value")).withColumn("territory", F.coalesce("territory", F.lit(AGGREGATE))).withColumn("state", S.damage_state(F.col("damage")))


def dependent(rows: DataFrame) -> DataFrame:
    """Rows with ``health`` and ``tier`` of their electricity, ``final`` damage and state, and annual impacts. Only water depends on it."""
    water = F.col("infra_class").isin(*dep.WATER)
    weighed = rows.select("hazard", "territory", "infra_class", "lat", "lon", "state", F.col("weight").alias("value"))
    places = rows.where(water).select("hazard", "territory", "lat", "lon").distinct()
    resolved = dep.resolve_health(places, dep.electric_health(weighed)).select("hazard", "territory", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), "health", "tier")
    same = [rows.hazard == resolved.hazard, rows.territory == resolved.territory, rows.lat.eqNullSafe(resolved["__lat"]), rows.lon.eqNullSafe(resolved["__lon"]), rows.infra_class.isin(*dep.WATER)]
    met = rows.join(resolved, same, "left").select(*[rows[c] for c in rows.columns], "health", "tier")
    met = met.withColumn("dependency", F.when(water, S.dependency_state(F.coalesce("health", F.lit(1.0)))).otherwise("S0"))
    met = met.withColumn("final_state", F.greatest("state", "dependency"))  # the names sort by severity
    met = met.withColumn("final", F.when(water, shares.water_damage(F.col("damage"), F.col("dependency"), F.coalesce("health", F.lit(1.0)))).otherwise(F.col("damage")))
    annual = lambda c: F.least("value", F.col("value") * F.col(c) * _of_hazard(ANNUAL))
    met = met.withColumn("direct", annual("damage")).withColumn("total", F.greatest("direct", annual("final")))
    return met.withColumn("indirect", F.col("total") - F.col("direct"))


def summed(rows: DataFrame, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """Exposure and annual impacts by key, in cents, and the risk index of the unrounded sums."""
    sums = rows.groupBy(*keys).agg(*[money_sum(F.col(c)).alias(n) for c, n in AMOUNTS.items()], *more)
    index = F.round(S.risk_index(F.col("total_eai"), F.col("exposure")), 2).alias("risk_index")
    extra = [c for c in sums.columns if c not in (*keys, *AMOUNTS.values())]
    return sums.select(*keys, *extra, *[F.round(F.col(n).cast("decimal(28,8)"), 2).cast("double").alias(n) for n in AMOUNTS.values()], index)


def portfolio_of(territories: DataFrame) -> DataFrame:
    """Sums of the rounded rows by hazard; the largest event, return-period losses and tail value are multiples of the total."""
    sums = territories.groupBy("hazard").agg(*[F.sum(F.col(n).cast("decimal(28,2)")).cast("double").alias(n) for n in AMOUNTS.values()])
    return sums.select("hazard", *AMOUNTS.values(), F.round(F.col("total_eai") * _of_hazard(LARGEST), 2).alias("max_event"), *[F.round(F.col("total_eai") * m, 2).alias(n) for n, m in MULTIPLES.items()])


def chart_curves(portfolio: DataFrame) -> DataFrame:
    """Exceedance curves for charts, annual and for lifetimes of 30 and 50 years: total * share / sqrt(period), more over a lifetime."""
    ratio = F.col("total_eai") / F.greatest("exposure", F.lit(1.0))
    rows = portfolio.select("hazard", "exposure", ratio.alias("ratio"), F.explode(F.array(*[F.lit(p) for p in CHART_PERIODS])).alias("return_period"))
    loss = F.col("exposure") * F.col("ratio") * (1.0 / F.sqrt(F.col("return_period").cast("double")))
    return rows.select("hazard", "return_period", *[F.round(loss * (1.0 + years / 100.0 * 0.35), 2).alias(n) for n, years in LIFETIMES.items()])


def fallback_run(features: DataFrame) -> Fallback:
    """The whole engine over ``features``: ``feature_id``, ``territory``, ``lat``, ``lon``, ``infra_class``, ``value``, ``weight``, ``n_points`` (sample points of it).

    Negative values count as 0. Features without a place belong to one territory. Columns ``label``, ``geometry_type`` and ``asset_type`` go
    through to the assets' results where there are any. Without features there is one territory of nothing.
    """
    rows = settled(dependent(settled(damaged(features))))
    territories = summed(rows, "hazard", "territory", more=(steady_mean(F.col("lat")).alias("lat"), steady_mean(F.col("lon")).alias("lon")))
    territories = settled(territories)
    if territories.isEmpty():
        nothing = [(h, AGGREGATE, None, None, 0.0, 0.0, 0.0, 0.0, 0.0) for h in HAZARDS]
        territories = features.sparkSession.createDataFrame(nothing, territories.schema)
    names = tuple(F.min(c).alias(c) for c in ("label", "geometry_type", "asset_type") if c in features.columns)
    portfolio = settled(portfolio_of(territories))
    by_name = {h: F.max(F.when(F.col("hazard") == h, F.col("total_eai"))) for h in HAZARDS}
    pair = portfolio.agg(by_name[HAZARDS[0]].alias("a"), by_name[HAZARDS[1]].alias("b"))
    delta = pair.select(F.round(F.col("b") - F.col("a"), 2).alias("eai"), F.round((F.col("b") / F.greatest("a", F.lit(1.0)) - 1.0) * 100.0, 2).alias("eai_pct"))
    in_state = [F.round(money_sum(F.when(F.col("final_state") == s, F.col("weight")).otherwise(0.0)), 4).alias(s.lower()) for s in ("S1", "S2", "S3")]
    buckets = rows.groupBy("hazard", "infra_class").agg(money_sum(F.col("weight")).alias("w"), *[money_sum(F.when(F.col("final_state") == s, F.col("weight")).otherwise(0.0)).alias(f"w{s}") for s in ("S1", "S2", "S3")], *in_state, F.count("*").alias("n_assets"))
    component_health = buckets.select("hazard", "infra_class", F.round(S.health(F.col("w"), F.col("wS1"), F.col("wS2"), F.col("wS3")), 4).alias("health"), F.round("w", 4).alias("total"), "s1", "s2", "s3", "n_assets")
    electric = F.col("infra_class").isin(*dep.ELECTRIC)
    of_electric = lambda s: F.coalesce(money_sum(F.when(electric & (F.col("state") == s), F.col("weight"))), F.lit(0.0))
    overall = S.health(F.coalesce(money_sum(F.when(electric, F.col("weight"))), F.lit(0.0)), of_electric("S1"), of_electric("S2"), of_electric("S3"))
    interdependency = rows.groupBy("hazard").agg(F.count_if(F.col("dependency") > F.col("state")).alias("impacted_assets"), F.round(overall, 4).alias("electric_health"))
    resolution = rows.where("tier is not null").groupBy("hazard", "tier").agg(F.count("*").alias("n"))
    return Fallback(rows, territories, summed(rows, "hazard", "feature_id", more=names), portfolio, delta, component_health, interdependency, resolution, chart_curves(portfolio))


def figures(done: Fallback) -> DataFrame:
    """All of a run's figures in long form: ``part``, ``hazard``, ``name``, ``figure``, ``amount``."""
    out = None
    parts = {"territory": (done.territories, "territory"), "portfolio": (done.portfolio, None), "component_health": (done.component_health, "infra_class"), "interdependency": (done.interdependency, None), "resolution": (done.resolution, "tier"), "curve": (done.curves, "return_period"), "delta": (done.delta.withColumn("hazard", F.lit("")), None)}
    for part, (df, name) in parts.items():
        own = [c for c in df.columns if c not in ("hazard", name)]
        rows = df.select(F.lit(part).alias("part"), "hazard", (F.col(name).cast("string") if name else F.lit("")).alias("name"), *[F.col(c).cast("double").alias(c) for c in own]).unpivot(["part", "hazard", "name"], own, "figure", "amount")
        out = rows if out is None else out.unionByName(rows)
    return out
