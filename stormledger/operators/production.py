"""The whole run: exposure points through hazards and curves, interdependency, portfolio, document."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import settled
from . import impact, metrics, multihazard
from . import interdependency as dep

ENGINES = ("auto", "full", "fallback")


@dataclass(frozen=True)
class Run:
    """A run's tables."""

    points: DataFrame
    events: DataFrame
    territories: DataFrame
    portfolio: DataFrame
    risk: DataFrame


def propagated(points: DataFrame) -> DataFrame:
    """Points with direct impacts after the resolution of electric health and its propagation."""
    direct = dep.with_direct(points)
    places = direct.groupBy("hazard", "territory").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return dep.propagate(direct, dep.resolve_health(places, dep.electric_health(direct)))


def risk(events: DataFrame, portfolio: DataFrame) -> DataFrame:
    """By hazard: return-period losses, tail value and largest event, scaled; 1000 years is the larger of 200 years and the largest event."""
    levels = metrics.pml(events, ("hazard",)).groupBy("hazard").pivot("return_period", list(metrics.RETURN_PERIODS)).agg(F.first("loss"))
    tails = metrics.tvar(events, ("hazard",)).select("hazard", "tvar")
    most = events.groupBy("hazard").agg(F.max("loss").alias("max_event"))
    rows = portfolio.select("hazard", "scaler").join(tails, "hazard", "left").join(most, "hazard", "left").join(levels, "hazard", "left")
    pml = {f"pml_{p}": F.col(str(p)) for p in metrics.RETURN_PERIODS}
    names = pml | {"pml_1000": F.greatest("200", "max_event"), "tvar95": F.col("tvar"), "max_event": F.col("max_event")}
    return rows.select("hazard", *[F.round(F.coalesce(c, F.lit(0.0)) * F.col("scaler"), 2).alias(n) for n, c in names.items()])


def run(points: DataFrame, hazard: DataFrame, damage: Column) -> Run:
    """Points (``point_id``, ``asset_id``, ``territory``, ``infra_class``, ``value``, ``lat``, ``lon``, ``centroid_id``) in a hazard table (``hazard``, ``event_id``, ``centroid_id``,
    ``intensity``, ``frequency``): losses by the damage expression (of the hazard's columns), then everything that follows from them. Points without losses stay.
    """
    points = settled(points.withColumn("value", F.greatest(F.lit(0.0), "value")))
    events, each = impact.by_centroid(points, hazard, damage)
    return completed(points, each, events, hazard.select("hazard").distinct())


def run_components(points: DataFrame, components: Mapping[str, multihazard.Component], capped: bool = False) -> tuple[Run, DataFrame]:
    """The same for hazards of several components, each with its own events, centroids and curves; also the risk by (``hazard``, ``component``)."""
    points = points.withColumn("value", F.greatest(F.lit(0.0), "value"))
    found = multihazard.impacts(points, components, capped)
    events = found.events.where(F.col("component") == multihazard.COMBINED).drop("component")
    return completed(points, found.points.drop("value"), events, found.catalogue.select("hazard").distinct()), found.risk()


def completed(points: DataFrame, each: DataFrame, events: DataFrame, hazards: DataFrame) -> Run:
    """From ``eai`` and ``max_loss`` by (``hazard``, ``point_id``) and losses by (``hazard``, ``event_id``) to a run's tables.

    Hazards, event losses, impacts by point and results by territory are settled: each is read by several figures.
    """
    events, each, hazards = settled(events), settled(each), settled(hazards)
    rows = points.crossJoin(F.broadcast(hazards)).join(each, ["hazard", "point_id"], "left").fillna(0.0, subset=["eai", "max_loss"])  # a row a hazard
    after = settled(propagated(rows))
    territories = settled(dep.territory_results(after))
    portfolio = dep.portfolio_results(territories)
    return Run(after, events, territories, portfolio, risk(events, portfolio))


def choose_engine(asked: str, has_hazard: bool, allow_fallback: bool = True) -> str:
    """``full`` or ``fallback``: the latter if asked for, or if hazards are missing and it's allowed."""
    if asked not in ENGINES:
        raise ValueError(f"{asked}: give one of {', '.join(ENGINES)}")
    if asked == "fallback" or not has_hazard:
        if not allow_fallback:
            raise ValueError("the fallback engine isn't allowed")
        return "fallback"
    return "full"


def figures(done: Run) -> DataFrame:
    """All of a run's figures in long form: ``part``, ``hazard``, ``name``, ``figure``, ``amount``."""
    t = done.territories.select(F.lit("territory").alias("part"), "hazard", F.col("territory").cast("string").alias("name"), "exposure", "direct_eai", "indirect_eai", "total_eai", "risk_index")
    p = done.portfolio.withColumn("part", F.lit("portfolio")).withColumn("name", F.lit(""))
    r = done.risk.withColumn("part", F.lit("risk")).withColumn("name", F.lit(""))
    long = lambda df: df.unpivot(["part", "hazard", "name"], [c for c in df.columns if c not in ("part", "hazard", "name")], "figure", "amount")
    return long(t).unionByName(long(p)).unionByName(long(r))


def document(done: Run, run_id: str, label: str) -> DataFrame:
    """The result document as JSON text: one row for each object of its parts, in the order of ``part`` and ``at``; Spark writes them as they are.

    Parts are the run's head, territories by exposure, portfolio, risk and charts' series. No part passes the driver.
    """
    one = done.portfolio.sparkSession.range(1).select(F.lit("meta").alias("part"), F.lit("").alias("at"), F.to_json(F.struct(F.lit(run_id).alias("run_id"), F.lit(label).alias("label"))).alias("json"))
    for name, df, at in (("territory_results", done.territories, "territory"), ("portfolio_results", done.portfolio, "hazard"), ("risk", done.risk, "hazard"), ("graphs", fec_series(done.risk), "hazard")):
        one = one.unionAll(df.select(F.lit(name).alias("part"), F.col(at).cast("string").alias("at"), F.to_json(F.struct("*")).alias("json")))
    return one


def fec_series(risk_: DataFrame) -> DataFrame:
    """Exceedance series for charts: damage by return period, annual and for lifetimes of 30 and 50 years."""
    names = [f"pml_{p}" for p in metrics.RETURN_PERIODS]
    long = risk_.select("hazard", *names).unpivot(["hazard"], names, "p", "annual").withColumn("return_period", F.substring("p", 5, 9).cast("int"))
    return long.select("hazard", "return_period", "annual", F.round(F.col("annual") * 1.105, 2).alias("lifetime_30"), F.round(F.col("annual") * 1.175, 2).alias("lifetime_50"))
