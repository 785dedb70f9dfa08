"""Case-study results: scenarios as rows, scaled portfolio risk, derived return periods, coherence of artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from .impact import money_sum

RP50_OF_RP100 = 0.86


def class_scenarios(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Losses of each class in each scenario (annual, rp50, rp100, event_max), within the class' value."""
    events = rows.groupBy("class", "event_id").agg(money_sum(F.col("loss")).alias("loss"), F.max("frequency").alias("frequency"))
    annual = rows.groupBy("class").agg(money_sum(F.col("loss") * F.col("frequency")).alias("loss")).select("class", F.lit("annual").alias("scenario"), "loss")
    periods = metrics.clamped_loss(events, ("class",), (50, 100)).select("class", F.concat(F.lit("rp"), "return_period").alias("scenario"), "loss")
    most = events.groupBy("class").agg(F.max("loss").alias("loss")).select("class", F.lit("event_max").alias("scenario"), "loss")
    return annual.unionByName(periods).unionByName(most).join(values, "class").select("class", "scenario", F.least("loss", F.greatest("value", F.lit(0.0))).alias("loss"))


def portfolio_risk(events: DataFrame, scaler: DataFrame) -> DataFrame:
    """One row: largest event, tail value and return-period losses, scaled by a one-row ``scaler``; 1000 years is the larger of 200 years and the largest event."""
    levels = metrics.pml(events).groupBy().pivot("return_period", list(metrics.RETURN_PERIODS)).agg(F.first("loss"))
    levels = levels.select(*[F.col(str(p)).alias(f"pml_{p}") for p in metrics.RETURN_PERIODS])
    one = levels.crossJoin(metrics.tvar(events, ())).crossJoin(events.agg(F.max("loss").alias("max_event"))).crossJoin(scaler)
    names = [f"pml_{p}" for p in metrics.RETURN_PERIODS]
    out = one.withColumn("pml_1000", F.greatest("pml_200", "max_event"))
    return out.select(*[F.round(F.col(c) * F.col("scaler"), 2).alias(c) for c in (*names, "pml_1000", "tvar", "max_event")])


def derived_rp50(rp100: Column) -> Column:
    """A 50-year loss from the 100-year one where the former is missing."""
    return F.when(rp100 > 0, RP50_OF_RP100 * rp100).otherwise(0.0)


def scenario_loss(scenario: Column, annual: Column, rp50: Column, rp100: Column, most: Column) -> Column:
    """The figure that a scenario stands for."""
    return F.when(scenario == "annual", annual).when(scenario == "rp50", rp50).when(scenario == "rp100", rp100).otherwise(most)


def top_scenarios(events: DataFrame, keys: tuple[str, ...], fractions: dict[str, float]) -> DataFrame:
    """Mean losses of the largest fractions of events, one row for each key and named fraction."""
    out = None
    for name, fraction in fractions.items():
        part = metrics.mean_top_fraction(events, keys, fraction).select(*keys, F.lit(name).alias("scenario"), "mean_loss")
        out = part if out is None else out.unionByName(part)
    return out


def retention(runs: DataFrame, now: str, most: int) -> DataFrame:
    """``state`` of each run (``run_id``, ``created``, ``terminal``): ``expired`` if created by ``now``; of the others the oldest terminal ones are
    ``pruned`` as long as more than ``most`` remain; the rest is ``kept``.

    How many go is known from counts; only as many of the oldest are ranked.
    """
    expired = F.col("created") <= F.to_timestamp(F.lit(now))
    alive = runs.where(~expired)
    extra = alive.agg(F.greatest(F.lit(0), F.count("*") - most).alias("extra"))
    blocks = alive.where("terminal").groupBy(F.to_date("created").alias("day")).agg(F.count("*").alias("n"))
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a day
    ranked = alive.where("terminal").withColumn("day", F.to_date("created")).join(before, "day")
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy("created", "run_id")))
    pruned = ranked.crossJoin(F.broadcast(extra)).where("rank <= extra").select("run_id", F.lit(True).alias("pruned"))
    state = F.when(expired, "expired").when(F.col("pruned"), "pruned").otherwise("kept")
    return runs.join(pruned, "run_id", "left").withColumn("state", state).drop("pruned")


def coherent(artefacts: DataFrame) -> DataFrame:
    """By territory: whether all artefacts have one run id and their times don't run backwards in the order of ``step``."""
    order = Window.partitionBy("territory").orderBy("step")
    late = artefacts.withColumn("back", F.col("at") < F.lag("at").over(order))
    return late.groupBy("territory").agg((F.countDistinct("run_id") == 1).alias("one_run"), (~F.coalesce(F.max("back"), F.lit(False))).alias("ordered"))
