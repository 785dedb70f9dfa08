"""What is told of runs: their journal entries, the run a label means, the summary of a run's impacts, centroids' winds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .impact import money_sum

#: Scenarios of a run's summary and the column that tells each one's loss. Fixed names.
TOTALS = {
    "annual": "eai_total_eur",
    "rp50": "rp50_total_loss_eur",
    "rp100": "rp100_total_loss_eur",
    "event_max": "event_max_total_loss_eur",
    "top10": "top10_total_loss_eur",
    "top5": "top5_total_loss_eur",
}


def run_entries(events: DataFrame, keys: Sequence[str] = ("territory", "hazard"), loss: str = "loss", frequency: str = "frequency") -> DataFrame:
    """One journal entry for each key: summed frequency, number of events, losses at 50 and 100 years (0 where no event loses)."""
    sums = events.groupBy(*keys).agg(F.sum(F.col(frequency).cast(metrics.FREQUENCY)).alias("f"), F.count("*").alias("n_events"))
    levels = metrics.pml(events, keys, (50, 100), loss, frequency).groupBy(*keys).agg(*[F.max(F.when(F.col("return_period") == rp, F.col("loss"))).alias(f"pml_{rp}") for rp in (50, 100)])
    rows = sums.join(levels, list(keys), "left")
    entry = [F.round(F.coalesce(f"pml_{rp}", F.lit(0.0)), 2).alias(f"pml_{rp}") for rp in (50, 100)]
    return rows.select(*keys, F.round(F.coalesce(F.col("f").cast("double"), F.lit(0.0)), 8).alias("sum_event_frequency"), "n_events", *entry)


def run_of_label(runs: DataFrame, asked: str, label: str, order: Sequence[Column]) -> DataFrame:
    """The run that a label means, at most one row: the first in ``order`` of those with just this label, else of those whose label contains it.

    Case and outer blanks don't count. An empty label means no run; null labels match nothing.
    """
    text = asked.strip().lower()
    name = F.lower(F.col(label))
    found = runs.where(name.contains(text) if text else F.lit(False))
    return found.orderBy((name == text).desc(), *order).limit(1)


def impact_summary(rows: DataFrame) -> DataFrame:
    """One row for each hazard: percent of the networks' weight out of service in the annual and in the largest event's scenario,
    directly (state S3) and through others, and the loss of each scenario.

    ``rows`` has hazard, scenario, weight, network, counted (both boolean: a network's part, a part whose loss counts), direct_state,
    indirect_s3 and loss, one row for each feature and scenario. Without weight a percentage is 0, and so is an absent scenario's loss.
    """
    out = []
    for scenario in ("annual", "event_max"):
        here = F.col("network") & (F.col("scenario") == scenario)
        total = money_sum(F.when(here, F.col("weight")))
        for kind, hit in (("direct", F.col("direct_state") == "S3"), ("indirect", F.col("indirect_s3"))):
            share = money_sum(F.when(here & hit, F.col("weight"))) / F.greatest(total, F.lit(1e-9)) * 100
            out.append(F.round(F.coalesce(share, F.lit(0.0)), 3).alias(f"{kind}_hs_pct_{scenario}"))
    losses = [F.round(F.coalesce(money_sum(F.when(F.col("counted") & (F.col("scenario") == s), F.col("loss"))), F.lit(0.0)), 2).alias(n) for s, n in TOTALS.items()]
    return rows.groupBy("hazard").agg(*out, *losses)


def centroid_summary(values: DataFrame, centroids: DataFrame, key: str = "point_id", value: str = "value", frequency: str = "frequency") -> DataFrame:
    """Each centroid's mean weighted by frequency, 50- and 100-year levels, largest value and number of positive finite values; all 0 where it has none.

    Negative or missing frequencies weigh nothing. A centroid whose frequencies are all nothing has even weights of 1.
    """
    v = F.col(value)
    kept = values.where((v > 0) & ~F.isnan(v) & (v < float("inf"))).select(key, v.cast("double").alias("v"), F.greatest(F.lit(0.0), F.coalesce(F.col(frequency), F.lit(0.0))).cast(metrics.FREQUENCY).alias("w"))
    weights = kept.groupBy(key).agg(F.sum("w").alias("t"))
    rows = kept.join(weights, key).select(key, "v", F.when(F.col("t") > 0, F.col("w")).otherwise(F.lit(1)).cast(metrics.FREQUENCY).alias("w"))
    each = metrics.running_frequency(rows, (key,), "v", "w")
    at = [F.coalesce(F.max(F.when(F.col("cum") >= (F.lit(1).cast(metrics.FREQUENCY) / F.lit(rp)).cast(metrics.FREQUENCY), F.col("v"))), F.lit(0.0)).alias(f"rp{rp}") for rp in (50, 100)]
    mean = F.sum(F.col("v").cast("decimal(24,6)") * F.col("f").cast("decimal(14,8)")).cast("double") / F.sum("f").cast("double")
    told = each.groupBy(key).agg(mean.alias("mean"), *at, F.max("v").alias("event_max"), F.sum("n").alias("sample_count"))
    return centroids.select(key).join(told, key, "left").fillna(0)
