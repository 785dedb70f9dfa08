"""Risk metrics over event losses: return-period losses in three variants, tail value at risk, top fractions, top events.

Cumulated frequencies are decimals, so that a return period falls on the same event in any order of summation. Events with
the same loss can't change a result's value, so losses are aggregated first: one row for each key and distinct loss. Those go into
blocks by the size of the loss; the blocks' totals are cumulated and the running sums go by key and block, so that neither a
key with very many events nor the whole table is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RETURN_PERIODS = (10, 20, 50, 100, 200)
FREQUENCY = "decimal(38,18)"


#: Blocks to a doubling of the loss.
BLOCKS = 32


def running_frequency(events: DataFrame, keys: Sequence[str] = (), loss: str = "loss", frequency: str = "frequency", descending: bool = True) -> DataFrame:
    """One row for each key and distinct loss: ``f`` and ``n``, its events' frequency and number, and ``cum`` and ``rank``, those of all
    events that lose as much or more (with ``descending=False``: as little or less).

    Null losses come last. Blocks go by the loss' logarithm, negative losses before zero, so they need no look at the data.
    """
    size = F.floor(F.log2(1 + F.abs(F.col(loss))) * BLOCKS) * F.signum(F.col(loss))
    each = events.groupBy(*keys, loss).agg(F.sum(F.col(frequency).cast(FREQUENCY)).cast(FREQUENCY).alias("f"), F.count("*").alias("n"))
    each = each.withColumn("__block", F.coalesce((-size if descending else size).cast("long"), F.lit(2**62)))
    totals = each.groupBy(*keys, "__block").agg(F.sum("f").alias("__t"), F.sum("n").alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as blocks
    totals = totals.select(*keys, "__block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o) for c, o in (("__t", "__f0"), ("__m", "__n0"))])
    within = Window.partitionBy(*keys, "__block").orderBy(F.desc(loss) if descending else F.asc_nulls_last(loss)).rowsBetween(Window.unboundedPreceding, 0)
    rows = each.join(totals, [*keys, "__block"])
    return rows.select(*keys, loss, "f", "n", (F.sum("f").over(within) + F.col("__f0")).cast(FREQUENCY).alias("cum"), (F.sum("n").over(within) + F.col("__n0")).alias("rank"))


def _at_return_periods(cumulated: DataFrame, keys: Sequence[str], loss: str, periods: Sequence[int], beyond: str) -> DataFrame:
    """The loss of the first event whose cumulated frequency reaches 1 / period, one row for each key and period."""
    rp = F.explode(F.array(*[F.lit(p) for p in periods]))
    target = (F.lit(1).cast(FREQUENCY) / F.greatest(F.col("return_period"), F.lit(1))).cast(FREQUENCY)
    hit = F.max(F.when(F.col("cum") >= target, F.col(loss)))
    rows = cumulated.select(*keys, loss, "cum", rp.alias("return_period"))
    out = rows.groupBy(*keys, "return_period").agg(hit.alias("hit"), F.min(loss).alias("least"))
    return out.select(*keys, "return_period", F.coalesce("hit", F.lit(0.0) if beyond == "zero" else "least").alias("loss"))


def pml(events: DataFrame, keys: Sequence[str] = (), periods: Sequence[int] = RETURN_PERIODS, loss: str = "loss", frequency: str = "frequency") -> DataFrame:
    """Probable maximum loss: events with positive loss and frequency; 0 beyond what the catalogue covers."""
    kept = events.where((F.col(loss) > 0) & (F.col(frequency) > 0))
    return _at_return_periods(running_frequency(kept, keys, loss, frequency), keys, loss, periods, "zero")


def return_level(values: DataFrame, keys: Sequence[str], periods: Sequence[int], value: str = "value", weight: str = "weight") -> DataFrame:
    """Return levels of all given values by key; 0 beyond."""
    out = _at_return_periods(running_frequency(values, keys, value, weight), keys, value, periods, "zero")
    return out.withColumnRenamed("loss", value) if value != "loss" else out


def spread_frequency(events: DataFrame, keys: Sequence[str] = (), frequency: str = "frequency") -> DataFrame:
    """``events`` with one over their number as frequency where their key's frequencies don't add up to more than nothing."""
    totals = events.groupBy(*keys).agg(F.sum(F.coalesce(F.col(frequency), F.lit(0.0)).cast(FREQUENCY)).alias("__sum"), F.count("*").alias("__n"))
    rows = events.join(totals, list(keys)) if keys else events.crossJoin(F.broadcast(totals))  # without keys a single row
    return rows.withColumn(frequency, F.when(F.col("__sum") > 0, F.col(frequency).cast("double")).otherwise(1.0 / F.col("__n"))).drop("__sum", "__n")


def clamped_loss(events: DataFrame, keys: Sequence[str] = (), periods: Sequence[int] = RETURN_PERIODS, loss: str = "loss", frequency: str = "frequency") -> DataFrame:
    """Return-period losses that stay at the smallest loss beyond the catalogue; negative losses count as 0, missing frequencies as even ones."""
    clipped = spread_frequency(events.withColumn(loss, F.greatest(F.lit(0.0), loss)), keys, frequency)
    return _at_return_periods(running_frequency(clipped, keys, loss, frequency), keys, loss, periods, "least")


def tvar(events: DataFrame, keys: Sequence[str], share: float = 0.95, loss: str = "loss", frequency: str = "frequency") -> DataFrame:
    """Value at risk and the frequency-weighted mean of the losses from there on; events without loss are included."""
    rows = events.withColumn("__w", F.greatest(F.lit(0), F.col(frequency)))
    cum = running_frequency(rows, keys, loss, "__w", descending=False)
    total = cum.groupBy(*keys).agg(F.sum("f").alias("__total"), F.max(loss).alias("__most"))
    level = F.lit(share).cast("decimal(10,6)")
    joined = cum.join(total, list(keys)) if keys else cum.crossJoin(F.broadcast(total))
    at = joined.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("cum") >= F.col("__total") * level, F.col(loss))), F.max("__most")).alias("var"), F.max("__total").alias("__total"))
    tail = (cum.join(at, list(keys)) if keys else cum.crossJoin(F.broadcast(at))).where(F.col(loss) >= F.col("var"))
    out = tail.groupBy(*keys).agg(F.max("var").alias("var"), F.max("__total").alias("t"), F.sum("f").alias("w"), F.sum(F.col(loss).cast("decimal(24,6)") * F.col("f").cast("decimal(12,8)")).alias("x"))
    value = F.when(F.col("t") <= 0, 0.0).when(F.col("w") <= 0, F.col("var")).otherwise(F.col("x").cast("double") / F.col("w").cast("double"))
    return out.select(*keys, "var", value.alias("tvar"))


def mean_top_fraction(events: DataFrame, keys: Sequence[str], fraction: float, loss: str = "loss") -> DataFrame:
    """The plain mean of the largest ceil(n * fraction) losses (one at least) of each key."""
    ranked = running_frequency(events.withColumn("__f", F.lit(0.0)), keys, loss, "__f")
    sizes = events.groupBy(*keys).agg(F.count("*").alias("__all"))
    rows = ranked.join(sizes, list(keys)) if keys else ranked.crossJoin(F.broadcast(sizes))
    quota = F.greatest(F.lit(1), F.ceil(F.col("__all") * fraction))
    taken = F.least("n", F.greatest(F.lit(0), quota - (F.col("rank") - F.col("n"))))
    kept = rows.withColumn("__k", taken.cast("long")).where("__k > 0")
    total = F.sum((F.col(loss).cast("decimal(24,6)") * F.col("__k").cast("decimal(12,0)")).cast("decimal(38,6)")).cast("double")
    return kept.groupBy(*keys).agg(F.sum("__k").alias("n_events"), (total / F.sum("__k")).alias("mean_loss"))


def quantiles(values: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row of linear-interpolated quantiles of all values that aren't null, by their ranks; nothing is sorted in one task."""
    kept = values.where(F.col(value).isNotNull()).withColumn("__f", F.lit(0.0))
    ranked = running_frequency(kept, (), value, "__f", descending=False)
    total = ranked.agg(F.sum("n").alias("__all"))
    rows = ranked.crossJoin(F.broadcast(total))  # a single row
    at = lambda q: (F.col("__all") - 1) * F.lit(q)
    ends = [F.min(F.when(F.col("rank") > f(at(q)), F.col(value))).alias(f"__{n}_{i}") for n, q in shares.items() for i, f in enumerate((F.floor, F.ceil))]
    one = rows.groupBy().agg(F.max("__all").alias("__all"), *ends)
    return one.select(*[(F.col(f"__{n}_0") + (F.col(f"__{n}_1") - F.col(f"__{n}_0")) * (at(q) - F.floor(at(q)))).alias(n) for n, q in shares.items()])


def top_events(events: DataFrame, n: int, keys: Sequence[str] = (), loss: str = "loss", frequency: str = "frequency", event: str = "event_id") -> DataFrame:
    """The n events of each key that lose most, with rank and return period; events without loss are left out."""
    period = F.when(F.col(frequency) > 0, 1.0 / F.col(frequency).cast("double"))
    kept = events.where(F.col(loss) > 0).select(*keys, event, loss, frequency, period.alias("return_period"))
    if keys:
        over = Window.partitionBy(*keys).orderBy(F.desc(loss), event)
        return kept.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= n)
    best = kept.orderBy(F.desc(loss), event).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(loss), event)))
