"""The driver's tables in the roles of the domain: exposure points, events, impact rows, track points.

The mapping carries no physical meaning; it gives the operators data that isn't degenerate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves as C
from ..functions import scalars as S

STORM_YEARS = 10_000
CATEGORY_OF = {"HOUSEHOLD": "residential", "BUILDING": "House", "AUTOMOBILE": "water-network", "MACHINERY": "power", "FURNITURE": "unknown"}
ASSET_OF = {"ECONOMY": "eau_aep", "STANDARD": "ELEC_BT_AERIEN", "PROMO": "elec_hta_souterrain", "LARGE": "aep_ouvrage_cuv", "MEDIUM": "eau_eu_step", "SMALL": "House"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat(key: Column) -> Column:
    return F.lit(14.0) + (key % 300) / 100.0


def lon(key: Column) -> Column:
    return F.lit(-63.0) + (key % 250) / 100.0


def choose(column: str, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(column))


def frequency() -> Column:
    return F.lit(1.0 / STORM_YEARS)


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact rows: event, point, wind, value, loss, frequency."""
    wind = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("point_id"), F.col("l_partkey").alias("part_id"), F.col("l_linenumber").alias("line"), wind.alias("wind"), F.col("l_extendedprice").alias("value"), F.col("l_discount").alias("rain"), F.col("l_tax").alias("surge"))
    return rows.withColumn("loss", F.col("value") * C.sigmoid(F.col("wind"))).withColumn("frequency", frequency())


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("point_id"), F.col("s_nationkey").alias("territory"), F.greatest(F.lit(0.0), "s_acctbal").alias("value"), lat(k).alias("lat"), lon(k).alias("lon"))


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of both networks for two hazards: suppliers carry electricity, customers are water or housing.

    Annual impact and largest loss follow from the key, so that all states occur.
    """
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    electric = s.select(F.concat(F.lit("e"), F.col("s_suppkey")).alias("asset_id"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("territory"), F.col("s_acctbal").alias("value"), F.when(F.col("s_suppkey") % 2 == 0, "elec_aerien").otherwise("elec_souterrain").alias("infra_class"))
    water = c.select(F.concat(F.lit("w"), F.col("c_custkey")).alias("asset_id"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("territory"), F.col("c_acctbal").alias("value"), F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY"), "eau_reseau").when(F.col("c_mktsegment") == "FURNITURE", "eau_ouvrage").otherwise("habitation").alias("infra_class"))
    both = electric.unionAll(water).withColumn("lat", lat(F.col("k"))).withColumn("lon", lon(F.col("k")))
    hazards = both.withColumn("hazard", F.explode(F.array(F.lit("storm"), F.lit("storm_cmcc"))))
    tilt = F.when(F.col("hazard") == "storm", 0).otherwise(3)
    value = F.greatest(F.lit(0.0), "value")
    hazards = hazards.withColumn("eai", value * ((F.col("k") + tilt) % 11) / 100.0).withColumn("max_loss", value * ((F.col("k") * 7 + tilt) % 53) / 100.0)
    return hazards.withColumn("point_id", F.concat(F.col("asset_id"), F.lit("::p0")))


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as track points: a track for each user, wind in m/s, year by the day."""
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), k, step.alias("time_step"), (F.dayofyear("ts") + 2000).alias("year"), lat(k * 7).alias("lat"), lon(k * 13).alias("lon"), S.wind_mps(F.col("value"), "km/h").alias("wind"), (F.lit(1000.0) - F.col("value") / 10.0).alias("p_c"), (k % 6).cast("int").alias("category"), F.col("event_type")
    )
