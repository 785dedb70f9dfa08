"""Access logs of JSON lines: what doesn't parse is dropped and counted while the rest is read; lines for people and for tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FIELDS = ("time", "visitor_ip", "status", "request", "user_agent")


def parsed(lines: DataFrame, observed: Observation | None = None) -> DataFrame:
    """The fields of JSON lines (``value``) as text. Lines that aren't objects are left out; ``observed`` tells ``lines`` and ``dropped`` of the same run."""
    one = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))  # in brackets, else what follows the first value would be ignored
    rows = lines.withColumn("__v", F.when(F.try_variant_get(one, "$[1]", "variant").isNull(), F.try_variant_get(one, "$[0]", "variant")))
    good = F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("__good", good)
    if observed is not None:
        rows = rows.observe(observed, F.count("*").alias("lines"), F.count_if(~F.col("__good")).alias("dropped"))
    rest = [c for c in lines.columns if c not in ("value", *FIELDS)]
    return rows.where("__good").select(*rest, *[F.try_variant_get("__v", f"$.{f}", "string").alias(f) for f in FIELDS])


def read_log(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, Observation]:
    """Logs with what their reading will have counted."""
    observed = Observation("access log")
    return parsed(spark.read.text(paths), observed), observed


def kind(own_ip: str) -> Column:
    return F.when(F.col("visitor_ip") == own_ip, "mine").otherwise("other")


def _or_dash(column: str) -> Column:
    return F.coalesce(column, F.lit("-"))


def rendered(rows: DataFrame, own_ip: str) -> DataFrame:
    """One line of text for each row; what is missing is a dash (a missing time the word null)."""
    return rows.select(F.concat_ws(" | ", F.coalesce("time", F.lit("null")), kind(own_ip), F.concat(F.lit("ip="), _or_dash("visitor_ip")), F.concat(F.lit("status="), _or_dash("status")), _or_dash("request"), F.concat(F.lit("ua="), _or_dash("user_agent"))).alias("line"))


def last_rows(rows: DataFrame, n: int, own_ip: str) -> DataFrame:
    """The last n rows by time as a table: time, type, ip, status, request, user agent."""
    last = rows.orderBy(F.desc_nulls_last("time"), F.desc_nulls_last("visitor_ip"), F.desc_nulls_last("request")).limit(n)
    return last.select(_or_dash("time").alias("time"), kind(own_ip).alias("type"), _or_dash("visitor_ip").alias("ip"), _or_dash("status").alias("status"), _or_dash("request").alias("request"), _or_dash("user_agent").alias("user_agent"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)
