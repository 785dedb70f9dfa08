"""Files of case studies: maps of maps in JSON whose keys are data, and tables under headings of Markdown texts.

Each text is one row (``study``, ``text``); any number of studies is read at once. Maps are read as variants, level by level, so a
missing or malformed part leaves the others as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.proxy import SCENARIOS

# Hazards, components, the classes that shares go by, keys of an analysis' maps.
HAZARDS = ("storm", "storm_cmcc")
PARTS = ("wind", "rain", "surge")
CLASSES = ("eau_aep", "eau_eu", "elec_bt_souterrain", "elec_bt_aerien", "elec_hta_souterrain", "elec_hta_aerien", "eau_aep_ouvrages", "eau_eu_pr", "eau_eu_step")
ANNUAL_KEY, EVENT_KEY = "components_direct_eai_eur", "components_direct_max_event_loss_eur"


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``study`` (the file's name without its ending) and its whole ``text``."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return spark.read.text(paths, wholetext=True).select(name.alias("study"), F.col("value").alias("text"))


def entries(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """A row for each entry of an object: ``key`` and ``value`` beside the other columns. What isn't an object has none."""
    spark = df.sparkSession
    rows = df.lateralJoin(spark.tvf.variant_explode(F.col(column).outer()).toDF("__pos", "__key", "__value"))
    return rows.where("__key is not null").withColumn(key, F.col("__key")).withColumn(value, F.col("__value")).drop("__pos", "__key", "__value")


def _is_map(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _ratios(value: Column) -> Column:
    """A map's wind, rain and surge as shares; what isn't a number counts as nothing, other keys aren't looked at."""
    shares = S.ratio_map(*[F.try_variant_get(value, f"$.{p}", "double") for p in PARTS])
    return F.struct(*[s.alias(p) for s, p in zip(shares, PARTS, strict=True)])


def _every(studies: DataFrame) -> DataFrame:
    """Each study with every hazard and scenario."""
    each = lambda names: F.explode(F.array(*[F.lit(n) for n in names]))
    return studies.select("study").distinct().withColumn("hazard", each(HAZARDS)).withColumn("scenario", each(SCENARIOS))


def component_ratios(analyses: DataFrame) -> DataFrame:
    """Wind, rain and surge of each (``study``, ``hazard``, ``scenario``) from complete analyses.

    The annual map stands for all scenarios but the largest event, which has its own or else the annual one. All is wind where there
    is no map, or no text that is one.
    """
    rows = analyses.select("study", _at(F.try_parse_json("text"), "$.portfolio_results").alias("v"))
    known = entries(rows, "v", "hazard", "v").select("study", "hazard", _at(F.col("v"), f"$.{ANNUAL_KEY}").alias("annual"), _at(F.col("v"), f"$.{EVENT_KEY}").alias("event"))
    known = known.select("study", "hazard", F.when(_is_map(F.col("annual")), _ratios(F.col("annual"))).alias("annual"), F.when(_is_map(F.col("event")), _ratios(F.col("event"))).alias("event"))
    joined = _every(analyses).join(known, ["study", "hazard"], "left")
    wind = F.struct(*[F.lit(1.0 if p == "wind" else 0.0).alias(p) for p in PARTS])
    chosen = F.when(F.col("scenario") == "event_max", F.coalesce("event", "annual", wind)).otherwise(F.coalesce("annual", wind))
    return joined.withColumn("r", chosen).select("study", "hazard", "scenario", "r.*")


def _scenarios(proxies: DataFrame) -> DataFrame:
    rows = proxies.select("study", _at(F.try_parse_json("text"), "$.hazards").alias("v"))
    rows = entries(rows, "v", "hazard", "v").withColumn("v", _at(F.col("v"), "$.scenarios"))
    rows = entries(rows, "v", "scenario", "v").where(_is_map(F.col("v")))
    return _every(proxies).join(rows, ["study", "hazard", "scenario"], "left")


def proxy_factors(proxies: DataFrame, ratios: DataFrame) -> DataFrame:
    """``multiplier`` and wind, rain and surge of each (``study``, ``hazard``, ``scenario``); ``ratios`` (by the same keys) hold where a proxy has none.

    A multiplier that is missing, zero or no number is 1, a negative one 0.
    """
    rows = _scenarios(proxies).join(ratios, ["study", "hazard", "scenario"], "left")
    own = _at(F.col("v"), "$.component_ratios")
    number = F.try_variant_get("v", "$.global_multiplier", "double")
    factor = F.when(number.isNull() | (number == 0), 1.0).otherwise(F.greatest(F.lit(0.0), number))
    fallback = F.struct(*[F.coalesce(F.col(p), F.lit(1.0 if p == "wind" else 0.0)).alias(p) for p in PARTS])
    return rows.select("study", "hazard", "scenario", factor.alias("multiplier"), F.when(_is_map(own), _ratios(own)).otherwise(fallback).alias("r")).select("study", "hazard", "scenario", "multiplier", "r.*")


def proxy_shares(proxies: DataFrame) -> DataFrame:
    """``share`` of each class by (``study``, ``hazard``, ``scenario``): a scenario without shares has the annual ones; unknown classes don't count."""
    rows = _scenarios(proxies).withColumn("v", _at(F.col("v"), "$.breakdown_shares"))
    parts = F.array(*[F.struct(F.lit(c).alias("class"), F.greatest(F.lit(0.0), F.coalesce(F.try_variant_get("v", f"$.{c}", "double"), F.lit(0.0))).alias("x")) for c in CLASSES])
    rows = rows.withColumn("parts", F.when(_is_map(F.col("v")), parts)).withColumn("total", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["x"]))
    rows = rows.select("study", "hazard", "scenario", F.when(F.col("total") > 0, F.struct("parts", "total")).alias("own"))
    annual = F.max(F.when(F.col("scenario") == "annual", F.col("own"))).over(Window.partitionBy("study", "hazard"))  # six rows
    rows = rows.withColumn("own", F.coalesce("own", annual)).where("own is not null")
    return rows.select("study", "hazard", "scenario", "own.total", F.inline("own.parts")).select("study", "hazard", "scenario", "class", (F.col("x") / F.col("total")).alias("share"))


def section_rows(texts: DataFrame) -> DataFrame:
    """Rows of pipe tables with the heading they stand under: ``study``, ``line``, ``section``, ``cells``.

    The heading of a line is the last one at or above it in its text. Rules between a table's head and body are left out.
    """
    lines = texts.select("study", F.posexplode(F.split("text", "\r?\n")).alias("line", "t"))
    title = F.nullif(F.trim(F.regexp_extract("t", r"^\s*#+\s+(.*?)\s*$", 1)), F.lit(""))
    above = Window.partitionBy("study").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)  # a text's lines
    rows = lines.withColumn("section", F.last(title, ignorenulls=True).over(above)).where(F.trim("t").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("t"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select("study", "line", "section", cells.alias("cells")).where(~F.forall("cells", lambda c: c.rlike("^:?-+:?$")))


def indicators(texts: DataFrame, heading: str, without: str = "1000") -> DataFrame:
    """The table rows under a heading (whatever its case) by ``indicator``, their first cell, and ``values``, the others; those that name ``without`` are left out, and so is the table's head."""
    rows = section_rows(texts).where(F.lower("section") == heading.lower())
    first = F.min("line").over(Window.partitionBy("study"))
    rows = rows.withColumn("head", F.col("line") == first).where("not head")
    return rows.select("study", "line", F.col("cells")[0].alias("indicator"), F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))).alias("values")).where(~F.col("indicator").contains(without))
