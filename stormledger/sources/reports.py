"""Texts that people read: tables in markdown, charts as JSON documents, network states as GeoJSON features, previews of uploaded CSV."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell of a CSV line with the comma behind it, and a number as a preview accepts it.
CELL, NUMBER = r'((?:[^",]|"(?:[^"]|"")*")*),', r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(value: Column, digits: int) -> Column:
    """A number with so many digits; a dash where there is none."""
    text = F.format_string(f"%.{digits}f", value.cast("double")) if digits else value.cast("long").cast("string")
    return F.when(value.isNull(), "-").otherwise(text)


def markdown_table(rows: DataFrame, columns: Mapping[str, Column], order: Sequence[Column], right: Sequence[str] = (), none: str = "No entries.") -> DataFrame:
    """A table as lines of markdown, in order: ``part`` (0 heading, 1 rule, 2 rows or the line of an empty table), ``place`` (ascending among rows) and ``line``.

    ``columns`` gives the text under each heading; a missing one is a dash, and bars and line breaks within are blanks. Headings in ``right`` are
    aligned to the right. Without rows the table is the one line ``none``. Sorting is Spark's own, by ranges, so the table may be of any length.
    """
    clean = [F.regexp_replace(F.coalesce(c.cast("string"), F.lit("-")), r"[|\r\n]", " ") for c in columns.values()]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *clean), F.lit(" |"))
    body = rows.withColumns({"__line": line}).orderBy(*order).select(F.monotonically_increasing_id().alias("place"), F.col("__line").alias("line"))
    head = ["| " + " | ".join(columns) + " |", "|" + "|".join("---:" if c in right else "---" for c in columns) + "|"]
    spark = rows.sparkSession
    some = rows.limit(1).groupBy().agg((F.count("*") > 0).alias("some"))  # a single row
    start = spark.range(3, numPartitions=1).select(F.col("id").cast("int").alias("part"), F.element_at(F.array(*map(F.lit, [*head, none])), F.col("id").cast("int") + 1).alias("line"))
    start = start.crossJoin(F.broadcast(some)).where(F.col("some") == (F.col("part") < 2))
    return start.select("part", F.lit(0).cast("long").alias("place"), "line").unionAll(body.select(F.lit(2).alias("part"), "place", "line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines of ``markdown_table`` as text files; read in the order of their names they are the table."""
    lines.orderBy("part", "place").select("line").write.mode("overwrite").text(path)


def chart_documents(points: DataFrame, chart: str, x: str, y: str) -> DataFrame:
    """A JSON document for each chart: its points by x. A chart has as many points as return periods or classes, so few."""
    both = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    out = points.groupBy(chart).agg(both.alias("p"))
    return out.select(chart, F.to_json(F.struct(F.col(chart).alias("chart"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))).alias("document"))


def state_features(features: DataFrame, states: DataFrame, hazards: Sequence[str], scenarios: Sequence[str]) -> DataFrame:
    """Features as GeoJSON with a state for each scenario and hazard (the worst given one; S0 without any).

    ``features``: feature_id, layer_key, layer_label and geometry (GeoJSON text, null allowed); ``states``: feature_id, hazard, scenario, state.
    """
    wide = {f"state_{s}_{h}": (s, h) for h in hazards for s in scenarios}
    worst = states.groupBy("feature_id").agg(*[F.max(F.when((F.col("scenario") == s) & (F.col("hazard") == h), F.col("state"))).alias(n) for n, (s, h) in wide.items()])
    told = F.to_json(F.struct("feature_id", "layer_key", "layer_label", *[F.coalesce(n, F.lit("S0")).alias(n) for n in wide]), {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"type":"Feature","properties":'), told, F.lit(',"geometry":'), F.coalesce("geometry", F.lit("null")), F.lit("}"))
    return features.join(worst, "feature_id", "left").select("feature_id", text.alias("feature"))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _cells(line: Column) -> Column:
    found = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(CELL), F.lit(1))
    return F.transform(found, lambda c: _trimmed(F.regexp_replace(c, '"("?)', "$1")))


def csv_preview(texts: DataFrame, name: str = "file", text: str = "text") -> DataFrame:
    """Points of uploaded CSV texts for a map: ``name``, ``line`` (of the lines with something on them, after the header), asset_id, label, lon, lat.

    Columns are found by their header in any case: lat or latitude, lon or longitude, asset_id, label. Lines whose place isn't two finite numbers
    are left out (an empty cell is 0, a missing one none); without an id or a label there is the line's number. Null or empty texts,
    and headers without a place, are errors. Each text is one upload; they are dealt over the cluster by text.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), _trimmed), lambda x: F.length(x) > 0)
    rows = texts.select(name, lines.alias("l"))
    header = F.when(F.size("l") == 0, F.raise_error(F.lit("empty CSV")).cast("array<string>")).otherwise(F.transform(_cells(F.get("l", F.lit(0))), F.lower))
    rows = rows.select(name, header.alias("h"), "l")

    def at(*names: str) -> Column:
        places = [F.nullif(F.array_position("h", n), F.lit(0).cast("long")) for n in names]
        return F.coalesce(*places, F.lit(0).cast("long"))

    place = {n: at(*names) for n, names in {"lat": ("lat", "latitude"), "lon": ("lon", "longitude"), "id": ("asset_id",), "label": ("label",)}.items()}
    rows = rows.select(name, "l", *[p.cast("int").alias(f"__{n}") for n, p in place.items()])
    bad = (F.col("__lat") == 0) | (F.col("__lon") == 0)
    rows = rows.withColumn("l", F.when(bad, F.raise_error(F.lit("CSV without lat and lon")).cast("array<string>")).otherwise(F.col("l")))
    each = rows.select(name, *[f"__{n}" for n in place], F.posexplode("l").alias("line", "__text")).where("line > 0").withColumn("__c", _cells(F.col("__text")))
    cell = {n: F.when(F.col(f"__{n}") > 0, F.get("__c", F.col(f"__{n}") - 1)) for n in place}
    value = {n: F.when(cell[n] == "", 0.0).when(cell[n].rlike(NUMBER), cell[n].try_cast("double")) for n in ("lat", "lon")}
    row = F.concat(F.lit("Line "), F.col("line"))
    filled = {n: F.nullif(cell[n], F.lit("")) for n in ("id", "label")}
    out = each.select(name, "line", F.coalesce(filled["id"], row).alias("asset_id"), F.coalesce(filled["label"], filled["id"], row).alias("label"), value["lon"].alias("lon"), value["lat"].alias("lat"))
    return out.where((F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf")))
