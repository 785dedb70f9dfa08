"""Geometries, maps of studies, logs, sections, blocks, previews: odd and missing parts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from stormledger.sources import accesslog, blocks, exposures, geojson, sinks, studyfiles

POINT = {"type": "Point", "coordinates": [1, 2.5, 99]}


def nest(n):
    return POINT if n == 0 else {"type": "GeometryCollection", "geometries": [nest(n - 1)]}


@pytest.mark.parametrize(
    "geometry,box",
    [
        (POINT, (1.0, 2.5, 1.0, 2.5)),
        ({"type": "GeometryCollection", "geometries": [POINT, {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [[[0, 0], [-3, 4.25], [5, 1]], [[-90, 1e1]]]}]}]}, (-90.0, 0.0, 5.0, 10.0)),
        (nest(10), (1.0, 2.5, 1.0, 2.5)),
        ({"type": "GeometryCollection", "geometries": []}, None),
        ({"type": "Point", "coordinates": []}, None),
        ({"type": "Point", "coordinates": ["1", "2"]}, None),
        ({"type": "Point"}, None),
        (None, None),
        ("text", None),
    ],
)
def test_boxes(spark, geometry, box):
    row = spark.createDataFrame([(json.dumps(geometry),)], "g string").select(geojson.box(F.col("g")).alias("b")).first().b
    assert (tuple(row) if box else set(row)) == (box or {None})


def test_boxes_of_no_text(spark):
    rows = spark.createDataFrame([(None,), ("{bad",), ("",)], "g string").select(geojson.box(F.col("g")).alias("b")).collect()
    assert {tuple(x.b) for x in rows} == {(None,) * 4}
    with pytest.raises(Exception, match="nested too deeply"):
        spark.createDataFrame([(json.dumps(nest(40)),)], "g string").select(geojson.box(F.col("g"))).collect()


def test_geojson_errors_come_together(spark, tmp_path):
    feature = lambda value, geometry=POINT: {"type": "Feature", "geometry": geometry, "properties": {"value_eur": value}}
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature(1), feature("x"), feature(2, None), feature("nan")]}))
    with pytest.raises(exposures.InputError, match="feature 2: value.*feature 3: no geometry.*feature 4: value"):
        exposures.read_exposure(spark, f"file://{path}")
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature(1), feature("7.5", nest(2))]}))
    assert {(x.asset_id, x.value_eur, x.lon, x.lat) for x in exposures.read_exposure(spark, f"file://{path}").collect()} == {("1", 1.0, 1.0, 2.5), ("2", 7.5, 1.0, 2.5)}
    lines = tmp_path / "b.geojsonl"
    lines.write_text("\n".join(json.dumps(feature(k)) for k in range(50)) + "\n\n")
    assert exposures.read_exposure(spark, f"file://{lines}").agg(F.sum("value_eur")).first()[0] == sum(range(50))


def studies(spark, **texts):
    return spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in texts.items()], "study string, text string")


def test_analysis_ratios_and_their_defaults(spark):
    full = {"portfolio_results": {"storm": {studyfiles.ANNUAL_KEY: {"wind": 2, "rain": 1, "surge": 1, "combined_capped": 4}, studyfiles.EVENT_KEY: {"surge": 5}}, "storm_cmcc": {studyfiles.EVENT_KEY: {"rain": "3", "wind": 1}}}}
    docs = studies(spark, full=full, bad="{", none=None, text='"x"', list=[1], zero={"portfolio_results": {"storm": {studyfiles.ANNUAL_KEY: {"wind": -1, "rain": None, "surge": "x"}}}})
    got = {(x.study, x.hazard, x.scenario): (x.wind, x.rain, x.surge) for x in studyfiles.component_ratios(docs).collect()}
    assert len(got) == 6 * 2 * 6
    assert {got["full", "storm", s] for s in ("annual", "rp50", "rp100", "top10", "top5")} == {(0.5, 0.25, 0.25)} and got["full", "storm", "event_max"] == (0.0, 0.0, 1.0)
    assert got["full", "storm_cmcc", "annual"] == (1.0, 0.0, 0.0) and got["full", "storm_cmcc", "event_max"] == (0.25, 0.75, 0.0)
    assert {v for k, v in got.items() if k[0] != "full"} == {(1.0, 0.0, 0.0)}


def test_proxies_inherit_what_they_lack(spark):
    scenario = {"annual": {"breakdown_shares": {"eau_aep": 3, "eau_eu": 1, "elec": 9}, "global_multiplier": 1.5}, "rp50": {"breakdown_shares": {"eau_eu_pr": 2}, "component_ratios": {"rain": 1}}, "rp100": {"breakdown_shares": {"eau_eu": -1}, "global_multiplier": -2}, "event_max": 5, "top5": {"component_ratios": [1], "global_multiplier": None}}
    docs = studies(spark, a={"hazards": {"storm": {"scenarios": scenario}, "storm_cmcc": []}}, b=None)
    ratios = studyfiles.component_ratios(studies(spark, a={"portfolio_results": {"storm": {studyfiles.ANNUAL_KEY: {"wind": 1, "surge": 1}}}}))
    got = {(x.study, x.hazard, x.scenario): (x.multiplier, x.wind, x.rain, x.surge) for x in studyfiles.proxy_factors(docs, ratios).collect()}
    assert len(got) == 24 and got["a", "storm", "annual"] == (1.5, 0.5, 0.0, 0.5) and got["a", "storm", "rp50"] == (1.0, 0.0, 1.0, 0.0) and got["a", "storm", "rp100"] == (0.0, 0.5, 0.0, 0.5)
    assert got["a", "storm", "top5"] == (1.0, 0.5, 0.0, 0.5) and got["b", "storm", "rp50"] == (1.0, 1.0, 0.0, 0.0)
    shares = {}
    for x in studyfiles.proxy_shares(docs).where("share > 0").collect():
        shares.setdefault((x.study, x.hazard, x.scenario), {})[x["class"]] = x.share
    annual = {"eau_aep": 0.75, "eau_eu": 0.25}
    assert shares == {("a", "storm", s): annual for s in ("annual", "rp100", "event_max", "top10", "top5")} | {("a", "storm", "rp50"): {"eau_eu_pr": 1.0}}


def test_sections(spark, tmp_path):
    (tmp_path / "doc.md").write_text("| x | 0 |\n# One\n| name | v |\n|---|:-:|\n| a | 1 |\n| 1000 years | 2 |\n## Two\n| name | v |\n| b | 3 |\n# One\n| c | 4 |\n")
    texts = studyfiles.read_texts(spark, f"file://{tmp_path}/doc.md")
    assert [(x.study, x.indicator, x["values"]) for x in studyfiles.indicators(texts, "ONE").orderBy("line").collect()] == [("doc", "a", ["1"]), ("doc", "c", ["4"])]
    assert studyfiles.section_rows(texts).where("section is null").first().cells == ["x", "0"]
    assert studyfiles.indicators(texts.where("false"), "one").collect() == []


def test_log_counts_what_it_drops(spark, tmp_path):
    good = '{"time":"t1","visitor_ip":"1.2.3.4","status":200,"request":"GET / HTTP"}'
    (tmp_path / "log").write_text("\n".join([good, good + "}", "[]", "7", "", good + "," + good, '{"time":null}', "{bad", "null"]) + "\n")
    rows, observed = accesslog.read_log(spark, f"file://{tmp_path}/log")
    assert sorted(x.line for x in accesslog.rendered(rows, "1.2.3.4").collect()) == ["null | other | ip=- | status=- | - | ua=-", "t1 | mine | ip=1.2.3.4 | status=200 | GET / HTTP | ua=-"]
    assert observed.get == {"lines": 9, "dropped": 7}
    accesslog.write_tsv(accesslog.last_rows(rows, 1, "x"), f"file://{tmp_path}/t")
    (out,) = [x for f in (tmp_path / "t").glob("part-*.csv") for x in f.read_text().splitlines()[1:]]
    assert out == "t1\tother\t1.2.3.4\t200\tGET / HTTP\t-"


def test_blocks_go_on_where_they_stopped(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    source = spark.range(100).selectExpr("id % 5 as block", "id as event_id", "id % 3 as keep")
    calls = []

    def build(rows):
        names = [x.block for x in rows.select("block").distinct().collect()]
        calls.append(names)
        if 2 in names and len(calls) < 5:
            raise RuntimeError("cut off")
        return rows.where("keep > 0 and block <> 3").drop("keep")

    with pytest.raises(RuntimeError):
        blocks.build_blocks(source, path, "block", build)
    assert {x.block for x in blocks.read_blocks(spark, path, "block").select("block").distinct().collect()} == {0, 1}
    spark.range(7).selectExpr("id as event_id", "2 as block").write.partitionBy("block").mode("append").parquet(f"{path}/rows")  # what a cut-off run left
    assert blocks.read_blocks(spark, path, "block").where("block = 2").count() == 0
    with pytest.raises(RuntimeError):
        blocks.build_blocks(source, path, "block", build)
    assert blocks.build_blocks(source, path, "block", build) == [2, 3, 4] and blocks.build_blocks(source, path, "block", build) == []
    want = sorted((x.block, x.event_id) for x in source.where("keep > 0 and block <> 3").collect())
    rows = blocks.read_blocks(spark, path, "block")
    assert sorted((x.block, x.event_id) for x in rows.collect()) == want
    assert {x.block: x.n for x in blocks.finished(spark, path, "block").collect()} == {str(b): sum(c == b for c, _ in want) for b in range(5)}
    one = blocks.read_blocks(spark, path, "block", [1, 3, 77])
    assert {x.block for x in one.select("block", F.input_file_name().alias("f")).collect()} == {1}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert blocks.build_blocks(source, path, "block", build, blocks=[1], again=True) == [1] and blocks.read_blocks(spark, path, "block").count() == len(want)
    assert blocks.build_blocks(source.where("false"), f"file://{tmp_path}/e", "block", build) == [] and blocks.finished(spark, f"file://{tmp_path}/e", "block").collect() == []


def test_preview_tells_what_it_leaves_out(spark):
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else 1.0, 2.0, 3.0) for k in range(20)], "asset_id int, lon double, lat double, value_eur double")
    for most, cut in ((10, True), (16, False)):
        observed = Observation()
        assert len(sinks.preview(rows, most, observed).collect()) == min(most, 16)
        assert observed.get == {"total": 16, "placeless": 4, "truncated": cut}
