"""From a file to the document in one call."""

from __future__ import annotations

import json

import pytest

from stormledger.functions import curves as C
from stormledger.operators import jobs
from stormledger.sources import exposures

LINE = {"type": "LineString", "coordinates": [[-61.5, 16.2], [-61.5, 16.21]]}
AREA = {"type": "Polygon", "coordinates": [[[-61.6, 16.2], [-61.59, 16.2], [-61.59, 16.21], [-61.6, 16.21], [-61.6, 16.2]]]}
CSV = "asset_id,label,asset_type,exposure_category,value_eur,lat,lon\na,BT line,elec_bt_aerien,ouvrage_electrique,120000,16.24,-61.55\nb,Pipe,eau_aep_cana,ouvrage_eau,95000,16.21,-61.51\nc,House,habitation,habitation,180000,16.25,-61.53\n"


@pytest.fixture
def sources(spark):
    centroids = spark.createDataFrame([(1, 16.2, -61.5), (2, 16.25, -61.6)], "centroid_id long, lat double, lon double")
    hazard = lambda low: spark.createDataFrame([(h, e, c, low + 8.0 * e, 0.01) for h in ("storm", "storm_cmcc") for e in range(1, 9) for c in (1, 2)], "hazard string, event_id long, centroid_id long, intensity double, frequency double")
    flood = C.number_curves(spark.createDataFrame([(c, x, x / 8) for c in ("F17.5", "F6.2") for x in (0.0, 2.0, 6.0)], "code string, depth_m double, mdd double"))
    wind = spark.createDataFrame([(k, x, x / 100) for k in (2, 310, 316) for x in (0.0, 50.0, 90.0)], "impf_id int, x double, y double")
    surge = flood.selectExpr("surge_id as impf_id", "depth_m as x", "mdd as y")
    return {"wind": jobs.Source(hazard(0.0), centroids, wind, 10.0), "surge": jobs.Source(hazard(-30.0), centroids, surge, 0.5)}, flood


def parts(document):
    out = {}
    for x in document.collect():
        out.setdefault(x.part, []).append((x.at, json.loads(x.json)))
    return out


def test_csv_to_document(spark, tmp_path, sources):
    (tmp_path / "a.csv").write_text(CSV)
    job = jobs.run_job(exposures.read_exposure(spark, f"file://{tmp_path}/a.csv"), *sources, "r1", "sample")
    found = parts(job.document)
    assert found["meta"][0][1] == {"run_id": "r1", "label": "sample"}
    assert found["exposure_summary"][0][1] == {"asset_count_original": 3, "asset_count_points": 3, "total_exposure_eur": 395000.0}
    assert {(x["hazard"], x["asset_id"]) for _, x in found["asset_results"]} == {(h, a) for h in ("storm", "storm_cmcc") for a in "abc"}
    total = {h: sum(x["direct_eai"] for _, x in found["territory_results"] if x["hazard"] == h) for h in ("storm", "storm_cmcc")}
    wind = 0.01 * sum(min(0.9, 0.08 * e) for e in range(1, 9))  # of the value; surge adds what its curve gives, within the value
    assert all(v >= wind * 395000 * 0.99 for v in total.values())
    assert {(x["hazard"], x["component"]) for _, x in found["components"]} == {(h, c) for h in ("storm", "storm_cmcc") for c in ("wind", "surge", "combined")}
    ranks = [x["rank"] for at, x in sorted(found["event_summary"]) if x["hazard"] == "storm"]
    assert ranks == list(range(1, 9)) and len(found["notes"]) == 3 and found["component_health"]
    assert {x["hazard"]: x["eai"] if "eai" in x else x["total_eai"] for _, x in found["portfolio_results"]}["storm"] > 0


def test_geometries_become_points(spark, tmp_path, sources):
    feature = lambda k, g: {"type": "Feature", "geometry": g, "properties": {"asset_id": k, "value_eur": 900, "asset_type": "eau_aep", "exposure_category": "water"}}
    shapes = {"line": LINE, "lines": {"type": "MultiLineString", "coordinates": [LINE["coordinates"], [[-61.4, 16.2]]]}, "area": AREA, "areas": {"type": "MultiPolygon", "coordinates": [AREA["coordinates"], AREA["coordinates"]]}, "point": {"type": "Point", "coordinates": [-61.5, 16.2]}, "all": {"type": "GeometryCollection", "geometries": [LINE, AREA]}, "dot": {"type": "LineString", "coordinates": [[-61.5, 16.2]]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(k, g) for k, g in shapes.items()]}))
    points = jobs.sampled(exposures.read_exposure(spark, f"file://{tmp_path}/a.geojson"), spacing=200.0).collect()
    n = {k: sum(x.feature_id == k for x in points) for k in shapes}
    assert n["line"] == n["lines"] == 7 and n["point"] == n["all"] == n["dot"] == 1 and 30 <= n["area"] <= 45 and n["areas"] == 2 * n["area"]
    assert all(abs(sum(x.value for x in points if x.feature_id == k) - 900) < 1e-6 for k in shapes)
    assert all(-61.6 - 1e-9 <= x.lon <= -61.59 + 1e-9 and 16.2 - 1e-9 <= x.lat <= 16.21 + 1e-9 for x in points if x.feature_id == "area")
    assert min(x.lat for x in points if x.feature_id == "line") == pytest.approx(16.2) and max(x.lat for x in points if x.feature_id == "line") == pytest.approx(16.21)
    none = exposures.read_exposure(spark, f"file://{tmp_path}/a.geojson").where("false")
    assert jobs.sampled(none).collect() == []
    empty = parts(jobs.run_job(none, *sources, "r", "none").document)
    assert empty["exposure_summary"][0][1]["asset_count_points"] == 0 and "asset_results" not in empty
