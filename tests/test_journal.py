"""Journals, summaries, reports, previews and the catalogue of sources, on small tables."""

import json
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stormledger.functions import classes as K
from stormledger.operators import journal
from stormledger.sources import catalogue, reports


def told(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_markdown_table_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b|c", 2.5), (3, None, None), (2, "x\ny", 1.0)], "k int, name string, v double").repartition(3)
    table = reports.markdown_table(rows, {"Name": F.col("name"), "V": reports.number(F.col("v"), 2)}, [F.desc("k")], right=["V"])
    reports.write_lines(table, f"file://{tmp_path}/t")
    lines = [line for p in sorted((tmp_path / "t").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ["| Name | V |", "|---|---:|", "| - | - |", "| x y | 1.00 |", "| b c | 2.50 |"]
    none = reports.markdown_table(rows.where("false"), {"Name": F.col("name")}, [F.col("k")], none="Nothing yet.")
    assert [x.line for x in none.collect()] == ["Nothing yet."]


def test_run_of_label_prefers_whole_labels(spark):
    runs = spark.createDataFrame([(1, "Alpha", 5), (2, "alpha beta", 9), (3, "ALPHA", 4), (4, None, 10), (5, "beta%", 1)], "id int, label string, at int")
    find = lambda x: [r.id for r in journal.run_of_label(runs, x, "label", [F.desc("at"), F.desc("id")]).collect()]
    assert find(" alpha ") == [1] and find("pha b") == [2] and find("%") == [5] and find("") == find("  ") == find("gamma") == []
    assert journal.run_of_label(runs.where("false"), "alpha", "label", [F.desc("at")]).collect() == []


def test_run_entries_without_losses(spark):
    rows = [("a", "s", 10.0, 0.015), ("a", "s", 20.0, 0.01), ("a", "s", 99.0, 0.0), ("b", "s", 0.0, 0.5), ("c", "s", 5.0, None)]
    out = journal.run_entries(spark.createDataFrame(rows, "territory string, hazard string, loss double, frequency double"))
    got = {x.territory: (x.sum_event_frequency, x.n_events, x.pml_50, x.pml_100) for x in out.collect()}
    assert got == {"a": (0.025, 3, 10.0, 20.0), "b": (0.5, 1, 0.0, 0.0), "c": (0.0, 1, 0.0, 0.0)}


def test_impact_summary_without_weight(spark):
    names = "hazard string, scenario string, weight double, network boolean, counted boolean, direct_state string, indirect_s3 boolean, loss double"
    rows = [("h", "annual", 3.0, True, True, "S3", False, 2.0), ("h", "annual", 1.0, True, False, "S1", True, 7.0), ("h", "annual", 9.0, False, True, "S3", True, 1.5), ("h", "rp50", 1.0, True, True, "S3", True, 4.0), ("i", "top5", 1.0, True, True, None, None, None)]
    got = {x.hazard: x.asDict() for x in journal.impact_summary(spark.createDataFrame(rows, names)).collect()}
    assert (got["h"]["direct_hs_pct_annual"], got["h"]["indirect_hs_pct_annual"], got["h"]["direct_hs_pct_event_max"]) == (75.0, 25.0, 0.0)
    assert (got["h"]["eai_total_eur"], got["h"]["rp50_total_loss_eur"], got["h"]["top10_total_loss_eur"]) == (3.5, 4.0, 0.0)
    assert all(v == 0.0 for k, v in got["i"].items() if k != "hazard")


def test_centroid_summary_like_plain_rules(spark):
    rows = [(1, 10.0, 0.01), (1, 20.0, 0.015), (1, 20.0, 0.0), (1, -4.0, 1.0), (1, math.nan, 1.0), (1, math.inf, 1.0), (2, 7.0, 0.0), (2, 9.0, None), (3, 0.0, 1.0), (None, 5.0, 1.0)]
    places = spark.createDataFrame([(1,), (2,), (3,), (4,)], "point_id int")
    values = spark.createDataFrame(rows, "point_id int, value double, frequency double")
    got = {x.point_id: tuple(x)[1:] for x in journal.centroid_summary(values, places).collect()}
    assert got[1] == (pytest.approx(16.0), 10.0, 20.0, 20.0, 3)
    assert got[2] == (8.0, 9.0, 9.0, 9.0, 2)
    assert got[3] == got[4] == (0.0, 0.0, 0.0, 0.0, 0)


def test_state_features_and_charts(spark):
    features = spark.createDataFrame([(1, "k", None, '{"type":"Point","coordinates":[1,2]}'), (2, "k", 'l "q"', None)], "feature_id int, layer_key string, layer_label string, geometry string")
    states = spark.createDataFrame([(1, "storm", "annual", "S1"), (1, "storm", "annual", "S3"), (1, "other", "annual", "S2"), (9, "storm", "annual", "S3")], "feature_id int, hazard string, scenario string, state string")
    got = {x.feature_id: json.loads(x.feature) for x in reports.state_features(features, states, ["storm", "cmcc"], ["annual"]).collect()}
    assert got[1]["properties"] == {"feature_id": 1, "layer_key": "k", "layer_label": None, "state_annual_storm": "S3", "state_annual_cmcc": "S0"}
    assert got[2]["geometry"] is None and got[2]["properties"]["state_annual_storm"] == "S0" and got[1]["geometry"]["coordinates"] == [1, 2]
    points = spark.createDataFrame([("a", 50, 2.5), ("a", 10, 1.0), ("b", 10, None)], "c string, x int, y double")
    assert {x.c: json.loads(x.document) for x in reports.chart_documents(points, "c", "x", "y").collect()} == {"a": {"chart": "a", "x": [10, 50], "y": [1.0, 2.5]}, "b": {"chart": "b", "x": [10], "y": [None]}}


def test_csv_preview_edges(spark):
    text = 'LABEL,lat,lon,asset_id\r\n"a, ""b""",1.5,2,z\n\n,1e1,-.5,\n x ,Infinity,1,y\nq,1\nr,0x1,2,w\ns,, ,v\nt,1d,2,u'
    frame = spark.createDataFrame([("f", text)], "file string, text string")
    got = [(x.line, x.asset_id, x.label, x.lon, x.lat) for x in reports.csv_preview(frame).orderBy("line").collect()]
    assert got == [(1, "z", 'a, "b"', 2.0, 1.5), (2, "Line 2", "Line 2", -0.5, 10.0), (6, "v", "s", 0.0, 0.0)]
    for bad in ("", None, " \n ", "x,y\n1,2"):
        with pytest.raises(PySparkException, match="empty CSV|without lat"):
            reports.csv_preview(spark.createDataFrame([("f", bad)], "file string, text string")).collect()
    assert reports.csv_preview(frame.where("false")).collect() == []


@pytest.mark.parametrize(
    "low, high, step, edges",
    [(1.2, 6.1, 2.0, [0, 2, 4, 6, 8]), (4.0, 4.0, 2.0, [4, 6]), (None, None, 3.0, [0, 3]), (math.nan, 5.0, 5.0, [0, 5]), (-1.0, math.inf, 0.5, [-1, -0.5]), (9.0, 2.0, 0.0, [9, 10]), (0.1, 0.35, 0.1, [0.1, 0.2, 0.3, 0.4])],
)
def test_step_edges(spark, low, high, step, edges):
    one = spark.createDataFrame([(low, high, step)], "a double, b double, s double")
    assert one.select(K.step_edges(F.col("a"), F.col("b"), F.col("s"))).first()[0] == edges


def test_sources_by_pattern(spark, tmp_path):
    for name, body in {"one/b.csv": "id,v\n1,2\n", "one/a.csv": "id\n5\n", "two/[x].csv": "id,w\n7,8\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    root = f"file://{tmp_path}"
    names = lambda *p: [x.rsplit("/", 1)[1] for x in catalogue.resolved(spark, root, p, "s")]
    assert names("one/*.csv", "one/a.csv") == ["a.csv", "b.csv"] and names("one/b.csv", "*/*.csv") == ["b.csv", "a.csv", "[x].csv"] and names("two/[x].csv") == ["[x].csv"]
    with pytest.raises(FileNotFoundError):
        names("none/*")
    sources = [catalogue.Source("lines", ("one/*.csv",), {"infra_type": "elec"}), catalogue.Source("points", ("two/*",))]
    out = catalogue.read_sources(spark, root, sources, lambda s, p: s.read.csv(p.replace("[", "\\[").replace("]", "\\]"), header=True))
    assert told(out.select("source", "infra_type", "id", "v", "w")) == [("lines", "elec", "1", "2", None), ("lines", "elec", "5", None, None), ("points", None, "7", None, "8")]
