"""Queries over tables that repeat with shifted keys: results stay right, and work doesn't grow with the square of the rows."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stormledger import registry
from stormledger.operators import geometry, hazard, impact

from .compare import assert_same, connect
from .conftest import SF

#: Keys this far apart share a place (of 300 x 250).
AGAIN = 1500


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """A folder with the tables of SF, ``n`` times over with keys ``AGAIN`` (or ``step``) apart."""

    def make(keys: dict[str, list[str]], n: int = 3, step: int = AGAIN) -> str:
        folder = tmp_path_factory.mktemp("repeated")
        for f in os.listdir(SF):
            name, to = f.split(".")[0], folder / f
            if name in keys:
                shifted = ", ".join(f"({k} + i * {step})::bigint as {k}" for k in keys[name])
                duckdb.connect().execute(f"copy (select t.* replace ({shifted}) from '{SF}/{f}' t, range({n}) r(i)) to '{to}' (format parquet)")
            else:
                os.symlink(f"{SF}/{f}", to)
        return str(folder)

    return make


def joined(spark, df) -> int:
    """The rows that the joins of ``df`` give out."""
    df.write.format("noop").mode("overwrite").save()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values, nodes, out = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for i in range(nodes.size()):
        if "Join" in nodes.apply(i).name():
            metrics = nodes.apply(i).metrics()
            for j in range(metrics.size()):
                if metrics.apply(j).name() == "number of output rows" and values.contains(metrics.apply(j).accumulatorId()):
                    out += int(values.apply(metrics.apply(j).accumulatorId()).replace(",", ""))
    return out


def test_each_supplier_meets_its_own_centroid(spark, repeated):
    d = repeated({"supplier": ["s_suppkey"], "lineitem": ["l_suppkey", "l_orderkey"]}, 2, AGAIN - 6)  # others than copies share places
    assert_same(registry.QUERIES["job_assets"](spark, d), connect(d).sql(registry.ORACLES["job_assets"]))


def test_wind_is_told_once_for_a_place(spark):
    tracks = spark.range(20).selectExpr("id as track_id", "15.0 + id / 100 as lat", "-61.0 as lon", "950.0 as p_c", "30.0 as rmax_km")
    centroids = spark.range(4000).selectExpr("id as centroid_id", "15.0 + id % 4 / 100 as lat", "-61.1 as lon")
    winds = hazard.wind_field(tracks, centroids, 0.5)
    assert winds.where("track_id = 3").groupBy("intensity").count().count() == 4 and winds.count() == 80_000
    assert joined(spark, winds) <= 20 * 4 + 80_000


def test_winds_are_not_shuffled(spark, monkeypatch):
    """rows of tracks times places go through no shuffle, however large the centroids' table; in blocks the result is the same."""
    tracks = spark.range(2000).selectExpr("id % 40 as track_id", "15.0 + id % 31 / 20 as lat", "-61.0 as lon", "950.0 - id % 7 as p_c", "30.0 as rmax_km")
    centroids = spark.range(900).selectExpr("id as centroid_id", "15.0 + id % 300 / 200 as lat", "-61.1 as lon")
    whole = sorted(map(tuple, hazard.wind_field(tracks, centroids, 0.5).collect()))
    assert len(whole) == 40 * 900
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(hazard, "CENTROIDS", 250)
        winds = hazard.wind_field(tracks, centroids, 0.5)
        assert sorted(map(tuple, winds.collect())) == whole
        assert "SortMergeJoin" not in winds._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_places_meet_places(spark):
    points = spark.range(3000).selectExpr("id as point_id", "15.0 + id % 5 / 100 as lat", "-61.0 as lon")
    centroids = spark.range(3000).selectExpr("id as centroid_id", "15.0 + id % 3 / 100 as lat", "-61.0 as lon")
    found = impact.assign_centroids(points.union(spark.sql("select -1L, null, 3.0")), centroids, 0.5, 0.015)
    assert {(x.point_id % 5, x.centroid_id) for x in found.collect() if x.point_id >= 0} == {(0, 0), (1, 1), (2, 2), (3, 2), (4, None)}
    assert joined(spark, found) < 10_000


def test_events_meet_centroids_not_points(spark):
    points = spark.range(2000).selectExpr("id as point_id", "concat('a', id) as asset_id", "'t' as territory", "'habitation' as infra_class", "cast(id % 10 - 1 as double) as value", "15.0 as lat", "-61.0 as lon", "7L as centroid_id")
    storms = spark.range(3000).selectExpr("'h' as hazard", "id as event_id", "7L as centroid_id", "cast(id % 4 as double) as intensity", "0.001 as frequency")
    rows = impact.impact_rows(storms, points.selectExpr("point_id", "centroid_id", "greatest(0.0, value) as value"), None, F.col("intensity") / 10)
    events, each = impact.by_centroid(points.selectExpr("point_id", "centroid_id", "greatest(0.0, value) as value"), storms, F.col("intensity") / 10)
    assert {tuple(x) for x in events.collect()} == {tuple(x) for x in impact.by_event(rows, ("hazard", "event_id")).collect()}
    assert {tuple(x) for x in each.collect()} == {tuple(x) for x in impact.by_point(rows, ("hazard", "point_id")).collect()}
    assert joined(spark, events) < 10_000 and joined(spark, each) < 10_000


def test_rings_are_cut_together():
    r = np.random.default_rng(4)
    rings = [np.round(r.uniform(-3, 13, (n, 2))) for n in r.integers(0, 9, 400)]
    box, starts = (0.0, 0.0, 10.0, 6.0), np.append(0, np.cumsum([len(x) for x in rings]))
    xy, sizes = geometry.clipped_rings(np.concatenate(rings), starts, box)
    alone = [geometry.clipped_rings(x, np.array([0, len(x)]), box)[0] for x in rings]
    assert [len(x) for x in alone] == sizes.tolist() and np.array_equal(np.concatenate(alone), xy) and (sizes > 0).sum() > 100
