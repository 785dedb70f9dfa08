"""Operators on small inputs with known answers, and edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormledger.functions import codecs
from stormledger.functions import curves as C
from stormledger.functions import scalars as S
from stormledger.operators import grid, impact, metrics, proxy, sampling, shares, tracks
from stormledger.sources import exposures, sinks, storms
from stormledger.streaming import losses as stream


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_states_at_their_bounds(spark):
    r = one(spark, a=S.damage_state(F.lit(0.05)), b=S.damage_state(F.lit(0.3499)), c=S.damage_state(F.lit(0.35)), d=S.dependency_state(F.lit(0.35)), e=S.dependency_state(F.lit(0.75)))
    assert tuple(r) == ("S1", "S2", "S3", "S2", "S0")


def test_territory_names(spark):
    r = one(spark, a=S.territory_cell(F.lit(16.24), F.lit(-61.55)), b=S.territory_cell(F.lit(-0.05), F.lit(0.0)), c=S.territory_cell(F.lit(None).cast("double"), F.lit(1.0)))
    assert tuple(r) == ("cell-+16.20_-61.60", "cell-+0.00_+00.00", "uploaded-aggregate")


def test_longitudes(spark):
    r = one(spark, a=S.wrap_longitude(F.lit(180.0)), b=S.wrap_longitude(F.lit(190.0)), c=S.wrap_longitude(F.lit(-190.0)), d=S.wrap_longitude(F.lit(540.0)))
    assert tuple(r) == (180.0, -170.0, 170.0, 180.0)


def test_numbers_must_be_finite(spark):
    r = one(spark, a=S.checked_number(F.lit("1e3")), b=S.checked_number(F.lit("NaN")), c=S.checked_number(F.lit("Infinity")), d=S.checked_number(F.lit("x")))
    assert tuple(r) == (1000.0, None, None, None)


def test_sigmoid(spark):
    r = one(spark, a=C.sigmoid(F.lit(25.7)), b=C.sigmoid(F.lit(59.6)))
    assert r.a == 0.0 and r.b == pytest.approx(0.5)


def test_interpolation_like_numpy(spark):
    x, y = [0.0, 1.0, 3.0], [0.1, 0.5, 0.9]
    curve = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in zip(x, y, strict=True)])
    asked = [-1.0, 0.0, 0.5, 2.0, 3.0, 9.0]
    got = spark.createDataFrame([(v,) for v in asked], "v double").select("v", C.interpolate(curve, F.col("v")).alias("y")).collect()
    assert [r.y for r in got] == pytest.approx(np.interp(asked, x, y, left=0.0).tolist())


def test_cents_add_up(spark):
    r = one(spark, **dict(zip("abc", S.cents(F.lit(0.05), [F.lit(0.5), F.lit(0.5), F.lit(0.0)]), strict=True)))
    assert (r.a, r.b, r.c) == (2, 2, 1)


def test_ratios_fall_back_to_the_first(spark):
    assert tuple(one(spark, **dict(zip("abc", S.ratio_map(F.lit(-1.0), F.lit(0.0), F.lit(None).cast("double")), strict=True)))) == (1.0, 0.0, 0.0)


EVENTS = [(1, 100.0), (2, 50.0), (3, 50.0), (4, 0.0), (5, 10.0)]


@pytest.fixture
def events(spark):
    return spark.createDataFrame([(k, v, 0.01) for k, v in EVENTS], "event_id long, loss double, frequency double")


def test_return_periods(events):
    got = {r.return_period: r.loss for r in metrics.pml(events, periods=(10, 20, 50, 100)).collect()}
    assert got == {100: 100.0, 50: 50.0, 20: 0.0, 10: 0.0}
    clamped = {r.return_period: r.loss for r in metrics.clamped_loss(events, periods=(10, 20, 100)).collect()}
    assert clamped == {100: 100.0, 20: 0.0, 10: 0.0}


def test_keyed_and_unkeyed_metrics_agree(events):
    a = metrics.pml(events).collect()
    b = metrics.pml(events.withColumn("k", F.lit(1)), ("k",)).drop("k").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    (x,), (y,) = metrics.tvar(events, ()).collect(), metrics.tvar(events.withColumn("k", F.lit(1)), ("k",)).drop("k").collect()
    assert tuple(x) == tuple(y)


def test_tail_value(events):
    r = metrics.tvar(events, ()).first()
    assert (r["var"], r.tvar) == (100.0, 100.0)


def test_top_events_leave_out_zero(events):
    assert [(r["rank"], r.event_id) for r in metrics.top_events(events, 10).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 5)]


def test_metrics_of_nothing(events):
    none = events.where("false")
    assert metrics.pml(none).collect() == [] and metrics.top_events(none, 3).collect() == []


def test_combination_caps_only_several(spark):
    rows = spark.createDataFrame([(1, "wind", 60.0, 100.0), (1, "rain", 60.0, 100.0), (2, "wind", 150.0, 100.0)], "point_id int, component string, eai double, value double")
    assert {r.point_id: r.eai for r in impact.combine_components(rows).collect()} == {1: 100.0, 2: 150.0}


def test_array_quantile_like_numpy(spark):
    xs = [1.0, 2.0, 3.0, 10.0, 50.0]
    r = one(spark, q=grid.array_quantile(F.array(*map(F.lit, xs)), 0.98), e=grid.array_quantile(F.array(F.lit(7.0)), 0.5))
    assert (r.q, r.e) == (pytest.approx(np.quantile(xs, 0.98)), 7.0)


def test_time_steps(spark):
    rows = spark.createDataFrame([("a", s) for s in (0, 2, 3)] + [("b", 5)], "track_id string, time_step int")
    got = [(r.track_id, r.time_step, r.step_h, r.elapsed_h) for r in tracks.timed(rows).orderBy("track_id", "time_step").collect()]
    assert got == [("a", 0, 6.0, 0.0), ("a", 2, 6.0, 6.0), ("a", 3, 3.0, 9.0), ("b", 5, 3.0, 0.0)]


def test_overlap_of_nothing(spark):
    a = spark.createDataFrame([("x",)], "track_id string")
    assert tracks.overlap_share(a, a.where("false")).first().overlap_pct is None


def test_lines(spark):
    path = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (100.0, 0.0), (100.0, 50.0))])
    got = sampling.sample_lines(spark.range(1).select(F.col("id").alias("feature_id"), path.alias("path")), 50.0).orderBy("k").collect()
    assert [(r.x, r.y) for r in got] == [(0.0, 0.0), (50.0, 0.0), (100.0, 0.0), (100.0, 50.0)]


def test_id_packing(spark):
    r = one(spark, a=codecs.unpack_ids(codecs.pack_ids(F.array(F.lit("b"), F.lit(" a "), F.lit("b"), F.lit("")))), b=codecs.unpack_ids(F.lit("no")), f=codecs.stable_factor(F.lit("x"), 1.0, 2.0))
    assert r.a == ["a", "b"] and r.b == [] and 1 <= r.f < 2


def test_quotas_and_samples(spark):
    rows = spark.range(100).select(F.col("id"), F.when(F.col("id") < 90, "a").otherwise("b").alias("s"))
    quotas = shares.stratified_quotas(rows, ["s"], 10)
    assert {r.s: r.quota for r in quotas.collect()} == {"a": 9, "b": 1}
    ids = [r.id for r in shares.evenly_spaced(rows, ["s"], quotas, "id").collect()]
    assert len(ids) == 10 and min(ids) == 0 and 89 in ids


def test_csv_ingest(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text("Asset_ID,LABEL,asset_type,exposure_category,value_eur,lat,lon,geometry_wkt\na1,One,eau_aep,water,1000,14.5,-61,\n,,house,,5,,,POINT (-61.5 16.25)\n")
    got = exposures.read_exposure(spark, f"file://{good}").orderBy("value_eur").collect()
    assert [(r.asset_id, r.asset_type, r.exposure_category, r.lat, r.lon) for r in got] == [("2", "habitation", "habitation", 16.25, -61.5), ("a1", "eau_aep_cana", "ouvrage_eau", 14.5, -61.0)]
    bad = tmp_path / "b.csv"
    bad.write_text("asset_type,value_eur,lat,lon\nhouse,x,1,1\nnope,1,1,1\nhouse,1,,\n")
    with pytest.raises(exposures.InputError, match="row 1.*row 2.*row 3"):
        exposures.read_exposure(spark, f"file://{bad}")


def test_geojson_ingest(spark, tmp_path):
    f = tmp_path / "a.geojson"
    f.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"x","value_eur":7,"asset_type":"house"},"geometry":{"type":"LineString","coordinates":[[-61,14],[-60,15]]}}]}')
    r = exposures.read_exposure(spark, f"file://{f}").first()
    assert (r.asset_id, r.value_eur, r.lon, r.lat, r.asset_type) == ("x", 7.0, -60.5, 14.5, "habitation")
    assert exposures.read_drawn(spark, f.read_text().replace('"value_eur":7,', "")).first().value_eur == exposures.DRAWN_VALUE
    with pytest.raises(exposures.InputError):
        exposures.read_exposure(spark, "x.xlsx")


def test_storm_text(spark, tmp_path):
    f = tmp_path / "STORM_DATA_1000_YEARS_2.txt"
    f.write_text("1,8,3,0,1,15.0,299.0,990,30,40,1,0,100\n1,8,3,1,2,15.0,299.0,990,30,40,1,0,100\n")
    got = storms.read_storm_text(spark, f"file://{f}", basin_id=1).collect()
    assert [(r.year, r.track_id, r.lon, r.wind) for r in got] == [(2001, "2-1-3", -61.0, 30.0)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0, "a")], "id int, v double, k string")
    sinks.write_csv(rows, f"file://{tmp_path}/c")
    sinks.write_split(rows, f"file://{tmp_path}/p", "k")
    sinks.append_journal(rows, f"file://{tmp_path}/j")
    assert spark.read.csv(f"file://{tmp_path}/c", header=True).columns == ["id", "v", "k"]
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == spark.read.json(f"file://{tmp_path}/j").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:{m:02d}:00", "a" if m % 2 else "b", float(m)) for h in (0, 1) for m in range(0, 60, 7)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"file://{tmp_path}/in")
    q = stream.windowed_counts(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, stream.windowed_counts(rows).collect()))


def test_grid_of_one_cell(spark):
    r = grid.regular_grid(spark, 0.0, 0.1, 0.0, 0.1, 0.5).collect()
    assert len(r) == 1 and math.isclose(r[0].lat, 0.05)


def test_tokens_and_units(spark):
    row = one(spark, a=S.token(F.lit("\t Eau-AEP cana\n")), b=S.category(F.lit(" Power\r\n")), c=S.asset_type(F.lit("nothing known"), strict=True), d=S.radius_nm(F.lit(1852.0), " Metres "), e=S.radius_nm(F.lit(1.852), "kilometre"), f=S.token(F.lit(None).cast("string")))
    assert row.asDict() == {"a": "eau_aep_cana", "b": "ouvrage_electrique", "c": None, "d": 1.0, "e": 1.0, "f": ""}
    for call in (lambda: S.radius_nm(F.lit(1.0), "miles"), lambda: S.wind_mps(F.lit(1.0), "mph")):
        with pytest.raises(ValueError, match="give one of"):
            call()


def test_multipliers_and_surge_from_a_map(spark):
    rows = [("storm", "rp50", "wind", 10.0), ("storm", "rp50", "rain", 6.0), ("storm", "rp50", "combined", 8.0), ("storm", "annual", "rain", 6.0), ("storm", "annual", "combined", 6.0), ("storm", "top5", "wind", 5.0), ("storm", "top5", "combined", -1.0)]
    known = spark.createDataFrame([("storm", s, 4.0) for s in ("rp50", "annual", "top5")], "hazard string, scenario string, loss double")
    got = {x.scenario: tuple(x)[2:] for x in proxy.scenario_ratios(spark.createDataFrame(rows, "hazard string, scenario string, component string, loss double"), known).collect()}
    assert got == {"rp50": (0.5, 0.3, 0.2, 0.8), "annual": (0.0, 1.0, 0.0, 1.0), "top5": (1.0, 0.0, 0.0, 0.0)}
