"""The query catalogue: each entry applies library operators to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, scalars as S
from ..functions import curves as C
from ..operators import casestudy as case, proxy
from ..operators import grid, hazard, impact, interdependency as dep, metrics, sampling, shares, tracks
from ..sources import exposures, sinks, storms
from ..streaming import losses as stream
from . import adapters as A
from .oracles import ORACLES as ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FLAGSHIP = "eai_by_territory"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# Impact and metrics


@query
def eai_by_territory(spark, d):
    """Expected annual impact by territory."""
    points = A.suppliers(spark, d).select("point_id", "territory")
    rows = A.losses(spark, d).select("point_id", "loss", "frequency").join(points, "point_id")
    out = rows.groupBy("territory").agg(impact.money_sum(F.col("loss") * F.col("frequency")).alias("eai"))
    names = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("territory"), F.col("n_name").alias("name"))
    return out.join(names, "territory").select("territory", "name", "eai")


def _events(spark, d):
    return impact.by_event(A.losses(spark, d))


@query
def event_losses(spark, d):
    return _events(spark, d).select("event_id", "loss")


@query
def point_impacts(spark, d):
    return impact.by_point(A.losses(spark, d))


@query
def top_events(spark, d):
    return metrics.top_events(_events(spark, d), 20).select("rank", "event_id", "loss", "return_period")


@query
def top_events_by_territory(spark, d):
    rows = A.losses(spark, d).join(A.suppliers(spark, d).select("point_id", "territory"), "point_id")
    return metrics.top_events(impact.by_event(rows, ("territory", "event_id")), 5, ("territory",)).select("territory", "rank", "event_id", "loss")


@query
def pml_curve(spark, d):
    return metrics.pml(_events(spark, d))


@query
def pml_by_territory(spark, d):
    rows = A.losses(spark, d).join(A.suppliers(spark, d).select("point_id", "territory"), "point_id")
    return metrics.pml(impact.by_event(rows, ("territory", "event_id")), ("territory",))


@query
def return_level_by_point(spark, d):
    rows = A.losses(spark, d).groupBy("point_id", "event_id").agg(F.max("wind").alias("value")).withColumn("weight", F.lit(0.001))
    return metrics.return_level(rows, ("point_id",), (50, 100))


@query
def loss_at_rp_clamped(spark, d):
    rows = _events(spark, d).withColumn("territory", F.col("event_id") % 7)
    rows = rows.withColumn("frequency", F.when(F.col("territory") < 3, 0.0).otherwise(0.00001))  # three without frequencies
    return metrics.clamped_loss(rows, ("territory",))


@query
def tvar95(spark, d):
    return metrics.tvar(_events(spark, d), ())


@query
def tvar95_by_group(spark, d):
    return metrics.tvar(_events(spark, d).withColumn("g", F.col("event_id") % 5), ("g",))


@query
def mean_top_fraction(spark, d):
    return metrics.mean_top_fraction(_events(spark, d).withColumn("g", F.col("event_id") % 5), ("g",), 0.05)


@query
def max_loss_approx(spark, d):
    rows = A.losses(spark, d)
    return impact.approximate_max(impact.by_point(rows).select("point_id", "eai"), impact.by_event(rows)).select("point_id", F.round("max_loss_approx", 4).alias("max_loss_approx"))


@query
def max_loss_exact(spark, d):
    return impact.by_point(A.losses(spark, d)).select("point_id", "max_loss")


def _components(spark, d):
    rows = A.losses(spark, d)
    wind = rows.select("point_id", F.lit("wind").alias("component"), (F.col("loss") * 0.001).alias("eai"))
    rain = rows.select("point_id", F.lit("rain").alias("component"), (F.col("value") * F.col("rain") * 0.001).alias("eai"))
    surge = rows.select("point_id", F.lit("surge").alias("component"), (F.col("value") * F.col("surge") * 0.001).alias("eai"))
    return wind.unionAll(rain).unionAll(surge)


@query
def multi_hazard_combined(spark, d):
    values = A.suppliers(spark, d).select("point_id", "value")
    sums = _components(spark, d).groupBy("point_id", "component").agg(impact.money_sum(F.col("eai")).alias("eai"))
    return impact.combine_components(sums.join(values, "point_id"))


@query
def component_ratios(spark, d):
    out = shares.component_ratios(_components(spark, d).withColumn("g", F.col("point_id") % 10), ("g",))
    return out.select("g", *[F.round(c, 6).alias(c) for c in ("wind", "rain", "surge")])


@query
def run_metrics(spark, d):
    ev = _events(spark, d)
    return ev.agg(F.count("*").alias("n_events"), F.sum(F.col("frequency").cast(metrics.FREQUENCY)).cast("double").alias("total_frequency"), F.max("loss").alias("max_loss"), F.count_if(F.col("loss") > 0).alias("n_positive"))


# Interdependency


def _propagated(spark, d):
    points = dep.with_direct(A.network(spark, d))
    places = points.groupBy("hazard", "territory").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return dep.propagate(points, dep.resolve_health(places, dep.electric_health(points)))


@query
def damage_states(spark, d):
    ratio = C.sigmoid(F.col("wind"))
    return A.losses(spark, d).groupBy(S.damage_state(ratio).alias("state")).agg(F.count("*").alias("n"), impact.money_sum(F.col("value")).alias("value"))


@query
def elec_health_grouping_sets(spark, d):
    out = dep.electric_health(dep.with_direct(A.network(spark, d)))
    return out.select("hazard", "territory", "overall", "total", "s1", "s2", "s3", "n", *[F.round(c, 9).alias(c) for c in ("health", "lat", "lon")])


@query
def water_dependency_resolution(spark, d):
    points = dep.with_direct(A.network(spark, d))
    asked = points.groupBy("hazard", "territory").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    # Every third territory is asked for under a name without electric points, so that the nearest and the overall tier occur too.
    asked = asked.withColumn("territory", F.when(F.col("territory") % 3 == 0, F.col("territory") + 100).otherwise(F.col("territory"))).withColumn("lat", F.when(F.col("territory") % 2 == 0, F.col("lat"))).withColumn("lon", F.when(F.col("lat").isNotNull(), F.col("lon")))
    out = dep.resolve_health(asked, dep.electric_health(points))
    return out.select("hazard", "territory", "tier", F.round("health", 9).alias("health"), S.dependency_state(F.col("health")).alias("dependency"))


@query
def territory_results(spark, d):
    return dep.territory_results(_propagated(spark, d))


@query
def asset_results(spark, d):
    return dep.asset_results(_propagated(spark, d))


@query
def portfolio_results(spark, d):
    return dep.portfolio_results(dep.territory_results(_propagated(spark, d)))


@query
def component_health(spark, d):
    return dep.component_health(_propagated(spark, d))


@query
def dependency_impacted_assets(spark, d):
    return dep.dependent_assets(_propagated(spark, d))


@query
def state_pct_table(spark, d):
    return dep.state_shares(_propagated(spark, d))


@query
def network_state_pivot(spark, d):
    return dep.states_wide(_propagated(spark, d), ["storm", "storm_cmcc"])


@query
def results_sorted(spark, d):
    out = dep.territory_results(_propagated(spark, d))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("hazard").orderBy(F.desc("exposure"), "territory"))).select("hazard", "territory", "exposure", "place")


# Row functions


@query
def asset_alias_normalisation(spark, d):
    rows = A.table(spark, d, "customer").select("c_custkey", A.choose("c_mktsegment", A.CATEGORY_OF).alias("raw"))
    return rows.select("c_custkey", S.token(F.col("raw")).alias("token"), S.category(F.col("raw")).alias("category"))


@query
def infra_class(spark, d):
    rows = A.table(spark, d, "part").select("p_partkey", S.asset_type(A.choose("p_type", A.ASSET_OF)).alias("asset_type"), F.when(F.col("p_size") % 3 == 0, "Point").otherwise("LineString").alias("geometry"))
    group = F.when(F.col("asset_type").startswith("elec"), "ouvrage_electrique").when(F.col("asset_type").startswith("eau"), "ouvrage_eau").otherwise("habitation")
    return rows.select("p_partkey", "asset_type", S.infra_class(group, F.col("asset_type"), F.col("geometry")).alias("infra_class"), C.wind_curve_id(F.col("asset_type")).alias("wind_curve"), C.flood_curve_code(F.col("asset_type")).alias("flood_curve"))


@query
def unit_conversions(spark, d):
    v = F.col("value")
    return A.table(spark, d, "events").select("event_id", F.round(S.wind_mps(v, "km/h"), 9).alias("from_kmh"), F.round(S.wind_mps(v, "knots"), 9).alias("from_kn"), F.round(S.radius_nm(v, "km"), 9).alias("nm_from_km"), F.round(S.radius_nm(v, "m"), 9).alias("nm_from_m"))


@query
def longitude_wrapping(spark, d):
    lon = (F.col("c_custkey") * 37 % 1440).cast("double") - 720.0
    rows = A.table(spark, d, "customer").select("c_custkey", S.wrap_longitude(lon).alias("lon"))
    return rows.withColumn("across", S.longitude_within(F.col("lon"), F.lit(170.0), F.lit(-170.0)))


@query
def territory_binning(spark, d):
    k = F.col("c_custkey")
    rows = A.table(spark, d, "customer").select(S.territory_cell(F.when(k % 10 > 0, A.lat(k)), A.lon(k)).alias("cell"), "c_acctbal")
    return rows.groupBy("cell").agg(F.count("*").alias("n"), impact.money_sum(F.greatest(F.lit(0.0), "c_acctbal")).alias("value"))


@query
def analytic_curve(spark, d):
    return C.tabulate(spark)


@query
def checked_numbers(spark, d):
    raw = F.when(F.col("p_partkey") % 7 == 0, "NaN").when(F.col("p_partkey") % 7 == 1, "abc").otherwise(F.col("p_size").cast("string"))
    return A.table(spark, d, "part").select("p_partkey", S.checked_number(raw).alias("number"))


@query
def coordinate_keys(spark, d):
    k = F.col("s_suppkey")
    return A.table(spark, d, "supplier").select("s_suppkey", S.coordinate_key(A.lat(k)).alias("lat_key"), S.coordinate_key(A.lon(k)).alias("lon_key"), S.cell_index(A.lat(k), 0.05).alias("i"), S.cell_centre(S.cell_index(A.lat(k), 0.05), 0.05).alias("centre"))


@query
def haversine_distances(spark, d):
    k = F.col("s_suppkey")
    return A.table(spark, d, "supplier").select("s_suppkey", F.round(S.haversine_km(A.lon(k), A.lat(k), F.lit(-61.5), F.lit(16.2)), 6).alias("km"))


@query
def display_percentages(spark, d):
    rows = A.table(spark, d, "customer")
    return rows.select("c_custkey", F.round(S.percent_of(F.lit(100.0), F.col("c_acctbal")), 9).alias("pct"), F.round(S.risk_index(F.lit(12.5), F.col("c_acctbal")), 9).alias("risk_index"))


@query
def cent_allocation(spark, d):
    rows = A.table(spark, d, "lineitem")
    ratios = [F.lit(0.5), F.lit(0.3), F.lit(0.2)]
    a, b, c = S.cents(F.col("l_extendedprice"), ratios)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", a.alias("wind_cents"), b.alias("rain_cents"), c.alias("surge_cents"))


@query
def distinct_labels(spark, d):
    labels = F.array(F.col("p_brand"), F.lit(" "), F.concat(F.lit(" "), F.col("p_brand")), F.col("p_type"))
    return A.table(spark, d, "part").select("p_partkey", F.array_join(S.distinct_strings(labels), "|").alias("labels"))


@query
def props_extract(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return A.table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


@query
def block_numbers(spark, d):
    name = F.when(F.col("s_suppkey") % 3 == 0, "plain.txt").otherwise(F.concat(F.lit("STORM_1000_YEARS_"), F.col("s_suppkey"), F.lit(".txt")))
    return A.table(spark, d, "supplier").select("s_suppkey", storms.block_index(name).alias("block"))


@query
def frequency_curves(spark, d):
    rows = A.suppliers(spark, d).withColumn("p", F.explode(shares.frequency_curve(F.col("value"), F.lit(0.12), F.lit(30.0))))
    return rows.select("point_id", "p.return_period", "p.loss")


@query
def fallback_factor(spark, d):
    rows = A.network(spark, d)
    return rows.select("point_id", "hazard", shares.fallback_damage(F.lit(0.08), F.col("infra_class"), F.col("hazard"), F.concat_ws("|", "asset_id", "hazard", "infra_class")).alias("damage"))


@query
def track_id_digest(spark, d):
    ids = A.table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), "event_type").groupBy("event_type").agg(F.collect_set("id").alias("ids"))
    return ids.select("event_type", codecs.ids_digest(F.col("ids")).alias("digest"), F.size(codecs.unpack_ids(codecs.pack_ids("ids"))).alias("n"))


# Curves


def _flood_points(spark, d):
    rows = A.table(spark, d, "part").select(F.concat(F.lit("F"), F.col("p_size") % 20, F.lit("."), F.length("p_type") % 3).alias("code"), (F.col("p_partkey") % 13 / 2.0).alias("depth_m"))
    return rows.select("code", "depth_m", (F.col("depth_m") / 5.0).alias("mdd"))


@query
def flood_curve_catalogue(spark, d):
    return C.number_curves(_flood_points(spark, d))


@query
def curve_interpolation(spark, d):
    """Losses by point, each line item through its part's own curve; parts whose curve isn't known lose nothing."""
    curves = C.number_curves(_flood_points(spark, d)).select("code", "depth_m", "mdd")
    code = F.concat(F.lit("F"), F.col("p_size") % 20, F.lit("."), F.length("p_type") % 3).alias("code")
    parts = A.table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), code)
    rows = A.losses(spark, d).select("point_id", "part_id", "value", (F.col("wind") / 6.0 - 1.0).alias("depth")).join(parts, "part_id")
    damaged = proxy.through_curves(rows, curves, "code", "depth", "depth_m", "mdd")
    return damaged.groupBy("point_id").agg(impact.money_sum(F.col("value") * F.coalesce("damage", F.lit(0.0))).alias("loss"))


# Tracks and basins


def _basins(spark):
    return spark.createDataFrame([(1, 5.0, 60.0, -105.0, -1.0), (2, -60.0, -5.0, 10.0, 135.0), (3, 14.0, 15.0, -63.0, -62.0)], "basin_id int, lat_min double, lat_max double, lon_min double, lon_max double")


def _customer_points(spark, d):
    k = F.col("c_custkey")
    return A.table(spark, d, "customer").select(k.alias("id"), A.lat(k).alias("lat"), A.lon(k).alias("lon"))


@query
def basin_membership(spark, d):
    return tracks.basins_of(_customer_points(spark, d), _basins(spark))


@query
def outside_coverage(spark, d):
    p = _customer_points(spark, d)
    boxes = p.select("id", (F.col("lat") - 0.05).alias("lat_min"), (F.col("lat") + 0.05).alias("lat_max"), (F.col("lon") - 0.05).alias("lon_min"), (F.col("lon") + 0.05).alias("lon_max"))
    zones = spark.createDataFrame([(14.0, 15.5, -63.0, -61.5), (15.0, 16.5, -62.0, -60.9)], "lat_min double, lat_max double, lon_min double, lon_max double")
    return tracks.outside_coverage(boxes, zones).select("id")


@query
def spatial_window(spark, d):
    return tracks.spatial_window(_customer_points(spark, d))


@query
def track_topk_nearest(spark, d):
    return tracks.nearest_tracks(A.track_points(spark, d), 16.2, -61.5, 40).groupBy("track_id").agg(F.count("*").alias("n"), F.round(F.max("d2"), 9).alias("d2"))


@query
def track_timesteps(spark, d):
    return tracks.timed(A.track_points(spark, d).withColumn("time_step", F.col("time_step") * 2)).select("track_id", "time_step", "step_h", "elapsed_h")


@query
def track_dedup(spark, d):
    rows = A.track_points(spark, d).withColumn("time_step", F.floor(F.col("time_step") / 3))
    return tracks.first_per_step(rows, "event_id").select("track_id", "time_step", "event_id")


@query
def track_attributes(spark, d):
    return tracks.attributes(A.track_points(spark, d)).select("track_id", "year", "category", "n_points", F.round("max_wind", 9).alias("max_wind"), F.round("ambient_pressure", 9).alias("ambient_pressure"))


@query
def track_overlap_share(spark, d):
    rows = A.track_points(spark, d)
    return tracks.overlap_share(rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'"))


@query
def year_maxima(spark, d):
    out = grid.maxima_summary(A.track_points(spark, d), "year")
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("mean_max", "q99", "q999", "top")])


@query
def track_maxima(spark, d):
    out = grid.maxima_summary(A.track_points(spark, d), "track_id")
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("mean_max", "q99", "q999", "top")])


# Grids


def _rounded(df, *keep):
    return df.select(*[c if c in keep or t not in ("double",) else F.round(c, 9).alias(c) for c, t in df.dtypes])


@query
def cell_wind_stats(spark, d):
    return _rounded(grid.cell_statistics(A.track_points(spark, d), 0.5))


@query
def cell_zero_filled_stats(spark, d):
    return _rounded(grid.cell_statistics(A.track_points(spark, d), 0.5, years=100))


def _metric_cells(spark, d, kind, name):
    rows = grid.with_cells(A.track_points(spark, d).where(F.col("event_type") == kind), 0.5)
    return rows.groupBy("i", "j").agg(F.max("wind").alias(name))


@query
def cell_merge_components(spark, d):
    cells = grid.with_cells(A.track_points(spark, d), 0.5).select("i", "j").distinct()
    return _rounded(grid.merge_components(cells, _metric_cells(spark, d, "click", "rain"), _metric_cells(spark, d, "error", "surge")))


@query
def subgrid_max(spark, d):
    rows = grid.with_cells(A.track_points(spark, d), 0.1).groupBy("i", "j").agg(F.max("wind").alias("wind"), F.max("p_c").alias("p_c"))
    return _rounded(grid.coarsen(rows, 2, ["wind", "p_c"]))


@query
def grid_bounds(spark, d):
    cells = grid.cell_statistics(A.track_points(spark, d), 0.5)
    return _rounded(grid.bounds(cells, 0.5))


@query
def regular_grid(spark, d):
    return grid.regular_grid(spark, 14.0, 15.05, -63.0, -62.0, 0.1)


@query
def centroid_grid(spark, d):
    return grid.densify(A.suppliers(spark, d))


@query
def gap_filled(spark, d):
    cells = grid.with_cells(A.track_points(spark, d), 0.25).groupBy("i", "j").agg(F.max("wind").alias("wind"))
    holes = cells.withColumn("wind", F.when((F.col("i") * 7 + F.col("j") * 3) % 5 != 0, F.col("wind")))
    return _rounded(grid.fill_gaps(holes, "wind", 2))


@query
def smoothed_cells(spark, d):
    cells = grid.with_cells(A.track_points(spark, d), 0.25).groupBy("i", "j").agg(F.max("wind").alias("wind"))
    return _rounded(grid.smooth(cells, "wind", 2))


@query
def shared_histogram(spark, d):
    return grid.histogram(A.track_points(spark, d), "wind", ("event_type",), 5.0)


@query
def loss_histogram(spark, d):
    return grid.equal_bins(_events(spark, d), "loss", 7)


@query
def scenario_comparison(spark, d):
    rows = A.track_points(spark, d).where(F.col("event_type").isin("click", "error"))
    means = rows.groupBy("year").pivot("event_type", ["click", "error"]).agg(impact.steady_mean(F.col("wind")))
    return means.select("year", F.round("click", 9).alias("storm"), F.round("error", 9).alias("cmcc"), F.round(F.col("error") - F.col("click"), 9).alias("delta"))


@query
def nearest_centroids(spark, d):
    points = _customer_points(spark, d).withColumnRenamed("id", "point_id")
    centroids = A.suppliers(spark, d).select(F.col("point_id").alias("centroid_id"), (F.col("lat") + 0.003).alias("lat"), (F.col("lon") + 0.002).alias("lon"))
    return impact.assign_centroids(points, centroids, 0.5, 0.4).select("point_id", "centroid_id")


# Shares, samples, valuation


@query
def breakdown_shares(spark, d):
    parts = A.table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("class"))
    rows = A.losses(spark, d).join(parts, "part_id")
    out = shares.shares(rows.withColumn("g", F.col("point_id") % 4), ("g",), "class", "loss")
    return out.select("g", "class", "amount", F.round("share", 9).alias("share"))


@query
def proxy_reallocation(spark, d):
    parts = A.table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("class"))
    rows = A.losses(spark, d).join(parts, "part_id").groupBy("point_id", "class").agg(impact.money_sum(F.col("value")).alias("value"), impact.money_sum(F.when(F.col("class") != "PROMO", F.col("loss")).otherwise(0.0)).alias("loss"))
    proxy = spark.createDataFrame([("ECONOMY", 0.3), ("STANDARD", 0.2), ("PROMO", 0.2), ("LARGE", 0.2), ("SMALL", 0.1)], "class string, share double")
    return shares.reallocate(rows, proxy, 1.3, 0.7).select("point_id", "class", F.round("loss", 3).alias("loss"))


@query
def stratified_quota(spark, d):
    return shares.stratified_quotas(A.table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], 400)


@query
def stratified_sample(spark, d):
    rows = A.table(spark, d, "customer")
    quotas = shares.stratified_quotas(rows, ["c_nationkey"], 300)
    return shares.evenly_spaced(rows, ["c_nationkey"], quotas, "c_custkey").select("c_nationkey", "c_custkey")


@query
def valuation_portfolio(spark, d):
    rates = {"ECONOMY": 120.0, "STANDARD": 95.0, "PROMO": 310.0, "LARGE": 45.0, "MEDIUM": 210.0}
    rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("p_type")), F.lit(800.0))
    value = F.greatest(F.lit(5000.0), F.col("p_size") * rate)
    rows = A.table(spark, d, "part").withColumn("value", value)  # not within the roll-up, which blanks p_type
    return rows.rollup("p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("length"), impact.money_sum(F.col("value")).alias("value"))


@query
def exposure_summary(spark, d):
    kind = F.when(F.col("p_size") % 4 == 0, "point").when(F.col("p_size") % 4 == 1, "line").when(F.col("p_size") % 4 == 2, "polygon").otherwise("other")
    rows = A.table(spark, d, "part").select(kind.alias("kind"), S.estimated_points(kind, F.col("p_retailprice"), F.col("p_retailprice") * 50.0, 100.0).alias("points"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


@query
def line_sampling(spark, d):
    k = F.col("s_suppkey")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    path = F.array(point(F.lit(0), F.lit(0)), point(k % 50 * 10 + 10, F.lit(0)), point(k % 50 * 10 + 10, k % 30 * 10 + 20))
    return _rounded(sampling.sample_lines(A.table(spark, d, "supplier").select(k.alias("feature_id"), path.alias("path")), 100.0))


# Hazard fields and case studies


@query
def wind_field(spark, d):
    rows = A.track_points(spark, d).withColumn("p_c", F.col("p_c") - 40.0).withColumn("rmax_km", 20.0 + F.col("category") * 5.0)
    centroids = A.suppliers(spark, d).select(F.col("point_id").alias("centroid_id"), "lat", "lon")
    return hazard.wind_field(rows, centroids, 0.5, digits=6)


@query
def rain_and_surge(spark, d):
    km = F.col("p_size") * 6.0
    wind = F.col("p_partkey") % 60 * 1.0 + 10.0
    return A.table(spark, d, "part").select("p_partkey", F.round(hazard.rain_rate(km, wind / 0.514444), 6).alias("rain"), F.round(hazard.surge_depth(wind, F.col("p_size") / 20.0, km / 20.0), 6).alias("surge"))


@query
def annual_frequencies(spark, d):
    rows = hazard.annual_frequency(_events(spark, d).select("event_id").withColumn("frequency", F.lit(1.0)), 10_000)
    return hazard.annual_frequency(rows, 10_000).groupBy("frequency").agg(F.count("*").alias("n"))


@query
def class_scenarios(spark, d):
    parts = A.table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("class"))
    rows = A.losses(spark, d).join(parts, "part_id")
    return case.class_scenarios(rows, rows.groupBy("class").agg(impact.money_sum(F.col("value")).alias("value")))


@query
def top_scenarios(spark, d):
    return case.top_scenarios(_events(spark, d).withColumn("g", F.col("event_id") % 3), ("g",), {"top10": 0.10, "top5": 0.05})


@query
def portfolio_risk(spark, d):
    scaler = dep.portfolio_results(dep.territory_results(_propagated(spark, d))).where("hazard = 'storm'").select("scaler")
    return case.portfolio_risk(_events(spark, d), scaler)


@query
def derived_scenarios(spark, d):
    rp100 = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(0.0)
    name = F.element_at(F.array(F.lit("annual"), F.lit("rp50"), F.lit("rp100"), F.lit("event_max")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return A.table(spark, d, "supplier").select("s_suppkey", F.round(case.scenario_loss(name, rp100 * 0.01, case.derived_rp50(rp100), rp100, rp100 * 1.5), 6).alias("loss"))


@query
def artefact_coherence(spark, d):
    rows = A.table(spark, d, "orders").select(F.col("o_custkey").alias("territory"), (F.col("o_orderkey") % 2).alias("run_id"), F.col("o_orderkey").alias("step"), F.col("o_orderdate").alias("at"))
    return case.coherent(rows)


# Listings, logs, sinks


@query
def log_top_visitors(spark, d):
    rows = A.table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "event_type", "user_id").limit(50)


@query
def log_tail(spark, d):
    return A.table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type", "user_id")


@query
def log_find(spark, d):
    return A.table(spark, d, "events").where("user_id = 7 or event_id = 12 or get_json_object(props, '$.k') = '42'").select("event_id", "user_id")


@query
def log_split(spark, d):
    return A.table(spark, d, "events").groupBy(F.when(F.col("user_id") % 10 == 0, "own").otherwise("other").alias("part")).agg(F.count("*").alias("n"))


@query
def previous_run(spark, d):
    over = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = A.table(spark, d, "orders")
    return rows.select("o_orderkey", F.lag("o_orderkey").over(over).alias("previous"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(over), 2).alias("change"))


@query
def latest_runs(spark, d):
    rows = A.table(spark, d, "orders")
    return dep.latest(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query
def searched_rows(spark, d):
    return A.table(spark, d, "part").where(F.lower("p_name").contains("ring")).orderBy(F.desc("p_retailprice"), "p_partkey").limit(200).select("p_partkey", "p_name")


@query
def hazard_blocks_union(spark, d):
    a, b = A.losses(spark, d).where("event_id % 2 = 0"), A.losses(spark, d).where("event_id % 2 = 1")
    both = a.select("event_id", "point_id").unionByName(b.select("event_id", "point_id"))
    return both.groupBy("point_id").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


@query
def leftover_points(spark, d):
    p = _customer_points(spark, d).select("id")
    chosen = p.where("id % 3 = 0")
    return p.join(chosen, "id", "left_anti").unionByName(chosen.where("id > 3")).distinct()


@query
def event_summary(spark, d):
    rows = _events(spark, d).withColumn("hazard", F.when(F.col("event_id") % 2 == 0, "storm").otherwise("storm_cmcc"))
    return sinks.ranked_events(metrics.top_events(rows, 10, ("hazard",)).select("hazard", "event_id", "loss", "frequency"))


@query
def feature_preview(spark, d):
    rows = A.suppliers(spark, d).select(F.col("point_id").alias("asset_id"), "lat", "lon", F.col("value").alias("value_eur"))
    return sinks.preview(rows, 100)


@query
def result_document(spark, d):
    t = dep.territory_results(_propagated(spark, d))
    rows = sinks.result_json(t, dep.portfolio_results(t))
    field = lambda name, kind: F.get_json_object("json", f"$.{name}").cast(kind).alias(name)
    return rows.select("part", field("hazard", "string"), field("territory", "long"), *[field(c, "double") for c in ("exposure", "direct_eai", "indirect_eai", "total_eai", "risk_index", "scaler")])


@query
def expired_runs(spark, d):
    """Each run's state at a given time."""
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created"), (F.col("o_orderstatus") != "P").alias("terminal"))
    return case.retention(rows, "1998-01-01 00:00:00", 10).select("run_id", "state")


@query
def windowed_counts(spark, d):
    return stream.windowed_counts(A.table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "top")
