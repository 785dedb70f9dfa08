"""Queries of the case studies and of whole runs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as K
from ..functions import curves as C
from ..functions import scalars as S
from ..operators import comparison as comp
from ..operators import fallback, grid, impact, production, proxy, sampling
from . import adapters as A
from .catalogue import _events, _flood_points, _propagated, _rounded, query
from .oracles import EVENTS, FLOOD, LOSSES, NETWORK, PARTS, PORTFOLIO, PROPAGATED, TRACKS, _cents, _km, _lat, _lon, _mdd, _money

TYPES = sorted(C.FLOOD_CURVE_OF)
CODES = ("TRAIT", "stpmp", " CAP ", "CUV", "x")
STUDIES: dict[str, str] = {}


def study(sql: str | None):
    """Registers a query and its SQL."""

    def add(f):
        if sql is not None:
            STUDIES[f.__name__] = sql
        return query(f)

    return add


def _listed(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _case(x: str, table: dict, other: str = "null") -> str:
    return f"case {x} " + " ".join(f"when '{k}' then " + (f"'{v}'" if isinstance(v, str) else f"{v}::double" if isinstance(v, float) else str(v)) for k, v in table.items()) + f" else {other} end"


def assets(spark, d):
    """Parts as assets of all types."""
    k = F.col("p_partkey")
    at = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    code = F.when(k % 7 > 0, at(CODES))
    return A.table(spark, d, "part").select(k.alias("point_id"), at(TYPES).alias("asset_type"), F.when(k % 2 == 0, "guadeloupe").otherwise("martinique").alias("territory"), (F.col("p_size") / 10.0).alias("km"), code.alias("code"), F.col("p_retailprice").alias("value"), A.lat(k).alias("lat"), A.lon(k).alias("lon"))


ASSETS = f"""ast as (select p_partkey as point_id, ({_listed(TYPES)})[p_partkey % {len(TYPES)} + 1] as asset_type, case when p_partkey % 2 = 0 then 'guadeloupe' else 'martinique' end as territory, p_size / 10::double as km,
  case when p_partkey % 7 > 0 then ({_listed(CODES)})[p_partkey % {len(CODES)} + 1] end as code, p_retailprice as value, {_lat('p_partkey')} as lat, {_lon('p_partkey')} as lon from part),
cls as (select *, {_case('asset_type', K.NETWORK_CLASSES)} as network, case when starts_with(asset_type, 'eau_aep_ouvrage') then 'eau_aep_ouvrages' when asset_type in ('eau_eu_pr', 'eau_eu_step') then asset_type else {_case('asset_type', K.NETWORK_CLASSES)} end as class from ast)"""


@study(f"with {ASSETS} select point_id, network as network_class, class as breakdown_class from cls")
def network_classes(spark, d):
    return assets(spark, d).select("point_id", K.network_class(F.col("asset_type")).alias("network_class"), K.breakdown_class(F.col("asset_type")).alias("breakdown_class"))


@study(f"""with {ASSETS}, u as (select *, coalesce(case when territory = 'martinique' then {_case('asset_type', K.WATER_VALUES['martinique'])} else {_case('asset_type', K.WATER_VALUES['guadeloupe'])} end, {_case('asset_type', K.ELECTRIC_VALUES)}) as unit from cls)
    select point_id, round(case when network is not null then greatest(5000::double, km * unit) when class = 'eau_aep_ouvrages' then {_case("upper(trim(code, ' '))", K.WORKS_VALUES, '800000::double')} else unit end, 4) as value from u""")
def asset_values(spark, d):
    return assets(spark, d).select("point_id", F.round(K.asset_value(F.col("territory"), F.col("asset_type"), F.col("km"), F.col("code")), 4).alias("value"))


_IDS = f"{FLOOD}, ids as (select code, 4100 + row_number() over (order by code) - 1 as surge_id from (select code from (select code, depth_m from f0 group by 1, 2) group by 1 having count(*) > 1))"


@study(f"""with {ASSETS}, {_IDS}, df as (select coalesce(max(case when code = 'F17.5' then surge_id end), min(surge_id)) as s from ids)
    select point_id, {_case('asset_type', {a: C.WIND_IDS[c] for a, c in C.WIND_CURVE_OF.items()}, '2')} as wind_id, coalesce(ids.surge_id, s)::int as surge_id, (coalesce(ids.surge_id, s) + 1000)::int as rain_id
    from ast cross join df left join ids on ids.code = {_case('asset_type', C.FLOOD_CURVE_OF, "'F17.5'")}""")
def curve_assignment(spark, d):
    return C.assign_curves(assets(spark, d), C.number_curves(_flood_points(spark, d))).select("point_id", "wind_id", "surge_id", "rain_id")


@study(f"""with {_IDS}, p as (select code, depth_m, min(depth_m / 5) as mdd from f0 group by 1, 2), k as (select * from (values {', '.join(f"('{c}', '{a}')" for a, c in C.FLOOD_CURVE_OF.items())}) v(code, asset)),
    n as (select code, string_agg(asset, '|' order by asset) as assets from k group by 1)
    select p.code, surge_id::int as surge_id, count(*)::int as n_points, max(depth_m) as depth, round(max(depth_m * 1000 / 0.25::double), 6) as rain_mm, round(sum(cast(greatest(0::double, least(1::double, mdd)) as decimal(24,9)))::double, 6) as damage, coalesce(max(assets), '') as assets
    from p join ids on ids.code = p.code left join n on n.code = p.code group by 1, 2""")
def vulnerability_payload(spark, d):
    rows = C.payload(C.number_curves(_flood_points(spark, d)))
    total = F.aggregate("mdd", F.lit(0).cast("decimal(24,9)"), lambda acc, x: (acc + x.cast("decimal(24,9)")).cast("decimal(24,9)"))
    return rows.select("code", "surge_id", F.size("mdd").alias("n_points"), F.array_max("depth_m").alias("depth"), F.round(F.array_max("rain_mm"), 6).alias("rain_mm"), F.round(total.cast("double"), 6).alias("damage"), F.array_join("assets", "|").alias("assets"))


@study(f"""with c as (select c_custkey as k, (c_custkey % 50) / 100::double as a, (c_custkey % 30) / 100::double + 0.01 as b, c_custkey % 5 as t from customer),
    w as (select k, t, case when t in (0, 3) then {_km('-61::double', '16::double', '-61::double + a', '16::double + b')} when t = 1 then {_km('-61::double', '16::double', '-61::double + a', '16::double + b')} + {_km('-61.5::double', '16.5::double', '-61.5::double', '16.5::double + b')} end as km from c)
    select k as feature_id, round(case when t in (0, 1, 3) then case when km > 0 then km else 1 end when t = 2 then 3 else 1 end, 9) as weight from w""")
def feature_weights(spark, d):
    k = F.col("c_custkey")
    a, b = (k % 50) / 100.0, (k % 30) / 100.0 + 0.01
    one = F.format_string("[[-61.0,16.0],[%.6f,%.6f]]", F.lit(-61.0) + a, F.lit(16.0) + b)
    text = F.when(k % 5 == 1, F.concat(F.lit("["), one, F.format_string(",[[-61.5,16.5],[-61.5,%.6f]],[[1.0,2.0]]]", F.lit(16.5) + b))).when(k % 5 == 4, "[-61.0,16.0]").otherwise(one)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("LineString", "MultiLineString", "Polygon", "LineString", "Point")]), (k % 5 + 1).cast("int"))
    rows = A.table(spark, d, "customer").select(k.alias("feature_id"), kind.alias("kind"), text.alias("coordinates"))
    km = F.when(F.col("kind").contains("Line"), sampling.parts_km(sampling.line_parts(F.col("coordinates"))))
    return rows.select("feature_id", F.round(sampling.feature_weight(F.col("kind"), km), 9).alias("weight"))


@study("""with f as (select s_suppkey as feature_id, (s_suppkey % 50 * 10 + 10)::double as a, (s_suppkey % 30 * 40 + 20)::double as b from supplier),
    c as (select *, least(300, greatest(2, ceil((a + b) / 100)::int + 1)) as total from f),
    n as (select *, greatest(1, round_even(total * a / (a + b), 0)::int) as n0, greatest(1, round_even(total * b / (a + b), 0)::int) as s1 from c),
    m as (select *, least(n0, total) as m0, greatest(0, least(s1, total - n0)) as m1 from n)
    select feature_id, r.range::int as k, round(case when r.range < m0 then case when m0 > 1 then a * r.range / (m0 - 1) else 0 end else 0 end, 9) as x,
      round(case when r.range < m0 then 0 else 500 + case when m1 > 1 then b * (r.range - m0) / (m1 - 1) else 0 end end, 9) as y from m cross join range(0, 400) r where r.range < m0 + m1""")
def multiline_sampling(spark, d):
    k = F.col("s_suppkey")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    paths = F.array(F.array(point(F.lit(0), F.lit(0)), point(k % 50 * 10 + 10, F.lit(0))), F.array(point(F.lit(0), F.lit(500)), point(F.lit(0), k % 30 * 40 + 520)))
    return _rounded(sampling.sample_multilines(A.table(spark, d, "supplier").select(k.alias("feature_id"), paths.alias("paths")), 100.0))


@study("""with f as (select s_suppkey as feature_id, greatest(0::double, s_acctbal) as value, (s_suppkey % 50 * 10 + 10)::double as a from supplier),
    n as (select *, least(300, greatest(2, ceil(a / 100)::int + 1)) as n from f)
    select feature_id || '::p' || r.range as point_id, round(value / n, 6) as value, round(degrees((-6800000 + a * r.range / (n - 1)) / 6378137::double), 9) as lon, round(degrees(2 * atan(exp(1800000 / 6378137::double)) - pi() / 2), 9) as lat from n cross join range(0, 300) r where r.range < n""")
def exposure_points(spark, d):
    k = F.col("s_suppkey")
    point = lambda x: F.struct(x.cast("double").alias("x"), F.lit(1_800_000.0).alias("y"))
    features = A.table(spark, d, "supplier").select(k.alias("feature_id"), F.col("s_acctbal").alias("value"), F.array(point(F.lit(-6_800_000)), point(k % 50 * 10 - 6_799_990)).alias("path"))
    points = sampling.explode_points(features.select("feature_id", "value"), sampling.sample_lines(features.select("feature_id", "path"), 100.0))
    lon, lat = S.from_mercator(F.col("x"), F.col("y"))
    return points.select("point_id", F.round("value", 6).alias("value"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


def _map_cells(spark, d):
    """Cells of both hazards from a corner at 14 N, 63 W, half a degree wide, with four metrics."""
    rows = A.track_points(spark, d).where("event_type in ('click', 'error')").withColumn("hazard", F.when(F.col("event_type") == "click", "storm").otherwise("storm_cmcc"))
    rows = rows.withColumn("i", F.floor((F.col("lat") - 14.0) / 0.5).cast("long")).withColumn("j", F.floor((F.col("lon") + 63.0) / 0.5).cast("long"))
    m = F.max("wind")
    return rows.groupBy("hazard", "i", "j").agg((m * 0.01).alias("mean"), (m * 0.05).alias("rp50"), (m * 0.06).alias("rp100"), (m * 0.08).alias("top"))


CELLS = f"""{TRACKS}, mc as (select case when event_type = 'click' then 'storm' else 'storm_cmcc' end as hazard, floor((lat - 14) / 0.5)::bigint as i, floor((lon + 63) / 0.5)::bigint as j, max(wind) as m from t where event_type in ('click', 'error') group by 1, 2, 3),
mcell as (select hazard, i, j, m * 0.01::double as mean, m * 0.05::double as rp50, m * 0.06::double as rp100, m * 0.08::double as top from mc),
pcell as (select *, floor((lat - 14) / 0.5)::bigint as i, floor((lon + 63) / 0.5)::bigint as j from cls)"""


@study(f"""with {ASSETS}, {CELLS} select point_id, round(max(greatest(mean, rp50, rp100, top)), 9) as score from pcell join mcell using (i, j) group by 1 having max(greatest(mean, rp50, rp100, top)) > 0""")
def surge_priority(spark, d):
    return _rounded(proxy.priority_scores(assets(spark, d), _map_cells(spark, d), ("mean", "rp50", "rp100", "top"), 14.0, -63.0, 0.5))


_DEPTHS = """dep as (select hazard, s as scenario, i, j, case s when 'rp50' then rp50 when 'rp100' then rp100 when 'event_max' then top else mean end as depth from mcell cross join (values ('annual'), ('rp50'), ('rp100'), ('event_max'), ('top10'), ('top5')) v(s))"""


@study(f"""with {ASSETS}, {CELLS}, {_DEPTHS}, {FLOOD}, cv0 as (select code, depth_m as x, greatest(0::double, least(1::double, min(depth_m / 5))) as y from f0 group by 1, 2),
    ids2 as (select code from (select code, depth_m from f0 group by 1, 2) group by 1 having count(*) > 1),
    cv as (select *, lead(x) over (partition by code order by x) as x1, lead(y) over (partition by code order by x) as y1, min(x) over (partition by code) as xf from cv0 where code in (select code from ids2)),
    q as (select hazard, scenario, value, {_case('asset_type', C.FLOOD_CURVE_OF, "'F17.5'")} as code, depth from pcell join dep using (i, j)),
    r as (select q.*, case when cv.code is null or depth < xf then 0::double when x1 is null then y else y + (y1 - y) / (x1 - x) * (depth - x) end as damage from q left join cv on cv.code = q.code and ((depth >= x and (x1 is null or depth < x1)) or (depth < xf and x = xf)))
    select hazard, scenario, round({_money('value * damage')}, 4) as loss, count(*) as n from r group by 1, 2""")
def surge_proxy_losses(spark, d):
    cells = _map_cells(spark, d).withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in proxy.SCENARIOS])))
    depth = K.scenario_metric(F.col("scenario"), F.col("mean"), F.col("rp50"), F.col("rp100"), F.col("top"))
    points = assets(spark, d).select("value", "lat", "lon", C.flood_curve_code(F.col("asset_type")).alias("code"))
    curves = C.number_curves(_flood_points(spark, d)).select("code", "depth_m", "mdd")
    out = proxy.proxy_losses(points, cells.select("hazard", "scenario", "i", "j", depth.alias("depth")), curves, 14.0, -63.0, 0.5)
    return out.select("hazard", "scenario", F.round("loss", 4).alias("loss"), "n")


@study(f"""with {LOSSES}, v as (select * from (values ('annual', 0.001::double), ('rp50', 0.5::double), ('rp100', 0.8::double)) v(s, f)),
    r as (select case when point_id % 2 = 0 then 'storm' else 'storm_cmcc' end as hazard, s as scenario, value, case when s = 'annual' or point_id % 10 <> 9 then loss * f else 0 end as wind, value * rain * f as rain, case when s = 'rp50' then 0 else value * surge * f end as surge from l cross join v),
    g as (select hazard, scenario, {_money('wind')} as w, {_money('rain')} as r, {_money('surge')} as s0, {_money('least(value, wind + rain + surge)')} as c from r group by 1, 2),
    m as (select case when s_suppkey % 2 = 0 then 'storm' else 'storm_cmcc' end as hazard, {_money('s_acctbal')} as loss from supplier group by 1),
    h as (select g.*, case when s0 <= 0 and scenario <> 'annual' and m.loss > 0 then m.loss else s0 end as s from g left join m on m.hazard = g.hazard)
    select hazard, scenario, round(case when w + r + s > 0 then w / (w + r + s) else 1 end, 6) as wind_ratio, round(case when w + r + s > 0 then r / (w + r + s) else 0 end, 6) as rain_ratio, round(case when w + r + s > 0 then s / (w + r + s) else 0 end, 6) as surge_ratio, round(case when w > 0 then greatest(0::double, c / w) else 1 end, 6) as multiplier from h""")
def scenario_ratios(spark, d):
    """Shares and multipliers of all line items in three scenarios; one lacks surge, which a map of all suppliers gives."""
    rows = A.losses(spark, d).withColumn("hazard", F.when(F.col("point_id") % 2 == 0, "storm").otherwise("storm_cmcc"))
    rows = rows.withColumn("v", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(f).alias("f")) for s, f in (("annual", 0.001), ("rp50", 0.5), ("rp100", 0.8))])))
    wind = F.when((F.col("v.s") == "annual") | (F.col("point_id") % 10 != 9), F.col("loss") * F.col("v.f")).otherwise(0.0)
    rain, surge = F.col("value") * F.col("rain") * F.col("v.f"), F.when(F.col("v.s") == "rp50", 0.0).otherwise(F.col("value") * F.col("surge") * F.col("v.f"))
    parts = F.array(*[F.struct(F.lit(c).alias("component"), x.alias("loss")) for c, x in (("wind", wind), ("rain", rain), ("surge", surge), ("combined", F.least("value", wind + rain + surge)))])
    known = A.table(spark, d, "supplier").groupBy(F.when(F.col("s_suppkey") % 2 == 0, "storm").otherwise("storm_cmcc").alias("hazard")).agg(impact.money_sum(F.col("s_acctbal")).alias("loss"))
    known = known.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in proxy.SCENARIOS])))
    return proxy.scenario_ratios(rows.select("hazard", F.col("v.s").alias("scenario"), F.inline(parts)), known)


def _class_rows(spark, d):
    parts = A.table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("class"))
    return A.losses(spark, d).join(parts, "part_id")


def _six(spark, d):
    rows = _class_rows(spark, d)
    return comp.six_scenarios(rows, rows.groupBy("class").agg(impact.money_sum(F.col("value")).alias("value")))


SIX = f"""{PARTS}, val as (select class, {_money('value')} as value from lp group by 1), e as (select class, event_id, {_money('loss')} as loss, 0.0001::double as frequency from lp group by 1, 2),
c as (select *, sum(cast(frequency as decimal(38,18))) over (partition by class order by loss desc, event_id rows unbounded preceding) as cum, row_number() over (partition by class order by loss desc, event_id) as r, count(*) over (partition by class) as n from e),
a as (select class, 'annual' as scenario, {_money('loss * frequency')} as loss from lp group by 1
  union all select class, 'rp' || p, coalesce(max(case when cum >= cast(1 as decimal(38,18)) / p then loss end), min(loss)) from c cross join (values (50), (100)) v(p) group by class, p
  union all select class, 'event_max', max(loss) from e group by 1
  union all select class, s, sum(cast(loss as decimal(24,6)))::double / count(*) from c join (values ('top10', 0.1::double), ('top5', 0.05::double)) f(s, share) on r <= greatest(1, ceil(n * share)) group by 1, 2),
six as (select a.class, scenario, least(loss, greatest(value, 0::double)) as loss from a join val on val.class = a.class)"""


@study(f"with {SIX} select * from six")
def scenario_losses(spark, d):
    return _six(spark, d)


@study(f"with {SIX}, s as (select scenario, {_money('loss')} as loss from six group by 1) select scenario, round(loss, 4) as loss, round(loss / (select greatest(loss, 1e-9) from s where scenario = 'annual'), 6) as factor from s")
def scenario_factors(spark, d):
    return comp.scenario_factors(_six(spark, d)).select("scenario", F.round("loss", 4).alias("loss"), F.round("factor", 6).alias("factor"))


@study(f"""with {PROPAGATED}, x as (select *, (k % 37) / 10::double as km from w),
    g as (select hazard, infra_class, {_money('km')} as w, {', '.join(_money(f"case when final_state = 'S{i}' then km else 0 end") + f' as s{i}' for i in range(4))}, {_cents('direct')} as direct_eur, {_cents('indirect')} as indirect_eur, {_cents('total')} as total_eur from x group by 1, 2)
    select hazard, infra_class, {', '.join(f'round(case when w > 0 then s{i} / w * 100 else 0 end, 3) as pct_s{i}' for i in range(4))}, round(case when w <= 0 then 1 else greatest(0::double, least(1::double, 1 - (0.3::double * s1 + 0.7::double * s2 + s3) / w)) end, 6) as health, direct_eur, indirect_eur, total_eur from g""")
def network_states(spark, d):
    return comp.state_table(_propagated(spark, d).withColumn("km", F.col("k") % 37 / 10.0), "infra_class", "km")


@study(f"""with {PROPAGATED}, x as (select *, (k % 37) / 10::double as km from w)
    select hazard, 'annual' as scenario, round({_money("case when state = 'S3' then km else 0 end")} / greatest({_money('km')}, 1e-9) * 100, 3) as direct_pct, round({_money("case when state <> 'S3' and final_state = 'S3' then km else 0 end")} / greatest({_money('km')}, 1e-9) * 100, 3) as indirect_pct, {_cents('total')} as total_eur from x group by 1""")
def out_of_service(spark, d):
    return comp.out_of_service(_propagated(spark, d).withColumn("km", F.col("k") % 37 / 10.0).withColumn("scenario", F.lit("annual")), "km")


@study(f"with {EVENTS} select event_id, loss from ev order by loss desc, event_id limit 1")
def largest_event(spark, d):
    return comp.top_event(_events(spark, d))


@study(f"with {ASSETS} select class, {_money('km')} as km, count(*) as n, {_money('greatest(0::double, value)')} as value from cls where class is not null group by rollup (class)")
def exposure_metrics(spark, d):
    return comp.exposure_metrics(assets(spark, d))


@study(f"with {ASSETS} select upper(coalesce(nullif(trim(code, ' '), ''), 'NA')) as type, count(*) as n from cls group by 1")
def works_by_type(spark, d):
    return comp.works_by_type(assets(spark, d), "code")


@study(f"""with {PARTS}, a as (select class, {_money('loss')} as storm from lp where event_id % 2 = 0 and class <> 'PROMO' group by 1), b as (select class, {_money('loss')} as storm_cmcc from lp where event_id % 2 = 1 and class <> 'LARGE' group by 1)
    select coalesce(a.class, b.class) as class, coalesce(storm, 0) as storm, coalesce(storm_cmcc, 0) as storm_cmcc from a full outer join b on a.class = b.class""")
def hazards_by_class(spark, d):
    rows = _class_rows(spark, d).withColumn("hazard", F.when(F.col("event_id") % 2 == 0, "storm").otherwise("storm_cmcc"))
    rows = rows.where("not (hazard = 'storm' and class = 'PROMO') and not (hazard = 'storm_cmcc' and class = 'LARGE')")
    return comp.side_by_side(rows.groupBy("hazard", "class").agg(impact.money_sum(F.col("loss")).alias("loss")), "class", "loss")


@study(f"""with {TRACKS}, s as (select min(wind) as low, greatest(1e-9, max(wind) - min(wind)) as span from t), b as (select event_type, greatest(0, least(13, floor((wind - low) / span * 14)))::int as bin, low, span from t cross join s),
    g as (select event_type, bin, low + (bin + 0.5) * span / 14 as centre, count(*) as n from b group by 1, 2, 3)
    select event_type, bin, round(centre, 6) as centre, round(n / (sum(n) over (partition by event_type)) * 100, 6) as pct from g""")
def value_histogram(spark, d):
    return comp.shared_bins(A.track_points(spark, d), "wind", ("event_type",)).select("event_type", "bin", F.round("centre", 6).alias("centre"), F.round("pct", 6).alias("pct"))


_MEAN = "sum(cast(v as decimal(24,9))) filter (hazard = '{h}')::double / count(v) filter (hazard = '{h}')"


@study(f"""with {ASSETS}, {CELLS}, u as (select hazard, metric, v from (unpivot mcell on mean, rp50, rp100, top into name metric value v))
    select metric, round({_MEAN.format(h='storm')}, 6) as storm, round({_MEAN.format(h='storm_cmcc')}, 6) as cmcc, round({_MEAN.format(h='storm_cmcc')} - {_MEAN.format(h='storm')}, 6) as delta, round(max(v) filter (hazard = 'storm'), 6) as top_storm, round(max(v) filter (hazard = 'storm_cmcc'), 6) as top_cmcc from u group by 1""")
def basin_comparison(spark, d):
    out = comp.hazard_means(_map_cells(spark, d), ("mean", "rp50", "rp100", "top"))
    return out.select("metric", *[F.round(a, 6).alias(b) for a, b in (("mean_storm", "storm"), ("mean_storm_cmcc", "cmcc"), ("delta", "delta"), ("top_storm", "top_storm"), ("top_storm_cmcc", "top_cmcc"))])


@study(f"with {ASSETS}, {CELLS}, u as (select metric, v from (unpivot mcell on mean, rp50, rp100, top into name metric value v)) select metric, round(min(v), 9) as low, round(max(v), 9) as high from u group by 1")
def metric_ranges(spark, d):
    return _rounded(comp.metric_ranges(_map_cells(spark, d), ("mean", "rp50", "rp100", "top")))


@study(f"with {ASSETS}, {CELLS}, c as (select (i + 0.5) * 0.5::double as lat, (j + 0.5) * 0.5::double as lon from mcell) select min(lat) - 0.25 as south, max(lat) + 0.25 as north, min(lon) - 0.25 as west, max(lon) + 0.25 as east, round((max(lat) - min(lat) + 0.5) / 0.5)::bigint as n_rows, round((max(lon) - min(lon) + 0.5) / 0.5)::bigint as n_cols from c")
def union_bounds(spark, d):
    cells = _map_cells(spark, d)
    centre = [S.cell_centre(F.col(a), 0.5).alias(b) for a, b in (("i", "lat"), ("j", "lon"))]
    both = cells.where("hazard = 'storm'").select(*centre).unionByName(cells.where("hazard = 'storm_cmcc'").select(*centre))
    return grid.bounds(both.distinct(), 0.5)


@study(f"with {ASSETS} select split_part(class, '_', 1) as network, {_money('value')} as total from cls where class is not null group by 1")
def prefix_totals(spark, d):
    return comp.prefix_totals(assets(spark, d).withColumn("class", K.breakdown_class(F.col("asset_type"))).where("class is not null"), "class", "value")


@study(f"with {TRACKS}, k as (select event_type as dataset_id, track_id, count(*) as n from t group by 1, 2) select dataset_id, count(*) as tracks, sum(n)::bigint as points, round(count(*) * 0.0001::double, 9) as frequency from k group by 1")
def catalogue_blocks(spark, d):
    rows = A.track_points(spark, d).withColumn("frequency", A.frequency()).withColumnRenamed("event_type", "dataset_id")
    return comp.catalogue_mass(rows, ("dataset_id",)).select("dataset_id", "tracks", "points", F.round("frequency", 9).alias("frequency"))


@study(f"""with {ASSETS}, {CELLS}, u as (select hazard, metric, i, j, v * 10 as v from (unpivot mcell on mean, rp50, rp100, top into name metric value v))
    select hazard, metric, count(*) as n, count(case when hazard = 'storm_cmcc' and metric in ('rp50', 'rp100') and v <= 18 then null else v end) as shown, round(max(v) * 3.6, 6) as top_kmh from u group by 1, 2""")
def shown_cells(spark, d):
    rows = _map_cells(spark, d).unpivot(["hazard", "i", "j"], ["mean", "rp50", "rp100", "top"], "metric", "v").withColumn("v", F.col("v") * 10)
    shown = K.hide_low(F.col("v"), F.col("hazard"), F.col("metric"))
    return rows.groupBy("hazard", "metric").agg(F.count("*").alias("n"), F.count(shown).alias("shown"), F.round(K.kmh(F.max("v")), 6).alias("top_kmh"))


@study("""with e as (select s_suppkey, greatest(0::double, s_acctbal) as v, floor(s_acctbal / 1000 * 2) / 2 as a, ceil((s_acctbal / 1000 + s_suppkey % 9) * 2) / 2 as b from supplier)
    select s_suppkey, a as low, round(a + 5 * greatest(0.5, ceil((b - a) / 5 * 2) / 2), 6) as high, round(v, 6) as first, 0::double as last from e""")
def map_scales(spark, d):
    low = F.col("s_acctbal") / 1000.0
    edges = K.class_edges(low, low + F.col("s_suppkey") % 9)
    losses = K.fixed_length(F.array(F.col("s_acctbal"), F.lit(float("nan")), F.lit(-3.0)), 5)
    return A.table(spark, d, "supplier").select("s_suppkey", F.get(edges, 0).alias("low"), F.round(F.get(edges, 5), 6).alias("high"), F.round(F.get(losses, 0), 6).alias("first"), F.get(losses, 4).alias("last"))


@study(f"""with r as (select c_custkey as id, c_nationkey as s1, c_mktsegment as s2, case when c_custkey % 3 = 0 then greatest(0::double, c_acctbal) end as score from customer),
    z as (select s1, s2, count(*) as n, count(*) filter (score > 0) as np from r group by 1, 2),
    q0 as (select *, least(n, 1 + round_even(n / (sum(n) over ()) * greatest(0, 400 - count(*) over ()), 0)::bigint) as q from z),
    q1 as (select *, 400 - sum(q) over () as more, coalesce(sum(q - 1) over (order by q desc, s1, s2 rows between unbounded preceding and 1 preceding), 0) as less, coalesce(sum(n - q) over (order by n desc, s1, s2 rows between unbounded preceding and 1 preceding), 0) as room from q0),
    q2 as (select s1, s2, n, np, case when more < 0 then q - least(q - 1, greatest(0, -more - less)) else q + least(n - q, greatest(0, more - room)) end as q from q1),
    q3 as (select *, least(np, case when q <= 2 then q else greatest(1, ceil(q * 0.4::double)) end)::bigint as f from q2),
    q4 as (select *, least(q - f, n - np) as pl from q3),
    a as (select r.*, row_number() over (partition by r.s1, r.s2 order by score desc, id) - 1 as pos from r where score > 0),
    b as (select r.*, row_number() over (partition by r.s1, r.s2 order by id) - 1 as pos from r where score is null or score <= 0),
    sp as (select s1, s2, case when pl = 1 then 0 else round_even(k.range * (n - np - 1) / (pl - 1)::double, 0)::bigint end as pos from q4 cross join range(0, 400) k where k.range < pl)
    select a.id from a join q4 on q4.s1 = a.s1 and q4.s2 = a.s2 where a.pos < least(np, q - pl) union all select b.id from b join sp on sp.s1 = b.s1 and sp.s2 = b.s2 and sp.pos = b.pos""")
def stratified_priority(spark, d):
    rows = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("s1"), F.col("c_mktsegment").alias("s2"), F.when(F.col("c_custkey") % 3 == 0, F.greatest(F.lit(0.0), "c_acctbal")).alias("score"))
    return proxy.stratified_pick(rows, ["s1", "s2"], "id", "score", 400).select("id")


def _run(spark, d):
    s, c = A.table(spark, d, "supplier"), A.table(spark, d, "customer")
    centroids = s.select(F.col("s_suppkey").alias("centroid_id"), (A.lat(F.col("s_suppkey")) + 0.003).alias("lat"), (A.lon(F.col("s_suppkey")) + 0.002).alias("lon"))
    points = A.network(spark, d).where("hazard = 'storm'").select("point_id", "asset_id", "territory", "infra_class", "value", "lat", "lon")
    points = impact.assign_centroids(points, centroids, 0.5, 0.4)
    hazard = A.losses(spark, d).groupBy("event_id", F.col("point_id").alias("centroid_id")).agg(F.max("wind").alias("wind"))
    hazard = hazard.withColumn("v", F.explode(F.array(*[F.struct(F.lit(h).alias("hazard"), F.lit(f).alias("f")) for h, f in (("storm", 1.0), ("storm_cmcc", 1.25))])))
    hazard = hazard.select("v.hazard", "event_id", "centroid_id", (F.col("wind") * F.col("v.f")).alias("intensity"), A.frequency().alias("frequency"))
    return production.run(points, hazard, C.sigmoid(F.col("intensity")))


_IMPACT = f"""), ce as (select s_suppkey as cid, {_lat('s_suppkey')} + 0.003::double as clat, {_lon('s_suppkey')} + 0.002::double as clon from supplier),
nc as (select asset_id, arg_min(cid, {{'a': (lat - clat) * (lat - clat) + (lon - clon) * (lon - clon), 'b': cid}}) as cid from b join ce on abs(lat - clat) <= 0.4 and abs(lon - clon) <= 0.4 and (lat - clat) * (lat - clat) + (lon - clon) * (lon - clon) <= 0.4::double * 0.4::double where hazard = 'storm' group by 1),
ha as (select hz as hazard, l_orderkey as event_id, l_suppkey as cid, max(l_quantity) * f as v from lineitem cross join (values ('storm', 1::double), ('storm_cmcc', 1.25::double)) x(hz, f) group by hz, f, 2, 3),
ls as (select ha.hazard, event_id, asset_id, value * {_mdd('v')} as loss from ha join nc using (cid) join (select asset_id, value from b where hazard = 'storm') using (asset_id)),
im as (select hazard, asset_id, {_money('loss * 0.0001::double')} as eai, max(loss) as max_loss from ls group by 1, 2),
re as (select hazard, event_id, {_money('loss')} as loss, cast(0.0001::double as decimal(38,18)) as f from ls group by 1, 2),
c as (select b.*, coalesce(im.eai, 0) as eai, coalesce(im.max_loss, 0) as max_loss from b left join im on im.hazard = b.hazard and im.asset_id = b.asset_id"""
_AT = NETWORK.index("), c as (")
_RUN = PORTFOLIO.replace(NETWORK, NETWORK[:_AT] + _IMPACT + NETWORK[NETWORK.index("from b", _AT) + len("from b") :])
_PML = ", ".join(f"coalesce(max(case when loss > 0 and cum >= cast(1 as decimal(38,18)) / {p} then loss end), 0) as pml_{p}" for p in (10, 20, 50, 100, 200))
PRODUCTION = f"""with {_RUN}, pk as (select *, round(total_eai / greatest(direct_eai, 1::double), 6) as scaler from po),
d1 as (select *, sum(case when loss > 0 then f else 0 end) over (partition by hazard order by loss desc, event_id rows unbounded preceding) as cum, sum(f) over (partition by hazard order by loss, event_id rows unbounded preceding) as up, sum(f) over (partition by hazard) as total from re),
vr as (select hazard, coalesce(min(case when up >= total * 0.95::decimal(3,2) then loss end), max(loss)) as var from d1 group by 1),
tl as (select d1.hazard, sum(cast(loss as decimal(24,6)) * cast(f as decimal(12,8)))::double / sum(f)::double as tvar95 from d1 join vr on vr.hazard = d1.hazard where loss >= var group by 1),
ri as (select d1.hazard, {_PML}, max(loss) as max_event from d1 group by 1),
rs as (select ri.hazard, {', '.join(f'round(pml_{p} * scaler, 2) as pml_{p}' for p in (10, 20, 50, 100, 200))}, round(greatest(pml_200, max_event) * scaler, 2) as pml_1000, round(tvar95 * scaler, 2) as tvar95, round(max_event * scaler, 2) as max_event from ri join tl using (hazard) join pk using (hazard)),
lg as (select 'territory' as part, hazard, territory::varchar as name, figure, amount from (unpivot tr on exposure, direct_eai, indirect_eai, total_eai, risk_index into name figure value amount)
  union all select 'portfolio', hazard, '', figure, amount from (unpivot pk on exposure, direct_eai, indirect_eai, total_eai, scaler into name figure value amount)
  union all select 'risk', hazard, '', figure, amount from (unpivot rs on pml_10, pml_20, pml_50, pml_100, pml_200, pml_1000, tvar95, max_event into name figure value amount))
select part, hazard, name, figure, round(amount, 2) as amount from lg"""


@study(PRODUCTION)
def production_run(spark, d):
    """From exposure points and hazards to the portfolio's figures."""
    return production.figures(_run(spark, d)).select("part", "hazard", "name", "figure", F.round("amount", 2).alias("amount"))


@query
def run_document(spark, d):
    return production.document(_run(spark, d), "run", "all tables")


@query
def fallback_results(spark, d):
    """The engine without hazards over all points of both networks; every seventh has no place."""
    lat, lon = (F.when(F.col("k") % 7 > 0, F.col(c)) for c in ("lat", "lon"))
    weight = F.when(F.col("infra_class") == "eau_reseau", F.col("k") % 37 / 10.0 + 0.1).otherwise(1.0)
    points = A.network(spark, d).where("hazard = 'storm'").select(F.col("asset_id").alias("feature_id"), S.territory_cell(lat, lon).alias("territory"), lat.alias("lat"), lon.alias("lon"), "infra_class", "value", weight.alias("weight"), (F.col("k") % 9 + 1).alias("n_points"))
    return fallback.figures(fallback.fallback_run(points))


@study(f"with {PORTFOLIO}, x as (select * from po) select hazard, p as return_period, round(total_eai * p / 100::double, 2) as annual, round(round(total_eai * p / 100::double, 2) * 1.105::double, 2) as lifetime_30, round(round(total_eai * p / 100::double, 2) * 1.175::double, 2) as lifetime_50 from x cross join (values (10), (20), (50), (100), (200)) v(p)")
def chart_series(spark, d):
    from ..operators import interdependency as dep

    p = dep.portfolio_results(dep.territory_results(_propagated(spark, d)))
    return production.fec_series(p.select("hazard", *[F.round(F.col("total_eai") * n / 100.0, 2).alias(f"pml_{n}") for n in (10, 20, 50, 100, 200)]))
