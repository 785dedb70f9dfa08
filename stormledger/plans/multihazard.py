"""Queries of runs with several components of a hazard, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves as C
from ..lineage import settled
from ..operators import jobs, multihazard, production
from . import adapters as A
from .catalogue import _flood_points
from .oracles import FLOOD, _mdd, _money
from .studies import _IDS, ASSETS, _case, assets, study

#: How many parts share a centroid, by component; what an intensity is made of.
SHARED = {"wind": 2, "rain": 4, "surge": 3}
INTENSITY = {"wind": ("l_quantity", 1.5), "rain": ("l_discount", 100_000.0), "surge": ("l_tax", 60.0)}
#: A prime, so that annual losses don't end on a half of the last digit that sums keep.
YEARS = 9973
WIDTH = {"wind": 5.0, "rain": 1000.0, "surge": 0.5}
#: Suppliers to a degree of latitude's hundredth, each at the next hundredth of longitude.
PLACES = 6000


def portfolio(spark, d):
    """All parts as points with a centroid and a curve for each component."""
    flood = C.number_curves(_flood_points(spark, d))
    points = C.assign_curves(assets(spark, d), flood)
    return points.withColumns({f"{c}_at": F.floor(F.col("point_id") / n).cast("long") for c, n in SHARED.items()}), flood


def components(spark, d):
    """All line items as events: wind, rain and surge at their parts' centroids. Surge comes with one of the hazards alone."""
    points, flood = portfolio(spark, d)
    rows = A.table(spark, d, "lineitem").withColumn("hazard", F.when(F.col("l_orderkey") % 2 == 0, "storm").otherwise("storm_cmcc"))
    k, x = F.col("wind_id"), F.col("k") * 5.0
    wind = points.select("wind_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20))))
    wind = wind.select(k.alias("impf_id"), x.alias("x"), C.sigmoid(x * (F.lit(0.8) + k % 5 / 10.0)).alias("y"))
    curves = {"wind": wind, "rain": flood.select(F.col("rain_id").alias("impf_id"), F.col("rain_mm").alias("x"), F.col("mdd").alias("y")), "surge": flood.select(F.col("surge_id").alias("impf_id"), F.col("depth_m").alias("x"), F.col("mdd").alias("y"))}
    out = {}
    for c, (column, times) in INTENSITY.items():
        own = rows.where("hazard = 'storm'") if c == "surge" else rows
        rows_at = own.select("hazard", F.col("l_orderkey").alias("event_id"), F.floor(F.col("l_partkey") / SHARED[c]).cast("long").alias("centroid_id"), (F.col(column) * times).alias("v"))
        # Dealt out by centroid, so that neither its groups nor its points need another shuffle.
        hazard = rows_at.repartition("centroid_id").groupBy("hazard", "event_id", "centroid_id").agg(F.max("v").alias("intensity"))
        out[c] = multihazard.Component(hazard.withColumn("frequency", F.lit(1.0 / YEARS)), curves[c], f"{c}_at", f"{c}_id", WIDTH[c])
    return points, out


_POINTS = " union all ".join(f"select '{c}' as c, point_id, value, {c}_id as id, point_id // {n} as cen from asg where value > 0" for c, n in SHARED.items())
_HAZARD = " union all ".join(
    f"select '{c}' as c, case when l_orderkey % 2 = 0 then 'storm' else 'storm_cmcc' end as hazard, l_orderkey as event_id, l_partkey // {SHARED[c]} as cen, max({col} * {t}::double) as v from lineitem {'where l_orderkey % 2 = 0' if c == 'surge' else ''} group by all" for c, (col, t) in INTENSITY.items()
)
MULTI = f"""{ASSETS}, {_IDS}, df as (select coalesce(max(case when code = 'F17.5' then surge_id end), min(surge_id)) as s from ids),
asg as (select point_id, value, {_case('asset_type', {a: C.WIND_IDS[c] for a, c in C.WIND_CURVE_OF.items()}, '2')} as wind_id, coalesce(ids.surge_id, s) as surge_id, coalesce(ids.surge_id, s) + 1000 as rain_id from ast cross join df left join ids on ids.code = {_case('asset_type', C.FLOOD_CURVE_OF, "'F17.5'")}),
fc as (select surge_id, f0.depth_m, greatest(0::double, least(1::double, min(f0.depth_m / 5))) as mdd from f0 join ids on ids.code = f0.code group by 1, 2),
cv as (select 'wind' as c, id, x, y from (select id, x, {_mdd('(x * (0.8::double + id % 5 / 10::double))')} as y from (select wind_id as id, r.range * 5::double as x from (select distinct wind_id from asg) cross join range(21) r))
  union all select 'surge', surge_id, depth_m, mdd from fc union all select 'rain', surge_id + 1000, depth_m * 1000::double / 0.25::double, mdd from fc),
sg as (select *, lead(x) over (partition by c, id order by x) as x1, lead(y) over (partition by c, id order by x) as y1 from cv),
pt as ({_POINTS}), hz as ({_HAZARD}),
rt as (select hz.c, hazard, event_id, cen, id, case when x1 is null then y else y + (y1 - y) / (x1 - x) * (v - x) end as damage from hz join (select distinct c, id, cen from pt) using (c, cen) join sg using (c, id) where v >= x and (x1 is null or v < x1)),
ls as (select c, hazard, event_id, point_id, value, value * damage as loss from rt join pt using (c, id, cen) where damage > 0),
each as (select hazard, c, point_id, {_money(f'loss * (1 / {YEARS}::double)')} as eai, max(loss) as max_loss, max(value) as value from ls group by 1, 2, 3),
np as (select hazard, count(distinct c) as n from hz group by 1),
bp as (select hazard, point_id, case when n > 1 then least(value, eai) else eai end as eai, case when n > 1 then least(value, max_loss) else max_loss end as max_loss from (select hazard, point_id, {_money('eai')} as eai, {_money('max_loss')} as max_loss, max(value) as value from each group by 1, 2) join np using (hazard)),
cat as (select distinct hazard, c, event_id from hz)"""
_SUMS = """re as (select hazard, c, event_id, sum(cast(loss as decimal(28,8)))::double as loss, cast(1 / 9973::double as decimal(38,18)) as f from (
    select hazard, c, event_id, loss from ls union all {combined} union all select hazard, c, event_id, 0 from cat union all select hazard, 'combined', event_id, 0 from cat) group by 1, 2, 3),
d1 as (select *, sum(case when loss > 0 then f else 0 end) over (partition by hazard, c order by loss desc, event_id rows unbounded preceding) as cum, sum(f) over (partition by hazard, c order by loss, event_id rows unbounded preceding) as up, sum(f) over (partition by hazard, c) as total from re),
vr as (select hazard, c, coalesce(min(case when up >= total * 0.95::decimal(3,2) then loss end), max(loss)) as var from d1 group by 1, 2),
tl as (select d1.hazard, d1.c, sum(cast(loss as decimal(24,6)) * cast(f as decimal(12,8)))::double / sum(f)::double as tvar95 from d1 join vr on vr.hazard = d1.hazard and vr.c = d1.c where loss >= var group by 1, 2),
aa as (select hazard, c, sum(cast(eai as decimal(28,8)))::double as aai from (select hazard, c, eai from each union all select hazard, 'combined', eai from bp) group by 1, 2)
select hazard, c as component, round(coalesce(max(aai), 0), 4) as aai, round(max(loss), 4) as max_event, round(max(tvar95), 4) as tvar95, """ + ", ".join(f"round(coalesce(max(case when loss > 0 and cum >= cast(1 as decimal(38,18)) / {p} then loss end), 0), 4) as pml_{p}" for p in (10, 20, 50, 100, 200)) + " from d1 join tl using (hazard, c) left join aa using (hazard, c) group by 1, 2"
_ADDED = "select hazard, 'combined', event_id, loss from ls"
_CAPPED = "select hazard, 'combined', event_id, least(max(value), sum(cast(loss as decimal(28,8)))::double) from ls group by hazard, event_id, point_id"


def _risk(spark, d, capped):
    out = multihazard.impacts(*components(spark, d), capped).risk()
    return out.select("hazard", "component", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


@study(f"with {MULTI}, " + _SUMS.format(combined=_ADDED))
def multi_hazard_risk(spark, d):
    """Annual impact, largest event, tail value and return-period losses of each component and of all together."""
    return _risk(spark, d, False)


@study(f"with {MULTI}, " + _SUMS.format(combined=_CAPPED))
def multi_hazard_risk_capped(spark, d):
    """The same with no point losing more than its value in one event."""
    return _risk(spark, d, True)


@study(f"with {MULTI} select hazard, point_id, round(eai, 9) as eai, round(max_loss, 9) as max_loss from bp")
def multi_hazard_points(spark, d):
    points, parts = components(spark, d)
    out = multihazard.by_point(settled(multihazard.by_component(multihazard.loss_rows(points, parts))))
    return out.select("hazard", "point_id", F.round("eai", 9).alias("eai"), F.round("max_loss", 9).alias("max_loss"))


@study("""with h as (select distinct case when l_orderkey % 2 = 0 then 'storm' else 'storm_cmcc' end as hazard from lineitem) select hazard, case when hazard = 'storm' then 'wind,rain,surge' else 'wind,rain' end as components, false as no_impact from h""")
def multi_hazard_model(spark, d):
    points, parts = components(spark, d)
    events = settled(multihazard.by_event(multihazard.loss_rows(points, parts)))
    out = multihazard.modelled(multihazard.catalogue(events), events)
    return out.select("hazard", F.array_join("components", ",").alias("components"), "no_impact")


#: Impacts by territory and hazard, without electric assets' dependency: the parts are of all types.
@study(f"""with {MULTI}, t as (select hazard, territory, value, least(value, greatest(0::double, coalesce(eai, 0))) as direct from (select distinct hazard from hz) cross join cls left join bp using (hazard, point_id))
    select hazard, territory, round(sum(cast(value as decimal(28,8)))::decimal(28,8), 2)::double as exposure, round(sum(cast(direct as decimal(28,8)))::decimal(28,8), 2)::double as direct_eai from t group by 1, 2""")
def multi_hazard_run(spark, d):
    """The whole run of a portfolio through all components: exposure and direct impact by territory."""
    points, parts = components(spark, d)
    kinds = F.when(F.col("asset_type").startswith("elec"), "elec_aerien").when(F.col("asset_type").contains("ouvrage"), "eau_ouvrage").otherwise("eau_reseau")
    done, _ = production.run_components(points.withColumn("infra_class", kinds).withColumn("asset_id", F.col("point_id")), parts)
    return done.territories.select("hazard", "territory", "exposure", "direct_eai")


@study(f"""with h as (select case when l_orderkey % 2 = 0 then 'storm' else 'storm_cmcc' end as hazard, l_orderkey as event_id, l_suppkey as c, max(l_quantity) as v from lineitem group by all),
    s as (select s_suppkey as c, greatest(0::double, s_acctbal) as value from supplier), im as (select hazard, c, {_money(f"value * {_mdd('v')} * (1 / {YEARS}::double)")} as eai from h join s using (c) where value > 0 and {_mdd('v')} > 0 group by 1, 2)
    select hazard, s.c::varchar as asset_id, round(cast(value as decimal(28,8)), 2)::double as exposure, round(cast(least(value, coalesce(eai, 0)) as decimal(28,8)), 2)::double as direct_eai from s cross join (select distinct hazard from h) left join im using (hazard, c)""")
def job_assets(spark, d):
    """The whole job over all suppliers as an upload and all line items as storms: results by asset, read from the document."""
    k = F.col("s_suppkey")
    lat, lon = -60.0 + F.floor(k / PLACES) / 100.0, -30.0 + k % PLACES / 100.0  # a place of its own, or an asset meets another's centroid
    supplier = A.table(spark, d, "supplier")
    exposure = supplier.select(k.cast("string").alias("asset_id"), F.lit("habitation").alias("asset_type"), F.lit("habitation").alias("exposure_category"), F.col("s_acctbal").alias("value_eur"), lat.alias("lat"), lon.alias("lon"))
    hazard = A.table(spark, d, "lineitem").groupBy(F.when(F.col("l_orderkey") % 2 == 0, "storm").otherwise("storm_cmcc").alias("hazard"), F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("centroid_id")).agg(F.max("l_quantity").alias("intensity"))
    centroids = supplier.select(k.alias("centroid_id"), lat.alias("lat"), lon.alias("lon"))
    curve = C.tabulate(spark).select(F.lit(C.DEFAULT_WIND_ID).alias("impf_id"), F.col("intensity").alias("x"), F.col("mdd").alias("y"))
    wind = jobs.Source(hazard.withColumn("frequency", F.lit(1.0 / YEARS)), centroids, curve, WIDTH["wind"])
    document = jobs.run_job(exposure, {"wind": wind}, C.number_curves(_flood_points(spark, d)), "run", "all suppliers", reach=0.004).document
    field = lambda name, kind: F.get_json_object("json", f"$.{name}").cast(kind).alias(name)
    return document.where("part = 'asset_results'").select(field("hazard", "string"), field("asset_id", "string"), field("exposure", "double"), field("direct_eai", "double"))
