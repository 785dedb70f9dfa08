"""Queries over texts: geometries, maps of studies, log lines, sections, catalogues by block; with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..lineage import shared_folder
from ..operators.proxy import SCENARIOS
from ..sources import accesslog, blocks, geojson, studyfiles
from . import adapters as A
from .studies import study


@study("""with c as (select c_custkey as feature_id, (c_custkey % 300)::double / 4 as x, (c_custkey % 170)::double / 4 as y, c_custkey % 6 as t from customer)
    select feature_id, case when t < 5 then x end as lon_min, case when t < 5 then case when t = 3 then -y else y end end as lat_min, case when t < 5 then case when t = 0 then x when t = 4 then x + 7 else x + 2 end end as lon_max, case when t < 5 then case when t in (0, 3) then y when t = 4 then y + 5 else y + 1 end end as lat_max from c""")
def geometry_boxes(spark, d):
    """Boxes of points, lines, areas, collections within collections, and of what has none."""
    k = F.col("c_custkey")
    x, y = (k % 300).cast("double") / 4, (k % 170).cast("double") / 4
    text = lambda form, *args: F.format_string(form, *args)
    point = text('{"type":"Point","coordinates":[%.2f,%.2f,99.5]}', x, y)
    line = text('{"type":"LineString","coordinates":[[%.2f,%.2f],[%.2f,%.2f]]}', x, y + 1, x + 2, y)
    area = text('{"type":"MultiPolygon","bbox":[-900,-900,900,900],"coordinates":[[[[%.2f,%.2f],[%.2f,%.2f,-7000],[%.2f,%.2f]]]]}', x, y, x + 2, y, x + 1, y + 1)
    pair = text('{"type":"GeometryCollection","geometries":[%s,{"type":"Point","coordinates":[%.2f,%.2f]}]}', point, x + 2, -y)
    deep = text('{"type":"GeometryCollection","geometries":[{"type":"GeometryCollection","geometries":[%s,%s]},{"type":"MultiPoint","coordinates":[[%.2f,%.2f]]}]}', line, area, x + 7, y + 5)
    chosen = F.when(k % 6 == 0, point).when(k % 6 == 1, line).when(k % 6 == 2, area).when(k % 6 == 3, pair).when(k % 6 == 4, deep).when(k % 12 == 5, "null")
    rows = A.table(spark, d, "customer").select(k.alias("feature_id"), geojson.box(chosen).alias("b"))
    return rows.select("feature_id", "b.*")


def _studies(spark, d):
    """A proxy file and an analysis for each supplier; parts of them are missing, malformed or of zeros, by its key."""
    k = F.col("s_suppkey")
    number = lambda m, a: (k * a % m).cast("double")
    form = F.format_string
    scenario = lambda a: form('{"global_multiplier":%s,"component_ratios":%s,"breakdown_shares":%s}', F.when(k % 5 == 0, '"none"').when(k % 5 == 1, "0").otherwise(form("%.2f", number(7, a) - 1)), F.when(k % 3 == 0, "[1,2]").otherwise(form('{"wind":%.1f,"surge":%.1f,"rain":"%.1f","combined_capped":99}', number(5, a), number(3, a), number(4, a))), F.when(F.lit(a) % 2 == 0, "{}").otherwise(form('{"eau_aep":%.1f,"eau_eu":%.1f,"unknown":50}', number(4, a), number(3, a))))
    named = ",".join('"%s":%%s' % s for s in SCENARIOS[:4])
    proxy = form('{"hazards":{"storm":{"scenarios":{' + named + '}},"other":{},"storm_cmcc":%s}}', *[scenario(a) for a in (1, 2, 3, 4)], F.when(k % 4 == 0, "7").otherwise(form('{"scenarios":{"event_max":%s}}', scenario(3))))
    analysis = F.when(k % 6 == 5, "{broken").otherwise(form('{"portfolio_results":{"storm":{"components_direct_eai_eur":{"wind":%.1f,"rain":%.1f,"surge":%.1f,"combined_capped":77}%s},"delta":{"eai":1}}}', number(5, 1), number(4, 1), number(3, 1), F.when(k % 2 == 0, form(',"components_direct_max_event_loss_eur":{"wind":%.1f,"surge":1}', number(3, 1))).otherwise("")))
    rows = A.table(spark, d, "supplier")
    return rows.select(k.alias("study"), proxy.alias("text")), rows.select(k.alias("study"), analysis.alias("text"))


def _three(w: str, r: str, s: str) -> str:
    return f"{{'w': case when {w} + {r} + {s} > 0 then ({w}) / ({w} + {r} + {s}) else 1 end, 'r': case when {w} + {r} + {s} > 0 then ({r}) / ({w} + {r} + {s}) else 0 end, 's': case when {w} + {r} + {s} > 0 then ({s}) / ({w} + {r} + {s}) else 0 end}}"


def _mod(m: int, a: str) -> str:
    return f"(k * {a} % {m})::double"


MAPS = f"""e as (select s_suppkey as k, hz as hazard, sc as scenario, a from supplier cross join (values ('storm'), ('storm_cmcc')) h(hz) cross join (values ('annual', 1), ('rp50', 2), ('rp100', 3), ('event_max', 4), ('top10', 0), ('top5', 0)) s(sc, a)),
an as (select *, case when hazard = 'storm' and k % 6 <> 5 then case when scenario = 'event_max' and k % 2 = 0 then {_three(_mod(3, '1'), '0::double', '1::double')} else {_three(_mod(5, '1'), _mod(4, '1'), _mod(3, '1'))} end else {{'w': 1::double, 'r': 0::double, 's': 0::double}} end as base,
  case when hazard = 'storm' then nullif(a, 0) when scenario = 'event_max' and k % 4 <> 0 then 3 end as own from e)"""


@study(f"with {MAPS} select k as study, hazard, scenario, round(base.w, 9) as wind, round(base.r, 9) as rain, round(base.s, 9) as surge from an")
def analysis_ratios(spark, d):
    out = studyfiles.component_ratios(_studies(spark, d)[1])
    return out.select("study", "hazard", "scenario", *[F.round(p, 9).alias(p) for p in studyfiles.PARTS])


@study(f"""with {MAPS}, p as (select *, case when own is not null and k % 3 > 0 then {_three(_mod(5, 'own'), _mod(4, 'own'), _mod(3, 'own'))} else base end as r, case when own is null or k % 5 in (0, 1) or (k * own % 7) = 1 then 1 else greatest(0, (k * own % 7) - 1) end::double as multiplier from an)
    select k as study, hazard, scenario, multiplier, round(r.w, 9) as wind, round(r.r, 9) as rain, round(r.s, 9) as surge from p""")
def proxy_maps(spark, d):
    proxies, analyses = _studies(spark, d)
    out = studyfiles.proxy_factors(proxies, studyfiles.component_ratios(analyses))
    return out.select("study", "hazard", "scenario", "multiplier", *[F.round(p, 9).alias(p) for p in studyfiles.PARTS])


@study(f"""with {MAPS}, o as (select *, own % 2 = 1 and (k * own % 4) + (k * own % 3) > 0 as has from an), f as (select *, case when has then own when hazard = 'storm' and max(case when scenario = 'annual' then has end) over (partition by k, hazard) then 1 end as src from o),
    x as (select *, {_mod(4, 'src')} as a1, {_mod(3, 'src')} as a2 from f where src is not null), u as (select * from (values ('eau_aep'), ('eau_eu'), ('elec_bt_souterrain'), ('elec_bt_aerien'), ('elec_hta_souterrain'), ('elec_hta_aerien'), ('eau_aep_ouvrages'), ('eau_eu_pr'), ('eau_eu_step')) c(class))
    select k as study, hazard, scenario, class, round(case class when 'eau_aep' then a1 when 'eau_eu' then a2 else 0 end / (a1 + a2), 9) as share from x cross join u""")
def proxy_class_shares(spark, d):
    return studyfiles.proxy_shares(_studies(spark, d)[0]).withColumn("share", F.round("share", 9))


def _lines(spark, d):
    """Events as log lines: some are broken, some are no objects, some lack fields."""
    k = F.col("event_id")
    ip = F.format_string("10.0.%d.%d", k % 3, F.col("user_id") % 50)
    text = F.format_string('{"time":"2024-01-%02d","visitor_ip":"%s","status":%d,"request":"%s"}', k % 28 + 1, ip, 200 + k % 5, F.col("event_type"))
    line = F.when(k % 17 == 0, F.concat(text, F.lit("}}"))).when(k % 17 == 1, "[1]").when(k % 17 == 2, '{"user_agent":"x","visitor_ip":null}').otherwise(text)
    return A.table(spark, d, "events").select(line.alias("value"))


@study("""with e as (select event_id as k, '10.0.' || event_id % 3 || '.' || user_id % 50 as ip, event_type from events where event_id % 17 > 1)
    select line, count(*) as n from (select case when k % 17 = 2 then 'null | other | ip=- | status=- | - | ua=x' else '2024-01-' || lpad((k % 28 + 1)::varchar, 2, '0') || ' | ' || case when ip = '10.0.1.7' then 'mine' else 'other' end || ' | ip=' || ip || ' | status=' || (200 + k % 5) || ' | ' || event_type || ' | ua=-' end as line from e) group by 1""")
def log_lines(spark, d):
    """Lines of the access log as people read them; what doesn't parse is left out."""
    return accesslog.rendered(accesslog.parsed(_lines(spark, d)), "10.0.1.7").groupBy("line").agg(F.count("*").alias("n"))


@study("""with s as (select s_suppkey as study, s_suppkey % 5 as n from supplier) select study, 'indicator ' || (i.range + 1) as indicator, (study * (i.range + 1))::varchar as first, i.range::int + 5 as line from s cross join range(5) i where i.range < n""")
def section_indicators(spark, d):
    """Of a report for each supplier the indicators of one section; others have tables too, and one names 1000 years."""
    k = F.col("s_suppkey")
    rows = F.transform(F.sequence(F.lit(1), (k % 5).cast("int")), lambda i: F.format_string("| indicator %d | %d | - |", i, k * i))
    body = F.when(k % 5 > 0, F.array_join(rows, "\n")).otherwise("")
    text = F.concat(F.lit("# Report\n| a | 1 |\n\n## Zone A  \n| indicator | x | y |\n"), F.when(k % 5 > 0, F.concat(body, F.lit("\n"))).otherwise(""), F.lit("|:---|---:|---|\n| over 1000 years | 1 | 2 |\ntext | no row\n## Zone B\n| indicator | x | y |\n| other | 3 | 4 |\n"))
    out = studyfiles.indicators(A.table(spark, d, "supplier").select(k.alias("study"), text.alias("text")), "zone a")
    return out.select("study", "indicator", F.col("values")[0].alias("first"), "line")


@study("""with p as (select event_type as dataset_id, user_id as track_id, floor((row_number() over (partition by user_id order by ts, event_id) - 1) / 3)::int as step from events),
    u as (select distinct dataset_id, track_id, step from p), l as (select *, step - lag(step) over w as s, lead(step) over w - step as nx, row_number() over w as r from u window w as (partition by dataset_id, track_id order by step))
    select dataset_id, count(*) as n, count(distinct track_id) as tracks, sum(case when r = 1 then coalesce(nx, 1) else s end * 3)::double as hours from l group by 1""")
def catalogue_by_block(spark, d):
    """Tracks built type by type into a table of blocks, cut off half-way, taken up again and read back."""
    points = A.track_points(spark, d).withColumn("time_step", F.floor(F.col("time_step") / 3).cast("int")).withColumnRenamed("event_type", "dataset_id").withColumn("event_id", F.col("event_id"))
    path = f"{shared_folder(spark).rstrip('/')}/catalogue-{uuid.uuid4().hex}"
    blocks.build_tracks(points.where(F.col("dataset_id") < "m"), path)
    blocks.build_tracks(points, path, at_once=2)
    return blocks.read_blocks(spark, path, "dataset_id").groupBy("dataset_id").agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("tracks"), F.sum("step_h").alias("hours"))
