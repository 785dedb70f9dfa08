"""DuckDB SQL for the catalogue's queries, over the driver's tables."""

from __future__ import annotations


def _v(v: str) -> str:
    return f"(({v} - 25.7::double) / (59.6::double - 25.7::double))"


def _mdd(v: str) -> str:
    c = f"({_v(v)} * {_v(v)} * {_v(v)})"
    return f"(case when {v} <= 25.7::double then 0::double else {c} / (1::double + {c}) end)"


def _money(x: str) -> str:
    return f"sum(cast({x} as decimal(28,8)))::double"


def _state(x: str) -> str:
    return f"(case when {x} >= 0.35::double then 'S3' when {x} >= 0.15::double then 'S2' when {x} >= 0.05::double then 'S1' else 'S0' end)"


def _dependency(x: str) -> str:
    return f"(case when {x} < 0.35::double then 'S3' when {x} < 0.55::double then 'S2' when {x} < 0.75::double then 'S1' else 'S0' end)"


def _lat(k: str) -> str:
    return f"(14::double + ({k} % 300) / 100::double)"


def _lon(k: str) -> str:
    return f"(-63::double + ({k} % 250) / 100::double)"


def _km(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * 6371.0088::double * asin(least(1::double, sqrt({a}))))"


LOSSES = f"l as (select l_orderkey as event_id, l_suppkey as point_id, l_partkey as part_id, l_quantity as wind, l_extendedprice as value, l_discount as rain, l_tax as surge, l_extendedprice * {_mdd('l_quantity')} as loss, 0.0001::double as frequency from lineitem)"
EVENTS = f"{LOSSES}, ev as (select event_id, {_money('loss')} as loss, 0.0001::double as frequency from l group by 1)"
SUPPLIERS = f"s as (select s_suppkey as point_id, s_nationkey as territory, greatest(0::double, s_acctbal) as value, {_lat('s_suppkey')} as lat, {_lon('s_suppkey')} as lon from supplier)"
TRACKS = f"t as (select user_id as track_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as time_step, dayofyear(ts) + 2000 as year, {_lat('event_id * 7')} as lat, {_lon('event_id * 13')} as lon, value / 3.6::double as wind, 1000::double - value / 10::double as p_c, event_id % 6 as category, event_type from events)"
NETWORK = f"""
a as (
  select 'e' || s_suppkey as asset_id, s_suppkey as k, s_nationkey as territory, s_acctbal as value, case when s_suppkey % 2 = 0 then 'elec_aerien' else 'elec_souterrain' end as infra_class from supplier
  union all
  select 'w' || c_custkey, c_custkey, c_nationkey, c_acctbal, case when c_mktsegment in ('AUTOMOBILE', 'MACHINERY') then 'eau_reseau' when c_mktsegment = 'FURNITURE' then 'eau_ouvrage' else 'habitation' end from customer
), b as (
  select hazard, asset_id, k, territory, infra_class, greatest(0::double, value) as value, {_lat('k')} as lat, {_lon('k')} as lon, case when hazard = 'storm' then 0 else 3 end as tilt
  from a cross join (values ('storm'), ('storm_cmcc')) h(hazard)
), c as (
  select *, value * ((k + tilt) % 11) / 100::double as eai, value * ((k * 7 + tilt) % 53) / 100::double as max_loss from b
), p as (
  select *, least(value, greatest(0::double, eai)) as direct, {_state('greatest(0::double, max_loss) / greatest(value, 1::double)')} as state from c
)"""
HEALTH = f"""
h0 as (
  select hazard, territory, grouping(territory) as overall, {_money('value')} as total,
    {_money("case when state = 'S1' then value else 0 end")} as s1, {_money("case when state = 'S2' then value else 0 end")} as s2, {_money("case when state = 'S3' then value else 0 end")} as s3, count(*) as n,
    sum(cast(lat as decimal(24,9)))::double / count(*) as lat, sum(cast(lon as decimal(24,9)))::double / count(*) as lon
  from p where infra_class in ('elec_aerien', 'elec_souterrain') group by grouping sets ((hazard, territory), (hazard))
), h as (
  select *, case when total <= 0 then 1::double else greatest(0::double, least(1::double, 1 - (0.3::double * s1 + 0.7::double * s2 + 1::double * s3) / total)) end as health from h0
)"""


def _resolved(asked: str) -> str:
    return f"""
q as ({asked}),
r0 as (select q.*, own.health as own from q left join (select * from h where overall = 0) own on own.hazard = q.hazard and own.territory = q.territory),
near as (
  select r0.hazard, r0.territory, arg_min(o.health, {{'a': floor({_km('r0.lon', 'r0.lat', 'o.lon', 'o.lat')} * 1e6), 'b': o.territory}}) as health
  from r0 join (select * from h where overall = 0) o on o.hazard = r0.hazard
  where r0.own is null and r0.lat is not null and r0.lon is not null group by 1, 2
),
r as (
  select r0.hazard, r0.territory, coalesce(r0.own, near.health, g.health, 1::double) as health, case when r0.own is not null then 'local' when near.health is not null then 'nearest' else 'global' end as tier
  from r0 left join near on near.hazard = r0.hazard and near.territory = r0.territory left join (select * from h where overall = 1) g on g.hazard = r0.hazard
)"""


PROPAGATED = f"""{NETWORK}, {HEALTH}, {_resolved('select hazard, territory, min(lat) as lat, min(lon) as lon from p group by 1, 2')},
w0 as (
  select p.*, case when infra_class in ('eau_reseau', 'eau_ouvrage') then {_dependency('coalesce(r.health, 1::double)')} else 'S0' end as dependency
  from p left join r on r.hazard = p.hazard and r.territory = p.territory
), w1 as (
  select *, greatest(state, dependency) as final_state, least(value, direct + direct * (case dependency when 'S1' then 0.1::double when 'S2' then 0.25::double when 'S3' then 0.45::double else 0::double end)) as total from w0
), w as (select *, total - direct as indirect from w1)"""


def _cents(x: str) -> str:
    return f"round(sum(cast({x} as decimal(28,8))), 2)::double"


TERRITORIES = f"""{PROPAGATED}, tr0 as (select hazard, territory, {_cents('value')} as exposure, {_cents('direct')} as direct_eai, {_cents('indirect')} as indirect_eai, {_cents('total')} as total_eai from w group by 1, 2),
tr as (select *, round(greatest(0::double, least(100::double, total_eai / greatest(exposure, 1::double) * 1000)), 2) as risk_index from tr0)"""
PORTFOLIO = f"""{TERRITORIES}, po as (
  select hazard, sum(cast(exposure as decimal(24,2)))::double as exposure, sum(cast(direct_eai as decimal(24,2)))::double as direct_eai, sum(cast(indirect_eai as decimal(24,2)))::double as indirect_eai, sum(cast(total_eai as decimal(24,2)))::double as total_eai from tr group by 1)"""


def _pml(source: str, keys: str, periods: str, value: str = "loss", weight: str = "frequency", beyond: str = "0::double", where: str = "loss > 0 and frequency > 0") -> str:
    part = f"partition by {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
x0 as (select * from ({source}) where {where}),
x as (select *, sum(cast({weight} as decimal(38,18))) over ({part} order by {value} desc, event_id rows unbounded preceding) as cum from x0),
rp as (select * from (values {periods}) v(return_period))
select {lead}return_period, coalesce(max(case when cum >= cast(1 as decimal(38,18)) / return_period then {value} end), {beyond}) as {value}
from x cross join rp group by {lead}return_period"""


RP = "(10), (20), (50), (100), (200)"


def _cells(degrees: str) -> str:
    return f"cell as (select *, floor(lat / {degrees}::double)::bigint as i, floor(lon / {degrees}::double)::bigint as j from t)"


def _stats(series: str) -> str:
    return f"""
y as (select i, j, year, max(wind) as m, sum(cast(wind as decimal(24,9))) as s, count(*) as n from cell group by 1, 2, 3),
z as (select i, j, sum(n)::bigint as sample_count, sum(s)::double / sum(n)::double as mean_wind, count(*) as n_years, list(m) as ms, max(m) as event_max from y group by 1, 2),
st as (select i, j, round((i + 0.5::double) * 0.5::double, 6) as lat, round((j + 0.5::double) * 0.5::double, 6) as lon, sample_count, n_years, round(mean_wind, 9) as mean_wind,
  round(list_aggregate({series}, 'quantile_cont', 0.98), 9) as rp50, round(list_aggregate({series}, 'quantile_cont', 0.99), 9) as rp100, round(event_max, 9) as event_max from z)"""


def _maxima(unit: str) -> str:
    return f"""with {TRACKS}, m as (select {unit}, max(wind) as m from t group by 1)
select count(*) as n, round(sum(cast(m as decimal(24,9)))::double / count(*), 9) as mean_max, round(quantile_cont(m, 0.99), 9) as q99, round(quantile_cont(m, 0.999), 9) as q999, round(max(m), 9) as top from m"""


COMPONENTS = f"""{LOSSES}, comp as (
  select point_id, 'wind' as component, loss * 0.001::double as eai from l union all select point_id, 'rain', value * rain * 0.001::double from l union all select point_id, 'surge', value * surge * 0.001::double from l)"""
FLOOD = """f0 as (select 'F' || (p_size % 20) || '.' || (length(p_type) % 3) as code, (p_partkey % 13) / 2::double as depth_m from part),
f1 as (select code, depth_m, min(depth_m / 5::double) as mdd from f0 group by 1, 2),
f2 as (select code, row_number() over (order by code) - 1 as pos from f1 group by code having count(*) > 1),
f as (select f1.code, (4100 + pos)::int as surge_id, (5100 + pos)::int as rain_id, depth_m, depth_m * 1000 / 0.25::double as rain_mm, greatest(0::double, least(1::double, mdd)) as mdd from f1 join f2 using (code))"""
ASSETS = "case p_type when 'ECONOMY' then 'eau_aep_cana' when 'STANDARD' then 'elec_bt_aerien' when 'PROMO' then 'elec_hta_souterrain' when 'LARGE' then 'eau_aep_ouvrage_cuv' when 'MEDIUM' then 'eau_eu_step' when 'SMALL' then 'habitation' end"
WIDE = "(c_custkey * 37 % 1440)::double - 720"
WRAPPED = f"(case when {WIDE} between -180 and 180 then {WIDE} else case when (((({WIDE}) + 180) % 360 + 360) % 360) - 180 = -180 and {WIDE} > 0 then 180 else (((({WIDE}) + 180) % 360 + 360) % 360) - 180 end end)"
GRID_AROUND = "(select a.range - 2 as a, b.range - 2 as b from range(5) a cross join range(5) b where (a.range - 2) * (a.range - 2) + (b.range - 2) * (b.range - 2) between 1 and 4)"
CELLS_25 = f"{TRACKS}, {_cells('0.25')}, g as (select i, j, max(wind) as wind from cell group by 1, 2)"
PARTS = f"{LOSSES}, lp as (select l.*, p_type as class from l join part on p_partkey = part_id)"

ORACLES: dict[str, str] = {
    "eai_by_territory": f"with {LOSSES}, {SUPPLIERS}, e as (select territory, {_money('loss * frequency')} as eai from l join s using (point_id) group by 1) select territory, n_name as name, eai from e join nation on n_nationkey = territory",
    "event_losses": f"with {EVENTS} select event_id, loss from ev",
    "point_impacts": f"with {LOSSES} select point_id, {_money('loss * frequency')} as eai, max(loss) as max_loss from l group by 1",
    "top_events": f"with {EVENTS} select row_number() over (order by loss desc, event_id)::int as rank, event_id, loss, 1 / frequency as return_period from ev where loss > 0 order by loss desc, event_id limit 20",
    "top_events_by_territory": f"with {LOSSES}, {SUPPLIERS}, e as (select territory, event_id, {_money('loss')} as loss from l join s using (point_id) group by 1, 2), r as (select *, row_number() over (partition by territory order by loss desc, event_id)::int as rank from e where loss > 0) select territory, rank, event_id, loss from r where rank <= 5",
    "pml_curve": f"with {EVENTS}, {_pml('select * from ev', '', RP)}",
    "pml_by_territory": f"with {LOSSES}, {SUPPLIERS}, e as (select territory, event_id, {_money('loss')} as loss, 0.0001::double as frequency from l join s using (point_id) group by 1, 2), {_pml('select * from e', 'territory', RP)}",
    "return_level_by_point": f"with {LOSSES}, e as (select point_id, event_id, max(wind) as value, 0.001::double as weight from l group by 1, 2), {_pml('select * from e', 'point_id', '(50), (100)', 'value', 'weight', where='true')}",
    "loss_at_rp_clamped": f"with {EVENTS}, e as (select event_id % 7 as territory, event_id, greatest(0::double, loss) as loss, case when event_id % 7 < 3 then 1::double / count(*) over (partition by event_id % 7) else 0.00001::double end as frequency from ev), {_pml('select * from e', 'territory', RP, beyond='min(loss)', where='true')}",
    "tvar95": f"""with {EVENTS}, c as (select *, cast(frequency as decimal(38,18)) as f, sum(cast(frequency as decimal(38,18))) over (order by loss, event_id rows unbounded preceding) as cum from ev),
        t as (select sum(f) as total from c), v as (select coalesce(min(case when cum >= total * 0.95::decimal(3,2) then loss end), max(loss)) as var from c cross join t)
        select max(var) as var, sum(cast(loss as decimal(24,6)) * cast(f as decimal(12,8)))::double / sum(f)::double as tvar from c cross join v where loss >= var""",
    "tvar95_by_group": f"""with {EVENTS}, c as (select *, event_id % 5 as g, cast(frequency as decimal(38,18)) as f, sum(cast(frequency as decimal(38,18))) over (partition by event_id % 5 order by loss, event_id rows unbounded preceding) as cum from ev),
        t as (select g, sum(f) as total from c group by 1), v as (select g, coalesce(min(case when cum >= total * 0.95::decimal(3,2) then loss end), max(loss)) as var from c join t using (g) group by 1)
        select g, max(var) as var, sum(cast(loss as decimal(24,6)) * cast(f as decimal(12,8)))::double / sum(f)::double as tvar from c join v using (g) where loss >= var group by 1""",
    "mean_top_fraction": f"with {EVENTS}, r as (select event_id % 5 as g, loss, row_number() over (partition by event_id % 5 order by loss desc, event_id) as r, count(*) over (partition by event_id % 5) as n from ev) select g, count(*) as n_events, sum(cast(loss as decimal(24,6)))::double / count(*) as mean_loss from r where r <= greatest(1, ceil(n * 0.05::double)) group by 1",
    "max_loss_approx": f"with {EVENTS}, p as (select point_id, {_money('loss * frequency')} as eai from l group by 1) select point_id, round(eai * (select max(loss) from ev) / (select sum(cast(eai as decimal(24,6)))::double from p), 4) as max_loss_approx from p",
    "max_loss_exact": f"with {LOSSES} select point_id, max(loss) as max_loss from l group by 1",
    "multi_hazard_combined": f"with {COMPONENTS}, {SUPPLIERS}, x as (select point_id, component, {_money('eai')} as eai from comp group by 1, 2), y as (select point_id, {_money('eai')} as total, count(distinct component)::int as n from x group by 1) select y.point_id, value, n as n_components, case when n > 1 then least(total, greatest(value, 0::double)) else total end as eai from y join s on s.point_id = y.point_id",
    "component_ratios": f"""with {COMPONENTS}, x as (select point_id % 10 as g, {_money("case when component = 'wind' then eai else 0 end")} as w, {_money("case when component = 'rain' then eai else 0 end")} as r, {_money("case when component = 'surge' then eai else 0 end")} as s from comp group by 1)
        select g, round(w / (w + r + s), 6) as wind, round(r / (w + r + s), 6) as rain, round(s / (w + r + s), 6) as surge from x""",
    "run_metrics": f"with {EVENTS} select count(*) as n_events, sum(cast(frequency as decimal(38,18)))::double as total_frequency, max(loss) as max_loss, count(*) filter (where loss > 0) as n_positive from ev",
    "damage_states": f"with {LOSSES} select {_state(_mdd('wind'))} as state, count(*) as n, {_money('value')} as value from l group by 1",
    "elec_health_grouping_sets": f"with {NETWORK}, {HEALTH} select hazard, territory, overall::tinyint as overall, total, s1, s2, s3, n, round(health, 9) as health, round(lat, 9) as lat, round(lon, 9) as lon from h",
    "water_dependency_resolution": f"""with {NETWORK}, {HEALTH}, q0 as (select hazard, case when territory % 3 = 0 then territory + 100 else territory end as territory, min(lat) as lat, min(lon) as lon from p group by 1, 2),
        {_resolved('select hazard, territory, case when territory % 2 = 0 then lat end as lat, case when territory % 2 = 0 then lon end as lon from q0')}
        select hazard, territory, tier, round(health, 9) as health, {_dependency('health')} as dependency from r""",
    "territory_results": f"with {TERRITORIES} select * from tr",
    "asset_results": f"with {PROPAGATED} select hazard, asset_id, {_cents('value')} as exposure, {_cents('direct')} as direct_eai, {_cents('total')} as total_eai, max(final_state) as state, min(infra_class) as infra_class from w group by 1, 2",
    "portfolio_results": f"with {PORTFOLIO} select *, round(total_eai / greatest(direct_eai, 1::double), 6) as scaler from po",
    "component_health": f"""with {PROPAGATED}, x as (select hazard, infra_class, {_money('value')} as total, {_money("case when final_state = 'S1' then value else 0 end")} as s1, {_money("case when final_state = 'S2' then value else 0 end")} as s2, {_money("case when final_state = 'S3' then value else 0 end")} as s3 from w group by 1, 2)
        select hazard, infra_class, round(case when total <= 0 then 1::double else greatest(0::double, least(1::double, 1 - (0.3::double * s1 + 0.7::double * s2 + s3) / total)) end, 4) as health from x""",
    "dependency_impacted_assets": f"with {PROPAGATED} select hazard, count(distinct asset_id) as n_assets from w where dependency <> 'S0' and indirect > 0 group by 1",
    "state_pct_table": f"with {PROPAGATED} select hazard, infra_class, "
    + ", ".join(f"""round(case when {_money('value')} > 0 then {_money(f"case when final_state = '{s}' then value else 0 end")} / {_money('value')} * 100 else 0 end, 3) as pct_{s.lower()}""" for s in ("S0", "S1", "S2", "S3"))
    + " from w group by 1, 2",
    "network_state_pivot": f"with {PROPAGATED} select asset_id, coalesce(max(case when hazard = 'storm' then final_state end), 'S0') as storm, coalesce(max(case when hazard = 'storm_cmcc' then final_state end), 'S0') as storm_cmcc from w group by 1",
    "results_sorted": f"with {TERRITORIES} select hazard, territory, exposure, row_number() over (partition by hazard order by exposure desc, territory)::int as place from tr",
    "asset_alias_normalisation": """with r as (select c_custkey, case c_mktsegment when 'HOUSEHOLD' then 'residential' when 'BUILDING' then 'house' when 'AUTOMOBILE' then 'water_network' when 'MACHINERY' then 'power' when 'FURNITURE' then 'unknown' end as token from customer)
        select c_custkey, token, case token when 'water_network' then 'ouvrage_eau' when 'power' then 'ouvrage_electrique' else 'habitation' end as category from r""",
    "infra_class": f"""with r as (select p_partkey, {ASSETS} as asset_type, case when p_size % 3 = 0 then 'point' else 'line' end as geometry from part)
        select p_partkey, asset_type, case when asset_type like 'elec%' then case when asset_type like '%souterrain%' then 'elec_souterrain' else 'elec_aerien' end
          when asset_type like 'eau%' then case when asset_type like '%step%' or asset_type like '%ouvrage%' or geometry = 'point' then 'eau_ouvrage' else 'eau_reseau' end else 'habitation' end as infra_class,
          case asset_type when 'eau_aep_cana' then 316 when 'elec_bt_aerien' then 310 when 'elec_hta_souterrain' then 316 when 'eau_aep_ouvrage_cuv' then 215 when 'eau_eu_step' then 212 else 2 end as wind_curve,
          case asset_type when 'eau_aep_cana' then 'F19.3' when 'elec_bt_aerien' then 'F6.2' when 'elec_hta_souterrain' then 'F6.1' when 'eau_aep_ouvrage_cuv' then 'F13.1' when 'eau_eu_step' then 'F18.4' else 'F17.5' end as flood_curve from r""",
    "unit_conversions": "select event_id, round(value / 3.6::double, 9) as from_kmh, round(value * 0.514444::double, 9) as from_kn, round(value / 1.852::double, 9) as nm_from_km, round(value / 1852::double, 9) as nm_from_m from events",
    "longitude_wrapping": f"with r as (select c_custkey, {WRAPPED} as lon from customer) select c_custkey, lon, lon >= 170 or lon <= -170 as across from r",
    "territory_binning": f"""with r as (select case when c_custkey % 10 > 0 then round_even({_lat('c_custkey')} / 0.2::double, 0) * 0.2::double end as a, round_even({_lon('c_custkey')} / 0.2::double, 0) * 0.2::double as b, c_acctbal from customer)
        select case when a is null then 'uploaded-aggregate' else printf('cell-%+05.2f_%+06.2f', a, b) end as cell, count(*) as n, {_money('greatest(0::double, c_acctbal)')} as value from r group by 1""",
    "analytic_curve": f"select range::double as intensity, {_mdd('range::double')} as mdd, 1::double as paa from range(301)",
    "checked_numbers": "select p_partkey, case when p_partkey % 7 in (0, 1) then null else p_size::double end as number from part",
    "coordinate_keys": f"with r as (select s_suppkey, round_even({_lat('s_suppkey')} * 1e5, 0)::bigint as lat_key, round_even({_lon('s_suppkey')} * 1e5, 0)::bigint as lon_key, floor({_lat('s_suppkey')} / 0.05::double)::bigint as i from supplier) select *, round((i + 0.5::double) * 0.05::double, 6) as centre from r",
    "haversine_distances": f"select s_suppkey, round({_km(_lon('s_suppkey'), _lat('s_suppkey'), '-61.5::double', '16.2::double')}, 6) as km from supplier",
    "display_percentages": "select c_custkey, round(case when c_acctbal > 0 then 100 / c_acctbal * 100 end, 9) as pct, round(greatest(0::double, least(100::double, 12.5::double / greatest(c_acctbal, 1::double) * 1000)), 9) as risk_index from customer",
    "cent_allocation": """with r as (select *, round_even(l_extendedprice * 100, 0)::bigint as w from lineitem), q as (select *, round_even(w * 0.5::double, 0)::bigint as a, round_even(w * 0.3::double, 0)::bigint as b from r)
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, a as wind_cents, b as rain_cents, w - a - b as surge_cents from q""",
    "distinct_labels": "select p_partkey, p_brand || '|' || p_type as labels from part",
    "props_extract": "with r as (select event_type, try_cast(json_extract_string(props, '$.k') as int) as k from events) select event_type, count(k) as n, sum(k)::bigint as total, max(k) as top from r group by 1",
    "block_numbers": "select s_suppkey, (case when s_suppkey % 3 = 0 then 0 else s_suppkey end)::int as block from supplier",
    "frequency_curves": f"with {SUPPLIERS} select point_id, rp as return_period, round(value * 0.12::double / sqrt(rp::double) * (1 + 30::double / 100 * 0.35::double), 2) as loss from s cross join (values (2), (5), (10), (20), (50), (100), (200), (250), (500), (750), (1000)) v(rp)",
    "track_id_digest": "with r as (select event_type, list_sort(list(distinct user_id::varchar)) as ids from events group by 1) select event_type, sha256(array_to_string(ids, chr(10))) as digest, len(ids)::int as n from r",
    "flood_curve_catalogue": f"with {FLOOD} select * from f",
    "curve_interpolation": f"""with {LOSSES}, {FLOOD}, k as (select code, depth_m as x0, mdd as y0, lead(depth_m) over (partition by code order by depth_m) as x1, lead(mdd) over (partition by code order by depth_m) as y1 from f),
        d as (select point_id, value, wind / 6::double - 1 as x, 'F' || (p_size % 20) || '.' || (length(p_type) % 3) as code from l join part on p_partkey = part_id),
        e as (select point_id, value * coalesce(case when x1 is null then y0 else y0 + (y1 - y0) / (x1 - x0) * (x - x0) end, 0::double) as loss from d left join k on k.code = d.code and x >= x0 and (x < x1 or x1 is null))
        select point_id, {_money('loss')} as loss from e group by 1""",
    "basin_membership": f"select 1 as basin_id where exists (select 1 from customer where {_lat('c_custkey')} between 5 and 60) union all select 3 where exists (select 1 from customer where {_lat('c_custkey')} between 14 and 15 and {_lon('c_custkey')} between -63 and -62)",
    "outside_coverage": f"""with r as (select c_custkey as id, {_lat('c_custkey')} as lat, {_lon('c_custkey')} as lon from customer)
        select id from r where not exists (select 1 from (values (14::double, 15.5::double, -63::double, -61.5::double), (15::double, 16.5::double, -62::double, -60.9::double)) z(a, b, c, d) where not (lon + 0.05::double < c or lon - 0.05::double > d or lat + 0.05::double < a or lat - 0.05::double > b))""",
    "spatial_window": f"select min({_lat('c_custkey')}) - 4 as lat_min, max({_lat('c_custkey')}) + 4 as lat_max, min({_lon('c_custkey')}) - 4 as lon_min, max({_lon('c_custkey')}) + 4 as lon_max from customer",
    "track_topk_nearest": f"with {TRACKS}, m as (select track_id, count(*) as n, min((lat - 16.2::double) * (lat - 16.2::double) + (lon + 61.5::double) * (lon + 61.5::double)) as d2 from t group by 1) select track_id, n, round(d2, 9) as d2 from m order by m.d2, track_id limit 40",
    "track_timesteps": f"with {TRACKS} select track_id, time_step * 2 as time_step, case when count(*) over (partition by track_id) = 1 then 3::double else 6::double end as step_h, (time_step * 6)::double as elapsed_h from t",
    "track_dedup": f"with {TRACKS} select track_id, floor(time_step / 3)::bigint as time_step, min(event_id) as event_id from t group by 1, 2",
    "track_attributes": f"with {TRACKS} select track_id, arg_min(year, time_step)::int as year, max(category)::int as category, count(*) as n_points, round(max(wind), 9) as max_wind, round(min(greatest(p_c + 5, 1010::double)), 9) as ambient_pressure from t group by 1",
    "track_overlap_share": "with a as (select distinct user_id from events where event_type = 'click'), b as (select distinct user_id from events where event_type = 'purchase') select (select count(*) from a) as n, (select count(*) from b) as n_previous, (select count(*) from a where user_id in (select user_id from b)) as common, round((select count(*) from a where user_id in (select user_id from b))::double / (select count(*) from a) * 100, 2) as overlap_pct",
    "year_maxima": _maxima("year"),
    "track_maxima": _maxima("track_id"),
    "cell_wind_stats": f"with {TRACKS}, {_cells('0.5')}, {_stats('ms')} select * from st",
    "cell_zero_filled_stats": f"with {TRACKS}, {_cells('0.5')}, {_stats('list_concat(ms, list_transform(range(greatest(0, 100 - n_years)), lambda r: 0::double))')} select * from st",
    "cell_merge_components": f"with {TRACKS}, {_cells('0.5')} select i, j, round(coalesce(max(case when event_type = 'click' then wind end), 0), 9) as rain, round(coalesce(max(case when event_type = 'error' then wind end), 0), 9) as surge from cell group by 1, 2",
    "subgrid_max": f"with {TRACKS}, {_cells('0.1')} select floor(i / 2::double)::bigint as i, floor(j / 2::double)::bigint as j, round(max(wind), 9) as wind, round(max(p_c), 9) as p_c from cell group by 1, 2",
    "grid_bounds": f"with {TRACKS}, {_cells('0.5')}, x as (select min(i) as a, max(i) as b, min(j) as c, max(j) as d from cell) select round(a * 0.5::double, 9) as south, round((b + 1) * 0.5::double, 9) as north, round(c * 0.5::double, 9) as west, round((d + 1) * 0.5::double, 9) as east, b - a + 1 as n_rows, d - c + 1 as n_cols from x",
    "regular_grid": "select i.range * 10 + j.range as cell_id, i.range as i, j.range as j, round(14 + (i.range * 0.1::double + least((i.range + 1) * 0.1::double, 1.05::double)) / 2, 6) as lat, round(-63 + (j.range + 0.5::double) * 0.1::double, 6) as lon from range(11) i cross join range(10) j",
    "centroid_grid": f"with {SUPPLIERS}, b as (select distinct round(lat, 5) as lat, round(lon, 5) as lon from s), n as (select count(*) as n from b) select distinct round(lat + (x.range - 1) * 0.01::double, 5) as lat, round(lon + (y.range - 1) * 0.01::double, 5) as lon from b cross join n cross join range(3) x cross join range(3) y where n <= 50 or (x.range = 1 and y.range = 1)",
    "gap_filled": f"""with {CELLS_25}, q as (select i, j, case when (i * 7 + j * 3) % 5 <> 0 then wind end as wind from g),
        m as (select q.i, q.j, arg_min(k.wind, {{'d': a * a + b * b, 'i': k.i, 'j': k.j}}) as v from q cross join {GRID_AROUND} o join q k on k.i = q.i + a and k.j = q.j + b where q.wind is null and k.wind is not null group by 1, 2)
        select q.i, q.j, round(coalesce(q.wind, m.v), 9) as wind from q left join m on m.i = q.i and m.j = q.j""",
    "smoothed_cells": f"""with {CELLS_25}, m as (select g.i, g.j, k.wind as v, row_number() over (partition by g.i, g.j order by a * a + b * b, k.i, k.j) as r from g cross join {GRID_AROUND} o join g k on k.i = g.i + a and k.j = g.j + b),
        s as (select i, j, count(*) as n, sum(cast(v as decimal(24,9)))::double / count(*) as v from m where r <= 6 group by 1, 2 having count(*) >= 3)
        select g.i, g.j, round(wind, 9) as wind, round(coalesce(s.v, wind), 9) as smoothed from g left join s on s.i = g.i and s.j = g.j""",
    "shared_histogram": f"""with {TRACKS}, e as (select floor(min(wind))::double as lo, ceil(max(wind))::double as hi from t), b as (select event_type, least(floor((wind - lo) / 5::double), greatest(1, ceil((hi - lo) / 5::double)) - 1)::bigint as bin, lo from t cross join e),
        c as (select event_type, bin, lo, count(*) as n from b group by 1, 2, 3) select event_type, bin, lo + (bin + 0.5::double) * 5 as centre, n, round(n / sum(n) over (partition by event_type)::double * 100, 6) as pct from c""",
    "loss_histogram": f"with {EVENTS}, e as (select min(loss) as lo, max(loss) as hi, count(*) as total from ev), b as (select least(6, floor((loss - lo) / ((hi - lo) / 7)))::int as bin, lo, hi, total from ev cross join e) select bin, round(max(lo) + (bin + 1) * ((max(hi) - max(lo)) / 7), 6) as edge, count(*) as n, round(count(*) / max(total)::double * 100, 6) as pct from b group by 1",
    "scenario_comparison": f"""with {TRACKS}, m as (select year, sum(case when event_type = 'click' then cast(wind as decimal(24,9)) end)::double / nullif(count(*) filter (where event_type = 'click'), 0) as a, sum(case when event_type = 'error' then cast(wind as decimal(24,9)) end)::double / nullif(count(*) filter (where event_type = 'error'), 0) as b from t where event_type in ('click', 'error') group by 1)
        select year::int as year, round(a, 9) as storm, round(b, 9) as cmcc, round(b - a, 9) as delta from m""",
    "nearest_centroids": f"""with p as (select c_custkey as point_id, {_lat('c_custkey')} as lat, {_lon('c_custkey')} as lon from customer), {SUPPLIERS}, c as (select point_id as centroid_id, lat + 0.003::double as clat, lon + 0.002::double as clon from s),
        m as (select p.point_id, arg_min(centroid_id, {{'d': (lat - clat) * (lat - clat) + (lon - clon) * (lon - clon), 'k': centroid_id}}) as centroid_id from p join c on (lat - clat) * (lat - clat) + (lon - clon) * (lon - clon) <= 0.4::double * 0.4::double group by 1)
        select p.point_id, centroid_id from p left join m on m.point_id = p.point_id""",
    "breakdown_shares": f"with {PARTS}, x as (select point_id % 4 as g, class, {_money('greatest(0::double, loss)')} as amount from lp group by 1, 2) select g, class, amount, round(amount / sum(cast(amount as decimal(24,6))) over (partition by g)::double, 9) as share from x",
    "proxy_reallocation": f"""with {PARTS}, x as (select point_id, class, {_money('value')} as value, {_money("case when class <> 'PROMO' then loss else 0 end")} as loss0 from lp group by 1, 2), y as (select point_id, class, value, least(greatest(0::double, value), greatest(0::double, loss0)) as loss from x),
        z as (select class, {_money('loss')} as own, {_money('value')} as capacity from y group by 1), u as (select *, sum(cast(own as decimal(24,6))) over ()::double as total from z),
        v as (select u.*, total * 1.3::double * (0.7::double * (own / total) + (1 - 0.7::double) * coalesce(share, 0::double)) as target from u left join (values ('ECONOMY', 0.3::double), ('STANDARD', 0.2::double), ('PROMO', 0.2::double), ('LARGE', 0.2::double), ('SMALL', 0.1::double)) q(class, share) on q.class = u.class)
        select point_id, y.class, round(least(greatest(0::double, value), case when own > 0 then loss * target / own when capacity > 0 then value * target / capacity else 0 end), 3) as loss from y join v on v.class = y.class""",
    "stratified_quota": "with s as (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2) select *, least(n, greatest(1, floor(400 * n / sum(n) over ()::double)))::bigint as quota from s",
    "stratified_sample": """with s as (select c_nationkey, count(*) as n from customer group by 1), q as (select *, least(n, greatest(1, floor(300 * n / sum(n) over ()::double)))::bigint as quota from s),
        r as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as at from customer)
        select distinct r.c_nationkey, r.c_custkey from q cross join range(1000) k join r on r.c_nationkey = q.c_nationkey and r.at = case when quota <= 1 then 0 else round_even(k.range * (n - 1) / (quota - 1)::double, 0)::bigint end where k.range < quota""",
    "valuation_portfolio": f"select p_type, count(*) as n, sum(p_size)::bigint as length, {_money('''greatest(5000::double, p_size * (case p_type when 'ECONOMY' then 120::double when 'STANDARD' then 95::double when 'PROMO' then 310::double when 'LARGE' then 45::double when 'MEDIUM' then 210::double else 800::double end))''')} as value from part group by rollup (p_type)",
    "exposure_summary": "with r as (select case p_size % 4 when 0 then 'point' when 1 then 'line' when 2 then 'polygon' else 'other' end as kind, p_retailprice as x from part) select kind, count(*) as n, sum(case kind when 'point' then 1 when 'line' then greatest(1, ceil(x / 100)) when 'polygon' then least(10000, greatest(1, ceil(x * 50 / 10000))) else 3 end)::bigint as points from r group by 1",
    "line_sampling": """with s as (select s_suppkey as feature_id, (s_suppkey % 50 * 10 + 10)::double as a, (s_suppkey % 30 * 10 + 20)::double as b from supplier), n as (select *, least(300, greatest(2, ceil((a + b) / 100) + 1))::int as n from s),
        p as (select feature_id, k.range::int as k, a, (a + b) * k.range / (n - 1) as pos from n cross join range(300) k where k.range < n)
        select feature_id, k, round(least(pos, a), 9) as x, round(greatest(0::double, pos - a), 9) as y from p""",
    "log_top_visitors": "select event_type, user_id, count(*) as n from events group by 1, 2 order by n desc, event_type, user_id limit 50",
    "log_tail": "select event_id, event_type, user_id from events order by ts desc, event_id desc limit 100",
    "log_find": "select event_id, user_id from events where user_id = 7 or event_id = 12 or json_extract_string(props, '$.k') = '42'",
    "log_split": "select case when user_id % 10 = 0 then 'own' else 'other' end as part, count(*) as n from events group by 1",
    "previous_run": "select o_orderkey, lag(o_orderkey) over w as previous, round(o_totalprice - lag(o_totalprice) over w, 2) as change from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    "latest_runs": "select o_custkey, arg_max(o_orderkey, {'a': o_orderdate, 'b': o_orderkey}) as o_orderkey from orders group by 1",
    "searched_rows": "select p_partkey, p_name from part where lower(p_name) like '%ring%' order by p_retailprice desc, p_partkey limit 200",
    "hazard_blocks_union": "select l_suppkey as point_id, count(*) as n, count(distinct l_orderkey) as events from lineitem group by 1",
    "leftover_points": "select c_custkey as id from customer where c_custkey not in (0, 3)",
    "event_summary": f"with {EVENTS}, e as (select case when event_id % 2 = 0 then 'storm' else 'storm_cmcc' end as hazard, event_id, loss, frequency from ev where loss > 0), r as (select *, row_number() over (partition by hazard order by loss desc, event_id)::int as rank from e) select hazard, rank, event_id, round(cast(loss as decimal(24,6)), 2)::double as loss_eur, frequency from r where rank <= 10",
    "feature_preview": f"""select s_suppkey as asset_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || {_lon('s_suppkey')} || ',' || {_lat('s_suppkey')} || ']}},"properties":{{"asset_id":' || s_suppkey || ',"value_eur":' || greatest(0::double, s_acctbal) || '}}}}' as feature from supplier order by 1 limit 100""",
    "result_document": f"""with {PORTFOLIO} select 'territory_results' as part, hazard, territory::bigint as territory, exposure, direct_eai, indirect_eai, total_eai, risk_index, null::double as scaler from tr
        union all select 'portfolio_results', hazard, null, exposure, direct_eai, indirect_eai, total_eai, null, round(total_eai / greatest(direct_eai, 1::double), 6) from po""",
    "expired_runs": """with r as (select o_orderkey as run_id, o_orderdate as created, o_orderstatus <> 'P' as terminal, o_orderdate <= timestamp '1998-01-01' as expired from orders),
        x as (select greatest(0, count(*) - 10) as extra from r where not expired), k as (select run_id, row_number() over (order by created, run_id) as n from r where terminal and not expired)
        select r.run_id, case when expired then 'expired' when k.n <= extra then 'pruned' else 'kept' end as state from r cross join x left join k on k.run_id = r.run_id""",
    "windowed_counts": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n, max(value) as top from events group by 1, 2",
    "wind_field": f"""with {TRACKS}, p as (select track_id, lat, lon, p_c - 40 as p_c, 20::double + category * 5::double as rmax from t), {SUPPLIERS},
        m as (select track_id, point_id as centroid_id, p.lat as lat, rmax, greatest({_km('p.lon', 'p.lat', 's.lon', 's.lat')}, 0.1::double) as km, greatest(1015 - p_c, 0::double) as dp from p join s on abs(p.lat - s.lat) <= 0.5 and abs(p.lon - s.lon) <= 0.5),
        w as (select *, pow(rmax / km, 1.5::double) as q, km * 1000 * 2 * 7.292e-5 * abs(sin(radians(lat))) / 2 as f from m)
        select track_id, centroid_id, round(max(sqrt(1.5::double / 1.15::double * q * dp * 100 * exp(-q) + f * f) - f), 6) as intensity from w group by 1, 2""",
    "rain_and_surge": """with r as (select p_partkey, p_size * 6::double as km, (p_partkey % 60)::double + 10 as v, p_size / 20::double as e from part), u as (select *, 1 + (v / 0.514444::double - 35) / 33 as u from r),
        c as (select *, -1.10::double + 3.96::double * u as t0, -1.60::double + 4.80::double * u as tm, 64.5::double - 13 * u as rm, 150::double - 16 * u as re from u)
        select p_partkey, round(greatest(0::double, case when km < rm then t0 + (tm - t0) * km / rm else tm * exp(-(km - rm) / re) end) * 25.4::double / 24, 6) as rain,
          round(case when v < 26.8224::double then 0::double else greatest(0::double, 0.1023::double * (v - 26.8224::double) + 1.8288::double - 0.2::double * (km / 20) - e) end, 6) as surge from c""",
    "annual_frequencies": "select 0.0001::double as frequency, count(distinct l_orderkey) as n from lineitem",
    "class_scenarios": f"""with {PARTS}, val as (select class, {_money('value')} as value from lp group by 1), e as (select class, event_id, {_money('loss')} as loss, 0.0001::double as frequency from lp group by 1, 2),
        c as (select *, sum(cast(frequency as decimal(38,18))) over (partition by class order by loss desc, event_id rows unbounded preceding) as cum from e),
        a as (select class, 'annual' as scenario, {_money('loss * frequency')} as loss from lp group by 1
          union all select class, 'rp' || p, coalesce(max(case when cum >= cast(1 as decimal(38,18)) / p then loss end), min(loss)) from c cross join (values (50), (100)) v(p) group by class, p
          union all select class, 'event_max', max(loss) from e group by 1)
        select a.class, scenario, least(loss, greatest(value, 0::double)) as loss from a join val on val.class = a.class""",
    "top_scenarios": f"""with {EVENTS}, r as (select event_id % 3 as g, loss, row_number() over (partition by event_id % 3 order by loss desc, event_id) as r, count(*) over (partition by event_id % 3) as n from ev)
        select g, scenario, sum(cast(loss as decimal(24,6)))::double / count(*) as mean_loss from r join (values ('top10', 0.1::double), ('top5', 0.05::double)) f(scenario, share) on r <= greatest(1, ceil(n * share)) group by 1, 2""",
    "portfolio_risk": f"""with {PORTFOLIO}, k as (select round(total_eai / greatest(direct_eai, 1::double), 6) as scaler from po where hazard = 'storm'), {EVENTS},
        cc as (select *, cast(frequency as decimal(38,18)) as f, sum(cast(frequency as decimal(38,18))) over (order by loss desc, event_id rows unbounded preceding) as cum from ev where loss > 0),
        ca as (select *, cast(frequency as decimal(38,18)) as f, sum(cast(frequency as decimal(38,18))) over (order by loss, event_id rows unbounded preceding) as cum from ev),
        vr as (select coalesce(min(case when cum >= (select sum(f) from ca) * 0.95::decimal(3,2) then loss end), max(loss)) as var from ca),
        x as (select """
    + ", ".join(f"(select coalesce(max(case when cum >= cast(1 as decimal(38,18)) / {p} then loss end), 0::double) from cc) as pml_{p}" for p in (10, 20, 50, 100, 200))
    + """, (select sum(cast(loss as decimal(24,6)) * cast(f as decimal(12,8)))::double / sum(f)::double from ca where loss >= (select var from vr)) as tvar, (select max(loss) from ev) as max_event)
        select """
    + ", ".join(f"round(pml_{p} * scaler, 2) as pml_{p}" for p in (10, 20, 50, 100, 200))
    + """, round(greatest(pml_200, max_event) * scaler, 2) as pml_1000, round(tvar * scaler, 2) as tvar, round(max_event * scaler, 2) as max_event from x cross join k""",
    "derived_scenarios": "with r as (select s_suppkey, greatest(s_acctbal, 0::double) as x from supplier) select s_suppkey, round(case s_suppkey % 4 when 0 then x * 0.01::double when 1 then 0.86::double * x when 2 then x else x * 1.5::double end, 6) as loss from r",
    "artefact_coherence": "with r as (select o_custkey as territory, o_orderkey % 2 as run_id, o_orderdate < lag(o_orderdate) over (partition by o_custkey order by o_orderkey) as back from orders) select territory, count(distinct run_id) = 1 as one_run, not coalesce(bool_or(back), false) as ordered from r group by 1",
}
