"""Queries of what is told of runs: journals, summaries, documents, previews; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as K
from ..operators import journal, metrics
from ..operators.impact import money_sum
from ..operators.proxy import SCENARIOS
from ..sources import reports
from . import adapters as A
from .oracles import LOSSES, SUPPLIERS, TRACKS, _money
from .studies import study

HAZARDS = ("storm", "storm_cmcc")
_LISTED = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SCENARIOS))


def _level(rp: int, value: str = "loss", where: str = "true") -> str:
    return f"coalesce(max(case when {where} and cum >= (1 / {rp}::decimal(10,0))::decimal(20,18) then {value} end), 0)"


def _territory_events(spark, d):
    """Losses by territory, hazard and event; one territory has no losses, and every third event no frequency."""
    rows = A.losses(spark, d).join(A.suppliers(spark, d).select("point_id", "territory"), "point_id")
    rows = rows.withColumn("hazard", F.when(F.col("event_id") % 2 == 0, "storm").otherwise("storm_cmcc"))
    loss = F.when(F.col("territory") == 3, 0.0).otherwise(F.col("loss"))


    return rows.groupBy("territory", "hazard", "event_id").agg(money_sum(loss).alias("loss")).withColumn("frequency", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(0.001))


ENTRIES = f"""{LOSSES}, {SUPPLIERS}, e as (select territory, case when event_id % 2 = 0 then 'storm' else 'storm_cmcc' end as hazard, event_id, {_money('case when territory = 3 then 0 else loss end')} as loss, case when event_id % 3 = 0 then 0 else 0.001::decimal(38,18) end as f from l join s using (point_id) group by 1, 2, 3),
    c as (select *, sum(case when loss > 0 and f > 0 then f else 0 end) over (partition by territory, hazard order by case when loss > 0 and f > 0 then loss else -1 end desc) as cum from e),
    j as (select territory, hazard, round(sum(f)::double, 8) as sum_event_frequency, count(*) as n_events, round({_level(50, where="loss > 0 and f > 0")}, 2) as pml_50, round({_level(100, where="loss > 0 and f > 0")}, 2) as pml_100 from c group by 1, 2)"""


@study(f"with {ENTRIES} select * from j")
def run_entries(spark, d):
    return journal.run_entries(_territory_events(spark, d))


@study(f"""with {ENTRIES} select line, count(*) as n from (select '| ' || territory || ' | ' || hazard || ' | ' || printf('%.6f', sum_event_frequency) || ' | ' || n_events || ' | ' || (case when pml_50 > 0 then round(pml_50 / 1000, 0)::bigint::varchar else '-' end) || ' |' as line from j
    union all select unnest(['| Territory | Hazard | Frequency | Events | 50 years, thousands |', '|---|---|---:|---:|---:|'])) group by 1""")
def run_journal(spark, d):
    """The journal as a table in markdown: its lines."""
    thousands = F.when(F.col("pml_50") > 0, reports.number(F.round(F.col("pml_50") / 1000, 0), 0))
    columns = {"Territory": F.col("territory"), "Hazard": F.col("hazard"), "Frequency": reports.number(F.col("sum_event_frequency"), 6), "Events": reports.number(F.col("n_events"), 0), "50 years, thousands": thousands}
    lines = reports.markdown_table(run_entries(spark, d), columns, [F.desc("territory"), F.desc("hazard")], list(columns)[2:])
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@study("""with a as (select unnest(['3-MEDIUM', ' urgent ', 'low', '', 'none']) as asked), q as (select asked, lower(trim(asked)) as t from a),
    m as (select asked, o_orderkey, o_orderpriority, row_number() over (partition by asked order by (lower(o_orderpriority) = t)::int desc, o_orderdate desc, o_orderkey desc) as n from q join orders on t <> '' and contains(lower(o_orderpriority), t))
    select asked, o_orderkey, o_orderpriority from m where n = 1""")
def run_by_label(spark, d):
    """The newest run for each of five labels: a whole one, parts, an empty one and one that no run has."""
    runs = A.table(spark, d, "orders")
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    each = [journal.run_of_label(runs, a, "o_orderpriority", order).select(F.lit(a).alias("asked"), "o_orderkey", "o_orderpriority") for a in ("3-MEDIUM", " urgent ", "low", "", "none")]
    out = each[0]
    for e in each[1:]:
        out = out.unionAll(e)
    return out


_PCT = ", ".join(
    f"round(coalesce({_money(f'case when net and scenario = {s!r} and {hit} then w end')} / greatest({_money(f'case when net and scenario = {s!r} then w end')}, 1e-9) * 100, 0), 3) as {k}_hs_pct_{s}"
    for s in ("annual", "event_max")
    for k, hit in (("direct", "st = 3"), ("indirect", "ind"))
)
_SUMS = ", ".join(f"round(coalesce({_money(f'case when counted and scenario = {s!r} then loss end')}, 0), 2) as {n}" for s, n in journal.TOTALS.items())


@study(f"""with v as (select case when l_orderkey % 2 = 0 then 'storm' else 'storm_cmcc' end as hazard, sc.name as scenario, l_quantity as w, l_partkey % 3 < 2 as net, l_partkey % 7 > 0 as counted, l_suppkey % 4 as st, l_orderkey % 5 = 0 as ind, l_extendedprice as loss from lineitem join (values {_LISTED}) sc(i, name) on l_linenumber % 6 = sc.i)
    select hazard, {_PCT}, {_SUMS} from v group by 1""")
def impact_summary(spark, d):
    k = F.col("l_linenumber") % 6
    scenario = F.element_at(F.array(*map(F.lit, SCENARIOS)), k.cast("int") + 1)
    hazard = F.when(F.col("l_orderkey") % 2 == 0, "storm").otherwise("storm_cmcc")
    rows = A.table(spark, d, "lineitem").select(hazard.alias("hazard"), scenario.alias("scenario"), F.col("l_quantity").alias("weight"), (F.col("l_partkey") % 3 < 2).alias("network"), (F.col("l_partkey") % 7 > 0).alias("counted"), F.concat(F.lit("S"), F.col("l_suppkey") % 4).alias("direct_state"), (F.col("l_orderkey") % 5 == 0).alias("indirect_s3"), F.col("l_extendedprice").alias("loss"))
    return journal.impact_summary(rows)


@study(f"""with {LOSSES}, e as (select point_id, event_id, max(wind) as v, case when point_id % 7 = 0 or event_id % 3 = 0 then case when event_id % 2 = 0 then -0.001 end when event_id % 3 = 1 then 0.002 else 0.001 end as f from l where point_id % 10 < 9 and event_id % 13 > 0 group by 1, 2),
    g as (select *, greatest(0, coalesce(f, 0))::decimal(38,18) as w0 from e), h as (select *, case when sum(w0) over (partition by point_id) > 0 then w0 else 1::decimal(38,18) end as w from g),
    c as (select *, sum(w) over (partition by point_id order by v desc) as cum from h),
    t as (select point_id, sum(v::decimal(24,6) * w::decimal(14,8))::double / sum(w)::double as mean, {_level(50, 'v')} as rp50, {_level(100, 'v')} as rp100, max(v) as event_max, count(*) as sample_count from c group by 1)
    select s_suppkey as point_id, round(coalesce(mean, 0), 6) as mean, coalesce(rp50, 0)::double as rp50, coalesce(rp100, 0)::double as rp100, coalesce(event_max, 0)::double as event_max, coalesce(sample_count, 0)::bigint as sample_count from supplier left join t on s_suppkey = point_id""")
def centroid_summary(spark, d):
    """Winds of each point; some points have negative ones alone, some events none or not a number, some frequencies are nothing."""
    p, e = F.col("point_id"), F.col("event_id")
    rows = A.losses(spark, d).groupBy("point_id", "event_id").agg(F.max("wind").alias("wind"))
    value = F.when(p % 10 == 9, -F.col("wind")).when(e % 26 == 0, float("nan")).when(e % 13 == 0, 0.0).otherwise(F.col("wind"))
    frequency = F.when((p % 7 == 0) | (e % 3 == 0), F.when(e % 2 == 0, -0.001)).when(e % 3 == 1, 0.002).otherwise(0.001)
    out = journal.centroid_summary(rows.select("point_id", value.alias("value"), frequency.alias("frequency")), A.suppliers(spark, d))
    return out.select("point_id", F.round("mean", 6).alias("mean"), "rp50", "rp100", "event_max", "sample_count")


_WIDE = ", ".join(f"'state_{s}_{h}', coalesce(max(case when hazard = '{h}' and scenario = '{s}' then state end), 'S0')" for h in HAZARDS for s in SCENARIOS)


@study(f"""with st as (select user_id as feature_id, case when event_id % 2 = 0 then 'storm' else 'storm_cmcc' end as hazard, sc.name as scenario, 'S' || (event_id // 12) % 4 as state from events join (values {_LISTED}) sc(i, name) on (event_id // 2) % 6 = sc.i)
    select c_custkey as feature_id, '{{"type":"Feature","properties":' || json_object('feature_id', c_custkey, 'layer_key', c_mktsegment, 'layer_label', c_name, {_WIDE}) || ',"geometry":' || case when c_custkey % 9 = 0 then 'null' else '{{"type":"Point","coordinates":[' || c_custkey % 90 || ',' || c_nationkey || ']}}' end || '}}' as feature
    from customer left join st on c_custkey = feature_id group by c_custkey, c_mktsegment, c_name, c_nationkey""")
def state_features(spark, d):
    k = F.col("event_id")
    scenario = F.element_at(F.array(*map(F.lit, SCENARIOS)), (F.floor(k / 2) % 6).cast("int") + 1)
    states = A.table(spark, d, "events").select(F.col("user_id").alias("feature_id"), F.when(k % 2 == 0, "storm").otherwise("storm_cmcc").alias("hazard"), scenario.alias("scenario"), F.concat(F.lit("S"), F.floor(k / 12) % 4).alias("state"))
    shape = F.when(F.col("c_custkey") % 9 > 0, F.format_string('{"type":"Point","coordinates":[%d,%d]}', F.col("c_custkey") % 90, F.col("c_nationkey")))
    features = A.table(spark, d, "customer").select(F.col("c_custkey").alias("feature_id"), F.col("c_mktsegment").alias("layer_key"), F.col("c_name").alias("layer_label"), shape.alias("geometry"))
    return reports.state_features(features, states, HAZARDS, SCENARIOS)


@study(f"""with {LOSSES}, {SUPPLIERS}, e as (select territory, event_id, {_money('loss')} as loss from l join s using (point_id) group by 1, 2), c as (select *, sum(0.0001::decimal(38,18)) over (partition by territory order by loss desc) as cum from e where loss > 0),
    p as (select territory, unnest([10, 20, 50, 100, 200]) as rp, unnest([{', '.join(_level(rp) for rp in metrics.RETURN_PERIODS)}]) as loss from c group by 1)
    select territory, '{{"chart":' || territory || ',"x":[' || string_agg(rp::varchar, ',' order by rp) || '],"y":[' || string_agg(round(loss)::bigint::varchar, ',' order by rp) || ']}}' as document from p group by 1""")
def chart_documents(spark, d):
    rows = A.losses(spark, d).join(A.suppliers(spark, d).select("point_id", "territory"), "point_id")


    events = rows.groupBy("territory", "event_id").agg(money_sum(F.col("loss")).alias("loss")).withColumn("frequency", A.frequency())
    return reports.chart_documents(metrics.pml(events, ("territory",)).withColumn("loss", F.round("loss").cast("long")), "territory", "return_period", "loss")


@study(f"""with {TRACKS}, b as (select event_type, floor(min(wind) / 2.5) * 2.5 as a, ceil(max(wind) / 2.5) * 2.5 as b from t group by 1)
    select event_type, k::bigint as k, round(a + k * 2.5, 6) as edge from b, unnest(range(((b - a) / 2.5 + 1)::bigint)) u(k)""")
def step_scale(spark, d):
    """Edges of a map's classes by steps of 2.5, for each type of event."""
    ends = A.track_points(spark, d).groupBy("event_type").agg(F.min("wind").alias("low"), F.max("wind").alias("high"))
    return ends.select("event_type", F.posexplode(K.step_edges(F.col("low"), F.col("high"), F.lit(2.5))).alias("k", "edge")).withColumn("k", F.col("k").cast("long"))


@study("""with c as (select c_custkey as k, c_name, (c_custkey % 90)::double as x, (c_nationkey - 12)::double / 4 as y, i.range as i from customer, range(4) i)
    select k as file, (i + 1)::int as line, case when i = 1 then 'Line 2' else 'a' || k || '-' || i end as asset_id, case when i = 2 then c_name || ', "x"' when i = 1 then 'Line 2' else 'a' || k || '-' || i end as label, case when i = 3 then 0 else x end as lon, y as lat from c where i <> 0 or k % 3 > 0""")
def uploads_previewed(spark, d):
    """A small upload for each customer: quoted labels, blank lines, missing ids, cells that are empty or no numbers."""
    k, y = F.col("c_custkey"), F.format_string("%.2f", (F.col("c_nationkey") - 12) / 4.0)
    x = (k % 90).cast("string")
    first = F.when(k % 3 == 0, "n/a").otherwise(x)
    lines = [
        F.when(k % 2 == 0, " ASSET_ID,Latitude,label,LON").otherwise("asset_id,lat,label,longitude"),
        F.concat(F.lit("a"), k, F.lit("-0,"), y, F.lit(",,"), first),
        F.lit("   "),
        F.concat(F.lit(","), y, F.lit(",,"), x, F.lit("\r")),
        F.concat(F.lit("a"), k, F.lit("-2, "), y, F.lit(',"'), F.col("c_name"), F.lit(', ""x""", '), x),
        F.concat(F.lit("a"), k, F.lit("-3,"), y, F.lit(","), F.lit(",")),
        F.concat(F.lit("a"), k, F.lit("-4,"), y),
    ]
    return reports.csv_preview(A.table(spark, d, "customer").select(k.alias("file"), F.concat_ws("\n", *lines).alias("text")))
