"""Queries of geometries and of nearest places, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import geometry, nearest
from . import adapters as A
from .studies import study

BOX = (0.5, -1.0, 3.0, 2.0)


def _path(*points) -> Column:
    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.array(*[F.struct(number(x).alias("x"), number(y).alias("y")) for x, y in points])


def _vertices(df, column="paths"):
    parts = df.select("feature_id", F.posexplode(column).alias("part", "path"))
    return parts.select("feature_id", "part", F.posexplode("path").alias("k", "p")).select("feature_id", "part", "k", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


@study("""with c as (select c_custkey as feature_id, 1 + (c_custkey % 50) / 10::double as w, 0.5 + (c_custkey % 30) / 10::double as h from customer where c_custkey % 11 > 0),
    v as (select feature_id, 0 as part, 0 as k, 0.5 as x, 0 as y from c union all select feature_id, 0, 1, least(w, 3), 0 from c
      union all select feature_id, 0, 2, w, least(h, 2) from c where w <= 3 union all select feature_id, 0, 3, 0.5, h from c where w <= 3 and h <= 2
      union all select feature_id, 1, 0, 3, h from c where w > 3 and h <= 2 union all select feature_id, 1, 1, 0.5, h from c where w > 3 and h <= 2)
    select feature_id, part, k, round(x, 9) as x, round(y, 9) as y from v""")
def clipped_lines(spark, d):
    """Lines of two parts, one beside the box and one that may leave it and come back; every eleventh lies elsewhere."""
    k = F.col("c_custkey")
    w, h, off = 1 + k % 50 / 10.0, 0.5 + k % 30 / 10.0, F.when(k % 11 == 0, 100).otherwise(0)
    paths = F.array(_path((-1.0, 0.25), (-1.0, h)), _path((off, 0.0), (w + off, 0.0), (w + off, h), (off, h)))
    return _vertices(geometry.clip_lines(A.table(spark, d, "customer").select(k.alias("feature_id"), paths.alias("paths")), BOX))


@study("""with c as (select c_custkey as feature_id, 2 + (c_custkey % 40) / 10::double as w, 1 + (c_custkey % 3) * 0.5::double as t from customer), m as (select *, least(w, 3) - 0.5 as a, t - 0.5 as b from c)
    select feature_id, 1 as n, round(2 * a * b - b * b - 0.04::double, 9) as area from m""")
def clipped_polygons(spark, d):
    """L-shaped areas with a hole, cut at all sides of a box; another one beside it goes."""
    k = F.col("c_custkey")
    w, t = 2 + k % 40 / 10.0, 1 + k % 3 * 0.5
    ring = _path((0, 0), (w, 0), (w, t), (t, t), (t, w), (0, w), (0, 0))
    rows = A.table(spark, d, "customer").select(k.alias("feature_id"), F.array(F.array(ring, _path((0.6, 0.6), (0.6, 0.8), (0.8, 0.8), (0.8, 0.6))), F.array(_path((9, 9), (9, 8), (8, 8)))).alias("polygons"))
    out = geometry.clip_polygons(rows, (0.5, 0.5, 3.0, 3.0))
    twice = lambda r: F.aggregate(F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, x: a + x)
    areas = F.transform(F.col("polygons")[0], lambda r: F.abs(twice(r)) / 2)
    return out.select("feature_id", F.size("polygons").alias("n"), F.round(2 * areas[0] - F.aggregate(areas, F.lit(0.0), lambda a, x: a + x), 9).alias("area"))


@study("""with c as (select c_custkey as feature_id, 6 + c_custkey % 17 as m, 12 + c_custkey % 17 + c_custkey % 12 as n from customer),
    v as (select feature_id, m, unnest([0, m - 1, m, m + 1, n]) as i, unnest([0, 1, 2, 3, 4]) as k from c)
    select feature_id, 0 as part, k, i::double as x, case when i = m then 50 else i % 2 end::double as y from v""")
def simplified_lines(spark, d):
    """Jagged lines with one spike, simplified at 3: the spike's foot, tip and ends stay."""
    k = F.col("c_custkey")
    m, n = (6 + k % 17).cast("int"), (12 + k % 17 + k % 12).cast("int")
    path = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.cast("double").alias("x"), F.when(i == m, 50.0).otherwise((i % 2).cast("double")).alias("y")))
    return _vertices(geometry.simplify_lines(A.table(spark, d, "customer").select(k.alias("feature_id"), F.array(path).alias("paths")), 3.0))


@study("""with c as (select s_suppkey as f, (100 + s_suppkey % 50 * 10)::double as w, (40 + s_suppkey % 20)::double as t from supplier),
    a as (select *, 2 * w * t - t * t - t * t / 16 as a1, t * t as a2 from c), n as (select *, least(299, greatest(1, round_even(300 * a1 / (a1 + a2), 0)::int)) as n1 from a),
    g as (select f, w, t, 0 as p, n1 as most, 0::double as x0, w as x1, w as y1, greatest(1, least(n1, ceil(a1 / 400)::int)) as target, a1 as size from n
      union all select f, w, t, 1, 300 - n1, w + 50, w + 50 + t, t, greatest(1, least(300 - n1, ceil(a2 / 400)::int)), a2 from n),
    s as (select *, greatest(1::double, sqrt(size / target)) as cell from g),
    q as (select f, p, most, w, t, i.range as i, j.range as j, x0 + (i.range + 0.5) * cell as x, (j.range + 0.5) * cell as y from s cross join range(200) i cross join range(200) j where x0 + (i.range + 0.5) * cell <= x1 and (j.range + 0.5) * cell <= y1),
    r as (select *, row_number() over (partition by f, p order by i, j) as z from q where p = 1 or ((y <= t or x <= t) and not (x > w / 2 and x < w / 2 + t / 4 and y > t / 4 and y < t / 2)))
    select f as feature_id, (row_number() over (partition by f order by p, z) - 1)::int as k, round(x, 6) as x, round(y, 6) as y from r where z <= most""")
def polygon_sampling(spark, d):
    """Points in features of an L with a hole and a square beside it."""
    k = F.col("s_suppkey")
    w, t = (100 + k % 50 * 10).cast("double"), (40 + k % 20).cast("double")
    ring = _path((0, 0), (w, 0), (w, t), (t, t), (t, w), (0, w), (0, 0))
    hole = _path((w / 2, t / 4), (w / 2 + t / 4, t / 4), (w / 2 + t / 4, t / 2), (w / 2, t / 2), (w / 2, t / 4))
    square = _path((w + 50, 0), (w + 50 + t, 0), (w + 50 + t, t), (w + 50, t), (w + 50, 0))
    rows = A.table(spark, d, "supplier").select(k.alias("feature_id"), F.array(F.array(ring, hole), F.array(square)).alias("polygons"))
    return geometry.sample_polygons(rows, 20.0).select("feature_id", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@study("""with u as (select user_id % 97 * 40 as i, user_id % 89 * 50 as j, max(value) as v from events where event_type = 'purchase' group by 1, 2), w as (select distinct c_custkey % 211 * 23 as i, c_custkey % 199 * 21 as j from customer),
    m as (select w.i, w.j, arg_min(u.v, {'a': (w.i - u.i) * (w.i - u.i) + (w.j - u.j) * (w.j - u.j), 'i': u.i, 'j': u.j}) as v, min((w.i - u.i) * (w.i - u.i) + (w.j - u.j) * (w.j - u.j)) > 0 as filled from w cross join u group by 1, 2)
    select i, j, round(v, 9) as v, filled from m""")
def cells_filled_from_far(spark, d):
    """Cells of a wide grid with the value of the nearest of few known cells, at any distance."""
    known = A.table(spark, d, "events").where("event_type = 'purchase'").groupBy((F.col("user_id") % 97 * 40).alias("i"), (F.col("user_id") % 89 * 50).alias("j")).agg(F.max("value").alias("v"))
    wanted = A.table(spark, d, "customer").select((F.col("c_custkey") % 211 * 23).alias("i"), (F.col("c_custkey") % 199 * 21).alias("j"))
    return nearest.nearest_filled(wanted, known, "v").select("i", "j", F.round("v", 9).alias("v"), "filled")
