"""The nearest of known places, however far it lies: a pyramid of cells, searched from its top.

Known places lie in cells; FAN**dimensions cells make one of the next level. Each cell knows the box around its own places. Going
down, a place asked for keeps those cells whose box may hold something nearer than the farthest corner of its best box, so a
few cells stay at every level, near or far. Every step is an equi join on cells; nothing meets all of anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..lineage import settled

#: Cells to a side of the next level's cell.
FAN = 4
#: Squared distances this much apart (relative, absolute) count as equal while cells are sorted out: no tie is lost by rounding.
SLACK = (1 + 1e-9, 1e-18)
EARTH_KM = 6371.0088


def _index(axis: Column, size: float) -> Column:
    return F.floor(axis / size).cast("long")


def nearest(asked: DataFrame, known: DataFrame, axes: Sequence[str], size: float, extent: float, group: Sequence[str] = (), rank: Column | None = None) -> DataFrame:
    """``ask`` and the nearest ``other`` of its group with its squared distance ``d2``; no row where the group has none.

    ``asked`` has ``ask`` (once for each group that it is looked for in), ``known`` has ``other``; both have the axes, which all lie within ``extent``, and the group. ``size`` is a cell's
    side at the bottom. Ties go to the smaller ``other``; ``rank``, of columns of both (``__`` before known ones), is what is
    compared instead of the squared distance, which it must follow. Places with a null on an axis are left out.
    """
    group, axes = list(group), list(axes)
    there = F.lit(True)
    for a in axes:
        there &= F.col(a).isNotNull()
    known, asked = known.where(there), asked.where(there)
    top = 0
    while size * FAN**top < extent:
        top += 1
    # Boxes of all levels in one pass over the known places.
    levels = known.select(*group, *axes, F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"))
    side = F.lit(size) * F.pow(F.lit(float(FAN)), F.col("level"))
    places = [f"__{a}" for a in axes]
    boxes = levels.groupBy("level", *group, *[F.floor(F.col(a) / side).cast("long").alias(p) for a, p in zip(axes, places, strict=True)])
    boxes = settled(boxes.agg(*[f(a).alias(f"{n}_{a}") for a in axes for f, n in ((F.min, "low"), (F.max, "high"))]))
    own = Window.partitionBy("ask")

    def sorted_out(met: DataFrame) -> DataFrame:
        square = lambda c: c * c
        near = sum((square(F.greatest(F.lit(0.0), F.col(f"low_{a}") - F.col(a), F.col(a) - F.col(f"high_{a}"))) for a in axes), F.lit(0.0))
        far = sum((square(F.greatest(F.abs(F.col(a) - F.col(f"low_{a}")), F.abs(F.col(a) - F.col(f"high_{a}")))) for a in axes), F.lit(0.0))
        met = met.withColumn("__near", near).withColumn("__best", F.min(far).over(own))
        return met.where(F.col("__near") <= F.col("__best") * SLACK[0] + SLACK[1]).select(*asked.columns, *places)

    at = lambda k: boxes.where(F.col("level") == k).drop("level")
    if group:
        left = sorted_out(asked.join(at(top), group))  # 2**axes cells at most
    else:
        left = sorted_out(asked.withColumn("__all", F.lit(0)).join(at(top).withColumn("__all", F.lit(0)), "__all"))
    for k in range(top - 1, -1, -1):
        parents = [F.floor(F.col(p) / FAN).cast("long").alias(f"up{p}") for p in places]
        children = at(k).select("*", *parents)
        left = left.withColumnsRenamed({p: f"up{p}" for p in places}).join(children, [*group, *[f"up{p}" for p in places]])
        left = sorted_out(left)
    cells = known.select("other", *group, *[F.col(a).alias(f"__at_{a}") for a in axes], *[_index(F.col(a), size).alias(p) for a, p in zip(axes, places, strict=True)], *[F.col(c).alias(f"__{c}") for c in known.columns if c not in ("other", *group, *axes)])
    met = left.join(cells, [*group, *places])
    d2 = sum(((F.col(a) - F.col(f"__at_{a}")) * (F.col(a) - F.col(f"__at_{a}")) for a in axes), F.lit(0.0))
    best = F.min(F.struct((d2 if rank is None else rank).alias("r"), F.col("other"), d2.alias("d2"))).alias("b")
    return met.groupBy("ask").agg(best).select("ask", "b.other", "b.d2")


def nearest_on_earth(asked: DataFrame, known: DataFrame, group: Sequence[str] = (), size: float = 0.01) -> DataFrame:
    """``ask``, the nearest ``other`` by great circle and its ``km``; places have ``lat`` and ``lon`` in degrees, any longitude will do.

    Places are looked for on the unit sphere, where straight distances order as great circles do, so neither poles nor the
    date line matter. Ties within a millionth of a kilometre go to the smaller ``other``.
    """
    turn = lambda df: df.withColumns({"__x": F.cos(F.radians("lat")) * F.cos(F.radians("lon")), "__y": F.cos(F.radians("lat")) * F.sin(F.radians("lon")), "__z": F.sin(F.radians("lat"))})
    rank = F.floor(S.haversine_km(F.col("lon"), F.col("lat"), F.col("__lon"), F.col("__lat")) * 1e6)
    out = nearest(turn(asked).select("ask", *group, "lat", "lon", "__x", "__y", "__z"), turn(known).select("other", *group, "lat", "lon", "__x", "__y", "__z"), ["__x", "__y", "__z"], size, 2.0, group, rank)
    return out.select("ask", "other", (2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt("d2") / 2))).alias("km"))


def nearest_filled(wanted: DataFrame, cells: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """``wanted`` cells (``i``, ``j``) with ``value`` of the same cell, else of the nearest one that has it, and ``filled``: whether that was so.

    Distances are those of cells; ties go to the smaller (i, j). There is no reach: only where a group has no value at all is it null.
    """
    group = list(group)
    full = cells.where(F.col(value).isNotNull()).groupBy(*group, "i", "j").agg(F.max(value).alias(value))
    rows = settled(wanted.select(*group, "i", "j").distinct().join(full, [*group, "i", "j"], "left"))
    place = [F.col(c).cast("double").alias(a) for c, a in (("i", "x"), ("j", "y"))]
    empty = rows.where(F.col(value).isNull()).select(F.struct(*group, "i", "j").alias("ask"), *group, *place)
    found = nearest(empty, full.select(F.struct("i", "j", value).alias("other"), *group, *place), ["x", "y"], 4.0, 2.0**32, group)
    found = found.select(*[F.col(f"ask.{g}").alias(g) for g in group], "ask.i", "ask.j", F.col(f"other.{value}").alias("__v"))
    out = rows.join(found, [*group, "i", "j"], "left")
    return out.select(*group, "i", "j", F.coalesce(value, "__v").alias(value), F.col(value).isNull().alias("filled"))
