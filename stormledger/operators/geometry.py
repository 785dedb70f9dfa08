"""Geometries as arrays of coordinates: clipping to a box, simplification, inner points of polygons.

Lines are ``paths`` (arrays of arrays of (x, y)), areas ``polygons`` (arrays of rings, the outer one first). Spark hands them over in
Arrow batches; each batch is worked on in pieces of a bounded number of vertices, as numpy arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Vertices that are worked on at once; a longer geometry is worked on alone.
PIECE = 500_000
POINT = "struct<x:double,y:double>"
#: A grid's place this close to an edge (in cells) is on it.
ON = 1e-9


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _points(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The points of a column of arrays of (x, y), end to end, and where each array begins (with the end of the last)."""
    flat = lists.flatten()
    xy = np.column_stack([pc.struct_field(flat, [k]).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)])
    return xy, np.append(0, np.cumsum(_sizes(lists)))


def _packed(xy: np.ndarray, *sizes: np.ndarray | list[int]) -> pa.Array:
    """Points that lie end to end as a column of nested arrays; ``sizes`` of the innermost ones first."""
    out = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    for n in sizes:
        out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), out)
    return out


def _nested(points: list[np.ndarray], groups: list[int], depth: list[int] | None = None) -> pa.Array:
    """Arrays of points as a column: ``groups`` says how many arrays a value has (``depth``: how many of those values a row has)."""
    xy = np.concatenate(points) if points else np.zeros((0, 2))
    return _packed(xy, [len(p) for p in points], groups, *([] if depth is None else [depth]))


def _pieces(batches: Iterator[pa.RecordBatch], column: str, levels: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most PIECE vertices, or one row."""
    for batch in batches:
        sizes, lists = [], batch.column(column)
        for _ in range(levels):
            sizes.append(_sizes(lists))
            lists = lists.flatten()
        n = sizes.pop()
        while sizes:
            n = np.diff(np.append(0, np.cumsum(n))[np.append(0, np.cumsum(sizes.pop()))])
        ends, at = np.cumsum(n), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            yield batch.slice(at, to - at)
            at = to


def _replaced(df: DataFrame, column: str, levels: int, work) -> DataFrame:
    """``df`` with ``column`` computed anew by ``work`` from pieces of it; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, column, levels):
            yield batch.set_column(batch.schema.get_field_index(column), column, work(batch.column(column)))

    return df.mapInArrow(run, df.schema)


# Clipping


def inside_part(a: np.ndarray, b: np.ndarray, box: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Where segments from ``a`` to ``b`` enter and leave a closed box (x_min, y_min, x_max, y_max), as shares of their length; enter > leave: never inside."""
    enter, leave = np.zeros(len(a)), np.ones(len(a))
    for axis in (0, 1):
        step = b[:, axis] - a[:, axis]
        for sign, bound in ((-1, box[axis]), (1, box[axis + 2])):
            p, q = sign * step, sign * (bound - a[:, axis])
            with np.errstate(divide="ignore", invalid="ignore"):
                t = q / p
            enter = np.where(p < 0, np.fmax(enter, t), enter)
            leave = np.where(p > 0, np.fmin(leave, t), leave)
            leave = np.where((p == 0) & (q < 0), -1.0, leave)
    return enter, leave


def clipped_paths(xy: np.ndarray, starts: np.ndarray, box: Sequence[float]) -> tuple[list[np.ndarray], np.ndarray]:
    """The parts inside the box of paths that lie end to end, in order, and how many each path has. Mere touches are no part."""
    n_paths = len(starts) - 1
    path = np.repeat(np.arange(n_paths), np.diff(starts))
    own = np.flatnonzero(path[1:] == path[:-1]) if len(path) > 1 else np.zeros(0, np.int64)
    a, b = xy[own], xy[own + 1]
    enter, leave = inside_part(a, b, box)
    still = (a == b).all(axis=1)
    kept = np.flatnonzero((enter < leave) & ~still)
    if not len(kept):
        return [], np.zeros(n_paths, np.int64)
    own, a, b, enter, leave = own[kept], a[kept], b[kept], enter[kept][:, None], leave[kept][:, None]
    from_, to = np.where(enter > 0, a + enter * (b - a), a), np.where(leave < 1, a + leave * (b - a), b)
    skipped = np.cumsum(np.append(0, still))  # segments without length don't part a line
    gap = own[1:] - own[:-1] - 1
    between = skipped[kept[1:]] - skipped[kept[:-1] + 1]
    joined = (path[own[1:]] == path[own[:-1]]) & (gap == between) & (leave[:-1, 0] >= 1) & (enter[1:, 0] <= 0)
    first = np.flatnonzero(np.append(True, ~joined))
    parts = [np.vstack([from_[i : i + 1], to[i:j]]) for i, j in zip(first, np.append(first[1:], len(own)), strict=True)]
    return parts, np.bincount(path[own[first]], minlength=n_paths)


def clip_lines(lines: DataFrame, box: Sequence[float], column: str = "paths") -> DataFrame:
    """Lines cut to a closed box: a line that leaves and comes back has several parts. What has no part left goes, null and empty lines too."""

    def work(lists: pa.Array) -> pa.Array:
        xy, starts = _points(lists.flatten())
        parts, n = clipped_paths(xy, starts, box)
        of = np.append(0, np.cumsum(_sizes(lists)))
        return _nested(parts, np.diff(np.append(0, np.cumsum(n))[of]).tolist())

    return _replaced(lines, column, 2, work).where(f"size(`{column}`) > 0")


def clipped_rings(xy: np.ndarray, starts: np.ndarray, box: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """The parts inside a box of rings that lie end to end, and how many vertices each has, by cutting all of them at each side in turn.

    A concave ring's parts stay joined along the box. Rings come closed; those without area have no vertex.
    """
    n_rings, sizes = len(starts) - 1, np.diff(starts)
    ring = np.repeat(np.arange(n_rings), sizes)
    long = np.flatnonzero(sizes > 1)
    ends = starts[long + 1] - 1
    open_ = np.ones(len(xy), bool)
    open_[ends[(xy[starts[long]] == xy[ends]).all(axis=1)]] = False
    xy, ring = xy[open_], ring[open_]

    def kept(xy: np.ndarray, ring: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vertices of the rings that ``which`` names, their rings, and where each ring's first and last ones are."""
        xy, ring = xy[which[ring]], ring[which[ring]]
        first = np.flatnonzero(np.append(True, ring[1:] != ring[:-1])) if len(ring) else np.zeros(0, np.int64)
        return xy, ring, first, np.append(first[1:], len(ring))[: len(first)] - 1

    areal = lambda: np.bincount(ring, minlength=n_rings) >= 3
    for axis, sign, bound in ((0, 1, box[0]), (1, 1, box[1]), (0, -1, box[2]), (1, -1, box[3])):
        xy, ring, first, last = kept(xy, ring, areal())
        after = np.roll(xy, -1, axis=0)
        after[last] = xy[first]
        d, e = sign * (xy[:, axis] - bound), sign * (after[:, axis] - bound)
        inside, crosses = d >= 0, (d >= 0) != (e >= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = xy + (d / (d - e))[:, None] * (after - xy)
        cut[:, axis] = bound
        stays = np.stack([inside, crosses], axis=1).ravel()
        xy, ring = np.stack([xy, cut], axis=1).reshape(-1, 2)[stays], np.repeat(ring, 2)[stays]
    xy, ring, first, last = kept(xy, ring, areal())
    full = np.zeros(n_rings, bool)
    if len(first):
        own = xy - np.repeat(xy[first], last - first + 1, axis=0)
        after = np.roll(own, -1, axis=0)
        after[last] = own[first]
        size = np.abs(np.add.reduceat(own[:, 0] * after[:, 1] - after[:, 0] * own[:, 1], first))
        full[ring[first]] = size > 0
        for i in np.flatnonzero(~(size > 1e-9 * np.maximum.reduceat((own * own).sum(axis=1), first))):  # next to nothing: as a ring alone is judged
            full[ring[first[i]]] = area(xy[first[i] : last[i] + 1]) != 0
    xy, ring, first, last = kept(xy, ring, full)
    return np.insert(xy, last + 1, xy[first], axis=0), np.bincount(ring, minlength=n_rings) + full


def clip_polygons(areas: DataFrame, box: Sequence[float], column: str = "polygons") -> DataFrame:
    """Polygons cut to a closed box, holes too. Polygons without area left go, then rows without polygons. A piece's rings are cut together."""

    def work(lists: pa.Array) -> pa.Array:
        xy, starts = _points(lists.flatten().flatten())
        xy, sizes = clipped_rings(xy, starts, box)
        rings, polygons = _sizes(lists.flatten()), _sizes(lists)
        outer = np.append(0, np.cumsum(rings))[:-1]
        stays = np.zeros(len(rings), bool)
        stays[rings > 0] = sizes[outer[rings > 0]] > 0  # by its outer ring
        mine = np.repeat(np.arange(len(rings)), rings)
        there = (sizes > 0) & stays[mine]
        n_rings = np.bincount(mine[there], minlength=len(rings))[stays]
        n_polygons = np.bincount(np.repeat(np.arange(len(polygons)), polygons)[stays], minlength=len(polygons))
        return _packed(xy[np.repeat(there, sizes)], sizes[there], n_rings, n_polygons)

    return _replaced(areas, column, 3, work).where(f"size(`{column}`) > 0")


# Simplification


def simplified(path: np.ndarray, tolerance: float) -> np.ndarray:
    """The vertices to keep: first, last, and wherever a stretch strays more than ``tolerance`` from its chord its farthest vertex."""
    keep = np.zeros(len(path), bool)
    keep[[0, -1]] = True
    stack = [(0, len(path) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, chord, own = path[i], path[j] - path[i], path[i + 1 : j] - path[i]
        square = float(chord @ chord)
        t = np.clip(own @ chord / square, 0.0, 1.0) if square > 0 else np.zeros(len(own))
        d = np.hypot(*(own - t[:, None] * chord).T)
        k = int(np.argmax(d))
        if d[k] > tolerance:
            k += i + 1
            keep[k] = True
            stack += [(i, k), (k, j)]
    return keep


def simplify_lines(lines: DataFrame, tolerance: float, column: str = "paths") -> DataFrame:
    """Lines with no vertex dropped that lies farther than ``tolerance`` from what is kept. First and last vertices stay; null and empty lines too (as empty ones).

    Without a tolerance (0 or less) lines stay as they are.
    """
    if tolerance <= 0:
        return lines

    def work(lists: pa.Array) -> pa.Array:
        xy, starts = _points(lists.flatten())
        paths = [xy[i:j] for i, j in zip(starts[:-1], starts[1:], strict=True)]
        return _nested([p[simplified(p, tolerance)] if len(p) else p for p in paths], _sizes(lists).tolist())

    return _replaced(lines, column, 2, work)


# Inner points


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def polygon_area(rings: list[np.ndarray]) -> float:
    return max(0.0, area(rings[0]) - sum(map(area, rings[1:])))


def edges(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])


def crossings(a: np.ndarray, b: np.ndarray, at: float, axis: int) -> np.ndarray:
    """Where edges cross the line on which ``axis`` is ``at``, along it, in order: every two bound a stretch inside."""
    p, q = a[:, axis], b[:, axis]
    hit = (p <= at) != (q <= at)
    a, b, p, q = a[hit], b[hit], p[hit], q[hit]
    return np.sort(a[:, 1 - axis] + (at - p) / (q - p) * (b[:, 1 - axis] - a[:, 1 - axis]))


def interior_point(rings: list[np.ndarray]) -> np.ndarray:
    """A point surely inside: the middle of the widest stretch inside on a line between vertices, near half the height. Without height, the middle of the box."""
    heights = np.unique(np.concatenate(rings)[:, 1])
    low, high = rings[0].min(axis=0), rings[0].max(axis=0)
    middles = (heights[1:] + heights[:-1]) / 2
    for y in middles[np.argsort(np.abs(middles - (low[1] + high[1]) / 2), kind="stable")]:
        x = crossings(*edges(rings), y, 1)
        if len(x) and (width := x[1::2] - x[::2]).max() > 0:
            k = 2 * int(np.argmax(width))
            return np.array([(x[k] + x[k + 1]) / 2, y])
    return (low + high) / 2


def grid_points(rings: list[np.ndarray], spacing: float, most: int, least_cell: float = 1.0) -> np.ndarray:
    """Points of a grid in or on a polygon, column by column from the left, ``most`` at most; else one inner point.

    The cell holds one of as many points as the area asks for. A column's points are read from the stretches inside it, so
    what is held is the points and the polygon, however thin and slanted that is.
    """
    size = polygon_area(rings)
    if size <= 0:
        return interior_point(rings)[None]
    target = max(1, min(most, math.ceil(size / max(1.0, spacing) ** 2)))
    cell = max(least_cell, math.sqrt(size / target))
    (x0, y0), (x1, _) = rings[0].min(axis=0), rings[0].max(axis=0)
    a, b = edges(rings)
    out, k = [], 0
    while (x := x0 + (k + 0.5) * cell) <= x1 and len(out) < most:
        k += 1
        y = crossings(a, b, x, 0)
        on = a[:, 0] == x  # vertices, and edges, that lie in the column
        along = on & (b[:, 0] == x)
        ends = [*zip(y[::2], y[1::2], strict=True), *((v, v) for v in a[on, 1]), *(sorted(e) for e in zip(a[along, 1], b[along, 1], strict=True))]
        rows = sorted({j for low, high in ends for j in range(math.ceil((low - y0) / cell - 0.5 - ON), math.floor((high - y0) / cell - 0.5 + ON) + 1)})
        out += [(x, y0 + (j + 0.5) * cell) for j in rows]
    return np.array(out[:most]) if out else interior_point(rings)[None]


def shared_out(sizes: list[float], most: int) -> list[int]:
    """``most`` in proportion to sizes: one at least for each, the last takes what is left."""
    whole, out, left = sum(sizes), [], most
    for i, s in enumerate(sizes):
        rest = len(sizes) - i - 1
        n = max(1, left) if not rest else min(max(1, round(most * s / whole)), max(1, left - rest))
        out.append(n)
        left -= n
    return out


def sample_polygons(features: DataFrame, spacing: float, most: int = 300) -> DataFrame:
    """Points in polygons (``feature_id``, ``polygons``): ``k``, ``x``, ``y``; the polygons of a feature share ``most`` by area.

    Every point lies in or on its polygon. A single polygon without area gives one point, several give none; polygons without area beside
    others are left out, and so are features without polygons.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "polygons", 3):
            lists = batch.column("polygons")
            xy, starts = _points(lists.flatten().flatten())
            sizes, at, rows = iter(_sizes(lists.flatten()).tolist()), 0, []
            for row, n in enumerate(_sizes(lists).tolist()):
                parts = []
                for _ in range(n):
                    k = next(sizes)
                    rings = [xy[starts[i] : starts[i + 1]] for i in range(at, at + k)]
                    at += k
                    if rings and len(rings[0]):
                        parts.append([r for r in rings if len(r)])
                if len(parts) > 1:
                    parts = [p for p in parts if polygon_area(p) > 0]
                shares = shared_out([polygon_area(p) for p in parts], most) if len(parts) > 1 else [most] * len(parts)
                found = [p for rings, share in zip(parts, shares, strict=True) for p in grid_points(rings, spacing, share).tolist()]
                rows += [(row, k, *p) for k, p in enumerate(found[:most])]
            own, k, x, y = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("feature_id").take(pa.array(own, pa.int64())), pa.array(k, pa.int32()), pa.array(x, pa.float64()), pa.array(y, pa.float64())], ["feature_id", "k", "x", "y"])

    kind = features.schema["feature_id"].dataType.simpleString()
    return features.select("feature_id", "polygons").mapInArrow(run, f"feature_id {kind}, k int, x double, y double")
